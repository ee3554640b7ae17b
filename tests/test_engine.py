import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction as E
from tessera.operators import resolution as R
from tessera.operators import signals as S
from tessera.plans.config import AppConfig, Extraction, Graph, KnownEntity, Project, Resolver, Scoring, Signals, Source, expand_env, load_config
from tessera.plans.pipeline import DOCUMENT, Engine
from tessera.functions.text import text_hash

KNOWN = [KnownEntity("Petróleos Mexicanos", "company", ["Pemex", "PEMEX"]), KnownEntity("PAN", "organization", ["Partido Acción Nacional"]), KnownEntity("Hamás", "organization", []), KnownEntity("CNTE", "organization", [])]


def catalogue(spark, known=KNOWN):
    return spark.createDataFrame([(k, e.name, e.entity_type, j, a) for k, e in enumerate(known) for j, a in enumerate([e.name, *e.aliases])], "pos int, name string, entity_type string, alias_pos int, alias string")


def texts(spark, *rows):
    return spark.createDataFrame([(f"doc_{k}", t) for k, t in enumerate(rows)], "id string, text string").withColumn("text_hash", text_hash("text"))


def test_development_extractor(spark):
    docs = texts(spark, "Pemex dialogó con el PAN.", "Hamas y Pemex hablaron.", "nada", "Petróleos Mexicanos o PEMEX.")
    found = {(r["id"], r["name"]): (r["pos"], round(r["confidence"], 2)) for r in E.extract_entities(docs, catalogue(spark)).collect()}
    assert found[("doc_0", "Petróleos Mexicanos")] == (0, 0.78) and found[("doc_0", "PAN")] == (1, 0.85)
    assert ("doc_1", "Hamás") not in found  # its quote isn't verbatim, though the name matches without accents
    assert found[("doc_3", "Petróleos Mexicanos")] == (0, 0.78)  # the last alias that matches decides
    pairs = {r["id"]: (r["subject"], r["object"], r["confidence"]) for r in E.co_mentions(docs, catalogue(spark)).collect()}
    assert pairs == {"doc_0": ("Petróleos Mexicanos", "PAN", 0.55), "doc_1": ("Petróleos Mexicanos", "Hamás", 0.55)}


def test_bounds_of_co_mentions(spark):
    known = [KnownEntity(f"Name{k}", "person", []) for k in range(10)]
    every = " ".join(e.name for e in known)
    docs = texts(spark, f"{every}.", " ".join(f"{every} number {k}." for k in range(9)), "x" * 15000 + f" {every}.", f"{every}. {every}.")
    rows = E.co_mentions(docs, catalogue(spark, known)).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in rows} == {"doc_0": 28, "doc_1": 80, "doc_3": 28}


RELATION = "struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,quote:string,confidence:double,assertion_type:string>"
ENTITY = "struct<name:string,entity_type:string,quote:string,confidence:double>"


def test_grounding(spark):
    docs = texts(spark, "La educación pública avanza. El PAN y Pemex firmaron. Comió pan con Pemex.")
    rel = lambda s, p, o, q: (s, "organization", p, o, "company", q, 0.9, "evidence")
    given = spark.createDataFrame(
        [("doc_0", [("PAN", "organization", "El PAN y Pemex", 0.9), ("Petróleos Mexicanos", "company", "Pemex firmaron", 0.9), ("CNTE", "organization", "educación pública", 0.9), ("PAN", "organization", "no está", 0.9)],
          [rel("PAN", "SOBORNO", "Petróleos Mexicanos", "El PAN y Pemex firmaron."), rel("PAN", "CO_MENTIONED_WITH", "Petróleos Mexicanos", "el pan  y pemex"), rel("PAN", "X", "Petróleos Mexicanos", "Comió pan con Pemex."), rel("PAN", "co_mentioned_with", "Pemex", "El PAN y Pemex firmaron.")], [], "forged")],
        f"document_id string, entities array<{ENTITY}>, relations array<{RELATION}>, warnings array<string>, text_hash string",
    )
    r = E.ground(given, docs, AppConfig(known_entities=KNOWN), "p", "m", "v1:x").first()
    assert (r["provider"], r["model"], r["cache_policy_fingerprint"]) == ("p", "m", "v1:x") and r["text_hash"] == docs.first()["text_hash"]
    assert [e["name"] for e in r["entities"]] == ["PAN", "Petróleos Mexicanos"]
    assert [(x["predicate"], x["assertion_type"]) for x in r["relations"]] == [("SOBORNO", "inference"), ("co_mentioned_with", "inference")]
    assert r["warnings"][0] == "dropped_items_without_verbatim_quote=1" and len(r["warnings"]) == 4


def test_cache_identity():
    c = AppConfig(known_entities=KNOWN)
    a = E.cache_identity(c)
    assert a[:2] == ("dev", E.MODEL) and a != E.cache_identity(AppConfig(known_entities=KNOWN[:2]))
    c.llm.provider = "auto"
    assert E.cache_identity(c, {}) == a and E.cache_identity(c, {E.HOSTED_KEY: "k"})[0] == E.HOSTED
    # the order of names and aliases and the similarity threshold don't count
    turned = AppConfig(known_entities=[KnownEntity(e.name, e.entity_type, e.aliases[::-1]) for e in KNOWN[::-1]], resolver=Resolver(similarity_threshold=0.5))
    assert E.cache_identity(turned, {}) == a
    assert E.cache_identity(AppConfig(known_entities=KNOWN, resolver=Resolver(aliases={"x": ["y"]})), {}) != a
    for bad in (lambda: Extraction(provider="other"), lambda: KnownEntity("x", "robot"), lambda: Graph(backend="other")):
        with pytest.raises(ValueError):
            bad()
    for bad in ("", "legacy"):
        with pytest.raises(ValueError):
            E.check_policy(bad)


def test_fuzzy_resolution(spark):
    config = AppConfig(known_entities=[KnownEntity("Claudia Sheinbaum Pardo", "person", ["Claudia Sheinbaum"])], resolver=Resolver({"Claudia Sheinbaum Pardo": ["La Doctora"]}))
    place = lambda k: F.struct(*(F.lit(k if j == 1 else 0).cast("long").alias(f"o{j}") for j in range(5)))
    given = ["Presidenta Claudia Sheinbaum", "Claudia Sheinbaun Pardo", "Juan Pérez Gómez", "Juan Peres Gómez", "Pemex", "Pemes", "La doctora"]
    names = None
    for k, n in enumerate(given):
        row = spark.range(1).select(F.lit(n).alias("name"), F.lit("person").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit(f"d{k}").alias("id"), place(k).alias("ord"))
        names = row if names is None else names.unionByName(row)
    names, seeds = R.distinct_names(names), R.seed_aliases(spark, config)
    got = {r["norm"]: (r["canonical_name"], r["resolution"]) for r in R.resolve_names(names, seeds).collect()}
    assert got["claudia sheinbaum"] == ("Claudia Sheinbaum Pardo", "exact") and got["claudia sheinbaun pardo"] == ("Claudia Sheinbaum Pardo", "fuzzy") and got["la doctora"][0] == "Claudia Sheinbaum Pardo"
    assert got["juan peres gomez"] == ("Juan Pérez Gómez", "fuzzy") and got["juan perez gomez"] == ("Juan Pérez Gómez", "new_entity")
    assert got["pemes"] == ("Pemes", "new_entity")  # one word is never matched loosely
    entities = R.canonical_entities(names, R.resolve_names(names, seeds), seeds).collect()
    assert {e["canonical_name"]: e["resolution_reason"] for e in entities}["Claudia Sheinbaum Pardo"] == "configured_known_entity"


def test_attention(spark):
    rows = spark.createDataFrame([(1.0, 1), (0.25, 6), (0.0, 1), (None, None), (0.5, -3)], "attention_weight double, feed_rank int").select(S.attention().alias("a")).collect()
    assert [round(r["a"], 6) for r in rows] == [1.0, 0.125, 0.7, 0.7, 0.5]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_AGENT", "")
    assert expand_env({"a": ["${SOME_AGENT:-fallback}", "x${NONE}y"]}) == {"a": ["fallback", "xy"]}
    path = tmp_path / "c.yaml"
    path.write_text("project:\n  request_delay_seconds: 0.1\nsources:\n  - {name: a, kind: rss_feed, limit: 2}\nknown_entities:\n  - {name: Pemex, entity_type: company}\n")
    c = load_config(str(path))
    assert c.sources[0].limit == 2 and c.project.request_delay_seconds == 1.0 and c.known_entities[0].aliases == [] and c.scoring == Scoring()
    with pytest.raises(ValueError):
        Source("a", "k", attention_weight=2)
    path.write_text("graph: {backend: neo4j}\n")
    with pytest.raises(ValueError):
        load_config(str(path))


@pytest.fixture
def engine(spark, tmp_path):
    config = AppConfig(project=Project(database_path=str(tmp_path / "state"), output_dir=str(tmp_path / "out")), known_entities=[KnownEntity("Pemex", "company", []), KnownEntity("CNTE", "organization", [])])
    config.scoring.null_model_samples = 4
    config.signals = Signals(low_attention_threshold=0.3, structural_novelty_threshold=0.2, small_note_min_score=0.35)
    config.sources = [Source("gov", "gob_presidency", side="official_government", attention_weight=1.0), Source("col", "rss_feed", side="independent_opinion", attention_weight=0.25)]
    return Engine(spark, config)


def document(ident, source, side, day, rank, weight, text, url=None):
    return {"id": ident, "source_name": source, "source_kind": "k", "source_side": side, "url": url or f"https://n.test/{ident}", "title": ident, "text": text, "published_at": datetime(2026, 6, day), "fetched_at": datetime(2026, 6, day), "metadata": rank | {"source_attention_weight": weight}}


def documents(spark, *rows):
    names = [x.split()[0] for x in DOCUMENT.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], DOCUMENT)
    return df.withColumn("text_hash", text_hash("text"))


OFFICIAL = document("doc_official", "gov", "official_government", 9, {"archive_rank": "1"}, "1.0", "It is false that Pemex concealed information. The president discussed energy.")
SMALL = document("doc_small", "col", "independent_opinion", 8, {"feed_rank": "6"}, "0.25", "A secondary item mentions Pemex and CNTE in connection with demonstrations.")


def test_run_end_to_end(spark, engine):
    stats = engine.run(documents(spark, OFFICIAL, SMALL))
    assert (stats["documents_collected"], stats["documents_extracted"], stats["edge_writes"], stats["evidence_writes"]) == (2, 2, 1, 1)
    notes, readings = engine.signals()
    note = notes.first()
    assert note["document_id"] == "doc_small" and note["attention_score"] == pytest.approx(0.125) and note["structural_novelty_score"] == pytest.approx(0.45) and note["score"] == pytest.approx(0.64125)
    by = {r["entity_name"]: (r["status"], round(r["score"], 6)) for r in readings.collect()}
    assert by == {"Pemex": ("official_denial_or_correction", 0.37), "CNTE": ("possible_silence", 0.22)}
    out = engine.config.project.output_dir
    assert {json.load(open(f"{out}/{n}.json"))[0]["entity_name"] for n in ("bridge_candidates",)} <= {"Pemex", "CNTE"}
    assert json.load(open(f"{out}/signals.json"))[0]["morning_readings"]
    # again: nothing new, nothing lost
    assert engine.extract() == 0
    again = engine.map_graph()
    assert again["evidence_writes"] == 0 and engine.store.read("evidence").count() == 1
    # a changed text loses its extraction and its evidence
    engine.ingest(documents(spark, SMALL | {"text": "Now it mentions nobody at all."}))
    assert engine.map_graph()["edge_writes"] == 0 and engine.store.read("evidence").count() == 0 and engine.store.read("entities").count() == 2
    with pytest.raises(ValueError):
        engine.ingest(documents(spark, SMALL | {"id": "other"}))


def test_external_provider_is_grounded(spark, engine):
    engine.ingest(documents(spark, SMALL))
    engine.config.llm.provider, engine.config.llm.model = E.HOSTED, "m"
    entities = "array<struct<name:string,entity_type:string,quote:string,confidence:double>>"
    given = lambda docs: docs.select(F.col("id").alias("document_id"), F.array(F.struct(F.lit("Pemex").alias("name"), F.lit("company").alias("entity_type"), F.lit("mentions Pemex").alias("quote"), F.lit(0.9).alias("confidence")), F.struct(F.lit("Ghost").alias("name"), F.lit("person").alias("entity_type"), F.lit("mentions").alias("quote"), F.lit(0.9).alias("confidence"))).cast(entities).alias("entities"), F.array().cast(f"array<{RELATION}>").alias("relations"), F.array().cast("array<string>").alias("warnings"))
    assert engine.extract(given) == 1
    assert [e["name"] for e in engine._valid().first()["entities"]] == ["Pemex"]


def test_stream_is_idempotent(spark, engine, tmp_path):
    from tessera.streaming.ingest import start

    folder = tmp_path / "landed"
    documents(spark, OFFICIAL, SMALL).write.json(str(folder))
    start(engine, str(folder), str(tmp_path / "cp"), map_each=True).awaitTermination()
    assert engine.documents().count() == 2 and engine.store.read("evidence").count() == 1
    documents(spark, SMALL).write.mode("append").json(str(folder))
    start(engine, str(folder), str(tmp_path / "cp")).awaitTermination()
    assert engine.documents().count() == 2


def test_cli_template(tmp_path, capsys):
    from tessera.cli import main

    path = str(tmp_path / "config.yaml")
    assert main(["init", "--to", path]) == 0 and main(["init", "--to", path]) == 1 and main(["init", "--to", path, "--overwrite"]) == 0
    assert load_config(path).llm.provider == "dev"


def test_empty_engine(spark, engine):
    stats = engine.run()
    assert stats["bridges"] == 2 or stats["bridges"] == 0
    assert engine.signals()[0].count() == 0
