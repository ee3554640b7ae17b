"""Entity resolution: exact by normalised name and type, then fuzzy, and resolved relations."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_name, stable_hash
from tessera.plans.config import AppConfig


def seed_aliases(spark: SparkSession, config: AppConfig) -> DataFrame:
    """(norm, entity_type, canonical_name, alias, seq) of the configured entities, in order; extra alias groups
    go to the first entity of that name, whatever its type."""
    rows, n = [], 0
    for e in config.known_entities:
        for a in [e.name, *e.aliases]:
            rows.append((a, e.entity_type, e.name, n, True))
            n += 1
    names = {}
    for e in config.known_entities:
        for a in [e.name, *e.aliases]:
            names.setdefault(a, (e.entity_type, e.name))
    for name, aliases in config.resolver.aliases.items():
        if name in names:
            for a in aliases:
                rows.append((a, *names[name], n, True))
                n += 1
    seeds = spark.createDataFrame(rows, "alias string, entity_type string, canonical_name string, seq long, seed boolean")
    return seeds.withColumn("norm", normalize_name("alias"))


def mentioned(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, entity_type, confidence, document_id, ord): every name of entities, then of relation ends, in order.
    entities: id, pos, name, entity_type, confidence; relations: id, sentence_no, i, j, subject, ..., confidence."""
    place = lambda *c: F.struct(*(F.col(x).cast("long").alias(f"o{k}") for k, x in enumerate(c)))
    zero = F.lit(0).cast("long")
    a = entities.select("name", "entity_type", "confidence", "id", F.struct(zero.alias("o0"), F.col("pos").cast("long").alias("o1"), zero.alias("o2"), zero.alias("o3"), zero.alias("o4")).alias("ord"))
    end = lambda name, kind, k: relations.select(F.col(name).alias("name"), F.col(kind).alias("entity_type"), "confidence", "id", F.struct(F.lit(1).cast("long").alias("o0"), F.col("sentence_no").cast("long").alias("o1"), F.col("i").cast("long").alias("o2"), F.col("j").cast("long").alias("o3"), F.lit(k).cast("long").alias("o4")).alias("ord"))
    return a.unionByName(end("subject", "subject_type", 0)).unionByName(end("object", "object_type", 1))


def distinct_names(names: DataFrame) -> DataFrame:
    """(norm, entity_type, name, confidence, first): one row for each spelling key, from its first mention by (id, ord)."""
    keyed = names.withColumn("norm", normalize_name("name"))
    return keyed.groupBy("norm", "entity_type").agg(F.min(F.struct("id", "ord", "name", "confidence")).alias("m")).select("norm", "entity_type", F.col("m.name").alias("name"), F.col("m.confidence").alias("confidence"), F.struct("m.id", "m.ord").alias("first"))


def similarity(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio; the order of the arguments matters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _greedy(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Names of one block in order: each joins the most similar earlier alias at or above the threshold, else stands for itself."""
    rows = rows.sort_values(["seed", "seq", "norm"], ascending=[False, True, True])
    known: list[tuple[str, str]] = []  # alias, canonical
    exact: dict[str, str] = {}
    out = []
    for r in rows.itertuples():
        if r.norm in exact:
            out.append((r.norm, exact[r.norm], "exact"))
            continue
        if r.seed:
            canonical, how = r.canonical, "configured_known_entity"
        else:
            best = None
            if len(r.norm.split()) >= 2:
                for alias, canonical in known:
                    if 2 * min(len(r.norm), len(alias)) >= threshold * (len(r.norm) + len(alias)):
                        m = difflib.SequenceMatcher(None, r.norm, alias)
                        if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and (s := m.ratio()) >= threshold and (best is None or s > best[0]):
                            best = (s, canonical)
            canonical, how = (best[1], "fuzzy") if best else (r.name, "new_entity")
        exact[r.norm] = canonical
        if len(r.norm.split()) >= 2:
            known.append((r.norm, canonical))
        out.append((r.norm, canonical, how))
    return pd.DataFrame(out, columns=["norm", "canonical_name", "resolution"])


def resolve_names(names: DataFrame, seeds: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(norm, entity_type, canonical_name, resolution) for distinct names (norm, entity_type, name, first) and seeds.

    Exact matches and one-word names need no comparison and are resolved by a join. The greedy pass
    depends on order, so it runs by entity type over the distinct names of two words or more that no
    seed holds: seeds first, in order, then names by first mention.
    """
    known = seeds.groupBy("norm", "entity_type").agg(F.max_by("canonical_name", "seq").alias("canonical_name"))
    exact = names.join(F.broadcast(known), ["norm", "entity_type"], "left")  # seeds: the configuration's size
    held = exact.where("canonical_name is not null").select("norm", "entity_type", "canonical_name", F.lit("exact").alias("resolution"))
    rest = exact.where("canonical_name is null").select("norm", "entity_type", "name", "first")
    short = rest.where(F.size(F.split("norm", " ")) < 2).select("norm", "entity_type", F.col("name").alias("canonical_name"), F.lit("new_entity").alias("resolution"))
    from pyspark.sql import Window as W

    long = rest.where(F.size(F.split("norm", " ")) >= 2).withColumn("seq", F.row_number().over(W.partitionBy("entity_type").orderBy("first", "norm")).cast("long"))
    both = long.select("norm", "entity_type", "name", F.lit(None).cast("string").alias("canonical"), "seq", F.lit(False).alias("seed")).unionByName(
        seeds.select("norm", "entity_type", F.col("alias").alias("name"), F.col("canonical_name").alias("canonical"), "seq", F.lit(True).alias("seed"))
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = _greedy(rows, threshold)
        out = out[out["norm"].isin(rows.loc[~rows["seed"], "norm"])]
        return out.assign(entity_type=key[0])[["norm", "entity_type", "canonical_name", "resolution"]]

    fuzzy = both.groupBy("entity_type").applyInPandas(run, "norm string, entity_type string, canonical_name string, resolution string")
    return held.unionByName(short).unionByName(fuzzy)


def entity_id(kind, name):
    """Identity of a canonical entity."""
    return F.concat(F.lit("ent_"), stable_hash(kind, normalize_name(name), length=24))


def canonical_entities(names: DataFrame, resolved: DataFrame, seeds: DataFrame) -> DataFrame:
    """All canonical entities: the configured ones, mentioned or not, and those that mentions founded."""
    spelled = names.join(resolved, ["norm", "entity_type"]).select("entity_type", "canonical_name", F.col("name").alias("alias"), "confidence", "resolution")
    both = spelled.unionByName(seeds.select("entity_type", "canonical_name", "alias", F.lit(1.0).alias("confidence"), F.lit("configured_known_entity").alias("resolution")))
    both = both.withColumn("canonical_id", entity_id("entity_type", "canonical_name"))
    seeded = F.max((F.col("resolution") == "configured_known_entity").cast("int")) == 1
    return both.groupBy("canonical_id", "canonical_name", "entity_type").agg(
        F.array_sort(F.collect_set("alias")).alias("aliases"), F.when(seeded, "configured_known_entity").otherwise("new_entity").alias("resolution_reason"),
        F.when(seeded, 1.0).otherwise(F.max(F.when(F.col("resolution") == "new_entity", F.col("confidence")))).alias("confidence"),
    )


def resolve_relations(relations: DataFrame, resolved: DataFrame, docs: DataFrame, method: str) -> DataFrame:
    """Relations with the identities of ends, edge and evidence and the document's provenance; relations of
    unknown documents are left out. relations: id, subject, subject_type, ..., docs: id, source_name, ..."""
    ends = resolved.select("norm", "entity_type", "canonical_name")
    side = lambda end: ends.select(F.col("norm").alias(f"{end}_norm"), F.col("entity_type").alias(f"{end}_type"), F.col("canonical_name").alias(f"{end}_name"))
    rows = relations.withColumns({"subject_norm": normalize_name("subject"), "object_norm": normalize_name("object")})
    rows = rows.join(side("subject"), ["subject_norm", "subject_type"]).join(side("object"), ["object_norm", "object_type"])
    rows = rows.withColumns({"subject_id": entity_id("subject_type", "subject_name"), "object_id": entity_id("object_type", "object_name")})
    rows = rows.withColumn("edge_id", F.concat(F.lit("edge_"), stable_hash("subject_id", "predicate", "object_id", "assertion_type", length=28)))
    rows = rows.withColumn("evidence_id", F.concat(F.lit("ev_"), stable_hash("edge_id", "id", "quote", length=28)))
    return rows.join(docs.select("id", "source_name", "source_side", "url", "title", "published_at"), "id").select(
        "edge_id", "subject_id", "subject_name", "subject_type", "predicate", "object_id", "object_name", "object_type", "assertion_type", "confidence", "evidence_id",
        F.col("id").alias("document_id"), "quote", "source_name", "source_side", "url", "title", "published_at", F.lit(method).alias("extraction_method"),
    )
