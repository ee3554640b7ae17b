import collections
import itertools
import json
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import centrality as C
from tessera.operators import graph_store as G
from tessera.operators import property_store as P
from tessera.operators import scoring as S
from tessera.plans.config import Scoring

RELATION = "edge_id STRING, subject_id STRING, predicate STRING, object_id STRING, assertion_type STRING, confidence DOUBLE, evidence_id STRING, document_id STRING, quote STRING, source_name STRING, source_side STRING, url STRING, title STRING, published_at TIMESTAMP, extraction_method STRING"


def relation(edge="edge_ab", ev="ev_ab", doc="doc_1", s="ent_a", o="ent_b", predicate="CO_MENTIONED_WITH", kind="evidence", confidence=0.5, side="side", name="name", at=datetime(2026, 6, 8), quote="q"):
    return (edge, s, predicate, o, kind, confidence, ev, doc, quote, name, side, "u", "t", at, "m")


def frames(spark, *rows):
    return spark.createDataFrame(list(rows), RELATION)


def empty(spark):
    df = frames(spark)
    return df.select(*G.EVIDENCE), df.select(*G.EDGE)


def docs(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "document_id string")


def edges(evidence, ends):
    return {r["edge_id"]: r for r in G.roll_up_edges(evidence, ends).collect()}


def test_idempotent_and_replacing(spark):
    one = frames(spark, relation())
    ev, ends, new = G.upsert_relations(*empty(spark), one)
    assert new.count() == 1
    ev, ends, new = G.upsert_relations(ev, ends, one)
    assert new.count() == 0 and ev.count() == 1 and len(edges(ev, ends)) == 1
    other = frames(spark, relation("edge_ac", "ev_ac", o="ent_c", predicate="WORKED_WITH"))
    ev2, ends2, _ = G.upsert_relations(ev, ends, other, docs(spark, "doc_1"))
    assert [r["evidence_id"] for r in ev2.collect()] == ["ev_ac"] and set(edges(ev2, ends2)) == {"edge_ac"}
    ev3, ends3, _ = G.upsert_relations(ev2, ends2, frames(spark), docs(spark, "doc_1"))
    assert ev3.count() == 0 and not edges(ev3, ends3)
    with pytest.raises(ValueError):
        G.upsert_relations(ev, ends, other, docs(spark, "doc_9"))


def test_shared_edge_and_downgrade(spark):
    ev, ends, _ = G.upsert_relations(*empty(spark), frames(spark, relation(confidence=0.95), relation(ev="ev_2", doc="doc_2", kind="inference", confidence=0.2, side="other")))
    e = edges(ev, ends)["edge_ab"]
    assert (e["assertion_type"], e["confidence"], e["source_sides"]) == ("evidence", 0.95, ["other", "side"])
    ev, ends, _ = G.upsert_relations(ev, ends, frames(spark), docs(spark, "doc_1"))
    e = edges(ev, ends)["edge_ab"]
    assert (e["assertion_type"], e["confidence"]) == ("inference", 0.2)


def test_legacy_rows_are_cautious(spark):
    old = frames(spark, relation(confidence=0.99)).select(*G.EVIDENCE).drop("assertion_type", "confidence")
    e = edges(G.with_legacy_defaults(old), frames(spark, relation()))["edge_ab"]
    assert (e["assertion_type"], e["confidence"]) == ("inference", 0.0)


def test_snapshots_switch_at_once(spark, tmp_path):
    store = G.SnapshotStore(spark, str(tmp_path / "state"))
    assert store.read("t") is None and store.read("t", "x int").count() == 0
    store.commit({"t": spark.range(3), "u": spark.range(1)})
    bad = spark.range(2).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        store.commit({"t": spark.range(9), "u": bad})
    assert store.read("t").count() == 3
    store.commit({"t": store.read("t").union(spark.range(2))})
    assert store.read("t").count() == 5 and store.read("u").count() == 1


def test_two_writers_and_old_snapshots(spark, tmp_path):
    """Of two writers that read one version one succeeds; the other's tables are gone and it can start again."""
    root = str(tmp_path / "state")
    a, b = G.SnapshotStore(spark, root, keep=2), G.SnapshotStore(spark, root, keep=2)
    a.commit({"t": spark.range(1), "kept": spark.range(7)})
    old = b.read("t")
    a.commit({"t": a.read("t").union(spark.range(5, 6))})
    with pytest.raises(G.ConcurrentWrite):
        b.commit({"t": old.union(spark.range(8, 9))})
    assert sorted(r[0] for r in a.read("t").collect()) == [0, 5]
    b.begin()
    b.commit({"t": b.read("t").union(spark.range(8, 9))})
    a.begin()
    assert sorted(r[0] for r in a.read("t").collect()) == [0, 5, 8] and a.read("kept").count() == 7
    for k in range(4):
        a.begin()
        a.commit({"t": spark.range(k)})
    assert len(a.versions()) == 2 and len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("t-")]) == 2


def test_property_graph_is_loaded_by_merging(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import json
        import os
        import uuid

        class Session:
            def run(self, statement, rows):
                with open(os.path.join(folder, uuid.uuid4().hex + ".json"), "w") as f:
                    json.dump([statement, rows], f)

            def close(self):
                pass

        return Session()

    entities = spark.createDataFrame([(f"ent_{k}", k, "person", [k], "x", 1.0) for k in "ab"], "canonical_id string, canonical_name string, entity_type string, aliases array<string>, resolution_reason string, confidence double")
    assert P.load(entities, frames(spark, relation(confidence=0.75)), connect) == (2, 1)
    sent = [json.loads(p.read_text()) for p in tmp_path.glob("*.json")]
    assert sorted(s for s, rows in sent if not rows) == sorted(P.constraints()) and len(P.constraints()) == 4
    nodes = {r["id"]: r["props"] for s, rows in sent for r in rows if "props" in r}
    assert set(nodes) == {"ent_a", "ent_b", "edge_ab", "ev_ab", "doc_1"} and nodes["edge_ab"]["confidence"] == 0.75
    kinds = {k for k in P.KINDS for s, rows in sent if rows and f":{k}" in s}
    assert kinds == set(P.KINDS) and all("MERGE" in s and "DELETE" not in s for s, rows in sent if rows)
    with pytest.raises(ValueError):
        P.load(entities.union(entities), frames(spark, relation()), connect)


def queue_brandes(nodes, pairs):
    ways = collections.defaultdict(set)
    for u, v in pairs:
        if u != v:
            ways[u].add(v)
            ways[v].add(u)
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, before = {s: 0}, collections.Counter({s: 1}), [], collections.defaultdict(list)
        todo = collections.deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for y in ways[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
                    before[y].append(x)
        delta = collections.Counter()
        for y in reversed(order):
            for x in before[y]:
                delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            if y != s:
                out[y] += delta[y]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) if n > 2 else 0.0 for k, v in out.items()}


@pytest.mark.parametrize("joined", [False, True])
def test_betweenness(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(C, "BROADCAST_EDGES", 0)
        monkeypatch.setattr(C, "JOINED_SOURCES", 12)
    rng = random.Random(3)
    nodes = [f"n{k:02d}" for k in range(24)]
    pairs = {tuple(sorted(rng.sample(nodes[:20], 2))) for _ in range(28)} | {("n03", "n03")}
    got = C.betweenness(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(list(pairs), "u string, v string"))
    expected = queue_brandes(nodes, pairs)
    assert {r["node"]: pytest.approx(r["betweenness"], abs=1e-12) for r in got.collect()} == expected


def test_path_and_small_graphs(spark):
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    pairs = lambda *p: spark.createDataFrame(list(p), "u string, v string")
    assert {r["node"]: r["betweenness"] for r in C.betweenness(frame("a", "b", "c"), pairs(("a", "b"), ("b", "c"))).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert {r["betweenness"] for r in C.betweenness(frame("a", "b"), pairs(("a", "b"))).collect()} == {0.0}
    assert C.betweenness(frame(), pairs()).count() == 0


def test_projection(spark):
    rows = spark.createDataFrame([("e1", "a", "b", ["x"]), ("e2", "b", "a", ["y"]), ("e3", "a", "a", ["z"])], "edge_id string, subject_id string, object_id string, source_sides array<string>")
    pairs = C.project(rows)
    assert {(r["u"], r["v"]): r["source_sides"] for r in pairs.collect()} == {("a", "b"): ["y"], ("a", "a"): ["z"]}
    assert {r["node"]: (r["degree"], r["source_sides"]) for r in C.degrees(pairs).collect()} == {"a": (3, ["y", "z"]), "b": (1, ["y"])}


def test_null_model_is_deterministic(spark):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(8)], "node string")
    pairs = spark.createDataFrame([(f"n{a}", f"n{b}", ["s"]) for a, b in itertools.combinations(range(8), 2) if (a * b) % 3 == 0], "u string, v string, source_sides array<string>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    a = rows(C.null_betweenness(pairs, nodes, 6, 11))
    assert a == rows(C.null_betweenness(pairs.repartition(7), nodes.repartition(3), 6, 11)) and len(a) == 48
    assert C.null_betweenness(pairs, nodes, 0, 11).count() == 0
    assert C.null_betweenness(pairs, nodes.limit(3), 5, 11).count() == 0


SCORED = (("ev_ax_1", "edge_ax", "ent_a", "ent_x", "official_government", "gov", 1), ("ev_ax_2", "edge_ax", "ent_a", "ent_x", "official_government", "gov", 1), ("ev_xb", "edge_xb", "ent_x", "ent_b", "column_b", "paper", 2), ("ev_bc", "edge_bc", "ent_b", "ent_c", "column_b", "paper", 10))


def scored(spark):
    return frames(spark, *(relation(e, ev, f"doc_{ev}", s, o, side=side, name=name, confidence=0.7, at=datetime(2026, 6, day)) for ev, e, s, o, side, name, day in SCORED))


def test_independence_and_temporal(spark):
    touched = G.touching(scored(spark)).where("entity_id = 'ent_x'")
    r = S.independence(touched).first()
    assert r["independence_passed"] and r["collapsed_evidence_count"] == 1 and r["source_sides"] == ["column_b", "official_government"]
    assert r["independence_score"] == pytest.approx(0.9066165626622601)
    t = S.temporal(touched, scored(spark).select("published_at"), Scoring(temporal_window_days=2)).first()
    assert (t["max_window_evidence_count"], t["total_dated_count"], t["corpus_span_days"], t["lift_over_uniform"], t["temporal_score"]) == (3, 3, 10, 5.0, 1.0)
    alone = S.temporal(touched.limit(1), scored(spark).select("published_at")).first()
    assert alone["temporal_score"] == 0 and alone["temporal_notes"] == ["insufficient_temporal_evidence"]


def test_specificity_ignores_inferences(spark):
    quote = "El director Juan Pérez recibió 40 millones de pesos de la Empresa Central, según el expediente judicial."
    found = spark.createDataFrame([("ent_a", "A", "person", 2, ["x"])], "entity_id string, entity_name string, entity_type string, degree long, source_sides array<string>")
    score = lambda kind: S.specificity(G.touching(frames(spark, relation(predicate="SOBORNO", kind=kind, quote=quote))), found).first()
    a, b = score("evidence"), score("inference")
    assert a["predicate_score"] == pytest.approx(0.8) and a["quote_score"] > 0
    assert b["predicate_score"] == 0.35 and b["quote_score"] == 0 and "inference_assertions_excluded_from_specificity=1" in b["specificity_notes"]


def test_status_boundaries(spark):
    row = lambda ind, spec, final, ip, np_, sp: spark.createDataFrame([(ind, spec, final, ip, np_, sp)], "independence_score double, specificity_score double, final_score double, independence_passed boolean, null_passed boolean, specificity_passed boolean").select(S.status().alias("s")).first()["s"]
    assert row(0.19, 0.9, 0.9, True, True, True) == "discard" and row(0.9, 0.24, 0.9, True, True, True) == "discard"
    assert row(0.5, 0.5, 0.5, True, True, True) == "promote_for_human_review" and row(0.5, 0.5, 0.49, True, True, True) == "needs_more_evidence"
    assert row(0.5, 0.5, 0.35, False, True, True) == "needs_more_evidence" and row(0.5, 0.5, 0.34, False, True, True) == "degraded"


def test_null_scores(spark):
    found = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "entity_id string, bridge_score double")
    samples = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.5)], "node string, betweenness double")
    rows = {r["entity_id"]: r for r in S.null_model(found, samples).collect()}
    values = np.array([0.1, 0.2, 0.5])
    assert rows["a"]["p_value"] == 0.5 and rows["a"]["z_score"] == pytest.approx((0.5 - values.mean()) / values.std())
    assert rows["b"]["samples"] == 0 and rows["b"]["p_value"] == 1.0 and rows["b"]["null_score"] == 0.0 and rows["b"]["null_notes"] == ["insufficient_graph_for_null_model"]


def test_null_mean_does_not_depend_on_the_order_of_samples(spark):
    """The samples' mean is 0.45, the observed value, in exact numbers; sums of doubles miss it in some orders."""
    parts = [(51041 * 7 + k * 12) % 11 / 11 for k in range(20)]
    orders = {"up": parts, "down": parts[::-1], "least": sorted(parts), "greatest": sorted(parts, reverse=True)}
    assert len({float(np.cumsum(o)[-1]) for o in orders.values()}) > 1
    found = spark.createDataFrame([(e, 0.45) for e in orders], "entity_id string, bridge_score double")
    samples = spark.createDataFrame([(e, b) for e, o in orders.items() for b in o], "node string, betweenness double").coalesce(1)
    rows = S.null_model(found, samples).collect()
    assert len(rows) == len(orders) and all(r["null_mean"] == 0.45 and r["z_score"] == 0 and "not_above_null_mean" in r["null_notes"] for r in rows)
