"""How the registered queries' shared steps move and keep rows."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import centrality, graph_store, scoring
from tessera.plans import registry
from tessera.sources import adapters
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture
def shuffled(spark):
    """All joins by shuffle, as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.catalog.clearCache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_evidence_is_told_apart_where_the_join_put_it(spark, shuffled):
    moved = re.findall(r"hashpartitioning\((\w+)#", plan(registry._evidence(spark, SF)))
    assert set(moved) == {"l_suppkey", "s_suppkey", "l_orderkey", "o_orderkey", "o_custkey", "c_custkey"}


def test_distinct_relations_are_those_of_sql(spark, tmp_path):
    """Repeated lines count once; so do lines whose quotes are equal because they leave nulls out."""
    for t in ("region", "nation", "customer", "supplier", "orders"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    line = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 200")
    gone = line.limit(40).withColumn("l_partkey", F.col("l_suppkey"))
    odd = gone.withColumn("l_quantity", F.lit(None).cast("double")).withColumn("l_extendedprice", F.lit(5.0)).unionByName(gone.withColumn("l_quantity", F.lit(5.0)).withColumn("l_extendedprice", F.lit(None).cast("double")))
    line.unionByName(line).unionByName(odd).write.parquet(f"{tmp_path}/lineitem.parquet")
    every = adapters.relations(spark, str(tmp_path))
    got, want = adapters.relations(spark, str(tmp_path), distinct=True), every.distinct()
    assert got.count() == want.count() < every.count() and got.exceptAll(want).isEmpty()
    assert got.select("evidence_id").distinct().count() == got.count()


def test_sets_are_made_of_few_rows(spark, shuffled):
    """Rows reach a set only after sums by side: sets of many keys make Spark sort all rows."""
    for df in (graph_store.edges_of(adapters.relations(spark, SF)), scoring.independence(graph_store.touching(registry._evidence(spark, SF)))):
        steps = re.findall(r"(ObjectHashAggregate|HashAggregate|SortMergeJoin)", plan(df))
        first = [k for k, s in enumerate(steps) if s == "ObjectHashAggregate"]
        assert first and all(steps[k + 1] in ("ObjectHashAggregate", "HashAggregate") for k in first)


def test_corpus_steps_are_kept_without_whole_documents(spark):
    notes = registry.small_notes(spark, SF)._jdf.queryExecution().withCachedData().toString()
    kept = [re.sub(r"#\d+", "", x) for x in re.findall(r"InMemoryRelation \[([^\]]*)\]", notes)]
    assert kept and not any("text_hash" in x for x in kept)
    aliases = registry.QUERIES["alias_sets"](spark, SF)._jdf.queryExecution().withCachedData().toString()
    assert re.search(r"InMemoryRelation \[norm#\d+, entity_type#\d+, name", aliases)
    spark.catalog.clearCache()


def test_parts_of_the_join_follow_the_tables(spark, shuffled, monkeypatch):
    """Both joins of the facts are cut by bytes, not by Spark's fixed number; so is what tells repeats apart."""
    each = max(1, adapters.stored(adapters.table(spark, SF, "lineitem")) // 9)
    monkeypatch.setitem(adapters.small_parts.__kwdefaults__, "each", each)
    cut = {k: int(n) for k, n in re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(registry._evidence(spark, SF)))}
    assert cut["l_orderkey"] == cut["o_orderkey"] >= 9
    monkeypatch.setitem(adapters.small_parts.__kwdefaults__, "each", 1 << 30)
    assert "REPARTITION_BY_NUM" not in plan(registry._evidence(spark, SF))


def test_suppliers_are_joined_in_small_parts_or_by_broadcast(spark, shuffled, monkeypatch):
    """Where suppliers don't fit a broadcast, lines meet them in parts that follow the table, too; else lines don't move for it."""
    each = max(1, adapters.stored(adapters.table(spark, SF, "lineitem")) // 9)
    monkeypatch.setitem(adapters.small_parts.__kwdefaults__, "each", each)
    cut = {k: int(n) for k, n in re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(registry._evidence(spark, SF)))}
    assert cut["l_suppkey"] == cut["s_suppkey"] >= 9
    every = sorted(map(str, registry._evidence(spark, SF).select("evidence_id").collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_suppkey" not in plan(registry._evidence(spark, SF))
    assert every == sorted(map(str, registry._evidence(spark, SF).select("evidence_id").collect()))


def test_thresholded_pairs_read_the_facts_once(spark, monkeypatch):
    """Counts and edges come from one sum, and the pairs are those of all relations."""
    calls, facts = [], adapters.facts
    monkeypatch.setattr(adapters, "facts", lambda *a, **k: calls.append(1) or facts(*a, **k))
    pairs = registry._thresholded_pairs(spark, SF)[1].collect()
    assert len(calls) == 1
    every = {(r.u, r.v): r.source_sides for r in centrality.project(graph_store.edges_of(adapters.relations(spark, SF))).collect()}
    assert pairs and all(every[r.u, r.v] == r.source_sides for r in pairs)
    spark.catalog.clearCache()
