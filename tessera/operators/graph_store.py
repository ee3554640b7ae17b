"""The provenance graph as three tables: entities, evidence, and edges derived from evidence."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVIDENCE = ("evidence_id", "edge_id", "document_id", "assertion_type", "confidence", "quote", "source_name", "source_side", "url", "title", "published_at", "extraction_method")
EDGE = ("edge_id", "subject_id", "predicate", "object_id")
PAYLOAD = ("evidence_id", "edge_id", "document_id", "source_name", "source_side", "url", "title", "published_at", "predicate", "assertion_type", "subject_id", "object_id", "quote")


def is_evidence(assertion: Column | str = "assertion_type") -> Column:
    """A missing assertion type counts as evidence."""
    return F.coalesce(F.col(assertion) if isinstance(assertion, str) else assertion, F.lit("evidence")) == "evidence"


def keep_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that with the greatest order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key; repeated keys within new keep one row."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by canonical_id; aliases sorted and distinct. Entities are never deleted."""
    return upsert(old, new.withColumn("aliases", F.array_sort(F.array_distinct("aliases"))), "canonical_id")


def with_legacy_defaults(evidence: DataFrame) -> DataFrame:
    """Evidence of an older layout lacks type and confidence: the cautious values are inference and 0."""
    for name, value in (("assertion_type", F.lit("inference")), ("confidence", F.lit(0.0))):
        evidence = evidence.withColumn(name, F.coalesce(F.col(name), value) if name in evidence.columns else value)
    return evidence


def roll_up_edges(evidence: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges re-derived from their evidence; an edge without any is dropped. ends: edge_id, subject_id, predicate, object_id."""
    rolled = _rolled(evidence, "edge_id")
    return rolled.join(ends.select(*EDGE).dropDuplicates(["edge_id"]), "edge_id").select(*EDGE, "assertion_type", "confidence", "first_seen_at", "last_seen_at", "source_sides")


def edges_of(relations: DataFrame) -> DataFrame:
    """Edges straight from relations in one aggregate: every relation of an edge has the same ends."""
    return _rolled(relations, *EDGE).select(*EDGE, "assertion_type", "confidence", "first_seen_at", "last_seen_at", "source_sides")


def _rolled(rows: DataFrame, *keys: str) -> DataFrame:
    """What edges derive from their evidence, first by side: a set for each key would make Spark sort all rows instead."""
    sides = rows.groupBy(*keys, "source_side").agg(
        F.max(is_evidence().cast("int")).alias("own"), F.max("confidence").alias("confidence"), F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_seen_at"),
    )
    return sides.groupBy(*keys).agg(
        F.when(F.max("own") == 1, "evidence").otherwise("inference").alias("assertion_type"), F.max("confidence").alias("confidence"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.array_sort(F.collect_set("source_side")).alias("source_sides"),
    )


def check_batch(relations: DataFrame, document_ids: DataFrame) -> None:
    """A replacing batch may hold relations of its own documents only."""
    if not relations.select("document_id").distinct().join(document_ids, "document_id", "left_anti").isEmpty():
        raise ValueError("relations from documents outside the batch")


def upsert_relations(evidence: DataFrame, ends: DataFrame, relations: DataFrame, replace_document_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, ends, new evidence ids) after adding relations, or after replacing all evidence of the given documents by them."""
    kept = evidence
    if replace_document_ids is not None:
        check_batch(relations, replace_document_ids)
        kept = evidence.join(replace_document_ids.select("document_id").distinct(), "document_id", "left_anti")
    fresh = relations.select(*EVIDENCE)
    observed = fresh.select("evidence_id").distinct().join(evidence, "evidence_id", "left_anti")
    return upsert(kept, fresh, "evidence_id").select(*EVIDENCE), ends.select(*EDGE).unionByName(relations.select(*EDGE)).dropDuplicates(["edge_id"]), observed


def all_evidence(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence with the ends, predicate and sides of its edge."""
    return evidence.join(edges.select(*EDGE, F.col("source_sides")), "edge_id")


def touching(evidence: DataFrame) -> DataFrame:
    """One row for each entity that evidence touches; a self-loop touches its entity once."""
    return evidence.withColumn("entity_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))))


def evidence_for_entities(evidence: DataFrame, limit: int = 8) -> DataFrame:
    """The newest pieces of evidence of every entity, at most `limit`; rank 1 is the newest."""
    w = W.partitionBy("entity_id").orderBy(F.desc("published_at"), F.desc("evidence_id"))
    return touching(evidence).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def evidence_for_documents(evidence: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence with the names and types of its ends; ends that are no entity drop it."""
    names = lambda end: entities.select(F.col("canonical_id").alias(f"{end}_id"), F.col("canonical_name").alias(f"{end}_name"), F.col("entity_type").alias(f"{end}_type"))
    return all_evidence(evidence, edges).join(names("subject"), "subject_id").join(names("object"), "object_id")


def evidence_counts_by_edge(evidence: DataFrame) -> DataFrame:
    """Number of pieces of evidence of each edge."""
    return evidence.groupBy("edge_id").agg(F.count("*").alias("evidence_count"))


def counts(entities: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of the three tables."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return one(entities, "entities").unionByName(one(edges, "edges")).unionByName(one(evidence, "evidence"))


class ConcurrentWrite(RuntimeError):
    """Another writer has switched the tables since they were read; nothing was changed."""


class SnapshotStore:
    """Tables as immutable Parquet snapshots; numbered version files name the current ones.

    A version file is created only if it doesn't exist, so of two writers that read the same version one
    succeeds and the other gets ConcurrentWrite. A failed write leaves all readers where they were.
    Snapshots that none of the last `keep` versions names are deleted after a commit.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 10):
        self.spark, self.root, self.keep, self.seen = spark, root.rstrip("/"), keep, None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/versions"))

    def versions(self) -> list[int]:
        """Numbers of all version files, in order."""
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(self._path(f"{self.root}/versions")) if f.getPath().getName().isdigit())

    def _tables(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/versions/{version:012d}").collect()))

    def begin(self) -> None:
        """Forget what was read before: the next commit follows the version of the next read."""
        self.seen = None

    def _current(self) -> int:
        """The version that a commit will follow: that of the first read since the last commit."""
        found = max(self.versions(), default=0)
        self.seen = found if self.seen is None else self.seen
        return found

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """The current snapshot of a table; an empty one of the schema, or None, before the first write."""
        found = self._tables(self._current()).get(name)
        if found:
            return self.spark.read.parquet(f"{self.root}/{found}")
        return self.spark.createDataFrame([], schema) if schema else None

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write new snapshots of the tables, then switch to all of them at once."""
        self._current()
        base, tag = self.seen, uuid.uuid4().hex
        named = self._tables(base) | {name: f"{name}-{tag}" for name in tables}
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{named[name]}")
            at = self._path(f"{self.root}/versions/{base + 1:012d}")
            if self.fs.exists(at):
                raise ConcurrentWrite(f"version {base + 1} exists")
            try:
                out = self.fs.create(at, False)
            except Exception as e:
                raise ConcurrentWrite(f"version {base + 1} exists") from e
            out.write(bytearray(json.dumps(named).encode()))
            out.close()
        except BaseException:
            for name in tables:
                self.fs.delete(self._path(f"{self.root}/{named[name]}"), True)
            raise
        finally:
            self.seen = None
        self.clean()

    def clean(self) -> None:
        """Delete versions but the last ones, and the snapshots that no version names any more."""
        versions = self.versions()
        kept, old = versions[-self.keep :], versions[: -self.keep]
        needed = {t for v in kept for t in self._tables(v).values()}
        gone = {t for v in old for t in self._tables(v).values()} - needed
        for t in gone:
            self.fs.delete(self._path(f"{self.root}/{t}"), True)
        for v in old:
            self.fs.delete(self._path(f"{self.root}/versions/{v:012d}"), False)
