"""Property-graph export and JSON artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph_store import edges_of


def property_graph(entities: DataFrame, relations: DataFrame, repeated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a reified graph: Entity, Document, Assertion and Evidence nodes; SUBJECT, OBJECT,
    SUPPORTS and FROM_DOCUMENT edges, and the direct ASSERTS. The export adds, and never deletes; an
    assertion keeps its greatest confidence. repeated: whether an evidence_id may come more than once."""
    node = lambda df, key, label, *props: df.select(F.col(key).alias("node_id"), F.lit(label).alias("label"), F.to_json(F.struct(*props)).alias("props"))
    asserted = edges_of(relations)
    evidence = relations.dropDuplicates(["evidence_id"]) if repeated else relations
    nodes = (
        node(entities, "canonical_id", "Entity", "canonical_name", "entity_type", "aliases", "resolution_reason", "confidence")
        .unionByName(node(relations.groupBy("document_id").agg(F.first("url").alias("url"), F.first("title").alias("title"), F.first("source_name").alias("source_name"), F.first("source_side").alias("source_side")), "document_id", "Document", "url", "title", "source_name", "source_side"))
        .unionByName(node(asserted, "edge_id", "Assertion", "predicate", "assertion_type", "confidence"))
        .unionByName(node(evidence, "evidence_id", "Evidence", "quote", "assertion_type", "confidence", "published_at", "extraction_method"))
    )
    edge = lambda df, a, b, kind, via=F.lit(""): df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("kind"), via.alias("via"))
    edges = (
        edge(asserted, "subject_id", "object_id", "ASSERTS", F.col("edge_id"))
        .unionByName(edge(asserted, "edge_id", "subject_id", "SUBJECT"))
        .unionByName(edge(asserted, "edge_id", "object_id", "OBJECT"))
        .unionByName(edge(evidence, "evidence_id", "edge_id", "SUPPORTS"))
        .unionByName(edge(evidence, "evidence_id", "document_id", "FROM_DOCUMENT"))
    )
    return nodes, edges


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness; an export demands none."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def write_json(rows: DataFrame, path: str) -> int:
    """A ranking's few rows as one indented JSON file in whatever file system the path names, non-ASCII kept; returns their number."""
    body = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    context = rows.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True)  # makes the folders above
    out.write(bytearray(json.dumps(body, ensure_ascii=False, indent=2).encode()))
    out.close()
    return len(body)
