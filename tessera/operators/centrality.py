"""Graph metrics over the undirected simple projection: degree, betweenness, random null graphs."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Graphs up to these sizes are sent whole to the executors; larger ones are walked with joins.
BROADCAST_NODES = 1 << 20
BROADCAST_EDGES = 1 << 23
#: Sources of one round of the join-based walk.
JOINED_SOURCES = 256


def project(edges: DataFrame) -> DataFrame:
    """Undirected simple graph (u, v, source_sides), u <= v: parallel edges collapse, and the attributes
    are those of the edge with the greatest edge_id. Self-loops are kept."""
    u, v = F.least("subject_id", "object_id").alias("u"), F.greatest("subject_id", "object_id").alias("v")
    return edges.select(u, v, "edge_id", "source_sides").groupBy("u", "v").agg(F.max_by("source_sides", "edge_id").alias("source_sides"))


def incidence(pairs: DataFrame) -> DataFrame:
    """(node, neighbour, source_sides); a self-loop appears once."""
    far = pairs.where("u <> v").select(F.col("v").alias("node"), F.col("u").alias("neighbour"), "source_sides")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("neighbour"), "source_sides").unionByName(far)


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree, source_sides): a self-loop adds two to the degree; sides are those of all neighbouring edges."""
    # each edge once and its sides one by one, so that partial sets stay as small as the number of sides
    own = F.when(F.col("node") == F.col("neighbour"), 2).otherwise(1)
    rows = incidence(pairs).select("node", own.alias("times"), F.posexplode_outer("source_sides").alias("pos", "side"))
    return rows.groupBy("node").agg(F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("times")).otherwise(0)).alias("degree"), F.array_sort(F.collect_set("side")).alias("source_sides"))


def dependencies(starts: np.ndarray, ends: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Summed dependencies of the sources on every node (Brandes), by levels over CSR arrays."""
    n = len(starts) - 1
    total = np.zeros(n)
    for s in sources.tolist():
        depth, paths = np.full(n, -1), np.zeros(n)
        depth[s], paths[s] = 0, 1
        front, levels = np.array([s]), []
        while len(front):
            size = starts[front + 1] - starts[front]
            at = np.repeat(starts[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            origin, target = np.repeat(front, size), ends[at]
            fresh = depth[target] == -1
            depth[target[fresh]] = depth[front[0]] + 1
            down = depth[target] == depth[front[0]] + 1
            origin, target = origin[down], target[down]
            np.add.at(paths, target, paths[origin])
            levels.append((origin, target))
            front = np.unique(target)
        delta = np.zeros(n)
        for origin, target in reversed(levels):
            np.add.at(delta, origin, paths[origin] / paths[target] * (1 + delta[target]))
        delta[s] = 0
        total += delta
    return total


def csr(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CSR arrays of an undirected graph without self-loops."""
    a, b = np.concatenate((u, v)), np.concatenate((v, u))
    order = np.argsort(a, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(a, minlength=n)))).astype(np.int64), b[order].astype(np.int64)


def betweenness(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, betweenness), normalised by (n - 1)(n - 2) over all nodes, those without edges included.

    The sizes are checked: a graph that fits is broadcast and its sources are shared out; a larger
    one is walked level by level with joins.
    """
    # counted, then read again: Spark keeps them, and spills what memory can't hold
    nodes = nodes.select("node").distinct().persist()
    simple = pairs.where("u <> v").select("u", "v").distinct().persist()
    n, m = nodes.count(), simple.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if not m or not scale:
        return nodes.withColumn("betweenness", F.lit(0.0))
    if n > BROADCAST_NODES or m > BROADCAST_EDGES:
        return _betweenness_joined(nodes, simple, scale)
    spark = nodes.sparkSession
    # numbered in Spark, so that the driver and the tasks hold integers only: BROADCAST_EDGES pairs at most
    place = nodes.select("node", (F.row_number().over(W.orderBy("node")) - 1).cast("long").alias("number")).persist()  # BROADCAST_NODES rows at most
    ends = simple.join(place.select(F.col("node").alias("u"), F.col("number").alias("a")), "u").join(place.select(F.col("node").alias("v"), F.col("number").alias("b")), "v").select("a", "b").toArrow()
    shared = spark.sparkContext.broadcast(csr(n, ends["a"].to_numpy(), ends["b"].to_numpy()))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, ends = shared.value
        total = np.zeros(len(starts) - 1)
        for part in parts:
            total += dependencies(starts, ends, part["id"].to_numpy())
        some = np.flatnonzero(total)
        yield pd.DataFrame({"number": some, "part": total[some]})

    tasks = max(1, min(n // 16, spark.sparkContext.defaultParallelism * 4))
    summed = spark.range(0, n, 1, tasks).mapInPandas(walk, "number long, part double").groupBy("number").agg(F.sum("part").alias("part"))
    return place.join(summed, "number", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def _betweenness_joined(nodes: DataFrame, simple: DataFrame, scale: float) -> DataFrame:
    """Level-synchronous Brandes with joins, JOINED_SOURCES sources at a time; every level is checkpointed."""
    ways = simple.union(simple.select("v", "u")).toDF("node", "next").checkpoint()
    groups = max(1, -(-nodes.count() // JOINED_SOURCES))
    total = None
    for g in range(groups):
        sources = nodes.where(F.pmod(F.xxhash64("node"), F.lit(groups)) == g)
        front = sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")).checkpoint()
        seen, levels = front.select("source", "node"), [front]
        while True:
            reached = front.join(ways, "node").groupBy("source", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
            front = reached.join(seen, ["source", "node"], "left_anti").checkpoint()
            if front.isEmpty():
                break
            seen = seen.union(front.select("source", "node")).checkpoint()
            levels.append(front)
        delta = levels[-1].select("source", "node", "paths", F.lit(0.0).alias("delta"))
        parts = []
        for above in reversed(levels[:-1]):
            parts.append(delta.select("node", "delta"))
            back = delta.select("source", F.col("node").alias("next"), ((1 + F.col("delta")) / F.col("paths")).alias("share")).join(ways, "next")
            gained = back.groupBy("source", "node").agg(F.sum("share").alias("share"))
            delta = above.join(gained, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("delta")).checkpoint()
        for p in parts:
            total = p if total is None else total.union(p)
        total = None if total is None else total.groupBy("node").agg(F.sum("delta").alias("delta")).checkpoint()
    if total is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    return nodes.join(total, "node", "left").select("node", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


def null_betweenness(pairs: DataFrame, nodes: DataFrame, samples: int, seed: int) -> DataFrame:
    """(node, sample, betweenness) of random graphs with the same degrees; none if n < 4, fewer than two edges or no samples.

    Sample k pairs the shuffled stubs of random.Random(seed + k), drops loops and collapses parallel
    edges, so it doesn't depend on partitions. Nodes are taken in the order of their names.
    """
    spark = nodes.sparkSession
    nodes = nodes.select("node").distinct()
    schema = f"node {dict(nodes.dtypes)['node']}, sample int, betweenness double"
    n, m = nodes.count(), pairs.count()
    if n < 4 or m < 2 or samples <= 0:
        return spark.createDataFrame([], schema)
    if n > BROADCAST_NODES or m > BROADCAST_EDGES:
        raise ValueError("the graph is too large for random null graphs; set the number of samples to 0")
    known = nodes.join(degrees(pairs), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy("node").toPandas()
    shared = spark.sparkContext.broadcast((known["node"].to_numpy(), known["degree"].to_numpy().astype(np.int64)))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, degree = shared.value
        size = len(names)
        for part in parts:
            for k in part["id"].tolist():
                stubs = np.repeat(np.arange(size), degree).tolist()
                random.Random(seed + k).shuffle(stubs)
                half = len(stubs) // 2
                pairs = {(min(a, b), max(a, b)) for a, b in zip(stubs[:half], stubs[half:]) if a != b}
                u, v = (np.array([p[i] for p in sorted(pairs)], np.int64) for i in (0, 1))
                found = dependencies(*csr(size, u, v), np.arange(size)) / ((size - 1) * (size - 2))
                yield pd.DataFrame({"node": names, "sample": np.full(size, k, np.int32), "betweenness": found})

    return spark.range(0, samples, 1, min(samples, spark.sparkContext.defaultParallelism * 4)).mapInPandas(draw, schema)
