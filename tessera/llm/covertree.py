"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are merged first, numbered, and carry how many they are. Each label's vectors are dealt to
the nearest of at most PIVOTS vectors (the first by hash) and large cells are cut by hash into tiles
of about TILE vectors. Cell pairs whose centres lie further apart than their covering radii and the
threshold distance are dropped; every other tile pair is one task's work: it builds a cover tree for
each tile, with nested levels of halving radii, and walks both together, dropping node pairs by the
same bound with the nodes' true covering radii. What is left is checked by its cosine.

Edge cases: vectors that are null, zero, or hold nulls, NaN or infinities, and rows with a null label
or vec_id, link with nothing and are kept; vectors of different length aren't compared; repeated rows
are vectors of their own and link; rows that repeat a vec_id with another vector or label are vectors
of their own, too; components of any size count, as each vector is divided by its largest one first;
an empty table gives an empty table; other columns are not read.

Pruning is exact, so its gain depends on the data: groups of copies are skipped at their centres, but
single vectors in many dimensions are all about as far from each other as from every pivot, and then each
tile meets each other tile of its label: N / TILE copies of a vector.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.components import connected_components

PIVOTS = 32
TILE = 2048
CHUNK = 8192
LEAF = 24


@dataclass
class Node:
    """A cover-tree node: for each child its centre, covering radius and subtree (None: a single point)."""

    centres: np.ndarray
    radii: np.ndarray
    below: list


def build(points: np.ndarray, members: np.ndarray, centre: int, scale: float) -> Node:
    """Cover the members by balls of half the scale around nested centres, again and again."""
    while True:
        if len(members) <= LEAF or scale < 1e-6:
            return Node(members, np.zeros(len(members)), [None] * len(members))
        scale /= 2
        left, centres, groups, radii = members, [], [], []
        pick = centre
        while len(left):
            d = np.sqrt(np.maximum(0, ((points[left] - points[pick]) ** 2).sum(axis=1)))
            near = d <= scale
            near |= left == pick
            centres.append(pick)
            groups.append(left[near])
            radii.append(float(d[near].max()))
            left = left[~near]
            pick = int(left[0]) if len(left) else -1
        if len(groups) > 1:
            break
    below = [None if len(g) == 1 else build(points, g, c, scale) for g, c in zip(groups, centres)]
    return Node(np.array(centres), np.array(radii), below)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is divided by its largest component first, so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, initial=0)[:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def dual_traversal(x: np.ndarray, a: Node, y: np.ndarray, b: Node, reach: float, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose points may lie within reach: node pairs too far apart are never opened."""
    out, stack = [], [(a, b, same)]
    while stack:
        p, q, own = stack.pop()
        d = np.sqrt(np.maximum(0, 2 - 2 * (x[p.centres] @ y[q.centres].T)))
        near = d <= reach + p.radii[:, None] + q.radii[None, :]
        if own:
            near = np.triu(near)
        i, j = np.nonzero(near)
        leaf_i = np.array([t is None for t in p.below])
        leaf_j = np.array([t is None for t in q.below])
        both = leaf_i[i] & leaf_j[j]
        out.append((p.centres[i[both]], q.centres[j[both]]))
        for m, n in zip(i[~both].tolist(), j[~both].tolist()):
            u = p.below[m] or Node(p.centres[m : m + 1], np.zeros(1), [None])
            v = q.below[n] or Node(q.centres[n : n + 1], np.zeros(1), [None])
            stack.append((u, v, own and m == n))
    return out


def threshold_pairs(x: np.ndarray, y: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of rows with at least that cosine: within x (i < j), or between x and y."""
    same = y is None
    if not len(x) or not (same or len(y)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ux = unit(x)
    uy = ux if same else unit(y)
    a = build(ux, np.arange(len(ux)), 0, 2.0)
    b = a if same else build(uy, np.arange(len(uy)), 0, 2.0)
    found = dual_traversal(ux, a, uy, b, math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6, same)
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    if same:
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i != j], j[i != j]
    scaled = lambda m: m / np.abs(m).max(axis=1)[:, None]
    other = scaled(x if same else y)
    x = scaled(x)
    keep = []
    for k in range(0, len(i), 1 << 18):
        p, q = x[i[k : k + (1 << 18)]], other[j[k : k + (1 << 18)]]
        keep.append((p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= cosine)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def _deal(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """Nearest pivot and distance of each vector of one chunk of a label."""
    if not points.num_rows or not pivots.num_rows:
        return pa.table({"rep": pa.array([], pa.int64()), "cell": pa.array([], pa.int32()), "far": pa.array([], pa.float64())})
    x, c = unit(_matrix(points["vector"])), unit(_matrix(pivots["vector"]))
    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ c.T)))
    cell = d.argmin(axis=1)
    return pa.table({"rep": points["rep"], "cell": pa.array(pivots["cell"].to_numpy()[cell].astype(np.int32)), "far": pa.array(d.min(axis=1))})


def _near_cells(cells: pa.Table, reach: float) -> pa.Table:
    """Cell pairs of one label that can hold links, by their covering radii."""
    cells = cells.sort_by("cell")
    c, far = unit(_matrix(cells["vector"])), cells["far"].to_numpy()
    i, j = np.nonzero(np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) <= far[:, None] + far[None, :] + reach + 1e-6)
    cell = cells["cell"].to_numpy()
    return pa.table({"label": cells["label"].take(pa.array(i)), "width": cells["width"].take(pa.array(i)), "cell": cell[i], "other": cell[j], "other_cuts": cells["cuts"].take(pa.array(j))})


def _links(t: pa.Table, cosine: float) -> pa.Table:
    """Links of one tile pair: rows (a, b, null) span them, rows (a, null, links) count them."""
    side, rep, times = t["side"].to_numpy(), t["rep"].to_numpy(), t["times"].to_numpy()
    x = _matrix(t["vector"])
    if side.min() == 0:
        left = right = np.arange(len(rep))
        i, j = threshold_pairs(x, None, cosine)
    else:
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        i, j = threshold_pairs(x[left], x[right], cosine)
        i, j = left[i], right[j]
    more = np.bincount(i, times[j], len(rep)) + np.bincount(j, times[i], len(rep))
    label, edges = np.arange(len(rep)), []
    for a, b in zip(i.tolist(), j.tolist()):
        while label[a] != a:
            label[a] = a = label[label[a]]
        while label[b] != b:
            label[b] = b = label[label[b]]
        if a != b:
            label[max(a, b)] = min(a, b)
            edges.append((int(rep[a]), int(rep[b])))
    counted = np.flatnonzero(more)
    a = np.array([e[0] for e in edges] + rep[counted].tolist(), np.int64)
    b = pa.array([e[1] for e in edges] + [None] * len(counted), pa.int64())
    return pa.table({"a": a, "b": b, "links": pa.array([None] * len(edges) + more[counted].astype(np.int64).tolist(), pa.int64())})


def embedding_groups(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vec_id, embedding, label."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("vector", lambda v: v != 0.0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some, F.lit(False))
    marked = materialize(rows.select("vec_id", "label", "vector", sound.alias("sound")))
    # each distinct vector has a number of its own, written with it: a vec_id may occur with several
    unique = marked.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    unique = materialize(unique.withColumn("width", F.size("vector")).withColumn("rep", F.monotonically_increasing_id()))
    group = ["label", "width"]
    sizes = unique.groupBy(group).agg(F.count("*").alias("n"))
    # pivots: one in TILE / 2 vectors of a label, at most PIVOTS, the first by hash
    ranked = unique.withColumn("cell", F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64("rep"), "rep"))).where(F.col("cell") <= PIVOTS)
    pivots = materialize(ranked.join(sizes, group).where(F.col("cell") <= F.ceil(F.col("n") * 2 / TILE)).select(*group, "cell", "vector", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    chunked = unique.join(pivots.where("cell = 1").select(*group, "chunks"), group).withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    copies = pivots.select(*group, "cell", "vector", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    keys = [*group, "chunk"]
    dealt = chunked.select(*keys, "rep", "vector").groupBy(keys).cogroup(copies.groupBy(keys)).applyInArrow(_deal, "rep long, cell int, far double")
    placed = materialize(unique.join(dealt, "rep"))
    cells = placed.groupBy(*group, "cell").agg(F.count("*").alias("m"), F.max("far").alias("far")).join(pivots.select(*group, "cell", "vector"), [*group, "cell"])
    cells = materialize(cells.withColumn("cuts", F.ceil(F.col("m") / TILE).cast("int")))
    kind = dict(placed.dtypes)["label"]
    near = cells.groupBy(group).applyInArrow(lambda t: _near_cells(t, math.sqrt(max(0.0, 2 - 2 * cosine))), f"label {kind}, width int, cell int, other int, other_cuts int")
    tile = F.struct("cell", F.pmod(F.xxhash64("rep"), "cuts").cast("int").alias("cut"))
    own = placed.join(cells.select(*group, "cell", "cuts"), [*group, "cell"]).withColumn("tile", tile)
    facing = near.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("other_cuts") - 1))).select(*group, "cell", F.struct(F.col("other").alias("cell"), "cut").alias("other"))
    work = own.join(facing, [*group, "cell"]).select(
        *group, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "rep", "times", "vector",
        F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    found = materialize(work.groupBy(*group, "low", "high").applyInArrow(lambda t: _links(t.select(["side", "rep", "times", "vector"]), cosine), "a long, b long, links long"))
    counted = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b"))
    grouped = materialize(unique.select("label", "vector", "rep", "times", "least").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    firsts = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    heads = grouped.join(counted, "rep", "left").join(firsts, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = marked.where("sound").join(heads, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
