"""SimHash near-duplicates: exact pairs within a Hamming radius, then groups.

Fingerprints of equal value are merged first. The 64 bits are cut into radius + 2 bands; two
fingerprints within the radius agree on two bands at least, so comparing the fingerprints that
share a pair of bands misses none. Such buckets are compared in tiles with numpy exclusive-or and
bit counts; tile pairs whose population counts differ by more than the radius are skipped. A bucket
of more than TILE fingerprints is cut by population count and hash into tiles, and each tile pair is
a task of its own, so a hot bucket is spread over the cluster. A comparison returns a spanning
forest of its links, never all pairs.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; texts shorter
than a shingle use their whole word sequence; repeated rows are separate rows with one result;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.common import materialize, raw_texts, row_key, slices
from tessera.llm.components import connected_components

TILE = 2048
SHARD_ROWS = 1 << 16
#: For each byte, its bits as eight counters of one byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).reshape(-1)


def majority_fingerprint(hashes: np.ndarray) -> int:
    """64-bit value whose bits are set where over half of the hashes have them."""
    if not len(hashes):
        return 0
    counts, data = np.zeros(64, np.int64), hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(data), 255 * 256):
        part = _SPREAD[data[a : a + 255 * 256]]
        for b in range(0, len(part), 255):
            counts += part[b : b + 255].sum(axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def text_fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's lower-cased word shingles, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority_fingerprint(np.fromiter(map(xxh64_intdigest, grams, itertools.repeat(seed)), np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, row) with fp the signed 64-bit fingerprint of each whole text; row is row_key()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            fps = np.fromiter((text_fingerprint(x, shingle) for x in raw_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "row"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row")).mapInArrow(run, "doc_id long, fp long, row binary")


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two uint64 arrays within the radius, tile by tile; tiles too far apart in population count are skipped."""
    step = 256
    order_a, order_b = np.argsort(np.bitwise_count(a), kind="stable"), np.argsort(np.bitwise_count(b), kind="stable")
    pa_, pb = np.bitwise_count(a[order_a]).astype(np.int64), np.bitwise_count(b[order_b]).astype(np.int64)
    for i in range(0, len(a), step):
        low, high = pa_[i] - radius, pa_[min(i + step, len(a)) - 1] + radius
        for j in range(0, len(b), step):
            if pb[j] > high:
                break
            if pb[min(j + step, len(b)) - 1] < low:
                continue
            x, y = order_a[i : i + step], order_b[j : j + step]
            near = np.bitwise_count(a[x][:, None] ^ b[y][None, :]) <= radius
            r, c = np.nonzero(near)
            yield x[r], y[c]


def _forest(values: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links, as value pairs."""
    label, out = np.arange(len(values)), []
    for left, right in pairs:
        x, y = label[left], label[right]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            continue
        _, first = np.unique(np.minimum(x[apart], y[apart]) * len(values) + np.maximum(x[apart], y[apart]), return_index=True)
        root = {}
        for k in apart[first].tolist():
            i, j = int(x[k]), int(y[k])
            while i in root:
                i = root[i]
            while j in root:
                j = root[j]
            if i != j:
                root[max(i, j)] = min(i, j)
                out.append((int(values[left[k]]), int(values[right[k]])))
        for i in sorted(root):  # roots are smaller, so they are settled first
            root[i] = root.get(root[i], root[i])
        moved = np.arange(len(values))
        moved[list(root)] = list(root.values())
        label = moved[label]
    return out


def _compare(group: pa.Table, radius: int) -> pa.Table:
    """All buckets of one shard: rows (bucket, side, fp); side 0 compares within, 1 against 2."""
    bucket, side = group["bucket"].to_numpy(), group["side"].to_numpy()
    fp = group["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((fp, bucket))
    bucket, side, fp = bucket[order], side[order], fp[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    links: list[tuple[int, int]] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 2:
            continue
        values, sides = fp[a:b], side[a:b]
        if sides[0] == 0:
            links += _forest(values, tile_links(values, values, radius))
        else:
            x, y = np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)
            links += _forest(values, ((x[i], y[j]) for i, j in tile_links(values[x], values[y], radius)))
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that span the same groups as all pairs of distinct fingerprints within the radius."""
    bands = radius + 2
    widths = [64 // bands + (i < 64 % bands) for i in range(bands)]
    starts = list(itertools.accumulate([0, *widths[:-1]]))
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, widths)]
    keys = F.array(*(F.xxhash64(F.lit(n), part[i], part[j]) for n, (i, j) in enumerate(itertools.combinations(range(bands), 2))))
    rows = distinct.select("fp", F.bit_count("fp").alias("ones"), F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, "key"))
    plain = shared.where(F.col("n") <= TILE).select(F.col("key").alias("bucket"), F.lit(0).alias("side"), "fp")
    # hot buckets: tiles by population count and hash, each tile pair its own bucket
    hot = shared.where(F.col("n") > TILE)
    tiles = hot.groupBy("key", "ones").agg(F.ceil(F.count("*") / TILE).cast("int").alias("cuts"))
    tile = F.struct("ones", F.pmod(F.xxhash64("fp"), "cuts").cast("int").alias("cut"))
    own = hot.join(tiles, ["key", "ones"]).select("key", "fp", "ones", tile.alias("tile"))
    reach = tiles.select("key", F.explode(F.sequence(F.col("ones") - radius, F.col("ones") + radius)).alias("ones"), F.col("ones").alias("o_ones"), "cuts")
    reach = reach.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    other = reach.select("key", "ones", F.struct(F.col("o_ones").alias("ones"), "cut").alias("other"))
    paired = own.join(other, ["key", "ones"]).select(
        F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("bucket"),
        F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).alias("side"),
        "fp",
    )
    work = plain.unionByName(paired)
    shards = max(1, -(-shared.count() // SHARD_ROWS) * 4)
    return (
        work.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(lambda t: _compare(t, radius), "a long, b long")
    )


def simhash_groups(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, row, head): component_id is the smallest doc_id reachable over links.

    row is row_key(). head is the row that stands for the group: the one with the smallest doc_id,
    and of several texts under it the one with the smallest row; a null doc_id comes last.
    """
    marked = materialize(fingerprints(docs, shingle, id_col, text_col))
    distinct = materialize(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")))
    groups = connected_components(fingerprint_links(distinct.select("fp"), radius))
    labelled = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = labelled.groupBy("component").agg(F.min("least").alias("least"))
    roots = labelled.select("fp", "component").join(heads, "component").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("head"))
    return marked.join(roots, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "row", "head")
