"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents go to shards of about the same token volume by hash; a shard is packed on its own, so
packing scales with the number of shards and each loses one unfilled bin of a size at most. Within a
shard pieces are placed longest first: into the open bin that it leaves fullest (best fit), else into
a new bin of the size with the least cost per token that it can be expected to hold: its capacity
plus a fixed cost, over the piece plus what smaller unplaced pieces can still add. At the end every
bin is downsized to the smallest permitted length that holds its contents. A document longer than
the largest length is cut into pieces of that length and one rest.

Edge cases: null and empty texts hold no tokens but their end token; repeated rows (and rows without
an id) are packed each for itself, and dealt to shards like any others by their number; ties go by
(doc_id, piece, number); an empty table gives no bins; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, raw_texts, slices

LENGTHS = (512, 1024, 2048, 4096, 8192)
BIN_COST = 16
SHARD_PIECES = 1 << 16
SCHEMA = "doc_id long, piece int, piece_start long, piece_tokens int, bin_id string, bin_tokens int, bin_used int, bin_offset int"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): white-space words of the whole text plus an end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 16 << 20):
            n = pa.array([len(x.split()) + 1 for x in raw_texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int], list[int]]:
    """Pack sizes given in falling order: (bin of each, offset of each, length of each bin, contents of each bin)."""
    lengths = tuple(sorted(lengths))
    n = len(sizes)
    rising = sizes[::-1]
    volume = np.concatenate(([0], np.cumsum(rising)))
    home, offset, capacity, used = [0] * n, [0] * n, [], []
    free: dict[int, list[int]] = {}  # bins by free space
    spaces: list[int] = []
    for k, size in enumerate(sizes.tolist()):
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            b = free[space].pop()
            if not free[space]:
                del free[space], spaces[at]
        else:
            # pieces not yet placed are the first n - k - 1 in rising order
            best = None
            for c in lengths:
                if c >= size:
                    small = min(int(np.searchsorted(rising, c - size, side="right")), n - k - 1)
                    held = size + min(c - size, int(volume[small]))
                    cost = (c + bin_cost) / held
                    if best is None or cost < best[0]:
                        best = (cost, c)
            b, space = len(capacity), best[1]
            capacity.append(space)
            used.append(0)
        home[k], offset[k] = b, used[b]
        used[b] += size
        if rest := space - size:
            if rest not in free:
                insort(spaces, rest)
                free[rest] = []
            free[rest].append(b)
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return home, offset, final, used


def pack_documents(counts: DataFrame, lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST) -> DataFrame:
    """Bins for (doc_id, n_tokens): one row for each piece of each document."""
    most = max(lengths)
    # rows that repeat are numbered, so that a very frequent one is spread over the shards
    repeated = materialize(counts.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("rows")))
    counts = repeated.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("number"))
    pieces = counts.select("doc_id", "n_tokens", "number", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / most)).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "number", "piece", (F.col("piece").cast("long") * most).alias("piece_start"), F.least(F.lit(most), F.col("n_tokens") - F.col("piece").cast("long") * most).cast("int").alias("piece_tokens"), "n_tokens")
    shards = max(1, -(-(repeated.agg(F.sum(F.col("rows") * (F.floor((F.col("n_tokens") - 1) / most) + 1))).first()[0] or 0) // SHARD_PIECES)) * 4
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "number"), F.lit(shards)))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("piece_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("number", "ascending")])
        home, offset, final, used = pack(t["piece_tokens"].to_numpy().astype(np.int64), lengths, bin_cost)
        shard = key[0].as_py()
        return pa.table(
            {
                "doc_id": t["doc_id"], "piece": t["piece"], "piece_start": t["piece_start"], "piece_tokens": t["piece_tokens"],
                "bin_id": pa.array([f"{shard}-{b}" for b in home], pa.string()), "bin_tokens": pa.array([final[b] for b in home], pa.int32()),
                "bin_used": pa.array([used[b] for b in home], pa.int32()), "bin_offset": pa.array(offset, pa.int32()),
            }
        )

    return pieces.drop("n_tokens").groupBy("shard").applyInArrow(run, SCHEMA)
