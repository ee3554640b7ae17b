"""Line dedup: content-defined chunks of lines, repeated ones removed after byte comparison.

A chunk ends after a line where a rolling hash over the last ROLL line hashes is 0 modulo DIVISOR and
that isn't the chunk's only line. The place depends on those lines and on where the chunk began, so
boundaries are the same again soon after lines that were inserted or removed. Chunks of two lines or more whose hash occurs again anywhere are compared byte by byte;
of each set of equal chunks the first by (doc_id, position) stays, the others go. A passage that two
otherwise different documents share loses the chunks that lie inside it: on average 9 % of its lines if it
has 3 lines, 23 % of 5, 43 % of 8, 61 % of 12, 76 % of 20, 88 % of 40 (simulated; the rest are its ends).

Edge cases: a null text is empty, and an empty text has one empty line; rows that repeat both id and
text count as one document and get one result; a text of any length is cut whole; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.common import materialize, raw_texts, row_key, slices

ROLL = 2
DIVISOR = 2
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
SCHEMA = "row binary, doc_id long, n_lines long, n_removed long, kept_sha256 string, text string"


def cut_lines(lines: list[bytes], roll: int = ROLL, divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """Chunks [first line, line after the last) of a document."""
    out, begin, recent = [], 0, []
    for i, line in enumerate(lines):
        recent.append(xxh64_intdigest(line))
        if len(recent) > roll:
            del recent[0]
        rolled = 0
        for h in recent:
            rolled = (rolled * _MULTIPLIER + h) & _MASK
        if (rolled >> 40) % divisor == 0 and i > begin:
            out.append((begin, i + 1))
            begin = i + 1
    if begin < len(lines):
        out.append((begin, len(lines)))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _chunks(docs: DataFrame) -> DataFrame:
    """(row, line, hash) of each chunk of two lines or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 8 << 20):
            rows, at, hashes = [], [], []
            for row, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                lines = raw.split(b"\n")
                if len(lines) > 1:
                    for a, b in cut_lines(lines):
                        if b - a > 1:
                            rows.append(row)
                            at.append(a)
                            hashes.append(_signed(xxh64_intdigest(b"\n".join(lines[a:b]))))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(at, pa.int32()), pa.array(hashes, pa.int64())], ["row", "line", "hash"])

    return docs.select("row", "text").mapInArrow(run, "row binary, line int, hash long")


def _chunk_bytes(docs: DataFrame) -> DataFrame:
    """(hash, bytes, doc_id, row, line) of the chunks that begin at the lines listed in `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 8 << 20):
            rows = []
            for ident, row, raw, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), batch.column(3).to_pylist()):
                lines, wanted = raw.split(b"\n"), set(at)
                for a, b in cut_lines(lines):
                    if a in wanted:
                        body = b"\n".join(lines[a:b])
                        rows.append((_signed(xxh64_intdigest(body)), body, ident, row, a))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["hash", "body", "doc_id", "row", "line"])

    return docs.select("doc_id", "row", "text", "at").mapInArrow(run, "hash long, body binary, doc_id long, row binary, line int")


def _without(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 8 << 20):
            rows = []
            for row, ident, raw, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), batch.column(3).to_pylist()):
                lines = raw.split(b"\n")
                n, kept = len(lines), raw
                if at:
                    gone = set(at)
                    lines = [x for a, b in cut_lines(lines) if a not in gone for x in lines[a:b]]
                    kept = b"\n".join(lines)
                rows.append((row, ident, n, n - len(lines), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["row", "doc_id", "n_lines", "n_removed", "kept_sha256", "text"])

    return docs.select("row", "doc_id", "text", "at").mapInArrow(run, SCHEMA)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(row, at): for each row that loses chunks, the first lines of those chunks. docs: doc_id, text, row."""
    chunks = materialize(_chunks(docs))
    # written, so that the join below reads plain exchanges, whose hot keys Spark can split
    again = materialize(chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    found = materialize(chunks.join(again, "hash").select("row", "line"))
    candidates = found.distinct()
    asked = candidates.groupBy("row").agg(F.collect_list("line").alias("at"))
    # texts move by shuffle at every size, so that a small input behaves as a large one; of repeated rows one moves
    bodies = _chunk_bytes(docs.dropDuplicates(["row"]).join(asked.hint("merge"), "row"))
    first = bodies.groupBy("hash", "body").agg(F.min(F.struct("doc_id", "row", "line")).alias("first")).select("first.row", "first.line")
    # written, so that the join with all rows reads plain exchanges, whose repeated rows Spark can split
    return materialize(candidates.join(first, ["row", "line"], "left_anti").groupBy("row").agg(F.collect_list("line").alias("at")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_lines, n_removed, kept_sha256, text): each document without the repeated chunks that are not the first; row is row_key()."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row"))
    return _without(rows.join(repeated_chunks(rows).hint("merge"), "row", "left"))
