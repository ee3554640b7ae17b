"""Substring dedup: windows of words that start anywhere else, found with FM-indexes.

1. Each window of WINDOW words has an anchor: the leftmost of its GRAM-word grams with the least
   hash. Consecutive windows with one anchor place form a segment (62 words at most). Equal windows
   have equal anchor hashes, and two windows of one segment differ, so only segments whose anchor
   hash occurs again can hold a repeated window; the others are dropped before any text moves.
2. Equal segments are merged with their count; all windows of a segment that occurs twice are
   repeated. Segments are equal if a 128-bit digest of their words' bytes is: two sums over two
   independent 64-bit hashes of each word's bytes, of which one is exact for words of up to 8 bytes.
3. Where an anchor has several distinct segments, their words are fetched. The segments go to shards by anchor hash, so equal windows meet in one shard. A shard
   builds an FM-index: a suffix array by prefix doubling, its transform in a wavelet matrix of packed
   bits with popcount ranks. All windows' ends of the segments that occur once are searched backwards
   in lockstep; the matching statistic of an end is the number of words, up to the window, that still
   occur twice in the shard. Ends that reach the window report it.
4. An anchor with more than HOT_SEGMENTS distinct segments (text around a very common passage) would
   overfill a shard. Its segments are cut into single windows, counted by 128-bit digest with map-side
   sums, and so spread over the cluster.

Edge cases: a null text has no words; a text shorter than a window loses nothing; repeated rows are
documents of their own, so all their windows repeat; a text of any length is cut whole; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _powers, discard, materialize, mix64, raw_texts, row_key, scan_words, slices, word_hashes

WINDOW = 35
GRAM = 8
SHARD_SEGMENTS = 6000
HOT_SEGMENTS = 3000
BLOCK_WORDS = 1 << 23
#: Keys that hold more than one in so many rows meet their partners by broadcast; there are at most so many of them.
HOT_KEYS = 1000
SECOND_SEED = 0x5EED
SCHEMA = "row binary, doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
_LOW = np.uint64((1 << 24) - 1)


def find_segments(hashes: np.ndarray, counts: np.ndarray, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK_WORDS, second: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, first word in it, windows, anchor hash, two hashes of all words) of each segment of many texts' words.

    second holds other hashes of the words, for the second of the two.

    More words than a block are taken block by block, each window in the block where it starts, so
    that places fit the low bits of _LOW; a segment on such a border is cut in two.
    """
    n, ends = len(hashes), np.cumsum(counts)
    second = hashes if second is None else second
    if n <= block:
        return _block_segments(hashes, second, counts, window, gram)
    found = []
    for a in range(0, n, block):
        b = min(n, a + block + window - 1)
        inside = np.clip(ends, a, b) - np.clip(ends - counts, a, b)
        text, first, *others = _block_segments(hashes[a:b], second[a:b], inside, window, gram)
        found.append((text, first + np.maximum(a - (ends - counts)[text], 0), *others))
    return tuple(np.concatenate(x) for x in zip(*found))


def _block_segments(hashes: np.ndarray, second: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(hashes)
    ends = np.cumsum(counts)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    if n < window:
        return none
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams += hashes[j : n - gram + 1 + j] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64))
    grams = mix64(grams)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    reach, wide = window - gram + 1, 1
    while wide * 2 <= reach:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < reach:
        least = np.minimum(least[: len(least) - (reach - wide)], least[reach - wide :])
    owner = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + window <= ends[owner])
    if not len(start):
        return none
    place = (least[start] & _LOW).astype(np.int64)
    fresh = np.concatenate(([True], (np.diff(start) != 1) | (np.diff(place) != 0)))
    at = np.flatnonzero(fresh)
    first = start[at]
    windows = np.diff(np.concatenate((at, [len(start)])))
    up, down = _powers(n + 1)
    last, digest = first + windows + window - 1, np.empty((len(first), 2), np.uint64)
    for k, words in enumerate((hashes, second)):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=total[1:])
        digest[:, k] = mix64((total[last] - total[first]) * down[first] + windows.astype(np.uint64))
    return owner[first], first - (ends - counts)[owner[first]], windows, grams[place[at]], digest


def _cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, first, windows, anchor, digest) of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            hashes, start, end, counts, joined = scan_words(raw_texts(batch.column(1)))
            text, first, windows, anchor, digest = find_segments(hashes, counts, window, gram, second=word_hashes(joined, start, end, SECOND_SEED))
            row = batch.column(0).take(pa.array(text))
            cols = first.astype(np.int32), windows.astype(np.int32), anchor.view(np.int64)
            offsets = pa.py_buffer(np.arange(0, 16 * len(text) + 1, 16, dtype=np.int32))
            both = pa.Array.from_buffers(pa.binary(), len(text), [None, offsets, pa.py_buffer(digest.tobytes())])
            yield pa.RecordBatch.from_arrays([row, *map(pa.array, cols), both], ["row", "first", "windows", "anchor", "digest"])

    return docs.select("row", "text").mapInArrow(run, "row binary, first int, windows int, anchor long, digest binary")


def _bodies(docs: DataFrame, window: int) -> DataFrame:
    """The words of the segments listed in `parts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            cols = [], [], [], [], [], [], []
            for row, raw, parts in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                words = raw.split()
                for p in parts:
                    body = b" ".join(words[p["first"] : p["first"] + p["windows"] + window - 1])
                    for c, x in zip(cols, (row, p["first"], p["windows"], p["anchor"], p["n"], p["kinds"], body)):
                        c.append(x)
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "first", "windows", "anchor", "n", "kinds", "body"])

    return docs.select("row", "text", "parts").mapInArrow(run, "row binary, first int, windows int, anchor long, n long, kinds long, body binary")


class WaveletMatrix:
    """Ranks over a sequence of small integers: one packed bit row and its popcounts for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, n = bits, [], len(sequence)
        for level in range(bits - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 - n % 64, bool))), bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
            self.levels.append((level, packed, before, n - int(bit.sum())))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefixes of length `at` end up after each level's partition by the symbol's bits."""
        for level, packed, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Counts occurrences of words sequences by backward search. Sorted by `depth` symbols, so patterns may have up to that many."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n, span = len(sequence), 1
        rank = sequence.astype(np.int64)
        while True:
            later = np.zeros(n, np.int64)
            later[: max(0, n - span)] = rank[span:] + 1
            key = rank * (int(later.max(initial=0)) + 1) + later
            order = np.argsort(key, kind="stable")
            steps = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = steps
            span *= 2
            if span >= depth or steps[-1] == n - 1:
                break
        top = int(sequence.max(initial=0)) + 1
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=top))))
        self.matrix = WaveletMatrix(sequence[order - 1].astype(np.int64), max(1, top.bit_length()))
        self.base = self.matrix.descend(np.arange(top), np.zeros(top, np.int64))
        self.size = n

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns with one more symbol in front."""
        both = self.matrix.descend(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        shift = self.starts[symbols] - self.base[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift


def matching_statistics(index: FMIndex, sequence: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """For each position of the sequence in `ends`: how many symbols up to it, at most limit, occur twice in the index."""
    length = np.zeros(len(ends), np.int64)
    lane, low, high = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), index.size, np.int64)
    for step in range(limit):
        low, high = index.extend(sequence[ends[lane] - step], low, high)
        live = high - low >= 2
        lane, low, high = lane[live], low[live], high[live]
        if not len(lane):
            break
        length[lane] = step + 1
    return length


def shard_windows(bodies: list[bytes], windows: np.ndarray, once: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window in it) of the windows of segments marked `once` that also occur in the shard's other segments."""
    ids: dict[bytes, int] = {}
    symbols, begins = [], []
    for body in bodies:
        begins.append(len(symbols))
        symbols.extend(ids.setdefault(w, len(ids) + 1) for w in body.split(b" "))
        symbols.append(0)
    sequence = np.array(symbols, np.int64)
    begins = np.array(begins, np.int64)
    index = FMIndex(sequence, window + 1)
    picked = np.flatnonzero(once)
    segment = np.repeat(picked, windows[picked])
    number = np.arange(len(segment)) - np.repeat(np.cumsum(windows[picked]) - windows[picked], windows[picked])
    found = matching_statistics(index, sequence, begins[segment] + number + window - 1, window) >= window
    return segment[found], number[found]


def _search(t: pa.Table, window: int) -> pa.Table:
    windows, n = t["windows"].to_numpy().astype(np.int64), t["n"].to_numpy()
    segment, number = shard_windows(t["body"].to_pylist(), windows, n == 1, window)
    return pa.table({"row": t["row"].combine_chunks().take(pa.array(segment)), "first": (t["first"].to_numpy()[segment] + number).astype(np.int32), "windows": np.ones(len(segment), np.int32)})


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row, spans): runs (first, windows) of repeated windows of each row that has some. docs: row, text."""
    segments = materialize(_cut(docs, window, gram))
    again = materialize(segments.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"))
    placed = materialize(segments.join(again, "anchor"))
    discard(segments, again)
    unique = materialize(placed.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "windows")).alias("at")))
    # segments that occur twice: every window of every occurrence
    twice = unique.where("n > 1")
    most = placed.count() // HOT_KEYS + 1
    hot_keys = F.broadcast(twice.where(F.col("n") > most).select("anchor", "digest", F.lit(True).alias("hot")))  # HOT_KEYS rows at most
    marked = placed.join(hot_keys, ["anchor", "digest"], "left")
    few = materialize(twice.where(F.col("n") <= most).select("anchor", "digest"))
    spans = marked.where("hot").select("row", "first", "windows").unionByName(marked.where("hot is null").join(few, ["anchor", "digest"]).select("row", "first", "windows"))
    # segments that occur once: their shard's index tells, if their anchor has other segments
    per = unique.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("rarest"))
    mixed = unique.join(per.where((F.col("kinds") > 1) & (F.col("rarest") == 1)), "anchor")
    asked = mixed.groupBy(F.col("at.row").alias("row")).agg(F.collect_set(F.struct("at.first", "at.windows", "anchor", "n", "kinds")).alias("parts"))
    # texts move by shuffle at every size, so that a small input behaves as a large one; of repeated rows one moves
    bodies = materialize(_bodies(docs.dropDuplicates(["row"]).join(asked.hint("merge"), "row"), window))
    shards = max(1, bodies.count() // SHARD_SEGMENTS)
    cool = bodies.where(F.col("kinds") <= HOT_SEGMENTS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = cool.select("shard", "row", "first", "windows", "n", "body").groupBy("shard").applyInArrow(lambda t: _search(t, window), "row binary, first int, windows int")
    # hot anchors: single windows, counted by digest
    words = F.split(F.col("body").cast("string"), " ", -1)
    hot = bodies.where(F.col("kinds") > HOT_SEGMENTS).select("row", "first", "n", words.alias("words"), F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("number"))
    single = hot.select("row", (F.col("first") + F.col("number")).alias("first"), "n", F.unhex(F.md5(F.array_join(F.slice("words", F.col("number") + 1, window), " ").cast("binary"))).alias("digest"))
    # written, so that the join below reads plain exchanges, whose hot keys Spark can split
    often = materialize(single.groupBy("digest").agg(F.sum("n").alias("times")).where("times > 1").select("digest"))
    wide = single.where("n = 1").join(often, "digest").select("row", "first", F.lit(1).alias("windows"))
    runs = spans.unionByName(found).unionByName(wide)
    grouped = materialize(runs.groupBy("row").agg(F.collect_set(F.struct("first", "windows")).alias("spans")))
    discard(placed, unique, few, bodies, often)
    return grouped


def _without(docs: DataFrame, window: int) -> DataFrame:
    """docs (doc_id, text, spans) without the words that the spans' windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 8 << 20):
            rows = []
            for row, ident, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), batch.column(3).to_pylist()):
                words, kept, at = raw.split(), [], 0
                for s in sorted((s["first"], s["first"] + s["windows"] + window - 1) for s in spans or ()):
                    kept += words[at : s[0]] if s[0] > at else []
                    at = max(at, s[1])
                kept += words[at:]
                body = b" ".join(kept)
                rows.append((row, ident, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["row", "doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return docs.mapInArrow(run, SCHEMA)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_removed, kept_sha256, text) of each document; row is row_key(), text the kept words joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row"))
    grouped = repeated_windows(rows.select("row", "text"), window, gram)
    return _without(rows.join(grouped.hint("merge"), "row", "left").select("row", "doc_id", "text", "spans"), window)
