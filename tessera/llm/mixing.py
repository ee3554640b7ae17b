"""LM scoring by online logistic context mixing, over bits of words and bits of bytes.

A text is its lower-cased words and one end token. It is coded, left to right, by binary decisions:

1. Match model. Places where a hash of the last MATCH_WORDS words is 0 modulo MATCH_STEP cut a text into
   blocks, of any other training document too. Where such words occur in other training documents, one
   decision says whether the same block follows again; its probability adapts to how such decisions
   went before in this document. If so, the block costs its share of the blocks seen after those words.
2. Every word of any other block: known in training or not. The probability adapts in the document.
3. A known word: the CLASS_BITS bits of a hash of it, one after the other, each predicted from counts
   of the bits so far on their own, after the last word, after the last two words, and in this document
   so far. The stretched probabilities are mixed by weights that are gated by the place of the bit and
   by how often two of the contexts were seen, refined by an adaptive probability map. The weights keep
   learning while a document is scored, after each CHUNK of words, from where training left them. Then
   the word within its class: its exact count among the class's, adapted to the document's words.
4. An unknown word: spelled by the bits of its bytes, predicted by hashed contexts (the last 1, 2, 3 and
   5 bytes of the word so far, and all of it) and mixed in the same way, or one of the document's own.

The probabilities of all texts sum to 1 at most. Word counts and blocks cover all training documents and are
kept as tables that grow with them; only words above a count that at most TOP_WORDS words reach are
broadcast, and all others are joined, with the same scores. The hashed contexts have tables of a fixed size, counted over all
training words and documents; the weights of step 3 learn from all training documents, those of step 4
from all training words, each task from its own, averaged by volume.
A training document's own blocks don't count for itself; its words and bits do.

Edge cases: null and empty texts have the end token alone; a null doc_id counts as the id ""; repeated
rows are rows of their own with equal scores, and one document to the match model; with no training documents N is 0
and all counts are 0; a text of any length is scored whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _powers, hot_join, materialize, mix64, raw_texts, row_key, scan_words, slices, word_hashes
from tessera.llm.spelling import END, SLOTS, Mixer, count_bits

CLASS_BITS = 8
TABLE_BITS = (CLASS_BITS, 19, 20)  # of the bits on their own, after one word, after two
CHUNK = 128
ONLINE_RATE = 0.004
LEARN_BATCH = 1 << 14
COUNT_BATCH = 1 << 15
MATCH_WORDS = 6
MATCH_STEP = 16
#: How many words the training counts weigh against the document's own, within a class and among unknown words.
CLASS_STRENGTH = 10.0
UNKNOWN_STRENGTH = 100.0
ESCAPE_STRENGTH = 20.0
TOP_WORDS = 1 << 18
FLUSH_WORDS = 1 << 18
#: Bytes of text that a task works on at a time: arrays over its tokens take about 50 times as many. Learning takes
#: LEARN_BYTES, as its pace starts anew with each.
SLICE_BYTES = 1 << 20
LEARN_BYTES = 4 << 20
COUNTED_WORDS = 1 << 16
TYPES_PER_TASK = 500_000
TOKENS_PER_TASK = 1 << 24
BLOCK = 1 << 13
MERGED = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEEP = np.uint64(0xD6E8FEB86659FD93)
_FAR = np.arange(1 << CLASS_BITS, dtype=np.uint64) * _ODD * _STEEP
_STARTS = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS])))
CLASS_SLOTS = int(_STARTS[-1])
END_HASH = word_hashes(END, np.array([0]), np.array([1]))[0]


def is_held_out(doc_id: int | None) -> bool:
    """Whether the crc32 of the id as text is 0 modulo 10."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hash of each word, as in a Stream."""
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return word_hashes(b"".join(words), np.concatenate(([0], end[:-1])) if len(words) else end, end)


def running_rank(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """How many came before each one in its group: order sorts by group and time, fresh marks the first of each group."""
    at = np.arange(len(order), dtype=np.int32)
    rank = np.empty(len(order), np.int32)
    rank[order] = at - np.maximum.accumulate(at * fresh)
    return rank


class Stream:
    """The tokens of many texts: each text's words and one end token, with hashes of what comes before."""

    def __init__(self, texts: list[bytes]):
        hashes, start, end, counts, self.joined = scan_words(texts, lower=True)
        self.docs, self.sizes = len(texts), counts + 1
        n = int(self.sizes.sum())
        self.doc = np.repeat(np.arange(self.docs), self.sizes)
        self.place = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.is_end = self.place == self.sizes[self.doc] - 1
        self.hash = np.full(n, END_HASH)
        self.hash[~self.is_end] = hashes
        self._bounds = start, end

    @cached_property
    def last(self) -> np.ndarray:
        """The hash of the token before, 0 where there is none."""
        last = np.concatenate((self.hash[:1], self.hash[:-1]))
        last[self.place == 0] = 0
        return last

    @cached_property
    def one(self) -> np.ndarray:
        """A hash of the last token."""
        return mix64(self.last + np.uint64(1))

    @cached_property
    def two(self) -> np.ndarray:
        """A hash of the last two tokens."""
        before = np.concatenate((self.last[:1], self.last[:-1]))
        before[self.place < 2] = 0
        return mix64((self.last + np.uint64(1)) * _ODD + before)

    def by_word(self) -> np.ndarray:
        """The order by document, word and place."""
        n = len(self.hash)
        low, high = n.bit_length(), self.docs.bit_length()
        kept = 64 - low - high  # bits of the hash between document and place: such keys are sorted faster than an order is found
        if kept < 16:
            return np.lexsort((self.hash, self.doc))
        keys = self.doc.astype(np.uint64) << np.uint64(64 - high) | self.hash >> np.uint64(64 - kept) << np.uint64(low) | np.arange(n, dtype=np.uint64)
        keys.sort()
        order = (keys & np.uint64((1 << low) - 1)).astype(np.int64)
        keys >>= np.uint64(low)
        clash = (np.diff(self.hash[order]) != 0) & (np.diff(keys) == 0)  # two words of one document that the keys don't tell apart
        return np.lexsort((self.hash, self.doc)) if clash.any() else order

    def words(self, at: np.ndarray) -> list[bytes]:
        """The bytes of tokens."""
        joined, ends, (start, end) = self.joined, self.is_end[at], self._bounds
        word = (at - self.doc[at])[~ends]  # each document before has one end token more than words
        found = [joined[a:b] for a, b in zip(start[word].tolist(), end[word].tolist())]
        for k in np.flatnonzero(ends).tolist():
            found.insert(k, END)
        return found

    def classes(self) -> np.ndarray:
        """The class of each token: the first bits of its hash."""
        return (self.hash >> np.uint64(64 - CLASS_BITS)).astype(np.int64)

    def grams(self) -> np.ndarray:
        """A hash of the MATCH_WORDS tokens up to each one."""
        gram = np.zeros(len(self.hash), np.uint64)
        for k in range(min(MATCH_WORDS, len(gram))):
            gram[k:] += self.hash[: len(gram) - k] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        return mix64(gram)

    def blocks(self) -> tuple[np.ndarray, ...]:
        """(document, first token, token after the last, hash of the words before, hash of the block) of each block."""
        n, gram = len(self.hash), self.grams()
        cut = np.flatnonzero((self.place >= MATCH_WORDS - 1) & ~self.is_end & (gram % np.uint64(MATCH_STEP) == 0))
        doc = self.doc[cut]
        stop = np.cumsum(self.sizes)[doc]
        if len(cut) > 1:
            stop[:-1] = np.where(doc[1:] == doc[:-1], cut[1:] + 1, stop[:-1])
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=total[1:])
        body = mix64((total[stop] - total[cut + 1]) * down[cut + 1] + (stop - cut).astype(np.uint64))
        return doc, cut + 1, stop, gram[cut], body


def class_slots(classes: np.ndarray, one: np.ndarray, two: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bit of each class at a level, and its slots on its own, after the last word and after the last two."""
    return _steep_slots(classes, one * _STEEP, two * _STEEP, level)


def _steep_slots(classes: np.ndarray, one: np.ndarray, two: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """class_slots() of hashes that were multiplied by _STEEP, once for all levels."""
    node = ((1 << level) | (classes >> (CLASS_BITS - level))).astype(np.int64)
    bit = (classes >> (CLASS_BITS - 1 - level)) & 1
    far, out = _FAR.take(node), []
    for c, b, o in zip((one, two), TABLE_BITS[1:], _STARTS[1:]):
        slot = c + far
        slot >>= np.uint64(64 - b)
        slot += np.uint64(o)
        out.append(slot.view(np.int64))
    return bit, node, *out


def count_classes(stream: Stream, pick: np.ndarray, table: np.ndarray) -> None:
    """Add the class bits of the picked tokens to the table [CLASS_SLOTS, 2]."""
    classes, one, two = stream.classes()[pick].astype(np.uint8), stream.one[pick] * _STEEP, stream.two[pick] * _STEEP
    flat, unit = table.reshape(-1), table.dtype.type(1)
    for j in range(CLASS_BITS):
        bit, *slots = _steep_slots(classes, one, two, j)
        alone = 2 << CLASS_BITS
        for slot in slots:
            slot *= 2
            slot += bit
        flat[:alone] += np.bincount(slots[0], minlength=alone).astype(table.dtype)
        for slot in slots[1:]:
            np.add.at(flat, slot, unit)


_LOG = np.log(np.arange(1 << 12) + 0.3).astype(np.float32)
_SIGN = np.array([-1, 1], np.float32)
_CONFIDENCE = np.minimum(np.log2(np.arange(1 << 12) + 1), 7).astype(np.int64)


def local_counts(doc: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
    """For each level: how many earlier tokens of the document share the first bits of the class."""
    out = [np.empty(len(doc), np.int32) for _ in range(CLASS_BITS + 1)]
    classes = classes.astype(np.uint8)
    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))[: len(doc)])
    # some documents at a time, which fit a core's cache
    cuts = heads[np.concatenate(([True], np.diff(heads // COUNT_BATCH) != 0))[: len(heads)]].tolist()
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        _local_counts(doc[a:b], classes[a:b], [x[a:b] for x in out])
    return out


def _local_counts(doc: np.ndarray, classes: np.ndarray, out: list[np.ndarray]) -> None:
    """local_counts() of one document or more. Of two levels that follow each other one needs no order of its own: ones among the next bits are summed up."""
    n = len(doc)
    at, fresh = np.arange(n, dtype=np.int32), np.ones(n, bool)
    number = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])), dtype=np.int32)
    for level in range(0, CLASS_BITS + 1, 2):
        if level:
            prefix = classes >> (CLASS_BITS - level)  # bytes are sorted in one pass
            order = np.argsort(prefix, kind="stable")
            group = number.take(order)  # rises within a prefix: a group ends where it changes, or the prefix does
            starts = np.cumsum(np.bincount(prefix, minlength=1 << level)[:-1])
        else:
            order, group, starts = slice(None), number, at[:0]
        np.not_equal(group[1:], group[:-1], out=fresh[1:])
        fresh[starts[starts < n]] = True
        before = at - np.maximum.accumulate(at * fresh)
        out[level][order] = before
        if level < CLASS_BITS:
            bit = (classes[order] >> (CLASS_BITS - 1 - level)) & 1
            total = np.cumsum(bit, dtype=np.int32)
            total -= bit
            ones = total - np.maximum.accumulate(total * fresh)
            out[level + 1][order] = np.where(bit, ones, before - ones)


class ClassMixer:
    """Mixes the predictions of class bits: gated weights and an adaptive probability map over context counts."""

    INPUTS = 4
    GATES = CLASS_BITS * 64
    CELLS = 33

    def __init__(self, table: np.ndarray | None, others: tuple[np.ndarray, np.ndarray] | None = None):
        self.table, self.others = table, others  # to learn, what without_own() made of the table is enough
        self.weights = np.full((self.GATES, self.INPUTS), 0.3)
        self.map = np.tile(1 / (1 + np.exp(-(np.arange(self.CELLS) - 16) / 2.0)), (self.GATES, 1))
        self.seen = np.full((self.GATES, self.CELLS), 30.0)
        self.inputs = self.confidence = None

    def without_own(self) -> tuple[np.ndarray, np.ndarray]:
        """For each slot and bit: the stretched probability and the confidence from all counts but one of that bit."""
        if self.others is None:
            n, fifth, step = np.asarray(self.table, np.float32), np.float32(0.2), 1 << 16
            inputs, sure = np.empty(n.shape, np.float32), np.empty(n.shape, np.uint8)
            for a in range(0, len(n), step):  # in parts, to take little memory
                zeros, ones = n[a : a + step].T
                for bit in (0, 1):
                    n0, n1 = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
                    inputs[a : a + step, bit] = np.log((n1 + fifth) / (n0 + fifth))
                    sure[a : a + step, bit] = np.minimum(np.log2(n0 + n1 + 1) / 2, 7).astype(np.uint8)
            self.others = inputs.ravel(), sure.ravel()
        return self.others

    @staticmethod
    def stretch(counts: np.ndarray) -> np.ndarray:
        """Stretched probability of a one for counts [.., 2]."""
        return np.log((counts[..., 1] + 0.2) / (counts[..., 0] + 0.2))

    @staticmethod
    def local(bit: np.ndarray, before: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretched probability, confidence) of a bit from the document's own counts: tokens at the node, and with the same bit."""
        before, same = np.minimum(before, len(_LOG) - 1), np.minimum(same, len(_LOG) - 1)
        out = _LOG.take(same)
        before -= same  # a copy
        out -= _LOG.take(before)
        before += same
        out *= _SIGN.take(bit)
        return out, _CONFIDENCE.take(before)

    def learn(self, stream: Stream, pick: np.ndarray, rate: float = 0.02, batch: int = LEARN_BATCH) -> None:
        """One online pass over the picked tokens in order; a token's own counts are left out."""
        classes, one, two = stream.classes()[pick].astype(np.uint8), stream.one[pick] * _STEEP, stream.two[pick] * _STEEP
        near = local_counts(stream.doc[pick], classes)
        inputs, confidence = self.without_own()
        gates = self.GATES // CLASS_BITS
        cells = gates * self.CELLS
        weights = np.ascontiguousarray(self.weights.T)
        for a in range(0, len(pick), batch):
            part = slice(a, a + batch)
            k, c1, c2 = classes[part], one[part], two[part]
            before = near[0][part]
            for j in range(CLASS_BITS):  # each level has gates of its own
                level = slice(j * gates, (j + 1) * gates)
                bit, *slots = _steep_slots(k, c1, c2, j)
                ones = bit.astype(np.float32)
                st = np.empty((self.INPUTS, len(k)), np.float32)
                for i, slot in enumerate(slots):
                    slot *= 2
                    slot += bit
                    inputs.take(slot, out=st[i], mode="clip")
                same = near[j + 1][part]
                st[-1], gate = self.local(bit, before, same)
                before = same
                sure = confidence.take(slots[1])
                sure *= 8  # 56 at most
                gate += sure
                share = weights[:, level].astype(np.float32).take(gate, axis=1)
                share *= st
                mixed = share.sum(axis=0)
                np.minimum(np.maximum(mixed, -15, out=mixed), 15, out=mixed)
                err = ones - 1 / (1 + np.exp(-mixed))
                pace = rate / np.maximum(1, np.sqrt(np.bincount(gate, minlength=gates)))
                st *= err
                for i in range(self.INPUTS):
                    weights[i, level] += pace * np.bincount(gate, st[i], gates)
                gate *= self.CELLS
                gate += self.cells(mixed)
                found = np.bincount(gate + bit * np.int64(cells), minlength=2 * cells).reshape(2, gates, self.CELLS)
                seen, n = self.seen[level], found[0] + found[1]
                self.map[level] = (self.map[level] * seen + found[1]) / (seen + n)
                seen += n
            rate = max(0.003, rate * 0.98)
        self.weights = weights.T.copy()

    def cells(self, mixed: np.ndarray) -> np.ndarray:
        """The cell of the probability map of each mixed prediction, which is used up."""
        mixed *= 2
        np.rint(mixed, out=mixed)
        mixed += 16
        return np.minimum(np.maximum(mixed, 0, out=mixed), self.CELLS - 1, out=mixed).astype(np.int64)

    learned = Mixer.learned
    take_over = Mixer.take_over

    def freeze(self) -> None:
        """Turn counts into the numbers that scoring needs."""
        self.inputs = self.stretch(self.table).astype(np.float32)
        self.confidence = np.minimum(np.log2(self.table.sum(axis=1) + 1) / 2, 7).astype(np.uint8)
        self.table = self.others = None
        self.map = np.clip(self.map, 1e-6, 1 - 1e-6).astype(np.float32)

    def log_bits(self, stream: Stream, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(natural logarithm of the probability of its class bits, earlier tokens of that class) of each picked token; weights learn within each document."""
        classes, one, two, doc = stream.classes()[pick].astype(np.uint8), stream.one[pick] * _STEEP, stream.two[pick] * _STEEP, stream.doc[pick]
        near = local_counts(doc, classes)
        out, weights, flat = np.zeros(len(pick)), np.ascontiguousarray(self.weights.T.astype(np.float32)), self.map.reshape(-1)
        moved = np.zeros((self.INPUTS, stream.docs), np.float32)
        step = (near[0] // CHUNK).astype(np.uint32)
        order = np.argsort(step, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(step[order])) + 1, [len(order)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = order[a:b]
            k, c1, c2, d = classes[at], one[at], two[at], doc[at]
            begin = np.flatnonzero(np.concatenate(([True], np.diff(d) != 0)))  # a step's tokens lie document by document
            own = moved.take(d, axis=1)
            total, slope = np.ones(b - a), np.zeros((self.INPUTS, len(begin)), np.float32)
            before, st = near[0][at], np.empty((self.INPUTS, b - a), np.float32)
            for j in range(CLASS_BITS):
                bit, *slots = _steep_slots(k, c1, c2, j)
                same = near[j + 1][at]
                st[-1], sure = self.local(bit, before, same)
                before = same
                for i, slot in enumerate(slots):
                    self.inputs.take(slot, out=st[i], mode="clip")
                gate = sure  # of its own
                seen = self.confidence.take(slots[1])
                seen *= 8  # 56 at most
                gate += seen
                gate += j * 64
                share = weights.take(gate, axis=1)
                share += own
                share *= st
                mixed = share.sum(axis=0)
                np.minimum(np.maximum(mixed, -15, out=mixed), 15, out=mixed)
                ones = bit.astype(np.float32)
                p = 1 / (1 + np.exp(-mixed))
                st *= ones - p
                slope += np.add.reduceat(st, begin, axis=1)
                gate *= self.CELLS
                gate += self.cells(mixed)
                p += flat.take(gate)
                p *= 0.5
                ones += p
                ones -= 1
                total *= np.abs(ones, out=ones)  # CLASS_BITS factors of 1e-7 or more
            out[at] = np.log(total)
            moved[:, d[begin]] += ONLINE_RATE * slope
        return out, near[CLASS_BITS]


def _tokens(docs: DataFrame) -> DataFrame:
    """(word, c) of all documents, with map-side sums; c counts training documents alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in slices(batches, 1, SLICE_BYTES):
            for ident, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                words = raw.lower().split()
                if is_held_out(ident):
                    counts.update(dict.fromkeys((*words, END), 0))
                else:
                    counts.update(words)
                    counts[END] += 1
            if len(counts) >= FLUSH_WORDS:
                yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def added(parts: DataFrame, tasks: int, size: int) -> np.ndarray:
    """The sum of arrays that tasks gave as rows (part, block, body): MERGED by MERGED, so that no task gets all of a block's."""

    def merge(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in t["body"])
        return pa.table({"part": pa.array([t["part"][0].as_py() // MERGED], pa.int64()), "block": t["block"].slice(0, 1), "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while True:
        parts = parts.groupBy("block", F.floor(F.col("part") / MERGED)).applyInArrow(merge, "part long, block int, body binary")
        tasks = -(-tasks // MERGED)
        if tasks <= 1:
            break
        parts = materialize(parts)
    blocks, out = parts.select("block", "body").toArrow(), np.zeros(size, np.float32)  # one row a block: a fixed size
    for k, body in zip(blocks["block"].to_pylist(), blocks["body"].to_pylist()):
        out[k * BLOCK : k * BLOCK + len(body) // 4] = np.frombuffer(body, np.float32)
    return out


def emitted(numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of an array for added()."""
    numbers = numbers.ravel()
    for k in range(0, len(numbers), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([k // BLOCK], pa.int32()), pa.array([numbers[k : k + BLOCK].astype(np.float32).tobytes()], pa.binary())], ["part", "block", "body"])


EMITTED = "part long, block int, body binary"


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Words of column 0, many at a time: each call on them walks a whole table."""
    words: list[bytes] = []
    for batch in batches:
        words += batch.column(0).to_pylist()
        if len(words) >= COUNTED_WORDS:
            yield words
            words = []
    if words:
        yield words


def train_spelling(words: DataFrame, types: int) -> Mixer:
    """A mixer for spelled words that learned from all training words, each task from its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for some in _word_batches(batches):
            table = np.zeros((2, SLOTS), np.int32) if table is None else table
            count_bits(some, table)
        if table is not None:
            yield from emitted(table)

    tasks = max(1, -(-types // TYPES_PER_TASK))
    dealt = words.select("word").repartition(tasks, "word")
    mixer = Mixer(added(dealt.mapInArrow(count, EMITTED), tasks, 2 * SLOTS).reshape(2, SLOTS))
    shared = words.sparkSession.sparkContext.broadcast(np.ascontiguousarray(mixer.table.T))  # as learning looks it up

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Mixer(shared.value.T), 0
        for some in _word_batches(batches):
            own.learn(some)
            n += len(some)
        if n:
            yield from emitted(own.learned(n))

    size = len(mixer.learned(0))
    mixer.take_over(added(dealt.sortWithinPartitions("word").mapInArrow(learn, EMITTED), tasks, size).astype(np.float64))
    shared.unpersist()
    mixer.freeze()
    return mixer


def _training(stream: Stream, idents: list) -> np.ndarray:
    """The tokens of the training documents."""
    return np.flatnonzero(~np.fromiter(map(is_held_out, idents), bool, len(idents))[stream.doc])


def train_classes(docs: DataFrame, tokens: int) -> ClassMixer:
    """A mixer for class bits whose counts, weights and probability map come from all training documents, each task from its own."""
    texts = docs.select("doc_id", "text")
    tasks = max(1, -(-tokens // TOKENS_PER_TASK))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in slices(batches, 1, SLICE_BYTES):
            table = np.zeros((CLASS_SLOTS, 2), np.int32) if table is None else table
            stream = Stream(raw_texts(batch.column(1)))
            count_classes(stream, _training(stream, batch.column(0).to_pylist()), table)
        if table is not None:
            yield from emitted(table)

    mixer = ClassMixer(added(texts.coalesce(tasks).mapInArrow(count, EMITTED), tasks, 2 * CLASS_SLOTS).reshape(CLASS_SLOTS, 2))
    shared = docs.sparkSession.sparkContext.broadcast(mixer.without_own())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = ClassMixer(None, shared.value), 0
        for batch in slices(batches, 1, LEARN_BYTES):
            stream = Stream(raw_texts(batch.column(1)))
            pick = _training(stream, batch.column(0).to_pylist())
            own.learn(stream, pick)
            n += len(pick)
        if n:
            yield from emitted(own.learned(n))

    mixer.take_over(added(texts.coalesce(tasks).mapInArrow(learn, EMITTED), tasks, len(mixer.learned(0))).astype(np.float64))
    shared.unpersist()
    mixer.freeze()
    return mixer


def match_flags(docs: DataFrame) -> DataFrame:
    """(row, flags): for each row the blocks (place, after, same) whose words before occur in `after` other training documents, the block too in `same`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE_BYTES):
            held = np.fromiter(map(is_held_out, batch.column(1).to_pylist()), bool, batch.num_rows)
            doc, first, _, before, body = (stream := Stream(raw_texts(batch.column(2)))).blocks()
            # a document counts once for each block
            order = np.lexsort((first, body, before, doc))
            new = np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(before[order]) != 0) | (np.diff(body[order]) != 0)))[: len(order)]
            counts = np.zeros(len(doc), np.int32)
            counts[order[new]] = 1
            counts[held[doc]] = 0
            cols = stream.place[first].astype(np.int32), before.view(np.int64), body.view(np.int64), counts, ~held[doc]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *map(pa.array, cols)], ["row", "place", "before", "body", "counts", "own"])

    blocks = materialize(docs.select("row", "doc_id", "text").mapInArrow(run, "row binary, place int, before long, body long, counts int, own boolean"))
    often = materialize(blocks.groupBy("before").agg(F.count("*").alias("m"), F.sum("counts").alias("after")).where("m > 1 and after > 0"))
    shared = materialize(hot_join(blocks, often, ["before"], "m").select(*blocks.columns).dropDuplicates(["row", "place"]))
    same = shared.groupBy("before", "body").agg(F.count("*").alias("m"), F.sum("counts").alias("same"))
    both = materialize(same.join(same.groupBy("before").agg(F.sum("same").alias("after")), "before"))
    # a document's own blocks don't count for itself
    own = shared.groupBy("row", "before").agg(F.sum("counts").alias("mine"))
    seen = hot_join(shared, both, ["before", "body"], "m").join(own, ["row", "before"])
    others = seen.select("row", "place", (F.col("after") - F.col("mine")).alias("after"), (F.col("same") - F.col("own").cast("int")).alias("same")).where("after > 0")
    return materialize(others.groupBy("row").agg(F.collect_set(F.struct("place", "after", "same")).alias("flags")))


def code_matches(flags: list[tuple[int, int, int]]) -> tuple[float, list[int]]:
    """(natural logarithm of the probability of all match decisions and matched blocks, places of the matched blocks)."""
    tries, hits, last, total, places = [0.0] * 3, [0.0] * 3, 0, 0.0, []
    for place, after, same in sorted(flags):
        p = (hits[last] + 0.3) / (tries[last] + 0.8)
        tries[last] += 1
        if same > 0:
            hits[last] += 1
            total += math.log(p) + math.log(min(1.0, same / after))
            places.append(place)
            last = 1
        else:
            total += math.log(1 - p)
            last = 2
    return total, places


@dataclass
class Known:
    """What all tasks need: the mixer, the most frequent words, tokens of each class."""

    mixer: ClassMixer
    hashes: np.ndarray
    counts: np.ndarray
    weight: np.ndarray  # log of CLASS_STRENGTH over the training tokens of each class


#: Rows that one document gives, rare words in lists.
SCORED = "line long, doc_id long, held_out boolean, n_tokens long, n_bytes long, coded long, known long, base double, score double, rare array<binary>, times array<int>, fresh array<int>, bits array<double>, weight array<double>"


def _score_batch(known: Known, texts: list[bytes], flags: list) -> list:
    """Columns of SCORED from coded on, for each text."""
    stream = Stream(texts)
    score, coded = np.zeros(stream.docs), np.ones(len(stream.hash), bool)
    begin = np.cumsum(stream.sizes) - stream.sizes
    if any(flags):
        doc, first, stop, _, _ = stream.blocks()
        ends = dict(zip(first.tolist(), stop.tolist()))
        for d, own in enumerate(flags):
            if own:
                score[d], places = code_matches([(f["place"], f["after"], f["same"]) for f in own])
                for place in places:
                    coded[begin[d] + place : ends[int(begin[d]) + place]] = False
    pick = np.flatnonzero(coded)
    bits, before = known.mixer.log_bits(stream, pick)
    part = np.zeros(len(stream.hash))
    part[pick] = bits - np.log(before + CLASS_STRENGTH)
    # words of each document, first those that come first
    order = stream.by_word()
    fresh = np.concatenate(([True], (np.diff(stream.doc[order]) != 0) | (np.diff(stream.hash[order]) != 0)))
    head = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    at = order[head]
    hashes, doc = stream.hash[at], stream.doc[at]
    times = np.diff(np.concatenate((head, [len(order)])))
    anew = np.add.reduceat(coded[order].astype(np.int64), head)
    place = np.minimum(np.searchsorted(known.hashes, hashes), max(0, len(known.hashes) - 1))
    top = known.hashes[place] == hashes if len(known.hashes) else np.zeros(len(hashes), bool)
    count = np.where(top, known.counts[place], 0) if len(known.hashes) else np.zeros(len(hashes), np.int64)
    weight = known.weight[(hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
    n_known = np.bincount(doc, np.where(top, times, 0), stream.docs).astype(np.int64)
    base = np.bincount(doc, np.where(top, times * np.log10(count + 0.1), 0), stream.docs)
    # each coded token of a frequent word: how often the document has had it, and its share of its class
    earlier = np.cumsum(coded[order]) - coded[order]
    earlier = earlier - earlier[head][group]
    prior = np.where(top, np.maximum(count, 1), 1) * np.exp(weight)
    value = np.where(coded[order] & top[group], part[order] + np.log(earlier + prior[group]), 0.0)
    score += np.bincount(stream.doc[order], value, stream.docs)
    rare = np.flatnonzero(~top)
    cuts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=stream.docs)))).astype(np.int32))
    sums = np.add.reduceat(part[order], head)
    lists = [
        pa.array(stream.words(at[rare]), pa.binary()), pa.array(times[rare].astype(np.int32)), pa.array(anew[rare].astype(np.int32)), pa.array(sums[rare]), pa.array(weight[rare]),
    ]
    whole = [np.bincount(stream.doc[pick], minlength=stream.docs).astype(np.int64), n_known, base, score]
    return [pa.array(stream.sizes), pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), *map(pa.array, whole), *(pa.ListArray.from_arrays(cuts, x) for x in lists)]


def rare_value() -> Column:
    """Log of the probabilities of all coded tokens of a rare word but for their class bits: sum of log(k + x) for k < fresh."""
    more = F.aggregate(F.sequence(F.lit(1), F.col("fresh") - 1), F.lit(0.0), lambda s, k: s + F.log(k + F.exp("x")))
    return F.when(F.col("fresh") == 0, 0.0).when(F.col("fresh") == 1, F.col("x")).otherwise(F.col("x") + more)


def _settle(rest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """score in place of (score, coded, unknown), the last three columns: adds the decisions whether words are known."""

    def rising(start: float, n: np.ndarray) -> np.ndarray:
        return np.concatenate(([0.0], np.cumsum(np.log(start + np.arange(int(n.max(initial=0)))))))[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, coded, unknown = (c.to_numpy() for c in batch.columns[-3:])
            yes, no = ESCAPE_STRENGTH * rest, ESCAPE_STRENGTH * (1 - rest)
            flags = rising(yes, unknown) + rising(no, coded - unknown) - rising(ESCAPE_STRENGTH, coded)
            whole = (score + flags - rising(UNKNOWN_STRENGTH, unknown)) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(whole)], [*batch.schema.names[:-3], "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row"))
    counts = materialize(_tokens(rows))
    training = counts.where("c > 0")
    level = F.floor(F.log2("c") * 8)
    levels = training.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("tokens"), F.sum((F.col("c") == 1).cast("int")).alias("once")).collect()
    total, types, once = (sum(r[k] for r in levels) for k in ("tokens", "n", "once"))
    least, reach = 1 << 40, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        reach += r["n"]
        if reach > TOP_WORDS:
            break
        least = r["level"]
    spelling = context.broadcast(train_spelling(training, types))
    mixer = train_classes(rows, total)

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            spelled, new = np.zeros(len(words)), np.flatnonzero(c == 0)
            spelled[new] = spelling.value.log10([words[i] for i in new.tolist()]) * math.log(10)
            classes = (hash_words(words) >> np.uint64(64 - CLASS_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spelled), pa.array(classes)], ["word", "c", "spelled", "class"])

    prices = materialize(counts.mapInArrow(priced, "word binary, c long, spelled double, class int"))
    spelling.unpersist()
    sizes = np.zeros(1 << CLASS_BITS)
    for r in prices.groupBy("class").agg(F.sum("c").alias("n")).collect():
        sizes[r["class"]] = r["n"]
    top = prices.where(F.col("c") > 0).where(level >= least).select("word", "c").toArrow()  # at most TOP_WORDS rows
    hashes = hash_words(top["word"].to_pylist())
    by = np.argsort(hashes)
    known = context.broadcast(Known(mixer, hashes[by], top["c"].to_numpy()[by], np.log(CLASS_STRENGTH / np.maximum(1, sizes))))  # TOP_WORDS words, fixed tables
    # texts move by shuffle at every size, so that a small input behaves as a large one
    flagged = rows.join(match_flags(rows).hint("merge"), "row", "left").select("doc_id", "text", "flags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1, SLICE_BYTES):
            idents = batch.column(0).to_pylist()
            held = pa.array([is_held_out(i) for i in idents])
            n_tokens, n_bytes, *others = _score_batch(known.value, raw_texts(batch.column(1)), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(line, line + len(idents))), batch.column(0), held, n_tokens, n_bytes, *others], [x.split()[0] for x in SCORED.split(", ")])
            line += len(idents)

    scored = materialize(flagged.mapInArrow(run, SCORED))
    known.unpersist()
    rare = scored.select("line", F.explode(F.arrays_zip("rare", "times", "fresh", "bits", "weight")).alias("x")).select("line", F.col("x.rare").alias("word"), "x.times", "x.fresh", "x.bits", "x.weight")
    met = rare.join(prices, "word").withColumn("x", F.when(F.col("c") > 0, F.col("weight") + F.log("c")).otherwise(math.log(UNKNOWN_STRENGTH) + F.col("spelled")))
    joined = met.groupBy("line").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(rare_value() + F.when(F.col("c") > 0, F.col("bits")).otherwise(0.0)).alias("more_score"), F.sum(F.when(F.col("c") > 0, 0).otherwise(F.col("fresh"))).alias("unknown"),
    )
    below = math.log10(total + 0.1 * (types + 1))
    whole = scored.drop("rare", "times", "fresh", "bits", "weight").join(joined, "line", "left").select(
        "doc_id", "held_out", "n_tokens", "n_bytes", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"), "coded", F.coalesce("unknown", F.lit(0)).cast("long").alias("unknown"),
    )
    done = whole.mapInArrow(_settle((once + 0.5) / (total + 1)), "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double")
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
