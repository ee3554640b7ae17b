"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), so pairwise
interactions of all features cost time linear in their number. It is fitted on the driver with
AdaGrad on a sample of at most SAMPLE_PER_CLASS labelled rows of each class, the first by a hash of
doc_id, one text (the least) under each doc_id; rows whose crc32(doc_id) mod 4 is 2 are held out. Examples are weighted back to the classes'
shares among all labelled training rows. Labels, lang, source and doc_id are never inputs.

Edge cases: null and empty texts have zero word features and get the score of their statistics;
null metadata counts as 0; labels that are null are skipped, and with no labels of either class
every score is 0.5; repeated rows get equal scores; an empty table gives an empty table; a text of
any length is read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import first_by_hash, raw_texts, row_key, scan_words, slices

WORD_BITS = 15
FACTORS = 8
SAMPLE_PER_CLASS = 3000
EPOCHS = 12
BATCH = 64

#: Byte classes for the structure statistics.
_CLASSES = 10
_CLASS_OF = np.full(256, 9, np.uint8)  # signs
_CLASS_OF[[9, 11, 12, 13, 32]] = 0
_CLASS_OF[10] = 1
_CLASS_OF[97:123] = 2
_CLASS_OF[65:91] = 3
_CLASS_OF[48:58] = 4
_CLASS_OF[[44, 46]] = 5
_CLASS_OF[[33, 63]] = 6
_CLASS_OF[[124, 60, 62, 123, 125, 91, 93]] = 7
_CLASS_OF[128:] = 8
STATISTICS = _CLASSES + 5


def features(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of texts: (feature, value, number of features of each text)."""
    docs = len(texts)
    hashes, start, end, counts, _ = scan_words(texts)
    doc = np.repeat(np.arange(docs), counts)
    key, tf = np.unique((doc << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    word_doc, word = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(word_doc, value**2, docs))
    value = value / norm[word_doc] if len(value) else value
    lengths = np.fromiter(map(len, texts), np.int64, docs)
    data = np.frombuffer(b"".join(texts), np.uint8)
    share = np.bincount(np.repeat(np.arange(docs) * _CLASSES, lengths) + _CLASS_OF[data], minlength=docs * _CLASSES).reshape(docs, _CLASSES) / np.maximum(lengths, 1)[:, None]
    distinct = np.bincount(word_doc, minlength=docs)
    stats = np.column_stack(
        (
            np.sqrt(share),
            np.log1p(counts) / 10,
            np.bincount(doc, end - start, docs) / np.maximum(counts, 1) / 10,
            distinct / np.maximum(counts, 1),
            np.log1p(np.maximum(np.nan_to_num(n_chars), 0)) / 12,
            (counts > 0).astype(np.float64),
        )
    )
    columns = (1 << WORD_BITS) + np.arange(STATISTICS)
    all_doc = np.concatenate((word_doc, np.repeat(np.arange(docs), STATISTICS)))
    order = np.argsort(all_doc, kind="stable")
    index = np.concatenate((word, np.tile(columns, docs)))[order]
    return index, np.concatenate((value, stats.reshape(-1)))[order], distinct + STATISTICS


@dataclass
class FactorisationMachine:
    """Bias, linear weights and low-rank factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid, in time linear in the number of features."""
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        weighted = self.factors[index] * value[:, None]
        total = np.add.reduceat(weighted, at, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(weighted**2, at, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[index] * value, at) + pairs


def fit(index: np.ndarray, value: np.ndarray, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the weighted logistic loss with a small L2 penalty."""
    rng, n = np.random.default_rng(seed), (1 << WORD_BITS) + STATISTICS
    m = FactorisationMachine(0.0, np.zeros(n), rng.normal(0, 0.05, (n, FACTORS)))
    g0, gl, gf = 1e-8, np.full(n, 1e-8), np.full((n, FACTORS), 1e-8)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for epoch in range(EPOCHS):
        rate = 0.15 / (1 + 0.3 * epoch)
        order = rng.permutation(len(sizes))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            size = sizes[rows]
            take = np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            i, x, doc = index[take], value[take], np.repeat(np.arange(len(rows)), size)
            p = 1 / (1 + np.exp(-np.clip(m.logits(i, x, size), -30, 30)))
            err = (p - label[rows]) * weight[rows]
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            own = m.factors[i]
            total = np.add.reduceat(own * x[:, None], at, axis=0)
            used, where = np.unique(i, return_inverse=True)
            dl = np.bincount(where, err[doc] * x) / len(rows)
            each = (err[doc] * x)[:, None] * (total[doc] - own * x[:, None])
            df = np.column_stack([np.bincount(where, each[:, f]) for f in range(FACTORS)]) / len(rows)
            dl += 1e-6 * m.linear[used]
            df += 1e-5 * m.factors[used]
            d0 = err.mean()
            g0 += d0**2
            gl[used] += dl**2
            gf[used] += df**2
            m.bias -= rate * d0 / np.sqrt(g0)
            m.linear[used] -= rate * dl / np.sqrt(gl[used])
            m.factors[used] -= 0.3 * rate * df / np.sqrt(gf[used])
    return m


def _texts(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(0.0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(chars, F.lit(0.0)).alias("n_chars"), row_key("doc_id", "text").alias("row"))


def remainder(column: str = "doc_id", modulus: int = 4):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame) -> FactorisationMachine | None:
    """Fit on the labelled rows that aren't held out; None without rows of both classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(remainder() != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return None
    first = lambda q: first_by_hash(known.where(F.col("quality") == q), "doc_id", shares[q], SAMPLE_PER_CLASS)
    # at most 2 * SAMPLE_PER_CLASS rows of two integers: a proven bound
    found = _texts(docs).join(F.broadcast(first(0).unionByName(first(1))), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("least"))
    sample = found.select("quality", "least.text", "least.n_chars", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            index, value, sizes = features(raw_texts(batch.column(1)), batch.column(2).to_numpy())
            cuts = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = pa.ListArray.from_arrays(cuts, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), *lists], ["doc_id", "quality", "index", "value"])

    found = sample.mapInArrow(run, "doc_id long, quality int, index array<int>, value array<float>").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    label = found["quality"].to_numpy().astype(np.float64)
    index, value = (found[c].combine_chunks() for c in ("index", "value"))
    sizes = np.diff(index.offsets.to_numpy()).astype(np.int64)
    total = sum(shares.values())
    got = {q: max(1, int((label == q).sum())) for q in (0, 1)}
    weight = np.where(label == 1, shares[1] / total / got[1], shares[0] / total / got[0]) * len(label)
    return fit(index.values.to_numpy().astype(np.int64), value.values.to_numpy().astype(np.float64), sizes, label, weight)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, row) for every whole text; row is row_key()."""
    return score_with(train(docs, labels), docs, threshold)


def score_with(model: FactorisationMachine | None, docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """As score_quality(), with a model of train()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^WORD_BITS * (FACTORS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 1, 4 << 20):
            if m is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = 1 / (1 + np.exp(-np.clip(m.logits(*features(raw_texts(batch.column(1)), batch.column(2).to_numpy())), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), batch.column(3)], ["doc_id", "score", "row"])

    scored = _texts(docs).mapInArrow(run, "doc_id long, score double, row binary")
    return scored.select("doc_id", (remainder() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "row")
