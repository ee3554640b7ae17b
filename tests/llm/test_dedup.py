import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup as L
from tessera.llm import substring as S


def brute_windows(docs, w):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    seen = collections.Counter(tuple(x[j : j + w]) for _, x in words for j in range(len(x) - w + 1))
    out = []
    for i, x in words:
        gone = [False] * len(x)
        for j in range(len(x) - w + 1):
            if seen[tuple(x[j : j + w])] > 1:
                gone[j : j + w] = [True] * w
        kept = b" ".join(y for y, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def window_docs(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["a", "bb", "ccc", "dd", "eé", "f,", "g."]) + str(rng.randrange(500)) for _ in range(n))
    passage, line = prose(60), prose(8)
    docs = [prose(rng.randrange(0, 150)) for _ in range(20)]
    docs += [prose(30) + " " + passage + "\n" + prose(rng.randrange(0, 40)) for _ in range(12)]
    docs += [docs[3], docs[3] + " tail", prose(5) + " " + (line + " \t") * 20, "same " * 200, passage[: len(passage) // 2], None, "", " \n ", prose(35), prose(34)]
    copy = docs[25].split()
    copy[40] = "changed"
    docs.append(" ".join(copy))
    return list(enumerate(docs))


@pytest.mark.parametrize("hot", [3000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(S, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 20)
    docs = window_docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted([tuple(r) for r in S.dedup_substrings(df).drop("row", "text").collect()], key=str)
    assert got == brute_windows(docs, 35)


def test_substrings_odd(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted([tuple(r) for r in S.dedup_substrings(odd_docs).drop("row", "text").collect()], key=str)
    assert got == brute_windows(docs, 35)
    assert S.dedup_substrings(no_docs).count() == 0


def test_segments_of_long_texts_are_cut_by_blocks():
    rng = np.random.default_rng(8)
    counts = np.array([0, 300, 10, 35, 700, 0, 90])
    hashes = rng.integers(0, 1 << 63, counts.sum()).astype(np.uint64)

    def windows(block):
        text, first, n, anchor, _ = S.find_segments(hashes, counts, block=block)
        return sorted((int(t), int(f) + k, int(a)) for t, f, m, a in zip(text, first, n, anchor) for k in range(m))

    whole = windows(1 << 23)
    assert len(whole) == sum(max(0, c - 34) for c in counts.tolist())
    assert all(windows(block) == whole for block in (1, 40, 333))


def test_equal_sums_of_bytes_are_no_repeats(spark):
    """Words of 1,024 bytes whose polynomial sums modulo 2^64 agree (Thue-Morse) are different words."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    prose = [f"w{k}" for k in range(34)]
    docs = [(1, " ".join([*prose, word])), (2, " ".join([*prose, word.translate({97: "b", 98: "a"})]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in S.dedup_substrings(df).drop("row", "text").collect()) == brute_windows(docs, 35)


def test_word_hashes_tell_words_apart():
    words = [b"", b"\0", b"a", b"a\0", b"aaaaaaaa", b"aaaaaaaab", b"b" * 64, b"b" * 65, b"b" * 66, b"c" * 1000, b"c" * 1001]
    joined, end = b"".join(words), np.cumsum([len(w) for w in words])
    for seed in (0, 9):
        hashes = S.word_hashes(joined, end - [len(w) for w in words], end, seed)
        assert len(set(hashes.tolist())) == len(words)
        alone = [int(S.word_hashes(w, np.array([0]), np.array([len(w)]), seed)[0]) for w in words]
        assert hashes.tolist() == alone


def test_many_repeated_rows(spark):
    """A row that is repeated very often, and one that shares a passage with it."""
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.range(20000).selectExpr("7L AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(8, "x " + text), (9, "alone " * 3)], "doc_id long, text string"))
    got = {tuple(r) for r in S.dedup_substrings(df).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {(7, 60, 60), (8, 61, 60), (9, 3, 0)}
    lines = df.selectExpr("doc_id", "replace(text, ' ', '\n') AS text")
    kept = L.dedup_lines(lines).groupBy("doc_id", "n_removed").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept} == {7: 20000, 8: 1, 9: 1} and {r["n_removed"] for r in kept if r["doc_id"] == 7} == {0}


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    sequence = np.concatenate([np.append(rng.integers(1, 6, 30), 0) for _ in range(20)])
    index = S.FMIndex(sequence, 8)
    text = sequence.tolist()
    for _ in range(200):
        size = int(rng.integers(1, 7))
        pattern = rng.integers(1, 6, size).tolist()
        low, high = np.array([0]), np.array([len(text)])
        for c in reversed(pattern):
            low, high = index.extend(np.array([c]), low, high)
        assert int(high[0] - low[0]) == sum(text[i : i + size] == pattern for i in range(len(text)))


def test_matching_statistics():
    sequence = np.array([1, 2, 3, 4, 0, 9, 2, 3, 4, 0, 7, 7, 0])
    found = S.matching_statistics(S.FMIndex(sequence, 6), sequence, np.array([3, 8, 1, 0, 11]), 5)
    assert found.tolist() == [3, 3, 1, 0, 1]


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    sequence = rng.integers(0, 50, 1000)
    m = S.WaveletMatrix(sequence, 6)
    base = m.descend(np.arange(50), np.zeros(50, np.int64))
    for c, at in zip(rng.integers(0, 50, 100), rng.integers(0, 1001, 100)):
        assert m.descend(np.array([c]), np.array([at]))[0] - base[c] == (sequence[:at] == c).sum()


def brute_lines(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        lines, kept = (t or "").encode().split(b"\n"), []
        for a, b in L.cut_lines(lines):
            body = b"\n".join(lines[a:b])
            if b - a == 1 or body not in seen:
                kept += lines[a:b]
            seen.add(body)
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    block = [f"shared line {k} é" for k in range(12)]
    docs = [(k, "\n".join([f"own {k} {j}" for j in range(rng.randrange(6))] + (block if k % 3 == 0 else []) + [f"tail {rng.randrange(9)}"] * rng.randrange(4))) for k in range(60)]
    docs += [(100, docs[0][1]), (101, None), (102, ""), (103, "\n\n\n\n\n\n"), (104, "\n\n\n\n\n\n")]
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_lines(docs)
    assert sum(r["n_removed"] for r in got) > 50
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_boundaries_resist_shifts():
    rng = random.Random(6)
    lines = [f"line {rng.random()}".encode() for _ in range(400)]
    cuts = {b for _, b in L.cut_lines(lines)}
    moved = {b - 3 for _, b in L.cut_lines([b"x", b"y", b"z", *lines])}
    assert len(cuts - moved) <= 2 and len(cuts) > 40


def test_equal_hashes_are_compared_byte_by_byte(spark, monkeypatch):
    # all hashes collide, so only the bytes tell chunks apart: nothing that is new may go
    monkeypatch.setattr(L, "_signed", lambda h: 7)
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "f\ng\nh\ni\nj"), (3, "a\nb\nc\nd\ne")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in L.dedup_lines(docs).collect()}
    assert got[1] == 0 and got[2] == 0


def test_lines_odd(spark, odd_docs, no_docs):
    got = L.dedup_lines(odd_docs).collect()
    assert len(got) == odd_docs.count() and sum(r["n_removed"] for r in got) == 0
    assert L.dedup_lines(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd")], "doc_id long, text string")
    assert [r["n_removed"] for r in L.dedup_lines(twice).collect()] == [0, 0]
    assert L.dedup_lines(odd_docs.withColumn("line", F.lit(1))).count() == odd_docs.count()
