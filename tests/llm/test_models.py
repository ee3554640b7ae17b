import collections
import math
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses as LI
from tessera.llm import mixing as X
from tessera.llm import packing as PK
from tessera.llm import quality as Q
from tessera.llm import spelling as SP
from tessera.llm.common import mix64, raw_texts, scan_words
from tests.conftest import TESTDATA


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in Q.score_quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for _, r in held) and len(held) > 50
    assert np.mean([(r["score"] >= 0.5) == (q == 1) for q, r in held]) > 0.85
    assert np.mean([r["predicted"] for q, r in held if q == 1]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows.values())


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = Q.FactorisationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    index, value, sizes = np.array([1, 5, 7, 2, 3]), rng.normal(size=5), np.array([3, 2])
    for d, part in enumerate((slice(0, 3), slice(3, 5))):
        i, x = index[part], value[part]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert m.logits(index, value, sizes)[d] == pytest.approx(0.3 + m.linear[i] @ x + pairs)


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (4, 1), (5, 1), (5, 1), (None, 1), (6, 1)], "doc_id long, quality int")
    rows = Q.score_quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = Q.score_quality(odd_docs, labels.where("quality = 1")).collect()
    assert all(r["score"] == 0.5 and r["predicted"] == 0 for r in none)
    assert Q.score_quality(no_docs, labels).count() == 0


def test_quality_query_against_a_plain_version(spark):
    """score of every document against the pairwise form, feature by feature, with the fitted model."""
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    m = Q.train(docs, labels)
    got = {r["doc_id"]: r for r in Q.score_with(m, docs).collect()}
    for r in docs.collect():
        text = (r["text"] or "").encode()
        tf = collections.Counter(int(h >> np.uint64(64 - Q.WORD_BITS)) for h in Q.scan_words([text])[0])
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in tf.values())) or 1.0
        words, n = text.split(), max(1, len(text))
        classes = collections.Counter(int(Q._CLASS_OF[b]) for b in text)
        stats = [math.sqrt(classes[k] / n) for k in range(10)]
        stats += [math.log1p(len(words)) / 10, sum(map(len, words)) / max(1, len(words)) / 10, len(tf) / max(1, len(words)), math.log1p(r["n_chars"] or 0) / 12, float(bool(words))]
        x = [(k, math.log1p(n) / norm) for k, n in tf.items()] + [((1 << Q.WORD_BITS) + k, v) for k, v in enumerate(stats)]
        f = np.array([m.factors[i] * v for i, v in x])
        logit = m.bias + sum(m.linear[i] * v for i, v in x) + sum((f[a + 1 :] @ f[a]).sum() for a in range(len(f)))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_sample_is_the_first_by_hash(spark, monkeypatch):
    from tessera.llm.common import first_by_hash

    rows = spark.range(5000).selectExpr("id AS doc_id")
    got = [r[0] for r in first_by_hash(rows, "doc_id", 5000, 100).collect()]
    want = rows.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id").limit(100)
    assert got == [r[0] for r in want.collect()] and len(first_by_hash(rows, "doc_id", 5000, 9000).collect()) == 5000


def test_base_scores(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    c = collections.Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 10 for w in x)
    n, v = sum(c.values()), len(c)
    rows = X.score_texts(docs).collect()
    assert len(rows) == len(words)
    for r in rows:
        x = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(c[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] is None or 0 < r["bits_per_byte"] < 8
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_rare_and_top_words_agree(spark, monkeypatch):
    """Counts that are joined give what counts that are broadcast give."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    key = lambda r: (r["doc_id"], r["n_known"], round(r["base_score"], 6))
    whole = sorted(map(key, X.score_texts(docs).collect()))
    monkeypatch.setattr(X, "TOP_WORDS", 40)
    assert sorted(map(key, X.score_texts(docs).collect())) == whole


def test_word_probabilities_sum_to_one_at_most():
    table = np.zeros((2, SP.SLOTS), np.float32)
    words = [b"ab", b"abc", b"b", b"ca", X.END]
    SP.count_bits(words, table)
    m = SP.Mixer(table)
    m.learn(words)
    m.freeze()
    some = [bytes([a]) for a in range(33, 127)] + [bytes([a, b]) for a in range(33, 127) for b in range(33, 127)] + [X.END]
    assert (10.0 ** m.log10(some)).sum() <= 1 + 1e-6


def test_class_bits_are_a_distribution():
    """After any words, the probabilities of all classes of the next word sum to 1."""
    texts = [b"a b c a b d", b"c c a b", b"d a b c"]
    table = np.zeros((X.CLASS_SLOTS, 2), np.float32)
    stream = X.Stream(texts)
    X.count_classes(stream, np.arange(len(stream.hash)), table)
    m = X.ClassMixer(table)
    m.learn(stream, np.arange(len(stream.hash)))
    m.freeze()
    by_class = {}
    for k in range(20000):
        by_class.setdefault(int(X.hash_words([b"w%d" % k])[0] >> np.uint64(64 - X.CLASS_BITS)), b"w%d" % k)
    assert len(by_class) == 1 << X.CLASS_BITS
    for before in (b"", b"a", b"a b c a b"):
        stream = X.Stream([before + b" " + w for w in by_class.values()])
        logs, _ = m.log_bits(stream, np.arange(len(stream.hash)))
        last = np.flatnonzero(stream.is_end) - 1
        assert np.exp(logs[last]).sum() == pytest.approx(1.0, abs=1e-4)


def test_counts_without_the_own_one():
    """The tables that learning looks up, against counts of which one is taken, slot by slot; slots against their formula."""
    rng = np.random.default_rng(4)
    table = rng.integers(0, 300, (X.CLASS_SLOTS, 2)).astype(np.float32)
    inputs, sure = X.ClassMixer(table).without_own()
    for slot in rng.integers(0, X.CLASS_SLOTS, 300).tolist():
        for bit in (0, 1):
            n = table[slot].astype(float)
            n[bit] = max(0, n[bit] - 1)
            assert inputs[slot * 2 + bit] == pytest.approx(math.log((n[1] + 0.2) / (n[0] + 0.2)), rel=1e-5, abs=1e-5)
            assert sure[slot * 2 + bit] == int(min(7, math.log2(n.sum() + 1) / 2))
    near = X.local_counts(np.array([0, 0, 0, 1, 1]), np.array([5, 255, 5, 5, 5]))
    assert [near[k].tolist() for k in (0, 1, X.CLASS_BITS)] == [[0, 1, 2, 0, 1], [0, 0, 1, 0, 1], [0, 0, 1, 0, 1]]


def test_class_weights_learn_from_every_training_document(spark):
    """The probability map has seen each class bit of each token of all training documents."""
    docs = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k % 7 + 1))) for k in range(90)]
    mixer = X.train_classes(spark.createDataFrame(docs, "doc_id long, text string"), 500)
    tokens = sum(len(t.split()) + 1 for i, t in docs if not X.is_held_out(i))
    assert mixer.seen.sum() - X.ClassMixer(None).seen.sum() == tokens * X.CLASS_BITS


def brute_mixing(docs, classes, spelling):
    """Natural logarithm of each text's probability, word by word and bit by bit, from the trained mixers."""
    tokens = {i: (t or "").encode().lower().split() + [X.END] for i, t in docs}
    count = collections.Counter(w for i, x in tokens.items() if not X.is_held_out(i) for w in x)
    total, kinds = sum(count.values()), [int(h >> np.uint64(64 - X.CLASS_BITS)) for h in X.hash_words(list(count))]
    sizes, rest = collections.Counter(), (sum(n == 1 for n in count.values()) + 0.5) / (total + 1)
    for k, n in zip(kinds, count.values()):
        sizes[k] += n
    sig = lambda x: 1 / (1 + math.exp(-x))

    def blocks(x):
        cuts = [j for j in range(X.MATCH_WORDS - 1, len(x) - 1) if int(X.Stream([b" ".join(x[j - X.MATCH_WORDS + 1 : j + 1])]).grams()[X.MATCH_WORDS - 1]) % X.MATCH_STEP == 0]
        return {j + 1: (tuple(x[j - X.MATCH_WORDS + 1 : j + 1]), tuple(x[j + 1 : (cuts[n + 1] + 1 if n + 1 < len(cuts) else len(x))])) for n, j in enumerate(cuts)}

    places = {i: blocks(x) for i, x in tokens.items()}
    out = {}
    for i, x in tokens.items():
        stream, log, place = X.Stream([(dict(docs)[i] or "").encode()]), 0.0, 0
        others = [set(p.values()) for j, p in places.items() if j != i and not X.is_held_out(j)]
        tries, hits, last = [0.0] * 3, [0.0] * 3, 0
        coded, own, unknown, known = [], collections.Counter(), 0, 0
        moved, slope = np.zeros(4), np.zeros(4)
        while place < len(x):
            if place in places[i]:
                before, body = places[i][place]
                after = sum(sum(b == before for b, _ in o) for o in others)
                same = sum((before, body) in o for o in others)
                if after:
                    p = (hits[last] + 0.3) / (tries[last] + 0.8)
                    tries[last] += 1
                    log += math.log(p if same else 1 - p)
                    if same:
                        hits[last] += 1
                        log += math.log(same / after)
                        place, last = place + len(body), 1
                        continue
                    last = 2
            w = x[place]
            k = int(X.hash_words([w])[0] >> np.uint64(64 - X.CLASS_BITS))
            if coded and len(coded) % X.CHUNK == 0:
                moved, slope = moved + X.ONLINE_RATE * slope, np.zeros(4)
            bits = 0.0
            for j in range(X.CLASS_BITS):
                bit, *slots = (int(v[0]) for v in X.class_slots(np.array([k]), stream.one[place : place + 1], stream.two[place : place + 1], j))
                near = [c >> (X.CLASS_BITS - 1 - j) & 1 for c in coded if c >> (X.CLASS_BITS - j) == k >> (X.CLASS_BITS - j)]
                st = np.array([*classes.inputs[slots], math.log((sum(near) + 0.3) / (len(near) - sum(near) + 0.3))])
                gate = j * 64 + int(classes.confidence[slots[1]]) * 8 + min(7, int(math.log2(len(near) + 1)))
                mixed = float(np.clip(st @ (classes.weights[gate] + moved), -15, 15))
                slope += (bit - sig(mixed)) * st
                p = 0.5 * sig(mixed) + 0.5 * classes.map[gate, int(np.clip(np.rint(mixed * 2) + 16, 0, 32))]
                bits += math.log(p if bit else 1 - p)
            if count[w]:
                log += math.log((known + X.ESCAPE_STRENGTH * (1 - rest)) / (len(coded) + X.ESCAPE_STRENGTH)) + bits
                log += math.log((own[w] + X.CLASS_STRENGTH * count[w] / sizes[k]) / (coded.count(k) + X.CLASS_STRENGTH))
                known += 1
            else:
                log += math.log((unknown + X.ESCAPE_STRENGTH * rest) / (len(coded) + X.ESCAPE_STRENGTH))
                log += math.log((own[w] + X.UNKNOWN_STRENGTH * 10 ** spelling.log10([w])[0]) / (unknown + X.UNKNOWN_STRENGTH))
                unknown += 1
            own[w] += 1
            coded.append(k)
            place += 1
        out[i] = log
    return out


def test_scores_match_brute_force(spark, monkeypatch):
    """score against a plain version: copies, near copies, unknown words that recur, a text of several chunks, a frequent and a rare word."""
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 300)
    docs = [(k, prose(int(rng.integers(1, 120)))) for k in range(40)]
    long = prose(400)
    docs += [(40, docs[3][1]), (41, docs[3][1] + " more"), (42, long), (43, docs[7][1]), (44, long[:900]), (45, None), (46, "new! new! new! words?")]
    held = next(k for k in range(100, 200) if X.is_held_out(k))
    docs += [(held, long + " never seen words never seen " + prose(80))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    kept = {}
    for name in ("train_classes", "train_spelling"):
        monkeypatch.setattr(X, name, lambda *a, name=name, f=getattr(X, name): kept.setdefault(name, f(*a)))
    got = {r["doc_id"]: r for r in X.score_texts(df).collect()}
    want = brute_mixing(docs, kept["train_classes"], kept["train_spelling"])
    for i, x in want.items():
        assert got[i]["score"] == pytest.approx(x / math.log(10), rel=1e-4), i
    assert got[44]["score"] > 0.2 * got[44]["base_score"]  # a copy of a part of another text
    monkeypatch.setattr(X, "TOP_WORDS", 5)
    few = {r["doc_id"]: r["score"] for r in X.score_texts(df).collect()}
    assert all(few[i] == pytest.approx(r["score"], rel=1e-9) for i, r in got.items())


def test_scores_beat_the_base_on_held_out_texts(spark):
    rows = X.score_texts(spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")).where("held_out").collect()
    assert np.mean([r["score"] for r in rows]) > np.mean([r["base_score"] for r in rows])


def test_mixing_odd(spark, odd_docs, no_docs):
    rows = X.score_texts(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert X.score_texts(no_docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    alone = X.score_texts(spark.createDataFrame([(held, "only held out")], "doc_id long, text string")).collect()
    assert alone[0]["train_tokens"] == 0 and alone[0]["n_known"] == 0 and math.isfinite(alone[0]["score"])


def check_bins(rows, counts, lengths):
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["bin_id"]].append(r)
    for ident, n in counts.items():
        at = 0
        for r in sorted(by_doc[ident], key=lambda r: r["piece"]):
            assert r["piece_start"] == at
            at += r["piece_tokens"]
        assert at == n
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["piece_tokens"]
        assert {(r["bin_used"], r["bin_tokens"]) for r in b} == {(at, min(c for c in lengths if c >= at))}


def test_packing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    counts = {int(k): int(v) for k, v in enumerate(np.exp(rng.normal(5.5, 1.6, 3000)).astype(int) + 1)}
    df = spark.createDataFrame(list(counts.items()), "doc_id long, n_tokens long")
    rows = PK.pack_documents(df).collect()
    check_bins(rows, counts, PK.LENGTHS)
    bins = {r["bin_id"]: r["bin_tokens"] for r in rows}
    assert sum(counts.values()) / sum(bins.values()) > 0.97
    assert PK.pack_documents(df.limit(0)).count() == 0
    monkeypatch.setattr(PK, "SHARD_PIECES", 100)
    check_bins(PK.pack_documents(df).collect(), counts, PK.LENGTHS)


def test_best_fit_by_hand():
    home, offset, final, used = PK.pack(np.array([60, 50, 40, 30, 4]), (64, 128), 0)
    assert used[home[0]] == 64 and offset[4] == 60  # the smallest piece goes where it leaves least room
    assert sorted(zip(final, used)) == [(64, 64), (128, 120)]


def test_packing_against_a_plain_version():
    """pack() against best fit written with lists, and rows that repeat are spread over shards."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = tuple(sorted(set(int(x) for x in rng.integers(8, 200, 3))))
        sizes = sorted((int(x) for x in rng.integers(1, lengths[-1] + 1, 60)), reverse=True)
        bins, capacity, places = [], [], []
        for k, size in enumerate(sizes):
            fits = [b for b in range(len(bins)) if capacity[b] - bins[b] >= size]
            if fits:
                least = min(capacity[b] - bins[b] for b in fits)
                b = [b for b in range(len(bins)) if capacity[b] - bins[b] == least][0]
            else:
                cost = {}
                for c in lengths:
                    if c >= size:
                        smaller = sum(x for x in sizes[k + 1 :] if x <= c - size)
                        cost[c] = (c + 5) / (size + min(c - size, smaller))
                b = len(bins)
                bins.append(0)
                capacity.append(min(cost, key=lambda c: (cost[c], c)))
            places.append((size, capacity[b] - bins[b] - size))
            bins[b] += size
        home, offset, final, used = PK.pack(np.array(sizes), lengths, 5)
        assert sorted(used) == sorted(bins) and final == [min(c for c in lengths if c >= u) for u in used]
        assert sum(final) == sum(min(c for c in lengths if c >= u) for u in bins)


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(PK, "SHARD_PIECES", 1000)
    rows = PK.pack_documents(spark.range(20000).selectExpr("cast(null AS long) AS doc_id", "100L AS n_tokens")).collect()
    shards = collections.Counter(r["bin_id"].split("-")[0] for r in rows)
    assert len(rows) == 20000 and max(shards.values()) < 1000 and {r["piece_tokens"] for r in rows} == {100}


def test_packing_odd(spark, odd_docs, no_docs):
    counts = PK.token_counts(odd_docs)
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()}[1] == 1
    rows = PK.pack_documents(counts).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    assert sum(r["piece_tokens"] for r in rows) == sum(r["n_tokens"] for r in counts.collect())
    assert PK.token_counts(no_docs).count() == 0


NOTICES = {"CC BY-NC 4.0": "cc-by-nc", "GNU General Public License": "gpl", "Apache License": "apache-2.0", "MIT License": "mit", "All rights reserved": "proprietary"}


def test_licenses_on_the_corpus(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["families"] for r in LI.scan_licenses(docs).collect()}
    expected = {r["doc_id"]: ",".join(sorted(f for s, f in NOTICES.items() if s in (r["text"] or ""))) for r in docs.collect()}
    assert got == expected and sum(v != "" for v in expected.values()) > 20


def test_license_variants_and_unknown(spark):
    model = LI.fit([f"plain prose number {k} about weather and other things".encode() for k in range(300)])
    texts = ["Prose first. This file is licensed under the Apache License, Version 2.0. More prose.", "released under the mit license", "all the rights of man", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "word " * 300 + "Licensed under the GNU Lesser General Public License, version 3." + " word" * 300]
    rows = LI.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r["families"] for r in sorted(rows, key=lambda r: r["doc_id"])] == ["apache-2.0", "mit", "", "cc-by-sa", "lgpl"]


def test_licenses_wrapped_over_lines(spark):
    model = LI.fit([f"plain prose number {k} about weather and other things".encode() for k in range(300)])
    texts = [
        "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation.",
        "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files, to deal\n# in the Software without restriction.\n\ncode = 1",
        " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met.",
        "Redistribution and use in source and binary forms, with\n\nor without modification, are permitted provided\n\nthat the following conditions are met.",
    ]
    rows = sorted(LI.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect(), key=lambda r: r["doc_id"])
    assert [r["families"] for r in rows] == ["gpl", "mit", "bsd", ""]
    assert [r["n_paragraphs"] for r in rows] == [3, 4, 3, 3] and [r["n_confirmed"] > 0 for r in rows] == [True] * 3 + [False]


WRAPPED = {
    "mit": "Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
    "apache-2.0": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at",
    "gpl": "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */",
}
STRANGE = {
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "epl": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/",
}


def test_wrapped_and_unknown_licences(spark):
    """With the corpus's own counter-examples: usual wrapped notices are confirmed, other licences are unknown, prose is neither."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    model = LI.train(docs)
    texts = {**WRAPPED, **STRANGE, "": "The committee granted permission to the farmers.\nAll the rights of man were discussed."}
    rows = {r["doc_id"]: r for r in LI.scan_licenses(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string"), model).collect()}
    assert [rows[k]["families"] for k in range(4)] == list(WRAPPED)
    assert all(rows[k]["families"] == "" and rows[k]["n_unknown"] > 0 for k in (4, 5))
    assert rows[6]["families"] == "" and rows[6]["n_unknown"] == 0


def test_licence_query_against_a_plain_version(spark):
    """Every finding recomputed span by span with dictionaries and the same model."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").limit(60)
    model = LI.train(docs)
    light = LI.LicenseModel(model.weights.astype(np.float32), model.bias.astype(np.float32), model.temperature)
    got = {r["doc_id"]: r for r in LI.scan_licenses(docs, model).collect()}
    for r in docs.collect():
        raw, best = (r["text"] or "").encode(), {}
        lines = [x for x in raw.split(b"\n") if x.split()]
        for n, line in enumerate(lines):
            words = line.split()
            for a in range(0, max(1, -(-(len(words) - LI.SPAN) // LI.STEP) + 1) * LI.STEP, LI.STEP):
                span = b" ".join(words[a : a + LI.SPAN])
                hashes, _, _, first, size = LI.spans_of([span])
                p = light.probabilities(*LI.gram_features(hashes, first, size))[0]
                if p[0] < 0.5:
                    k = int(p[1:].argmax()) + 1
                    known = k > 1 and p[k] >= LI.CONFIDENCE
                    own = set(zip(span.lower().split(), span.lower().split()[1:]))
                    grams = [set(zip(t.encode().lower().split(), t.encode().lower().split()[1:])) for t in LI.TEMPLATES.get(LI.FAMILIES[k], ())]
                    found = (known and any(len(own & g) >= LI.CONTAINMENT * len(g) for g in grams), float(p[k]), k if known else 0)
                    best[n] = max(best.get(n, (False, 0.0, 0)), found, key=lambda f: f[:2])
        assert got[r["doc_id"]]["n_paragraphs"] == len(lines)
        if got[r["doc_id"]]["n_confirmed"] == sum(f[0] for f in best.values()):  # none of more lines than one
            assert got[r["doc_id"]]["families"] == ",".join(sorted({LI.FAMILIES[f[2]] for f in best.values() if f[0]}))
            assert got[r["doc_id"]]["n_unknown"] == sum(not f[2] for f in best.values())
        else:
            assert got[r["doc_id"]]["n_confirmed"] > sum(f[0] for f in best.values())


def test_licenses_odd(spark, odd_docs, no_docs):
    rows = LI.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["families"] for r in rows} == {""}
    assert LI.scan_licenses(no_docs).count() == 0


def test_spelling_steps_take_little_memory(monkeypatch):
    """Counting takes slots for some words at a time; learning and giving out a table don't copy it."""
    words = [b"%x" % (k * 2654435761 % (1 << 40)) for k in range(1 << 15)]
    table = np.zeros((2, SP.SLOTS), np.int32)
    whole = np.zeros_like(table)
    for a in range(0, len(words), 1000):
        SP.count_bits(words[a : a + 1000], whole)
    lying = np.ascontiguousarray(whole.astype(np.float32).T).T
    monkeypatch.setattr(X, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    steps = {
        "count": lambda: SP.count_bits(words, table),
        "learn": lambda: SP.Mixer(lying).learn(words[:5000]),
        "emit": lambda: collections.deque(X.emitted(whole), maxlen=0),
    }
    next(X.emitted(whole[:, :1]))  # what is imported on first use
    for name, step in steps.items():
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20e6, (name, peak)
    assert (table == whole).all()


def test_scoring_takes_little_memory():
    """Texts are scored some at a time, with the same numbers as all at once; learning keeps the larger parts that its pace depends on."""
    words = [b"%x" % (k * 2654435761 % 5003) for k in range(20_000)]
    texts = [b" ".join(words[k : k + 150 + 400 * (k % 7 == 0)]) for k in range(0, 19_000, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["doc_id", "text"])
    table = np.zeros((X.CLASS_SLOTS, 2), np.float32)
    X.count_classes(stream := X.Stream(texts[:300]), np.arange(len(stream.hash)), table)
    mixer = X.ClassMixer(table)
    mixer.freeze()
    known = X.Known(mixer, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1 << X.CLASS_BITS))
    whole = [c.to_pylist() for c in X._score_batch(known, texts, [None] * len(texts))]
    parts, peak = [], 0
    for part in X.slices([batch], 1, X.SLICE_BYTES):
        tracemalloc.start()
        parts.append(X._score_batch(known, raw_texts(part.column(1)), [None] * part.num_rows))
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert sum(map(len, texts)) > 4 << 20 and peak < 120e6
    assert whole == [[x for p in parts for x in p[k].to_pylist()] for k in range(len(whole))]
    assert X.LEARN_BYTES == 4 << 20 and X.local_counts(stream.doc, stream.classes())[1].dtype == np.int32


def test_counts_of_a_document_take_few_sorts(monkeypatch):
    """Every second level is summed up from the order of the one before; documents are counted some at a time, with the same numbers."""
    rng, sorts, argsort = np.random.default_rng(5), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    for n, top in ((0, 1), (1, 256), (700, 4), (700, 256)):
        doc, classes = np.sort(rng.integers(0, 1 + n // 40, n)), rng.integers(0, top, n)
        want, seen = [], collections.Counter()
        for level in range(X.CLASS_BITS + 1):
            keys = [(level, d, k >> (X.CLASS_BITS - level)) for d, k in zip(doc.tolist(), classes.tolist())]
            want.append([seen.update([key]) or seen[key] - 1 for key in keys])
        sorts.clear()
        whole = X.local_counts(doc, classes)
        assert len(sorts) <= X.CLASS_BITS // 2
        assert [x.tolist() for x in whole] == want
        with monkeypatch.context() as few:
            few.setattr(X, "COUNT_BATCH", 16)
            assert [x.tolist() for x in X.local_counts(doc, classes)] == want


def test_words_of_documents_are_sorted_by_keys(monkeypatch):
    """The order by document, word and place is that of lexsort(), for words that share a document or a hash, too."""
    texts = [b"a b a  b c", b"", b"b a b", b" ".join(b"%d" % (k % 37) for k in range(500))]
    stream = X.Stream(texts)
    want = np.lexsort((stream.hash, stream.doc)).tolist()
    monkeypatch.setattr(np, "argsort", None)
    assert stream.by_word().tolist() == want
    stream.hash = stream.hash & np.uint64(3)  # hashes that keys don't tell apart
    assert stream.by_word().tolist() == np.lexsort((stream.hash, stream.doc)).tolist()


def test_words_are_found_at_every_byte():
    """Words, their places and hashes are those of a plain scan, next to every byte and of lengths around the steps of eight."""
    texts = [bytes([97, k, 98]) for k in range(256)] + [b"", b" \t", *(b"x" * (k - 1) + b"y\x0b" + b"z" * k for k in (1, 7, 8, 9, 16, 17, 63, 64))]
    hashes, start, end, counts, joined = scan_words(texts)
    assert [joined[a:b] for a, b in zip(start.tolist(), end.tolist())] == b"\n".join(texts).split() and counts.tolist() == [len(t.split()) for t in texts]
    odd = 0x9E3779B97F4A7C15
    for h, word in zip(hashes.tolist(), b"\n".join(texts).split()):
        own = len(word) * odd % (1 << 64)
        for k in range(0, len(word), 8):
            own = (int(mix64(np.array([own ^ int.from_bytes(word[k : k + 8], "little")], np.uint64))[0]) + k) % (1 << 64)
        assert h == int(mix64(np.array([own], np.uint64))[0])
