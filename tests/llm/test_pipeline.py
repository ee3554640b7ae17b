import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as CP
from tessera.llm import linededup, nearcopies, queries, quality, simhash
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def groups_of(nodes, links):
    """The least node that each one reaches."""
    comp = {i: i for i in nodes}
    while True:
        before = dict(comp)
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            return comp


def brute_heads(texts):
    """The first of each group of texts whose five-word shingle sets have a similarity of 0.8 or more, by comparing all pairs."""
    grams = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids, links = sorted(grams, key=lambda i: len(grams[i])), []
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(grams[i]) < 0.8 * len(grams[j]):
                break
            common = len(grams[i] & grams[j])
            if common >= 0.8 * (len(grams[i]) + len(grams[j]) - common):
                links.append((i, j))
    return {i for i, c in groups_of(grams, links).items() if c == i}


def test_stages_against_brute_force(spark):
    """Each stage on all that its predecessor kept, held against a plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(CP.STAGES)
    good = {r["doc_id"] for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    rows = {i: t for i, t in rows.items() if i in good}
    docs = CP.materialize(stages["quality classifier"](spark, docs, SF))
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == rows

    seen, kept = set(), {}
    for i, t in sorted(rows.items()):
        lines, left = t.encode().split(b"\n"), []
        for a, b in linededup.cut_lines(lines):
            body = b"\n".join(lines[a:b])
            if b - a == 1 or body not in seen:
                left += lines[a:b]
            seen.add(body)
        if left or not lines:
            kept[i] = b"\n".join(left).decode()
    rows = kept
    docs = CP.materialize(stages["line dedup"](spark, docs, SF))
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == rows

    heads = brute_heads(rows)
    assert len(heads) < len(rows)
    rows = {i: t for i, t in rows.items() if i in heads}
    docs = CP.materialize(stages["near-duplicates"](spark, docs, SF))
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == rows

    words = {i: t.encode().split() for i, t in rows.items()}
    count = collections.Counter(tuple(x[j : j + 35]) for x in words.values() for j in range(len(x) - 34))
    after = {}
    for i, x in words.items():
        gone = [False] * len(x)
        for j in range(len(x) - 34):
            if count[tuple(x[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        if not any(gone):
            after[i] = rows[i]
        elif not all(gone):
            after[i] = b" ".join(w for w, g in zip(x, gone) if not g).decode()
    docs = CP.materialize(stages["substring dedup"](spark, docs, SF))
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == after

    packed = CP.STAGES[-1][1](spark, docs, SF).collect()
    used = collections.Counter()
    for r in packed:
        used[r["doc_id"]] += r["piece_tokens"]
    assert used == {i: len(t.split()) + 1 if t.isascii() else len(t.encode().split()) + 1 for i, t in after.items()}
    whole = CP.run(spark, SF)
    digest = lambda rs: hashlib.sha256(repr(sorted(tuple(r) for r in rs)).encode()).hexdigest()
    assert digest(whole.collect()) == digest(packed)


def test_pipeline_odd(spark, odd_docs, no_docs, tmp_path):
    """Without labels of both classes no document is judged; of the odd ones those with distinct texts are packed."""
    for name, docs, expected in (("odd", odd_docs.select("doc_id", "text", "lang"), {1, 4, None, 5, 6, 7}), ("none", no_docs, set())):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = CP.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in rows} == expected


def test_near_copies_keep_null_ids_and_merge_repeated_rows(spark):
    rows = [(1, "one text of its own"), (1, "another text of its own"), (2, "copied text here"), (3, "copied text here"), (None, "copied text here"), (None, "a text without an id"), (4, "the same row"), (4, "the same row")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    kept = CP.near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted({rows[k] for k in (0, 1, 2, 5, 6)}, key=str)


@pytest.mark.parametrize("pivots", [2, 0])
def test_near_copies_of_similarity_0_8(spark, monkeypatch, pivots):
    """Groups of five-word shingle sets of similarity 0.8 or more, against all pairs; with pivots and by tiles alone."""
    monkeypatch.setattr(nearcopies, "PIVOTS", pivots)
    monkeypatch.setattr(nearcopies, "TILE", 7)
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "text")
    assert {r["doc_id"] for r in CP.near_copies(spark, docs, SF).collect()} == brute_heads({r["doc_id"]: r["text"] for r in docs.collect()})


def test_near_copies_miss_no_pair(spark):
    """A pair of similarity 0.8 that shares no bucket of five MinHash values in 24 tries."""
    words = [f"w4751x{j}" for j in range(14)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:12])), (3, "another text that is not like them")], "doc_id long, text string")
    assert {r["doc_id"] for r in CP.near_copies(spark, docs, SF).collect()} == {1, 3}


def test_similar_sets_share_a_part():
    """Pairs at the least similarity, of all small sizes and some larger ones: one key in common, and bins that don't rule them out."""
    rng = np.random.default_rng(8)
    for m in [*range(4, 130), 400, 1500] * 6:
        n = int(rng.integers(-(-4 * m // 5), m + 1))
        common = -(-4 * (n + m) // 9)
        hashes = rng.permutation(np.unique(rng.integers(0, 1 << 64, 2 * m + 40, dtype=np.uint64)))
        a, b = np.sort(hashes[:n]), np.sort(hashes[n - common : n - common + m])
        assert nearcopies.similar_to(a, [b])[0]
        assert n == m == common or np.intersect1d(nearcopies.part_keys(a), nearcopies.part_keys(b)).size
        assert nearcopies.may_be_similar(nearcopies.bin_counts(a)[None], nearcopies.bin_counts(b)[None], np.array([n]), np.array([m]))[0]


def test_hot_tiles_keep_rows_with_a_partner(spark, monkeypatch):
    """Many sets in one bucket, cut into tiles, without pivots: groups as by all pairs."""
    monkeypatch.setattr(nearcopies, "PIVOTS", 0)
    monkeypatch.setattr(nearcopies, "TILE", 5)
    rng, shared = np.random.default_rng(2), " ".join(f"s{j}" for j in range(60))
    rows = [(k, " ".join([shared, *(f"u{k // 3}x{j}" for j in range(40)), *(f"v{k}x{j}" for j in range(int(rng.integers(1, 20))))])) for k in range(45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in CP.near_copies(spark, docs, SF).collect()} == brute_heads(dict(rows))


def test_pairs_of_many_buckets_are_found_once():
    """Sets that share many buckets in several shards: each pair gives its rows once, and none is missed beyond the first keys."""
    rng = np.random.default_rng(7)
    keys = [np.sort(rng.choice(1 << 20, 60, replace=False)) for _ in range(3)]
    sets = [(b"%02d" % k, np.sort(rng.choice(keys[k // 8], int(rng.integers(2, 50)), replace=False))) for k in range(24)]
    tables = [[], [], [], []]
    for k, (sig, own) in enumerate(sets):
        for key in own.tolist():
            tables[key % 4].append({"bucket": key * 31, "key": key, "side": 0, "sig": sig, "fp": 5, "group": sig, "n": 40, "bins": bytes(nearcopies.BINS), "firsts": own[: nearcopies.FIRST_KEYS].tolist(), "block": k // 4})
    found = [(r["low"], r["high"], r["sig"]) for t in tables for r in nearcopies._live(pa.Table.from_pylist(rng.permutation(np.array(t, object)).tolist())).to_pylist()]
    want, parted = set(), 0
    for j, (b, keys_b) in enumerate(sets):
        for i, (a, keys_a) in enumerate(sets[:j]):
            if len(np.intersect1d(keys_a, keys_b)):
                want |= {(i // 4, j // 4, a), (i // 4, j // 4, b)}
                parted += not len(np.intersect1d(keys_a[: nearcopies.FIRST_KEYS], keys_b[: nearcopies.FIRST_KEYS]))
    assert parted and set(found) == want
    # one bucket for a pair, but for those with no first key in common
    pairs = sum(len(np.intersect1d(a, b)) > 0 for j, (_, b) in enumerate(sets) for _, a in sets[:j])
    assert len(found) <= 2 * pairs


def test_sets_are_read_by_shuffle_at_every_size(spark, monkeypatch):
    """A small list of sets isn't broadcast to the texts, as a large one couldn't be."""
    plans, real = [], nearcopies.materialize
    monkeypatch.setattr(nearcopies, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    texts = spark.createDataFrame([(b"r1", "a text of some words"), (b"r2", "another")], "row binary, text string")
    distinct = spark.createDataFrame([(b"s1", (b"r1",)), (b"s2", (b"r2",))], "sig binary, least struct<row binary>")
    found = nearcopies._sets_of_sigs(spark.createDataFrame([(b"s1",), (b"s1",)], "sig binary"), distinct, texts).collect()
    assert [(bytes(r["sig"]), bytes(r["grams"])) for r in found] == [(b"s1", nearcopies.shingle_sets([b"a text of some words"])[0].tobytes())]
    assert "SortMergeJoin" in plans[-1] and "BroadcastHashJoin" not in plans[-1]


def test_tile_joins_are_complete():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 40, 200, 900)]
    sets = [np.unique(np.concatenate((x[rng.random(len(x)) > p], x[:1]))) for x in base for p in (0, 0.02, 0.1, 0.15, 0.3) for _ in range(4)]
    fps = np.array([simhash.majority_fingerprint(x) for x in sets], np.uint64)
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    for side in (np.zeros(len(sets), int), rng.integers(1, 3, len(sets))):
        want = [(i, j) for i, j in similar if not side[i] or side[i] != side[j]]
        assert groups_of(range(len(sets)), nearcopies.tile_joins(sets, fps, np.arange(len(sets)), side)) == groups_of(range(len(sets)), want)


def test_fingerprints_rule_out_no_similar_sets():
    """Sets of a similarity of 0.9 are linked whatever bits of their fingerprints differ."""
    rng = np.random.default_rng(3)
    whole = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    sets, fps, sigs = [whole, whole[:180]], np.array([0, (1 << 64) - 1], np.uint64), [b"a", b"b"]
    assert nearcopies.tile_joins(sets, fps, np.arange(2), np.zeros(2, int)) == [(0, 1)]
    rows = [{"bucket": 1, "key": 1, "side": 0, "sig": g, "fp": int(f), "group": g, "n": len(x), "bins": nearcopies.bin_counts(x).tobytes(), "firsts": [1], "block": 0} for g, f, x in zip(sigs, fps.view(np.int64), sets)]
    assert sorted(r["sig"] for r in nearcopies._live(pa.Table.from_pylist(rows)).to_pylist()) == sigs


def test_quality_judges_texts_under_one_id_each(spark, tmp_path):
    good, bad = "a fine sentence about rivers and hills . " * 4, "|| {{ ]] << >> 77 || "
    rows = [(k, f"{good}{k}" if k % 2 else f"{bad * 4}{k}") for k in range(80)] + [(500, good), (500, bad * 4), (None, good), (None, bad * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {(r["doc_id"], r["text"]) for r in CP.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {r for r in rows if good in r[1]}


def test_one_query_for_each_operator():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 11)] == [1] * 10
    assert [s.__name__ for _, s in CP.STAGES] == ["quality", "lines", "near_copies", "substrings", "packing"]
