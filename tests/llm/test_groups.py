import math
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import covertree as C
from tessera.llm import simhash as H
from tessera.llm.components import connected_components


def components(nodes, linked):
    comp = {n: n for n in nodes}
    while True:
        new = {n: min([comp[n], *(comp[m] for m in nodes if linked(n, m))]) for n in nodes}
        if new == comp:
            return comp
        comp = new


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_docs(seed=1):
    rng = random.Random(seed)
    base = [" ".join(f"W{rng.randrange(3000)}" for _ in range(120)) for _ in range(6)]
    docs = []
    for k in range(90):
        words = base[k % 6].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        docs.append(" ".join(words))
    return list(enumerate([*docs, None, "", "  ", "one", "one two", "ONE two"]))


@pytest.mark.parametrize("tile", [2048, 3])
def test_simhash_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(H, "TILE", tile)
    docs = near_docs()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.simhash_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs}
    comp = components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}
    assert len(set(comp.values())) < len(docs) - 20


def test_tile_links_are_complete():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    b = np.concatenate((a[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)), rng.integers(0, 1 << 63, 300).astype(np.uint64)))
    got = {(int(i), int(j)) for x, y in H.tile_links(a, b, 2) for i, j in zip(x, y)}
    assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= 2}


def test_simhash_odd(spark, odd_docs, no_docs):
    rows = H.simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count() and H.simhash_groups(no_docs).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 1 and by[8]["component_id"] == 5


def test_majority_of_many():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 70000).astype(np.uint64)
    expected = sum(1 << b for b in range(64) if int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(hashes))
    assert H.majority_fingerprint(hashes) == expected


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for p in links if p[0] != p[1] for x in p})
    pairs = {frozenset(p) for p in links}
    assert got == components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=1, n=260):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    for k in range(0, n - 1, 3):
        x[k + 1] = x[k] + rng.normal(size=16) * 0.12
    x[50:60] = x[0]
    return [(int(k), [float(v) for v in x[k].astype(np.float32)], int(k // 3 % 4)) for k in range(n)]


def brute_vectors(rows, cosine=0.98):
    unit = {}
    for i, v, label in rows:
        if v and label is not None and i is not None and all(c is not None and math.isfinite(c) for c in v) and any(v):
            unit[i] = (np.array(v) / np.sqrt((np.array(v) ** 2).sum()), label)
    near = lambda a, b: a != b and a in unit and b in unit and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and float(unit[a][0] @ unit[b][0]) >= cosine
    ids = [r[0] for r in rows]
    comp = components(ids, near)
    return {i: (sum(near(i, j) for j in ids), comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("tile", [2048, 6])
def test_cover_tree_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(C, "TILE", tile)
    monkeypatch.setattr(C, "CHUNK", 16)
    rows = vectors()
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, rows[0][1], None), (1005, [float("inf")] * 16, 0), (1006, [1.0] * 4, 0), (1007, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS cell", "3 AS n_links")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in C.embedding_groups(df).collect()}
    expected = brute_vectors(rows)
    assert got == expected and sum(v[0] for v in expected.values()) > 100


def test_cover_tree_levels():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    seen = []

    def walk(node):
        for centre, radius, below in zip(node.centres, node.radii, node.below):
            if below is None:
                seen.append(int(centre))
                continue
            under = leaves(below)
            assert np.sqrt(((x[under] - x[centre]) ** 2).sum(axis=1)).max() <= radius + 1e-9
            assert int(centre) in under  # nested
            walk(below)

    def leaves(node):
        out = []
        for centre, below in zip(node.centres, node.below):
            out += [int(centre)] if below is None else leaves(below)
        return out

    walk(C.build(x, np.arange(300), 0, 2.0))
    assert sorted(seen) == list(range(300))


def test_embeddings_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert C.embedding_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = sorted([tuple(r) for r in C.embedding_groups(spark.createDataFrame(rows, schema)).collect()], key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)], key=str)


def test_repeated_ids_and_extreme_components(spark):
    schema = "vec_id long, embedding array<double>, label int"
    near = [0.999, 0.04]
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, near, 0), (3, [1e-200, 0.0], 2), (4, [2e-200, 1e-202], 2), (5, [1e300, 0.0], 3), (6, [1.5e300, 1e299], 3), (7, [5e-324, 0.0], 3), (8, [0.0, 1e-310], 3)]
    got = sorted([tuple(r) for r in C.embedding_groups(spark.createDataFrame(rows, schema)).collect()])
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (8, 0, 8, True)]
