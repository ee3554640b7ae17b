import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tessera.llm import pieces as P  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.PieceModel(PATH)


def test_equals_the_library(model):
    rng = random.Random(1)
    alphabet = list("abcdehinorst  ▁\t\n.,ABéüßﬁＡ中文字日😀́​\x00|#") + ["the ", "ing", "<s>", "  ", "<unk>", "<0x0A>"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        ids = model.encode(text)
        assert ids == model.library.encode(text)
        assert model.decode(ids) == model.library.decode(ids)


def test_decodes_any_ids_as_the_library(model):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(0, 32000), rng.randrange(0, 259), rng.randrange(195, 259)]) for _ in range(rng.randrange(0, 12))]
        assert model.decode(ids) == model.library.decode(ids)


def test_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 8)
    model.cache.clear()
    for k in range(50):
        model.encode(f"w{k}")
        assert len(model.cache) <= 8


def test_query(spark, odd_docs, no_docs, model):
    rows = P.piece_digests(odd_docs, PATH, check_every=1).collect()
    assert len(rows) == odd_docs.count() and P.piece_digests(no_docs, PATH).count() == 0
    by = {r["doc_id"]: r for r in rows}
    for r in odd_docs.collect():
        ids = model.library.encode(r["text"] or "")
        assert by[r["doc_id"]]["n_tokens"] == len(ids)
        assert by[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()


def test_frames(spark, odd_docs):
    back = P.decode_pieces(P.encode_pieces(odd_docs, PATH), PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert {r["doc_id"]: r["text"] for r in back.collect()} == texts


def test_a_difference_is_raised(spark, monkeypatch):
    monkeypatch.setattr(P.PieceModel, "encode", lambda self, text: [5])
    docs = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    model = P.PieceModel(PATH)
    assert model.encode("hello") != model.library.encode("hello")
    assert docs.count() == 1
