"""Registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated chunks of lines."""
    from tessera.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).drop("row", "text")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a baseline JPEG and read back."""
    from tessera.llm.media import encode_media, media_features

    return media_features(encode_media(table(spark, sf_dir, "documents")))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that start anywhere else."""
    from tessera.llm.substring import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).drop("row", "text")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded with the 32k vocabulary."""
    from tessera.llm.pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    from tessera.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op6_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors with equal labels."""
    from tessera.llm.covertree import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    from tessera.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).drop("row", "head")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of several lengths."""
    from tessera.llm.packing import pack_documents, token_counts

    return pack_documents(token_counts(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    from tessera.llm.mixing import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence findings of all documents."""
    from tessera.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lines, op2_media, op3_substrings, op4_pieces, op5_quality, op6_covertree, op7_simhash, op8_packing, op9_mixing, op10_licenses)}
#: Words of every text, and the windows of 35 of them; equal windows are compared as texts.
_WINDOWS = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS r(i)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN again USING (s), range(35) AS r(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Links by cosine within a label, and the least vector that each reaches.
_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN deg USING (vec_id)"""

#: All else needs hashes, trained models, codecs or tokenizers that SQL lacks; tests hold those queries against plain versions.
ORACLES: dict[str, str] = {"op3_substrings": _WINDOWS, "op6_covertree": _VECTORS}
