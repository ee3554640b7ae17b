"""Entity mentions and co-mentions from text, grounding of given extractions, and their cache."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import citation_text, contains_words, is_acronym, normalize_name, normalize_ws, quote_window, split_sentences, stable_hash
from tessera.plans.config import AppConfig

PROVIDER, MODEL = "dev", "heuristic-known-entities-v1"
HOSTED, HOSTED_KEY = "deepseek", "DEEPSEEK_API_KEY"
#: Bounds of co-mention extraction.
SCANNED_CHARS, ENTITIES_PER_SENTENCE, RELATIONS_PER_DOCUMENT, CO_MENTION_CONFIDENCE = 15000, 8, 80, 0.55
PAYLOAD_SCHEMA = (
    "document_id STRING, text_hash STRING, provider STRING, model STRING, cache_policy_fingerprint STRING, entities ARRAY<STRUCT<name:STRING,entity_type:STRING,quote:STRING,confidence:DOUBLE>>, "
    "relations ARRAY<STRUCT<subject:STRING,subject_type:STRING,predicate:STRING,object:STRING,object_type:STRING,quote:STRING,confidence:DOUBLE,assertion_type:STRING>>, warnings ARRAY<STRING>"
)
IDENTITY = ("provider", "model", "fingerprint")


def _terms(catalogue: DataFrame) -> DataFrame:
    return catalogue.withColumn("alias_norm", normalize_name("alias")).where("alias_norm <> ''")


def _catalogue_rows(catalogue: DataFrame) -> DataFrame:
    """The catalogue as one row of an array: it lives in the configuration, so its size is that of a file."""
    rows = _terms(catalogue).groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "alias_pos", "name", "entity_type", "alias", "alias_norm"))).alias("terms"))
    return F.broadcast(rows)


def _padded(text: Column | str) -> Column:
    """The normalised text between blanks, in which words are found as ' word '."""
    return F.concat(F.lit(" "), normalize_name(text), F.lit(" "))


def with_found(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """docs (id, text) with found: for each catalogue entity in the text, the last alias that matches. No shuffle:
    each document is normalised once and held against the whole catalogue."""
    hit = F.filter("terms", lambda t: F.contains("padded", F.concat(F.lit(" "), t["alias_norm"], F.lit(" "))))
    # exploding an array of one keeps the optimizer from putting what it holds inside a lambda
    padded = docs.select("id", "text", F.explode(F.array(_padded("text"))).alias("padded"))
    hits = padded.crossJoin(_catalogue_rows(catalogue)).select("id", "text", F.explode(F.array(hit)).alias("hits"))
    last = F.filter("hits", lambda t, i: (i == F.size("hits") - 1) | (F.get("hits", i + 1)["pos"] != t["pos"]))
    found = F.transform(last, lambda t: F.struct(t["pos"].alias("pos"), t["name"].alias("name"), t["entity_type"].alias("entity_type"), t["alias"].alias("alias"), F.when(t["alias"] == t["name"], 0.85).otherwise(0.78).alias("confidence")))
    return hits.select("id", "text", found.alias("found"))


def find_mentions(docs: DataFrame, catalogue: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(id, pos, name, entity_type, quote, confidence, verbatim): catalogue entities in each text; the last alias that
    matches gives quote and confidence; verbatim: whether the quote stands in the text. found: with_found(), where it is at hand.
    A text's white space and case are normalised once for all of its mentions."""
    own = (with_found(docs, catalogue) if found is None else found).where(F.size("found") > 0)
    plain = own.select("id", "found", F.explode(F.array(normalize_ws("text"))).alias("plain"))
    low = plain.select("id", "found", "plain", F.explode(F.array(F.lower("plain"))).alias("low"))
    rows = low.select("id", "plain", "low", F.explode("found").alias("m")).select("id", "m.*", "low", F.explode(F.array(quote_window("plain", "low", "m.alias"))).alias("quote"))
    quote = F.lower(normalize_ws("quote"))
    return rows.select("id", "pos", "name", "entity_type", "quote", "confidence", ((quote != "") & F.contains("low", quote)).alias("verbatim"))


def is_verbatim(quote: Column | str, text: Column | str) -> Column:
    """Whether the quote stands in the text, white space and case apart."""
    q = normalize_ws(quote)
    return (q != "") & F.contains(F.lower(normalize_ws(text)), F.lower(q))


def extract_entities(docs: DataFrame, catalogue: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Mentions whose quote is verbatim."""
    return find_mentions(docs, catalogue, found).where("verbatim").drop("verbatim")


def co_mentions(docs: DataFrame, catalogue: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(id, sentence_no, subject, ..., quote, confidence): pairs of entities that share a sentence. docs: id, text; found: as in find_mentions().

    Entities are those of find_mentions(), before the check of their quotes, in catalogue order; of a
    sentence the first 8 pair up, equal pairs with the same first 80 characters count once, and a
    document has 80 relations at most.
    """
    terms = _terms(catalogue).groupBy("pos").agg(F.first("name").alias("name"), F.first("entity_type").alias("entity_type"), F.collect_set("alias_norm").alias("norms"))
    all_terms = F.broadcast(terms.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "name", "entity_type", "norms"))).alias("entries")))
    own = (with_found(docs, catalogue) if found is None else found).where(F.size("found") >= 2)
    texts = own.select("id", F.substring("text", 1, SCANNED_CHARS).alias("head"), F.explode(F.array("found")).alias("found")).crossJoin(all_terms)
    present = F.filter("entries", lambda e: F.exists("found", lambda f: f["pos"] == e["pos"]))
    known = texts.select("id", "found", "head", F.explode(F.array(present)).alias("entries")).where(F.size("entries") >= 2)
    both = F.transform(split_sentences("head"), lambda s: F.struct(s.alias("sentence"), _padded(s).alias("padded")))
    lines = known.select("id", "found", "entries", F.posexplode(both).alias("sentence_no", "s")).select("id", "found", "entries", "sentence_no", "s.sentence", "s.padded")
    inside = F.filter("entries", lambda e: F.exists(e["norms"], lambda a: F.contains("padded", F.concat(F.lit(" "), a, F.lit(" ")))))
    lines = lines.withColumn("inside", F.slice(inside, 1, ENTITIES_PER_SENTENCE)).where(F.size("inside") >= 2)
    numbers = F.sequence(F.lit(0), F.size("inside") - 1)
    pairs = F.flatten(F.transform(numbers, lambda i: F.transform(F.filter(numbers, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = lines.withColumn("p", F.explode(pairs)).select("id", "sentence_no", "sentence", "found", "p.i", "p.j", F.get("inside", F.col("p.i")).alias("l"), F.get("inside", F.col("p.j")).alias("r"))
    sure = lambda side: F.get(F.filter("found", lambda f: f["pos"] == F.col(f"{side}.pos")), F.lit(0))["confidence"]
    left, right = normalize_name("l.name"), normalize_name("r.name")
    rows = rows.select(
        "id", "sentence_no", "i", "j", F.col("l.name").alias("subject"), F.col("l.entity_type").alias("subject_type"), F.lit("CO_MENTIONED_WITH").alias("predicate"), F.col("r.name").alias("object"), F.col("r.entity_type").alias("object_type"),
        F.col("sentence").alias("quote"), F.least(sure("l"), sure("r"), F.lit(CO_MENTION_CONFIDENCE)).alias("confidence"), F.lit("evidence").alias("assertion_type"),
        stable_hash("id", F.concat(F.least(left, right), F.lit("|"), F.greatest(left, right)), F.substring("sentence", 1, 80), length=20).alias("key"),
    )
    place = ("sentence_no", "i", "j")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("id", "key").orderBy(*place))).where("n = 1")
    return first.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(*place))).where(F.col("n") <= RELATIONS_PER_DOCUMENT).drop("n", "key")


def sanitize(extractions: DataFrame, docs: DataFrame) -> DataFrame:
    """Keep entities and relations whose quote is verbatim; count the dropped ones in a warning.
    extractions: document_id, entities, relations, warnings; docs: id, text, text_hash."""
    rows = extractions.drop("text_hash").join(docs.select(F.col("id").alias("document_id"), "text", "text_hash"), "document_id")
    kept = lambda c: F.filter(F.coalesce(c, F.expr("array()").cast(extractions.schema[c].dataType)), lambda e: is_verbatim(F.coalesce(e["quote"], F.lit("")), F.col("text")))
    size = lambda c: F.coalesce(F.size(F.coalesce(c, F.expr("array()").cast(extractions.schema[c].dataType))), F.lit(0))
    rows = rows.withColumns({"__e": kept("entities"), "__r": kept("relations")})
    dropped = size("entities") - F.size("__e") + size("relations") - F.size("__r")
    warned = F.when(dropped > 0, F.array_append(F.coalesce("warnings", F.array().cast("array<string>")), F.concat(F.lit("dropped_items_without_verbatim_quote="), dropped.cast("string")))).otherwise(F.coalesce("warnings", F.array().cast("array<string>")))
    return rows.withColumn("warnings", warned).withColumns({"entities": F.col("__e"), "relations": F.col("__r")}).drop("__e", "__r")


def named_in(quote: Column, alias: Column) -> Column:
    """Whether the alias stands in the quote; two- and three-letter acronyms with their case."""
    found = lambda keep: contains_words(citation_text(quote, keep), citation_text(alias, keep))
    return F.when(is_acronym(alias), found(True)).otherwise(found(False))


def alias_groups(config: AppConfig) -> list[tuple[str, list[str]]]:
    """(member, all names of its groups) of the configured names and aliases."""
    out: list[tuple[str, list[str]]] = []
    groups = [{e.name, *e.aliases} for e in config.known_entities] + [{n, *a} for n, a in config.resolver.aliases.items()]
    for g in groups:
        out += [(m, sorted(g)) for m in sorted(g)]
    return out


def ground(extractions: DataFrame, docs: DataFrame, config: AppConfig, provider: str, model: str, fingerprint: str) -> DataFrame:
    """sanitize(), then keep entities and relations whose names, or aliases of them, stand in their quotes;
    predicates other than CO_MENTIONED_WITH become inferences; provenance is overwritten."""
    spark = extractions.sparkSession
    names = spark.createDataFrame(alias_groups(config) or [("", [""])], "member string, names array<string>")
    known = names.select(normalize_name("member").alias("k"), F.explode("names").alias("n")).where("k <> ''").groupBy("k").agg(F.collect_set("n").alias("v"))
    lookup = F.broadcast(known.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("groups")))  # the configuration's size
    clean = sanitize(extractions, docs).crossJoin(lookup)
    grounded = lambda name, quote: F.exists(F.coalesce(F.try_element_at("groups", normalize_name(name)), F.array(name)), lambda a: named_in(quote, a))
    rows = clean.withColumns(
        {
            "__e": F.filter("entities", lambda e: grounded(e["name"], e["quote"])),
            "__r": F.filter("relations", lambda r: grounded(r["subject"], r["quote"]) & grounded(r["object"], r["quote"])),
        }
    )
    demoted = F.transform("__r", lambda r: r.withField("assertion_type", F.when(r["predicate"] == "CO_MENTIONED_WITH", r["assertion_type"]).otherwise("inference")))
    inferred = F.size(F.filter("__r", lambda r: r["predicate"] != "CO_MENTIONED_WITH"))
    count = lambda n, text: F.when(n > 0, F.concat(F.lit(text), n.cast("string"), F.lit(".")))
    more = F.array_compact(F.array(
        count(F.size("entities") - F.size("__e"), "Entities dropped because the quote supports neither name nor alias: "),
        count(F.size("relations") - F.size("__r"), "Relations dropped because the quote does not support subject and object: "),
        count(inferred, "Relations with predicates other than CO_MENTIONED_WITH marked as inference for human review: "),
    ))
    return rows.select(
        "document_id", "text_hash", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(fingerprint).alias("cache_policy_fingerprint"),
        F.col("__e").alias("entities"), demoted.alias("relations"), F.concat("warnings", more).alias("warnings"),
    )


def policy_fingerprint(config: AppConfig, provider: str) -> str:
    """Version and hash of all settings that extraction depends on: names and aliases in any order, and the hosted request."""
    known = sorted((e.name, e.entity_type, sorted(set(e.aliases))) for e in config.known_entities)
    body = {"known_entities": known, "aliases": sorted((n, sorted(set(a))) for n, a in config.resolver.aliases.items())}
    if provider != PROVIDER:
        body["request"] = {k: v for k, v in asdict(config.llm).items() if k not in ("cache_extractions", "provider", "model")}
    return "v1:" + hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:24]


def cache_identity(config: AppConfig, environ: dict[str, str] | None = None) -> tuple[str, str, str]:
    """(provider, model, fingerprint) in force; provider auto is the hosted one only with its key in the environment."""
    provider = config.llm.provider
    if provider == "auto":
        provider = HOSTED if (os.environ if environ is None else environ).get(HOSTED_KEY) else PROVIDER
    if provider not in (PROVIDER, HOSTED):
        raise ValueError(f"{provider} is no extraction provider")
    return provider, MODEL if provider == PROVIDER else config.llm.model, policy_fingerprint(config, provider)


def valid_extractions(stored: DataFrame, docs: DataFrame, provider: str, model: str, fingerprint: str) -> DataFrame:
    """Stored extractions whose text hash is the document's current one and whose identity is the given one,
    in their row as well as in their payload. stored: document_id, text_hash, provider, model, payload_json."""
    check_policy(fingerprint)
    p = F.from_json("payload_json", PAYLOAD_SCHEMA)
    same = (F.col("provider") == provider) & (F.col("model") == model) & (p["provider"] == provider) & (p["model"] == model) & (p["cache_policy_fingerprint"] == fingerprint) & (p["text_hash"] == F.col("text_hash"))
    current = docs.select(F.col("id").alias("document_id"), "text_hash")
    return stored.where(same).join(current, ["document_id", "text_hash"]).select("document_id", "text_hash", "provider", "model", p["entities"].alias("entities"), p["relations"].alias("relations"), p["warnings"].alias("warnings"))


def check_policy(fingerprint: str) -> None:
    """A blank or legacy fingerprint is refused."""
    if not fingerprint.strip() or fingerprint == "legacy":
        raise ValueError("the extraction policy has no current fingerprint")


def split_by_cache(docs: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): documents with and without a valid extraction."""
    ids = valid.select(F.col("document_id").alias("id"))
    return docs.join(ids, "id", "left_semi"), docs.join(ids, "id", "left_anti")
