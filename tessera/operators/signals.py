"""Reading signals: small notes of low attention, and contrasts with official sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import clamp01, contains_words, normalize_name, split_sentences
from tessera.operators.graph_store import PAYLOAD, is_evidence
from tessera.operators.scoring import notes
from tessera.plans.config import Signals


def attention(weight: Column | str = "attention_weight", rank: Column | str = "feed_rank") -> Column:
    """Attention of a document: its source's weight (0 and null count as 0.7), falling with its rank (at least 1)."""
    w = F.col(weight) if isinstance(weight, str) else weight
    r = F.col(rank) if isinstance(rank, str) else rank
    return clamp01(F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(0.7)) / (1 + (F.greatest(F.lit(1), F.coalesce(r.cast("int"), F.lit(1))) - 1) / 5))


def document_time() -> Column:
    """A document's date; the time it was fetched stands in. Evidence has no such stand-in."""
    return F.coalesce("published_at", "fetched_at")


def window(docs: DataFrame, days: int) -> DataFrame:
    """One row: (window_start, window_end) up to the latest document."""
    return docs.agg(F.max("dated").alias("window_end")).select(F.timestamp_add("DAY", F.lit(-days), "window_end").alias("window_start"), "window_end")


def in_window(value: Column | str = "dated") -> Column:
    """Closed on both ends; null bounds are open; null is outside."""
    v = F.col(value) if isinstance(value, str) else value
    return v.isNotNull() & (F.col("window_start").isNull() | (v >= F.col("window_start"))) & (F.col("window_end").isNull() | (v <= F.col("window_end")))


def novelty(evidence: DataFrame, betweenness: DataFrame) -> DataFrame:
    """Evidence with its novelty components and score. evidence: with ends and source_sides; betweenness: node, betweenness."""
    counts = evidence.groupBy("edge_id").agg(F.count("*").alias("edge_count"))
    b = lambda end: betweenness.select(F.col("node").alias(f"{end}_id"), F.col("betweenness").alias(f"{end}_b"))
    rows = evidence.join(counts, "edge_id", "left").join(b("subject"), "subject_id", "left").join(b("object"), "object_id", "left")
    sides = F.when(F.size(F.coalesce("source_sides", F.array().cast("array<string>"))) > 0, F.col("source_sides")).otherwise(F.array(F.coalesce("source_side", F.lit("unknown"))))
    zero = lambda x: F.when(is_evidence(), x).otherwise(0.0)
    rows = rows.withColumns(
        {
            "rare_edge": zero(1 / F.sqrt(F.greatest(F.lit(1), F.coalesce("edge_count", F.lit(1))))),
            "bridge_endpoint": zero(clamp01(4 * F.greatest(F.coalesce("subject_b", F.lit(0.0)), F.coalesce("object_b", F.lit(0.0))))),
            "cross_side_edge": zero(F.when(F.size(F.array_distinct(sides)) >= 2, 1.0).otherwise(0.0)),
            "predicate_specificity": zero(F.when(F.col("predicate") == "CO_MENTIONED_WITH", 0.0).otherwise(1.0)),
        }
    )
    return rows.withColumn("novelty", clamp01(0.45 * F.col("rare_edge") + 0.30 * F.col("bridge_endpoint") + 0.15 * F.col("cross_side_edge") + 0.10 * F.col("predicate_specificity")))


COMPONENTS = ("rare_edge", "bridge_endpoint", "cross_side_edge", "predicate_specificity")


def small_notes(docs: DataFrame, evidence: DataFrame, betweenness: DataFrame, signals: Signals = Signals()) -> DataFrame:
    """Documents of low attention whose best evidence is structurally novel, best first.
    docs: id, dated, attention_weight, feed_rank and provenance; evidence: with ends and source_sides."""
    within = docs.crossJoin(F.broadcast(window(docs, signals.novelty_window_days))).where(in_window())  # one row of two dates
    scored = novelty(evidence, betweenness).join(within.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    place = W.partitionBy("document_id").orderBy(F.desc("novelty"), F.desc("published_at"), "evidence_id")
    ranked = scored.withColumn("place", F.row_number().over(place)).where("place <= 5")
    best = ranked.groupBy("document_id").agg(
        F.max("novelty").alias("structural"), F.min_by(F.struct(*COMPONENTS), "place").alias("novelty_components"), F.array_sort(F.collect_list(F.struct("place", *PAYLOAD))).alias("evidence")
    )
    rows = within.withColumnRenamed("id", "document_id").join(best, "document_id").withColumn("attention_score", attention())
    rows = rows.withColumn("low_attention_score", 1 - F.col("attention_score"))
    rows = rows.withColumn("score", clamp01(0.55 * F.col("structural") + 0.45 * F.col("low_attention_score")))
    kept = rows.where((F.col("low_attention_score") >= signals.low_attention_threshold) & (F.col("structural") >= signals.structural_novelty_threshold) & (F.col("score") >= signals.small_note_min_score))
    return kept.select(
        "document_id", "title", "url", "source_name", "source_side", "published_at", "score", "attention_score", "low_attention_score", F.col("structural").alias("structural_novelty_score"), "novelty_components", "evidence"
    ).orderBy(F.desc("score"), "document_id").limit(signals.small_note_top_n)


def official_sentences(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """(document_id, sentence_no, quote, words, denies) of the sentences of documents (id, text)."""
    both = F.transform(split_sentences("text"), lambda s: F.struct(s.alias("quote"), normalize_name(s).alias("norm")))
    lines = docs.select(F.col("id").alias("document_id"), F.posexplode(both).alias("sentence_no", "s")).select("document_id", "sentence_no", "s.quote", "s.norm")
    denies = F.lit(False)
    for k in keywords:
        denies = denies | F.contains("norm", normalize_name(F.lit(k)))
    return lines.withColumn("denies", denies)


def alias_sentences(sentences: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, document_id, sentence_no, quote, denies): sentences that hold an alias, matched on the
    alias's first word, so no sentence meets an alias it shares no word with. aliases: entity_id, alias_norm."""
    words = sentences.withColumn("word", F.explode(F.array_distinct(F.split("norm", " "))))
    keyed = aliases.where("alias_norm <> ''").withColumn("word", F.substring_index("alias_norm", " ", 1))
    hit = words.join(keyed, "word").where(contains_words("norm", "alias_norm"))
    return hit.select("entity_id", "document_id", "sentence_no", "quote", "denies").dropDuplicates(["entity_id", "document_id", "sentence_no"])


def morning_readings(docs: DataFrame, evidence: DataFrame, entities: DataFrame, betweenness: DataFrame, signals: Signals = Signals()) -> DataFrame:
    """Entities of non-official evidence that official documents deny or do not mention, best first."""
    bounds = F.broadcast(window(docs, signals.morning_lookback_days))  # one row of two dates
    official = docs.where(F.col("source_side") == signals.official_side).crossJoin(bounds).where(in_window())
    others = evidence.where(F.coalesce("source_side", F.lit("")) != signals.official_side).crossJoin(bounds).where(in_window("published_at"))
    # a self-loop counts twice here
    touched = others.withColumn("entity_id", F.explode(F.array("subject_id", "object_id")))
    w = W.partitionBy("entity_id").orderBy("published_at", "evidence_id")
    ranked = touched.withColumn("place", F.row_number().over(w))
    per = ranked.groupBy("entity_id").agg(
        F.count("*").alias("non_official_evidence_count"), F.array_sort(F.collect_set(F.coalesce("source_side", F.lit("unknown")))).alias("source_sides"), F.min("published_at").alias("earliest"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", *PAYLOAD)))).alias("non_official_evidence"),
    ).where(F.col("non_official_evidence_count") >= signals.min_non_official_mentions)
    named = per.join(entities.select(F.col("canonical_id").alias("entity_id"), "canonical_name", "aliases"), "entity_id")
    aliases = named.select("entity_id", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).select("entity_id", normalize_name("a").alias("alias_norm")).distinct()
    hits = alias_sentences(official_sentences(official, signals.denial_keywords), aliases)
    order = F.struct("document_id", "sentence_no", "quote")
    said = hits.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.sum(F.col("denies").cast("int")).alias("denials"), F.slice(F.array_sort(F.collect_list(F.when(F.col("denies"), order))), 1, 5).alias("official_quotes"))
    latest = F.broadcast(official.agg(F.max("dated").alias("latest_official"), F.count("*").alias("n_official")))  # one row
    rows = named.join(said, "entity_id", "left").fillna(0, ["mentions", "denials"]).where("denials > 0 or mentions = 0")
    rows = rows.join(betweenness.withColumnRenamed("node", "entity_id"), "entity_id", "left").crossJoin(latest).crossJoin(bounds)
    denied = F.col("denials") > 0
    score = clamp01(
        0.35 * F.least(F.lit(1.0), F.col("non_official_evidence_count") / 5) + 0.30 * F.least(F.lit(1.0), F.size("source_sides") / 2)
        + 0.20 * clamp01(4 * F.coalesce("betweenness", F.lit(0.0))) + F.when(denied, 0.15).otherwise(0.0)
    )
    return rows.select(
        "entity_id", F.col("canonical_name").alias("entity_name"), F.when(denied, "official_denial_or_correction").otherwise("possible_silence").alias("status"), score.alias("score"), "source_sides",
        "non_official_evidence_count", F.col("mentions").alias("official_mentions_count"), "window_start", "window_end", "non_official_evidence", F.coalesce("official_quotes", F.array().cast("array<struct<document_id:string,sentence_no:int,quote:string>>")).alias("official_quotes"),
        F.concat(F.array(F.lit("Comparison of a text window: it implies neither deliberate omission nor falsehood.")), notes(
            ((F.col("n_official") > 0) & (F.col("latest_official") < F.col("earliest")), "The official source available is older than the non-official mention."), (F.col("n_official") == 0, "There are no official documents in the window."),
        )).alias("caveats"),
    ).orderBy(F.desc("score"), "entity_id").limit(signals.morning_top_n)
