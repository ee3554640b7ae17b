"""Registered queries of the evidence-graph engine; their SQL is in tessera.plans.oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import centrality, export, extraction, graph_store, resolution, scoring, signals
from tessera.plans import store_queries
from tessera.plans.config import AppConfig, Scoring, Signals
from tessera.plans.oracles import ORACLES
from tessera.sources import adapters, web
from tessera.sources.adapters import table

CONFIG = AppConfig(known_entities=list(adapters.CATALOGUE))
DAY = "yyyy-MM-dd"
POLICY = "v1:fixture"


def r6(c) -> F.Column:
    """Rounded to six decimals."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational adapter's relations without repeats."""
    return adapters.relations(spark, sf_dir, distinct=True)


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(buyer, seller, flag, linestatus, n): facts counted by what edges between nations are made of; kept, a few thousand rows."""
    return adapters.facts(spark, sf_dir).groupBy("buyer", "seller", "flag", "linestatus").agg(F.count("*").alias("n")).persist()


def _trade_edges(trade: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as edges_of() makes them of all relations, without confidence and dates."""
    rows = adapters.with_edges(adapters.with_nations(trade, spark, sf_dir))
    return rows.groupBy(*graph_store.EDGE).agg(F.array_sort(F.collect_set("source_side")).alias("source_sides"))


def _kept_pairs(trade: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(buyer, seller, u, v) of pairs of distinct nations with many relations: percent_rank of 0.66 or more over at most 300 pairs."""
    counted = trade.groupBy("buyer", "seller").agg(F.sum("n").alias("n"))
    ends = {"u": F.least("subject_id", "object_id"), "v": F.greatest("subject_id", "object_id")}
    ways = adapters.with_nations(counted, spark, sf_dir).where("subject_id <> object_id").withColumns(ends).select("buyer", "seller", "u", "v", "n").persist()  # at most 600 rows
    ranked = ways.groupBy("u", "v").agg(F.sum("n").alias("n")).withColumn("p", F.percent_rank().over(W.orderBy("n")))
    return ways.drop("n").join(F.broadcast(ranked.where("p >= 0.66").select("u", "v")), ["u", "v"])


def _thresholded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entities, evidence) of the thresholded nation graph. Kept are the narrow facts, for several readers; texts and hashes are made from them."""
    kept = _kept_pairs(_trade(spark, sf_dir), spark, sf_dir).select("buyer", "seller")
    rows = adapters.facts(spark, sf_dir, distinct=True).join(F.broadcast(kept), ["buyer", "seller"], "left_semi").persist()
    return adapters.nation_entities(spark, sf_dir), adapters.as_relations(rows, spark, sf_dir)


def _thresholded_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, pairs) of the thresholded nation graph: repeats make no difference to edges."""
    trade = _trade(spark, sf_dir)
    kept = _kept_pairs(trade, spark, sf_dir).select("u", "v").distinct()
    pairs = centrality.project(_trade_edges(trade, spark, sf_dir))
    return adapters.nation_entities(spark, sf_dir).select(F.col("canonical_id").alias("node")), pairs.join(F.broadcast(kept), ["u", "v"]).persist()  # at most 300 pairs


def evidence_scan_filtered(spark, sf_dir):
    """Evidence with a predicate of its own."""
    rows = _evidence(spark, sf_dir).where(graph_store.is_evidence() & (F.col("predicate") != "CO_MENTIONED_WITH"))
    return rows.select("evidence_id", "edge_id", "document_id", "predicate", r6("confidence").alias("confidence"), F.date_format("published_at", DAY).alias("published_on"))


def edge_rollup(spark, sf_dir):
    """Edges derived from evidence."""
    edges = graph_store.edges_of(adapters.relations(spark, sf_dir))
    return edges.select("edge_id", "subject_id", "predicate", "object_id", "assertion_type", r6("confidence").alias("confidence"), F.date_format("first_seen_at", DAY).alias("first_seen"), F.date_format("last_seen_at", DAY).alias("last_seen"), F.array_join("source_sides", ",").alias("source_sides"))


def evidence_counts_by_edge(spark, sf_dir):
    """Pieces of evidence of each edge."""
    return graph_store.evidence_counts_by_edge(_evidence(spark, sf_dir))


def graph_counts(spark, sf_dir):
    """Sizes of the three tables."""
    rel = _evidence(spark, sf_dir)
    return graph_store.counts(adapters.nation_entities(spark, sf_dir), rel.select("edge_id").distinct(), rel)


def evidence_for_entity_topk(spark, sf_dir):
    """The 8 newest pieces of evidence of every entity."""
    return graph_store.evidence_for_entities(_evidence(spark, sf_dir).select("evidence_id", "subject_id", "object_id", "published_at"), 8).select("entity_id", "evidence_id", "rank")


def evidence_for_document(spark, sf_dir):
    """Evidence of every document with the names of its ends."""
    ev, entities = _evidence(spark, sf_dir), adapters.nation_entities(spark, sf_dir)
    names = lambda end: F.broadcast(entities.select(F.col("canonical_id").alias(f"{end}_id"), F.col("canonical_name").alias(f"{end}_name"), F.col("entity_type").alias(f"{end}_type")))  # noqa: E731  25 nations
    return ev.drop("subject_name", "object_name", "subject_type", "object_type").join(names("subject"), "subject_id").join(names("object"), "object_id").select("document_id", "evidence_id", "subject_name", "object_name", "subject_type", "predicate")


def stable_ids(spark, sf_dir):
    """Document identities and hashes."""
    docs = adapters.corpus(spark, sf_dir)
    return docs.select("doc_id", "id", "text_hash", T.stable_hash("source_name", F.lit(None), "url").alias("short_hash"))


def normalize_names(spark, sf_dir):
    """Normalised titles and texts."""
    return adapters.corpus(spark, sf_dir).select("doc_id", T.normalize_name("title").alias("title_norm"), F.sha2(T.normalize_name("text"), 256).alias("text_norm_hash"))


def sentences(spark, sf_dir):
    """All sentences."""
    return adapters.corpus(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences("text")).alias("sentence_no", "sentence"))


def quote_windows(spark, sf_dir):
    """The quote around each mention and whether it is verbatim."""
    rows = extraction.find_mentions(adapters.corpus(spark, sf_dir), adapters.catalogue(spark))
    return rows.select("id", "name", "quote", "verbatim")


def dev_entities(spark, sf_dir):
    """Catalogue entities of each document."""
    rows = extraction.extract_entities(adapters.corpus(spark, sf_dir), adapters.catalogue(spark))
    return rows.select("id", "pos", "name", "entity_type", "quote", r6("confidence").alias("confidence"))


def co_mentions(spark, sf_dir):
    """Entities that share a sentence."""
    rows = extraction.co_mentions(adapters.corpus(spark, sf_dir), adapters.catalogue(spark))
    return rows.select("id", "sentence_no", "subject", "object", "quote", r6("confidence").alias("confidence"))


def _corpus_relations(spark, sf_dir):
    """(docs, seeds, names, resolved, relations) of the corpus adapter."""
    docs, terms = adapters.corpus(spark, sf_dir), adapters.catalogue(spark)
    # read by several branches below; Spark spills what memory can't hold
    both = extraction.with_found(docs, terms).where(F.size("found") > 0).persist()
    found, pairs = extraction.extract_entities(docs, terms, both).persist(), extraction.co_mentions(docs, terms, both).persist()
    seeds = resolution.seed_aliases(spark, CONFIG)
    names = resolution.distinct_names(resolution.mentioned(found, pairs)).persist()
    resolved = resolution.resolve_names(names, seeds, CONFIG.resolver.similarity_threshold).persist()
    return docs, seeds, names, resolved, resolution.resolve_relations(pairs, resolved, docs, f"{extraction.PROVIDER}:{extraction.MODEL}")


def resolved_relations(spark, sf_dir):
    """Co-mentions between canonical entities."""
    rows = _corpus_relations(spark, sf_dir)[4]
    return rows.select("evidence_id", "edge_id", "subject_id", "object_id", "document_id", "source_side", r6("confidence").alias("confidence"))


def _stored(spark, sf_dir) -> DataFrame:
    """Stored extractions of a third of the documents: some of an old text, some of another policy."""
    docs = adapters.corpus(spark, sf_dir).where("doc_id % 3 = 0")
    seen = F.when(F.col("doc_id") % 5 == 0, F.lit("stale")).otherwise(F.col("text_hash"))
    policy = F.when(F.col("doc_id") % 7 == 0, F.lit("v0:old")).otherwise(F.lit(POLICY))
    payload = F.to_json(F.struct(F.col("id").alias("document_id"), seen.alias("text_hash"), F.lit(extraction.PROVIDER).alias("provider"), F.lit(extraction.MODEL).alias("model"), policy.alias("cache_policy_fingerprint")))
    return docs.select(F.col("id").alias("document_id"), seen.alias("text_hash"), F.lit(extraction.PROVIDER).alias("provider"), F.lit(extraction.MODEL).alias("model"), payload.alias("payload_json"))


def valid_extractions(spark, sf_dir):
    """Stored extractions that still hold."""
    return extraction.valid_extractions(_stored(spark, sf_dir), adapters.corpus(spark, sf_dir), extraction.PROVIDER, extraction.MODEL, POLICY).select("document_id", "text_hash")


def cache_hit_miss(spark, sf_dir):
    """Documents with and without a valid extraction, by source."""
    docs = adapters.corpus(spark, sf_dir)
    hits, misses = extraction.split_by_cache(docs, extraction.valid_extractions(_stored(spark, sf_dir), docs, extraction.PROVIDER, extraction.MODEL, POLICY))
    one = lambda df, hit: df.select("source_name", F.lit(hit).alias("hit"))
    return one(hits, 1).unionByName(one(misses, 0)).groupBy("source_name").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


def replace_documents(spark, sf_dir):
    """Every tenth order replaced by its co-mentions alone."""
    rel = _evidence(spark, sf_dir)
    number = F.substring("document_id", 5, 20).cast("long")
    batch = rel.where(number % 10 == 0)
    old = rel.select(*graph_store.EVIDENCE)
    ends = graph_store.edges_of(rel).select(*graph_store.EDGE).persist()  # as small as the edges
    after, ends, observed = graph_store.upsert_relations(old, ends, batch.where("predicate = 'CO_MENTIONED_WITH'"), batch.select("document_id").distinct())
    # read by three branches below: the columns that these need
    after = after.select("evidence_id", "document_id", "edge_id", "published_at", "confidence", "assertion_type", "source_side").persist()
    edges = graph_store.roll_up_edges(after, ends)
    gone = batch.select("evidence_id").join(after.where(number % 10 == 0).select("evidence_id"), "evidence_id", "left_anti")  # the others' documents stay whole
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return one(after, "evidence").unionByName(one(edges, "edges")).unionByName(one(gone, "removed")).unionByName(one(observed, "observed"))


def discovery_rank_dedup(spark, sf_dir):
    """Discovery order of pages by host, first of each address, five each."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return web.discovered(pages, "page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), 5).select("page_id", F.col("source").alias("host"), "rank")


def url_safety(spark, sf_dir):
    """Whether an address may be fetched, as far as its text tells."""
    return table(spark, sf_dir, "pages").select("page_id", "url", web.is_safe_url("url").alias("safe"))


def independence(spark, sf_dir):
    """Independence of every nation's evidence."""
    ev = _evidence(spark, sf_dir).select("subject_id", "object_id", "source_side", "source_name", "document_id")
    rows = scoring.independence(graph_store.touching(ev))
    return rows.select("entity_id", r6("independence_score").alias("independence_score"), F.size("independent_units").alias("units"), F.size("source_sides").alias("sides"), "documents", F.col("total_evidence_count").alias("total"), F.col("independence_passed").alias("passed"))


def specificity(spark, sf_dir):
    """Specificity of the nations of the thresholded graph."""
    entities, ev = _thresholded(spark, sf_dir)
    pairs = centrality.project(graph_store.edges_of(ev))
    names = entities.select(F.col("canonical_id").alias("entity_id"), F.col("canonical_name").alias("entity_name"), "entity_type")
    found = centrality.degrees(pairs).withColumnRenamed("node", "entity_id").join(names, "entity_id")
    rows = scoring.specificity(graph_store.touching(ev), found)
    return rows.select("entity_id", *(r6(c).alias(c) for c in ("predicate_score", "quote_score", "degree_penalty", "specificity_score")))


def temporal_concentration(spark, sf_dir):
    """Best week of every user's events."""
    ev = adapters.event_evidence(spark, sf_dir)
    rows = scoring.temporal(ev, ev.select("published_at"))
    return rows.select(
        "entity_id", F.col("total_dated_count").alias("total"), F.col("max_window_evidence_count").alias("max_window"), F.col("corpus_span_days").alias("span_days"), r6("lift_over_uniform").alias("lift"),
        r6("temporal_score").alias("score"), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
    )


def graph_projection_degree(spark, sf_dir):
    """Degrees in the undirected simple graph."""
    pairs = centrality.project(_trade_edges(_trade(spark, sf_dir), spark, sf_dir))
    return centrality.degrees(pairs).select(F.col("node").alias("entity_id"), "degree")


def betweenness(spark, sf_dir):
    """Betweenness in the thresholded nation graph."""
    scores = centrality.betweenness(*_thresholded_pairs(spark, sf_dir))
    return scores.join(adapters.nation_entities(spark, sf_dir), F.col("node") == F.col("canonical_id")).select(F.col("node").alias("entity_id"), F.col("canonical_name").alias("entity_name"), r6("betweenness").alias("betweenness"))


def null_model(spark, sf_dir):
    """Every nation's betweenness against random graphs of the same degrees."""
    nodes, pairs = _thresholded_pairs(spark, sf_dir)
    observed = centrality.betweenness(nodes, pairs).select(F.col("node").alias("entity_id"), F.col("betweenness").alias("bridge_score"))
    return scoring.null_model(observed, centrality.null_betweenness(pairs, nodes, Scoring().null_model_samples, Scoring().null_model_seed))


def bridge_ranking(spark, sf_dir):
    """The ten best bridges of the thresholded nation graph, without null samples."""
    entities, ev = _thresholded(spark, sf_dir)
    rows = scoring.discover_bridges(entities, graph_store.edges_of(ev), ev, 10, Scoring(null_model_samples=0))
    return rows.select("entity_name", r6("bridge_score").alias("bridge_score"), "degree", *(r6(c).alias(c) for c in ("independence_score", "specificity_score", "temporal_score", "final_score")), "status")


def attention(spark, sf_dir):
    """Attention of every document."""
    return adapters.corpus(spark, sf_dir).select("id", r6(signals.attention()).alias("attention"))


def _corpus_graph(spark, sf_dir):
    """(docs, entities, evidence with ends and sides, betweenness) of the corpus adapter."""
    docs, seeds, names, resolved, relations = _corpus_relations(spark, sf_dir)
    # relations are few; documents are read again, each time the columns needed, as whole texts would fill memory and disk
    relations = relations.dropDuplicates(["evidence_id"]).persist()
    edges = graph_store.edges_of(relations)
    evidence = relations.join(edges.select("edge_id", "source_sides"), "edge_id")
    entities = resolution.canonical_entities(names, resolved, seeds).persist()
    scores = centrality.betweenness(entities.select(F.col("canonical_id").alias("node")), centrality.project(edges)).persist()
    return docs.withColumn("dated", F.col("published_at")), entities, evidence, scores


def small_notes(spark, sf_dir):
    """Documents of low attention with novel structure."""
    docs, _, evidence, scores = _corpus_graph(spark, sf_dir)
    rows = signals.small_notes(docs, evidence, scores, Signals(structural_novelty_threshold=0.05, small_note_min_score=0.2))
    return rows.select("document_id", *(r6(c).alias(c) for c in ("attention_score", "structural_novelty_score", "score")))


def morning_readings(spark, sf_dir):
    """Contrasts between official and other sources."""
    docs, entities, evidence, scores = _corpus_graph(spark, sf_dir)
    rows = signals.morning_readings(docs, evidence, entities, scores, Signals(denial_keywords=list(adapters.DENIALS)))
    return rows.select("entity_name", "status", r6("score").alias("score"), F.col("non_official_evidence_count").alias("non_official"), F.col("official_mentions_count").alias("mentions"))


def fuzzy_resolution(spark, sf_dir):
    """The 25 nation names and one misspelt copy of each, at every scale, resolved to each other."""
    some = table(spark, sf_dir, "nation").select(F.concat(F.lit("Republic of "), "n_name").alias("name"), F.col("n_nationkey").cast("string").alias("id"))
    wrong = some.select(F.concat(F.substring("name", 1, 5), F.lit("x"), F.substring("name", 6, 99)).alias("name"), F.concat(F.lit("9"), "id").alias("id"))
    both = some.unionByName(wrong).select("id", "name", F.lit("place").alias("entity_type"), F.lit(0.5).alias("confidence"), F.struct(*(F.lit(0).cast("long").alias(f"o{k}") for k in range(5))).alias("ord"))
    return resolution.resolve_names(resolution.distinct_names(both), resolution.seed_aliases(spark, CONFIG))


def page_text(spark, sf_dir):
    """Article text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", web.article("html").alias("a")).select("page_id", "a.text", "a.selector")


def page_meta(spark, sf_dir):
    """Title and meta tags of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(web.meta("html")).alias("key", "value"))


def property_graph_nodes(spark, sf_dir):
    """Nodes of the reified graph."""
    return export.property_graph(adapters.nation_entities(spark, sf_dir), _evidence(spark, sf_dir), repeated=False)[0].select("node_id", "label")


def property_graph_edges(spark, sf_dir):
    """Edges of the reified graph."""
    return export.property_graph(adapters.nation_entities(spark, sf_dir), _evidence(spark, sf_dir), repeated=False)[1]


QUERIES = {
    f.__name__: f
    for f in (
        evidence_scan_filtered, edge_rollup, evidence_counts_by_edge, graph_counts, evidence_for_entity_topk, evidence_for_document, stable_ids, normalize_names, sentences, quote_windows, dev_entities, co_mentions,
        resolved_relations, valid_extractions, cache_hit_miss, replace_documents, discovery_rank_dedup, url_safety, independence, specificity, temporal_concentration, graph_projection_degree, betweenness, null_model,
        bridge_ranking, attention, small_notes, morning_readings, fuzzy_resolution, page_text, page_meta, property_graph_nodes, property_graph_edges,
    )
}
QUERIES |= store_queries.QUERIES
ORACLES = {**ORACLES, **store_queries.ORACLES}
__all__ = ["ORACLES", "QUERIES"]
