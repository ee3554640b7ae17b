"""Registered queries of the store, the web sources and the statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import centrality, extraction, graph_store, resolution, scoring
from tessera.plans.config import AppConfig, Scoring
from tessera.plans.oracles import DOCS, EVIDENCE, INDEPENDENCE, KEPT, MENTIONS, NODES, SPECIFICITY, TERMS, clamp, hashed, temporal, touched, ws
from tessera.sources import adapters, web
from tessera.sources.adapters import table

CONFIG = AppConfig(known_entities=list(adapters.CATALOGUE))
LETTERS = "array<struct<name:string,entity_type:string,quote:string,confidence:double>>"
RELATIONS = "array<struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,quote:string,confidence:double,assertion_type:string>>"


def cited(x: str) -> str:
    """Text for checking citations, in SQL."""
    plain = f"lower(strip_accents({ws(x)}))"
    return ws(f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')")


def cache_paths(spark, sf_dir) -> DataFrame:
    """Where each page would be kept."""
    return table(spark, sf_dir, "pages").select("page_id", web.cache_path("url").alias("path"))


def allowed_urls(spark, sf_dir) -> DataFrame:
    """Pages whose address a source with two pieces, and one with one piece, would read."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", web.allowed_url("url", ["/en/", "/fr/"]).alias("some"), web.allowed_url("url", "/de/").alias("one"), web.allowed_url("url", None).alias("any"))


def page_links(spark, sf_dir) -> DataFrame:
    """Links of every page, in order, each once."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(web.listing_links("html", F.col("url"))).alias("place", "link"))


def parsed_dates(spark, sf_dir) -> DataFrame:
    """Dates of all orders, written in five ways and read again."""
    ways = ["yyyy-MM-dd", "EEE, dd MMM yyyy HH:mm:ss '+0000'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MMMM d, yyyy", "yyyy/MM/dd"]
    day, text = F.col("o_orderdate").cast("timestamp"), None
    for k, way in enumerate(ways):
        one = F.date_format(day, way)
        text = F.when(F.col("o_orderkey") % len(ways) == k, one) if text is None else text.when(F.col("o_orderkey") % len(ways) == k, one)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(T.parse_datetime(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def unwrapped_fragments(spark, sf_dir) -> DataFrame:
    """Every text with the escapes of an archive's fragment, and without them again."""
    text = F.coalesce("text", F.lit(""))
    escaped = F.replace(F.replace(F.replace(text, F.lit("/"), F.lit("\\/")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.unwrap_archive_fragment(escaped), 256).alias("text_hash"))


def citation_texts(spark, sf_dir) -> DataFrame:
    """Titles as citations are checked."""
    return adapters.corpus(spark, sf_dir).select("doc_id", T.citation_text("title").alias("cited"))


def grounded_entities(spark, sf_dir) -> DataFrame:
    """Given entities held against their quotes: those of the catalogue, one that its quote doesn't name, one whose quote isn't there."""
    docs = adapters.corpus(spark, sf_dir)
    own = extraction.find_mentions(docs, adapters.catalogue(spark)).groupBy("id").agg(F.collect_list(F.struct("name", "entity_type", "quote", "confidence")).alias("own"))
    made = lambda name, quote: F.struct(F.lit(name).alias("name"), F.lit("other").alias("entity_type"), quote.alias("quote"), F.lit(0.9).alias("confidence"))
    more = F.array(made("Nobody Atall", F.substring("text", 1, 30)), made("Nowhere", F.lit("§ a quote that no document holds §")))
    given = docs.join(own, "id", "left").select(
        F.col("id").alias("document_id"), F.concat(F.coalesce("own", F.array().cast(LETTERS)), more).cast(LETTERS).alias("entities"), F.array().cast(RELATIONS).alias("relations"), F.array().cast("array<string>").alias("warnings"),
    )
    rows = extraction.ground(given, docs, CONFIG, "p", "m", "v1:x")
    return rows.select("document_id", F.size("entities").alias("kept"), F.try_element_at("warnings", F.lit(1)).alias("first_warning"))


def alias_sets(spark, sf_dir) -> DataFrame:
    """All names of every canonical entity of the corpus."""
    docs, terms = adapters.corpus(spark, sf_dir), adapters.catalogue(spark)
    both = extraction.with_found(docs, terms).where(F.size("found") > 0).persist()
    # each is read several times below and holds a few columns of a fraction of the rows
    found, pairs = extraction.extract_entities(docs, terms, both).persist(), extraction.co_mentions(docs, terms, both).drop("quote").persist()
    names = resolution.distinct_names(resolution.mentioned(found, pairs)).persist()
    seeds = resolution.seed_aliases(spark, CONFIG)
    known = resolution.canonical_entities(names, resolution.resolve_names(names, seeds), seeds)
    return known.select("canonical_id", "canonical_name", "entity_type", F.array_join("aliases", "|").alias("aliases"), "resolution_reason")


def upserted_documents(spark, sf_dir) -> DataFrame:
    """Every second document stored, then every third one written over or added."""
    docs = adapters.corpus(spark, sf_dir).select("doc_id", "id", "url", "title")
    old, new = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0").withColumn("title", F.concat(F.lit("new "), "title"))
    return graph_store.upsert(old, new, "id").select("id", "url", "title")


def document_by_id(spark, sf_dir) -> DataFrame:
    """Every document found by its identity among those stored."""
    docs = adapters.corpus(spark, sf_dir)
    stored = graph_store.upsert(docs.limit(0), docs, "id")
    return docs.select("id", F.col("doc_id").alias("asked")).join(stored.drop("doc_id"), "id").select("asked", "id", "text_hash", "source_side")


def upserted_entities(spark, sf_dir) -> DataFrame:
    """Nations stored with one alias; those of even keys written again with others, repeated and out of order."""
    own = adapters.nation_entities(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_name").alias("canonical_name"), "n_nationkey"), "canonical_name")
    again = own.where("n_nationkey % 2 = 0").withColumn("aliases", F.array(F.lower("canonical_name"), "canonical_name", F.lower("canonical_name"), F.lit("AA")))
    return graph_store.upsert_entities(own, again).select("canonical_id", F.array_join("aliases", "|").alias("aliases"))


def legacy_edges(spark, sf_dir) -> DataFrame:
    """Edges of evidence of which a part has neither type nor confidence, as in the older layout."""
    rel = adapters.relations(spark, sf_dir, distinct=True)
    old = F.col("predicate") != "CO_MENTIONED_WITH"
    gone = rel.withColumns({"assertion_type": F.when(~old, F.col("assertion_type")), "confidence": F.when(~old, F.col("confidence"))})
    edges = graph_store.roll_up_edges(graph_store.with_legacy_defaults(gone.select(*graph_store.EVIDENCE)), graph_store.edges_of(rel))
    return edges.select("edge_id", "assertion_type", F.round("confidence", 6).alias("confidence"))


def null_statistics(spark, sf_dir) -> DataFrame:
    """How improbable each customer's balance is among the samples of its segment: the statistics of the null model."""
    people = table(spark, sf_dir, "customer")
    share = F.pmod(F.round(F.col("c_acctbal") * 100).cast("long"), F.lit(1000)) / 1000
    found = people.select(F.col("c_custkey").cast("string").alias("entity_id"), share.alias("bridge_score"))
    samples = people.select(F.col("c_custkey").cast("string").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"), "c_custkey", "c_nationkey")
    samples = samples.where("c_custkey % 10 <> 0").select("node", (((F.col("c_custkey") * 7 + F.col("k") * (F.col("c_nationkey") % 5) * 3) % 11) / 11).alias("betweenness"))
    rows = scoring.null_model(found, samples, Scoring())
    return rows.select("entity_id", "samples", *(F.round(c, 6).alias(c) for c in ("null_mean", "null_std", "p_value", "z_score", "null_score")), "null_passed", F.array_join("null_notes", "|").alias("null_notes"))


def trade_degrees(spark, sf_dir) -> DataFrame:
    """Degrees in the graph of customers and suppliers that share an order: it grows with the tables."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("object_id"), F.array("l_returnflag").alias("source_sides"))
    ends = ends.withColumn("edge_id", F.concat("subject_id", "object_id"))
    return centrality.degrees(centrality.project(ends)).select(F.col("node").alias("entity_id"), "degree")


def bridge_caveats(spark, sf_dir) -> DataFrame:
    """Caveats and the simplest explanation of the ten best bridges of the thresholded nation graph."""
    from tessera.plans.registry import _thresholded

    entities, ev = _thresholded(spark, sf_dir)
    rows = scoring.discover_bridges(entities, graph_store.edges_of(ev), ev, 10, Scoring(null_model_samples=0))
    return rows.select("entity_name", F.array_join("caveats", "|").alias("caveats"), F.contains("simplest_explanation", F.lit("public convergence")).alias("public"))


NOTE = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '|')"

ORACLES: dict[str, str] = {
    "cache_paths": "SELECT page_id, replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':', '_') || '/' || substr(sha256(url), 1, 32) || '.html' AS path FROM pages",
    "allowed_urls": "SELECT page_id, contains(url, '/en/') OR contains(url, '/fr/') AS some, contains(url, '/de/') AS one, true AS any FROM pages",
    "page_links": """WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages),
        u AS (SELECT page_id, root || unnest(h) AS link, generate_subscripts(h, 1) AS k FROM l)
        SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY min(k)) - 1)::INTEGER AS place, link FROM u GROUP BY page_id, link""",
    "parsed_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS parsed FROM orders",
    "unwrapped_fragments": "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents",
    "citation_texts": f"WITH {DOCS} SELECT doc_id, {cited('title')} AS cited FROM docs",
    "grounded_entities": f"""WITH {DOCS}, {MENTIONS},
        own AS (SELECT id, contains(lower(text), lower({ws('quote')})) AS verbatim, EXISTS (SELECT 1 FROM terms t WHERE t.pos = quoted.pos AND contains(' ' || {cited('quote')} || ' ', ' ' || {cited('t.alias')} || ' ')) AS named FROM quoted),
        n AS (SELECT id, count(*) FILTER (verbatim AND named) AS kept, count(*) FILTER (NOT verbatim) AS gone FROM own GROUP BY id)
        SELECT id AS document_id, coalesce(kept, 0)::INTEGER AS kept, 'dropped_items_without_verbatim_quote=' || (coalesce(gone, 0) + 1 + (CASE WHEN trim(substr(text, 1, 30)) = '' THEN 1 ELSE 0 END))::VARCHAR AS first_warning FROM docs LEFT JOIN n USING (id)""",
    "alias_sets": f"""WITH {TERMS} SELECT canonical_id, canonical_name, entity_type, aliases, 'configured_known_entity' AS resolution_reason
        FROM (SELECT {hashed('ent_', 24, 'any_value(entity_type)', "any_value(alias_norm) FILTER (alias_pos = 0)")} AS canonical_id, any_value(name) AS canonical_name, any_value(entity_type) AS entity_type, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases FROM normed GROUP BY pos)""",
    "upserted_documents": f"WITH {DOCS} SELECT id, url, CASE WHEN doc_id % 3 = 0 THEN 'new ' || title ELSE title END AS title FROM docs WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "document_by_id": f"WITH {DOCS} SELECT doc_id AS asked, id, text_hash, source_side FROM docs",
    "upserted_entities": f"""SELECT {hashed('ent_', 24, "'place'", 'lower(n_name)')} AS canonical_id, CASE WHEN n_nationkey % 2 = 0 THEN array_to_string(list_sort(list_distinct([lower(n_name), n_name, 'AA'])), '|') ELSE n_name END AS aliases FROM nation""",
    "legacy_edges": f"""WITH {EVIDENCE}, l AS (SELECT edge_id, CASE WHEN predicate = 'CO_MENTIONED_WITH' THEN assertion_type ELSE 'inference' END AS a, CASE WHEN predicate = 'CO_MENTIONED_WITH' THEN confidence ELSE 0.0 END AS c FROM ev)
        SELECT edge_id, CASE WHEN bool_or(a = 'evidence') THEN 'evidence' ELSE 'inference' END AS assertion_type, round(max(c), 6) AS confidence FROM l GROUP BY edge_id""",
    "null_statistics": f"""WITH f AS (SELECT c_custkey, c_custkey::VARCHAR AS entity_id, (((round(c_acctbal * 100)::BIGINT % 1000) + 1000) % 1000) / 1000 AS seen FROM customer),
        s AS (SELECT c_custkey, ((c_custkey * 7 + k * (c_nationkey % 5) * 3) % 11) / 11 AS b FROM customer, range(20) AS r(k) WHERE c_custkey % 10 <> 0),
        g AS (SELECT f.c_custkey, entity_id, seen, count(b) AS n, coalesce(avg(b), 0.0) AS mean, coalesce(stddev_pop(b), 0.0) AS std, count(*) FILTER (b >= seen) AS above FROM f LEFT JOIN s USING (c_custkey) GROUP BY ALL),
        p AS (SELECT *, CASE WHEN n > 0 THEN (above + 1) / (n + 1) ELSE 1.0 END AS p FROM g)
        SELECT entity_id, n::BIGINT AS samples, round(mean, 6) AS null_mean, round(std, 6) AS null_std, round(p, 6) AS p_value,
               round(CASE WHEN n = 0 THEN 0.0 WHEN std > 0 THEN (seen - mean) / std WHEN seen <= mean THEN 0.0 ELSE 10.0 END, 6) AS z_score, round({clamp('1 - p')}, 6) AS null_score, n > 0 AND p <= 0.1 AND 1 - p >= 0.55 AS null_passed,
               CASE WHEN n = 0 THEN 'insufficient_graph_for_null_model' ELSE {NOTE.format("CASE WHEN seen <= mean THEN 'not_above_null_mean' END, CASE WHEN 1 - p < 0.55 THEN 'below_improbability_threshold' END")} END AS null_notes FROM p""",
    "trade_degrees": """WITH e AS (SELECT DISTINCT 'c' || o_custkey::VARCHAR AS u, 's' || l_suppkey::VARCHAR AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT entity_id, count(*)::BIGINT AS degree FROM (SELECT u AS entity_id FROM e UNION ALL SELECT v FROM e) GROUP BY entity_id""",
    "bridge_caveats": f"""WITH {EVIDENCE}, {KEPT}, {NODES}, {touched('kev')}, {INDEPENDENCE}, {SPECIFICITY}, {temporal('touched', 'kev')},
        final AS (SELECT entity_id, entity_name, betweenness, sides, independence_score, specificity_score, temporal_score, {clamp('0.30 * independence_score + 0.25 * specificity_score + 0.15 * temporal_score')} AS final_score
                  FROM between_ JOIN indep USING (entity_id) JOIN specificity USING (entity_id) JOIN temporal USING (entity_id))
        SELECT entity_name, {NOTE.format("CASE WHEN NOT (independence_score >= 0.45 AND sides >= 2) THEN 'Independent convergence is below the threshold.' END, 'Betweenness does not clearly exceed the null model.', "
        "CASE WHEN specificity_score < 0.45 THEN 'The claim is still too broad.' END, CASE WHEN temporal_score < 0.4 THEN 'There is no strong temporal anomaly in this window.' END")} AS caveats, sides >= 2 AS public
        FROM final ORDER BY round(final_score, 9) DESC, round(betweenness, 9) DESC, entity_id LIMIT 10""",
}
QUERIES = {
    f.__name__: f
    for f in (
        cache_paths, allowed_urls, page_links, parsed_dates, unwrapped_fragments, citation_texts, grounded_entities, alias_sets, upserted_documents, document_by_id, upserted_entities, legacy_edges, null_statistics,
        trade_degrees, bridge_caveats,
    )
}
