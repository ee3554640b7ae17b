"""SQL fragments and oracle queries for DuckDB over the same tables."""

from __future__ import annotations

from tessera.functions.text import OPENERS, SENTENCE_CHARS, TITLES
from tessera.sources.adapters import CATALOGUE, DENIALS


def ws(x: str) -> str:
    """White space normalised."""
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def norm(x: str) -> str:
    """A name normalised."""
    plain = f"lower(strip_accents({ws(x)}))"
    return ws(f"regexp_replace(regexp_replace({plain}, '\\b({'|'.join(TITLES)})\\b\\.?', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g')")


def hashed(prefix: str, length: int, *parts: str) -> str:
    """Identity from the hash of parts."""
    return f"'{prefix}' || substr(sha256({' || chr(10) || '.join(parts)}), 1, {length})"


def clamp(x: str) -> str:
    """x bounded to [0, 1]."""
    return f"greatest(0.0, least(1.0, {x}))"


DOCS = f"""docs AS (
  SELECT doc_id, {hashed('doc_', 24, 'source', "'doc://' || doc_id::VARCHAR")} AS id, source AS source_name,
         CASE WHEN no % 5 = 0 THEN 'official_government' ELSE 'side_' || (no % 5)::VARCHAR END AS source_side,
         'doc://' || doc_id::VARCHAR AS url, substr(t, 1, 60) AS title, t AS text, sha256(t) AS text_hash,
         TIMESTAMP '2024-01-01' + to_days((doc_id % 45)::INTEGER) AS published_at, ((doc_id // 20) % 10 + 1)::INTEGER AS feed_rank,
         round(0.25 + 0.05 * (no % 10), 2)::DOUBLE AS attention_weight
  FROM (SELECT *, regexp_extract(source, '(\\d+)$', 1)::INTEGER AS no, {ws("coalesce(text, '')")} AS t FROM documents))"""

SENTENCES = f"""parts AS (
  SELECT id, doc_id, source_side, published_at, unnest(l) AS part, generate_subscripts(l, 1) AS k
  FROM (SELECT id, doc_id, source_side, published_at,
               string_split(regexp_replace(regexp_replace(text, '([.!?])([{OPENERS}])', '\\1 \\2', 'g'), '([.!?])\\s+([{OPENERS}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l
        FROM {{source}})),
chunks AS (
  SELECT id, doc_id, source_side, published_at, k, i, CASE WHEN length(part) <= {SENTENCE_CHARS} THEN part ELSE {ws(f'substr(part, (i * {SENTENCE_CHARS} + 1)::INTEGER, {SENTENCE_CHARS})')} END AS sentence
  FROM (SELECT *, unnest(range(0, greatest(1, (length(part) + {SENTENCE_CHARS - 1}) // {SENTENCE_CHARS}))) AS i FROM parts)),
sentences AS (
  SELECT id, doc_id, source_side, published_at, row_number() OVER (PARTITION BY id ORDER BY k, i) - 1 AS sentence_no, sentence FROM chunks WHERE sentence <> '')"""

TERMS = "terms AS (SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{e.name}', '{e.entity_type}', {j}, '{a}')" for k, e in enumerate(CATALOGUE) for j, a in enumerate([e.name, *e.aliases])
) + f") AS t(pos, name, entity_type, alias_pos, alias)), normed AS (SELECT *, {norm('alias')} AS alias_norm FROM terms)"

MENTIONS = f"""{TERMS}, plain AS (SELECT *, {norm('text')} AS norm FROM docs),
hits AS (SELECT d.id, d.text, t.*, row_number() OVER (PARTITION BY d.id, t.pos ORDER BY t.alias_pos DESC) AS rn
         FROM plain d JOIN normed t ON contains(' ' || d.norm || ' ', ' ' || t.alias_norm || ' ')),
mentions AS (SELECT id, text, pos, name, entity_type, CASE WHEN alias = name THEN 0.85 ELSE 0.78 END::DOUBLE AS confidence, alias, instr(lower(text), lower(alias)) AS place FROM hits WHERE rn = 1),
quoted AS (SELECT id, text, pos, name, entity_type, confidence,
                  CASE WHEN place = 0 THEN substr(alias, 1, 220) ELSE trim(substr(text, greatest(1, place - 110)::INTEGER, (least(length(text), place - 1 + length(alias) + 110) - greatest(1, place - 110) + 1)::INTEGER)) END AS quote FROM mentions)"""

CO = f"""heads AS (SELECT id, doc_id, source_side, published_at, trim(substr(text, 1, 15000)) AS text FROM docs), {SENTENCES.format(source='heads')},
snorm AS (SELECT *, {norm('sentence')} AS norm FROM sentences),
present AS (SELECT DISTINCT s.id, s.sentence_no, s.sentence, m.pos, m.name, m.entity_type, m.confidence
            FROM snorm s JOIN mentions m ON m.id = s.id JOIN normed t ON t.pos = m.pos WHERE contains(' ' || s.norm || ' ', ' ' || t.alias_norm || ' ')),
seated AS (SELECT *, row_number() OVER (PARTITION BY id, sentence_no ORDER BY pos) - 1 AS seat FROM present),
pairs AS (SELECT l.id, l.sentence_no, l.seat AS i, r.seat AS j, l.name AS subject, l.entity_type AS subject_type, r.name AS object, r.entity_type AS object_type, l.sentence AS quote,
                 least(l.confidence, r.confidence, 0.55) AS confidence,
                 row_number() OVER (PARTITION BY l.id, least({norm('l.name')}, {norm('r.name')}), greatest({norm('l.name')}, {norm('r.name')}), substr(l.sentence, 1, 80) ORDER BY l.sentence_no, l.seat, r.seat) AS again
          FROM seated l JOIN seated r ON l.id = r.id AND l.sentence_no = r.sentence_no AND l.seat < r.seat WHERE r.seat < 8),
co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sentence_no, i, j) AS n FROM pairs WHERE again = 1) WHERE n <= 80)"""

#: Relations of the corpus: exact resolution, as no name of the catalogue is new.
CORPUS_RELATIONS = f"""crel AS (
  SELECT *, {hashed('edge_', 28, 'subject_id', "'CO_MENTIONED_WITH'", 'object_id', "'evidence'")} AS edge_id
  FROM (SELECT c.*, {hashed('ent_', 24, 'subject_type', norm('subject'))} AS subject_id, {hashed('ent_', 24, 'object_type', norm('object'))} AS object_id,
               d.source_name, d.source_side, d.url, d.title, d.published_at FROM co c JOIN docs d ON d.id = c.id)),
cev AS (SELECT *, {hashed('ev_', 28, 'edge_id', 'id', 'quote')} AS evidence_id FROM crel)"""

RELATIONS = f"""nat AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
rel0 AS (
  SELECT b.n_name AS subject_name, s.n_name AS object_name, b.r_name AS source_side, c_mktsegment AS source_name, 'doc_' || l_orderkey::VARCHAR AS document_id,
         CASE WHEN l_returnflag = 'N' THEN 'CO_MENTIONED_WITH' ELSE 'RETURN_' || l_returnflag END AS predicate, CASE WHEN l_linestatus = 'O' THEN 'inference' ELSE 'evidence' END AS assertion_type,
         round(1 - l_discount, 2) AS confidence, l_shipdate AS published_at,
         concat_ws(' ', 'Line', l_linenumber::VARCHAR, 'Part', l_partkey::VARCHAR, 'Supplier', l_suppkey::VARCHAR, round(l_quantity * 100)::BIGINT::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR,
                   round(l_discount * 100)::BIGINT::VARCHAR, round(l_tax * 100)::BIGINT::VARCHAR, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')) AS quote,
         {hashed('ent_', 24, "'place'", 'lower(b.n_name)')} AS subject_id, {hashed('ent_', 24, "'place'", 'lower(s.n_name)')} AS object_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nat b ON c_nationkey = b.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nat s ON s_nationkey = s.n_nationkey),
rel AS (SELECT *, {hashed('edge_', 28, 'subject_id', 'predicate', 'object_id', 'assertion_type')} AS edge_id FROM rel0)"""

EVIDENCE = f"""{RELATIONS}, ev AS (SELECT DISTINCT *, {hashed('ev_', 28, 'edge_id', 'document_id', 'quote')} AS evidence_id FROM rel)"""

KEPT = """pair AS (SELECT least(subject_id, object_id) AS u, greatest(subject_id, object_id) AS v, count(*) AS n FROM rel WHERE subject_id <> object_id GROUP BY 1, 2),
kept AS (SELECT u, v FROM (SELECT u, v, percent_rank() OVER (ORDER BY n) AS p FROM pair) WHERE p >= 0.66),
kev AS (SELECT ev.* FROM ev JOIN kept ON u = least(subject_id, object_id) AND v = greatest(subject_id, object_id)),
adj AS (SELECT u AS a, v AS b FROM kept UNION ALL SELECT v, u FROM kept),
common AS (SELECT x.a AS s, y.b AS t, x.b AS m FROM adj x JOIN adj y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.a = x.a AND z.b = y.b)),
sigma AS (SELECT s, t, count(*) AS sigma FROM common GROUP BY s, t),
gain AS (SELECT m, sum(1.0 / sigma) AS dep FROM common JOIN sigma USING (s, t) GROUP BY m)"""

NODES = f"""nodes AS (SELECT {hashed('ent_', 24, "'place'", 'lower(n_name)')} AS entity_id, n_name AS entity_name FROM nation),
between_ AS (SELECT entity_id, entity_name, coalesce(dep, 0.0) / ((SELECT count(*) - 1 FROM nodes) * (SELECT count(*) - 2 FROM nodes)) AS betweenness FROM nodes LEFT JOIN gain ON m = entity_id)"""


def touched(source: str) -> str:
    """One row for each entity that evidence touches."""
    return f"touched AS (SELECT subject_id AS entity_id, * FROM {source} UNION ALL SELECT object_id, * FROM {source} WHERE object_id <> subject_id)"


INDEPENDENCE = f"""ind AS (
  SELECT entity_id, least(1.0, log2(count(DISTINCT source_side || ':' || source_name) + 1) / 2) AS sd, count(DISTINCT source_side) AS sides, count(DISTINCT source_name) AS names,
         count(DISTINCT document_id) AS docs_n, count(*) AS total, count(DISTINCT source_side || ':' || source_name) AS units FROM touched GROUP BY entity_id),
indep AS (SELECT *, {clamp("0.45 * sd + 0.45 * (CASE WHEN sides >= 2 THEN 1.0 WHEN names >= 2 THEN 0.35 ELSE 0.15 END) + 0.10 * least(1.0, docs_n / 3)")} AS independence_score FROM ind)"""

QUOTE = clamp(
    "0.20 + (CASE WHEN regexp_matches(quote, '\\d') THEN 0.20 ELSE 0.0 END) + (CASE WHEN regexp_matches(lower(quote), 'director|coordinador|secretar|gobernador|president') THEN 0.20 ELSE 0.0 END)"
    " + least(0.30, len(list_filter(string_split(quote, ' '), lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 3)) * 0.04) + 0.10 * (CASE WHEN length(quote) BETWEEN 80 AND 450 THEN 1.0 ELSE 0.65 END)"
)

SPECIFICITY = f"""qs AS (SELECT entity_id, assertion_type = 'evidence' AS own, predicate, {QUOTE} AS q FROM touched),
spec0 AS (SELECT entity_id, count(*) FILTER (own) AS n, count(*) FILTER (own AND predicate <> 'CO_MENTIONED_WITH') AS specific, avg(q) FILTER (own) AS quotes, count(*) FILTER (NOT own) AS excluded FROM qs GROUP BY entity_id),
degree AS (SELECT a AS entity_id, count(*) AS degree FROM adj GROUP BY a),
spec AS (SELECT entity_id, degree, n, specific, excluded, coalesce(quotes, 0.0) AS quote_score, CASE WHEN n = 0 THEN 0.35 ELSE 0.35 + 0.45 * specific / n END AS predicate_score, 1 / (1 + greatest(0, degree - 6) / 6) AS degree_penalty FROM spec0 JOIN degree USING (entity_id)),
specificity AS (SELECT *, {clamp('0.35 * predicate_score + 0.25 * quote_score + 0.25 * 0.48 + 0.15 * degree_penalty')} AS specificity_score FROM spec)"""


def temporal(source: str, corpus: str, days: int = 7) -> str:
    """Best window of each entity's dated evidence."""
    w = f"(PARTITION BY entity_id ORDER BY published_at RANGE BETWEEN CURRENT ROW AND INTERVAL {days} DAYS FOLLOWING)"
    return f"""win AS (SELECT entity_id, published_at, count(*) OVER {w} AS inside, min(source_side) OVER {w} AS lo, max(source_side) OVER {w} AS hi FROM {source}),
best AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY inside DESC, published_at) AS rn, count(*) OVER (PARTITION BY entity_id) AS total FROM win),
span AS (SELECT greatest(1, date_diff('day', min(published_at), max(published_at)) + 1) AS span FROM {corpus}),
temp AS (SELECT entity_id, total, inside, lo <> hi AS multi, published_at AS start, span, CASE WHEN span > {days} THEN (inside / total) / least(1.0, {days} / span) ELSE 1.0 END AS lift FROM best, span WHERE rn = 1),
temporal AS (SELECT entity_id, total, CASE WHEN total >= 2 THEN inside ELSE total END AS max_window, CASE WHEN total >= 2 THEN span ELSE 0 END AS span_days, CASE WHEN total >= 2 THEN lift ELSE 0.0 END AS lift,
             CASE WHEN total >= 2 THEN start END AS start,
             CASE WHEN total < 2 THEN 0.0 WHEN multi THEN {clamp(f"(CASE WHEN span > {days} THEN {clamp('(lift - 1) / 3')} ELSE 0.15 END) + 0.15")} ELSE (CASE WHEN span > {days} THEN {clamp('(lift - 1) / 3')} ELSE 0.15 END) END AS temporal_score FROM temp)"""


ATTENTION = clamp("coalesce(nullif(attention_weight, 0.0), 0.7) / (1 + (greatest(1, feed_rank) - 1) / 5)")

#: Two-hop betweenness of the corpus graph's few entities; tests assert that no shortest path is longer.
CORPUS_BETWEEN = f"""cpair AS (SELECT DISTINCT least(subject_id, object_id) AS u, greatest(subject_id, object_id) AS v FROM cev WHERE subject_id <> object_id),
cadj AS (SELECT u AS a, v AS b FROM cpair UNION ALL SELECT v, u FROM cpair),
ccommon AS (SELECT x.a AS s, y.b AS t, x.b AS m FROM cadj x JOIN cadj y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM cadj z WHERE z.a = x.a AND z.b = y.b)),
csigma AS (SELECT s, t, count(*) AS sigma FROM ccommon GROUP BY s, t),
cgain AS (SELECT m, sum(1.0 / sigma) AS dep FROM ccommon JOIN csigma USING (s, t) GROUP BY m),
cent AS (SELECT {hashed('ent_', 24, 'entity_type', norm('name'))} AS entity_id, name, entity_type, pos FROM normed WHERE alias_pos = 0),
cbet AS (SELECT entity_id, name, pos, coalesce(dep, 0.0) / ((SELECT count(*) - 1 FROM cent) * (SELECT count(*) - 2 FROM cent)) AS b FROM cent LEFT JOIN cgain ON m = entity_id)"""

CORPUS = f"WITH {DOCS}, {MENTIONS}, {CO}, {CORPUS_RELATIONS}"
DENIED = " OR ".join(f"contains(norm, {norm(repr(k))})" for k in DENIALS)

ORACLES: dict[str, str] = {
    "evidence_scan_filtered": f"WITH {EVIDENCE} SELECT evidence_id, edge_id, document_id, predicate, round(confidence, 6) AS confidence, strftime(published_at, '%Y-%m-%d') AS published_on FROM ev WHERE assertion_type = 'evidence' AND predicate <> 'CO_MENTIONED_WITH'",
    "edge_rollup": f"""WITH {EVIDENCE} SELECT edge_id, subject_id, predicate, object_id, CASE WHEN bool_or(assertion_type = 'evidence') THEN 'evidence' ELSE 'inference' END AS assertion_type, round(max(confidence), 6) AS confidence,
        strftime(min(published_at), '%Y-%m-%d') AS first_seen, strftime(max(published_at), '%Y-%m-%d') AS last_seen, array_to_string(list_sort(list(DISTINCT source_side)), ',') AS source_sides FROM ev GROUP BY edge_id, subject_id, predicate, object_id""",
    "evidence_counts_by_edge": f"WITH {EVIDENCE} SELECT edge_id, count(*)::BIGINT AS evidence_count FROM ev GROUP BY edge_id",
    "graph_counts": f"WITH {EVIDENCE} SELECT 'entities' AS item, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'edges', count(DISTINCT edge_id)::BIGINT FROM ev UNION ALL SELECT 'evidence', count(*)::BIGINT FROM ev",
    "evidence_for_entity_topk": f"WITH {EVIDENCE}, {touched('ev')} SELECT entity_id, evidence_id, rank FROM (SELECT entity_id, evidence_id, row_number() OVER (PARTITION BY entity_id ORDER BY published_at DESC NULLS LAST, evidence_id DESC)::INTEGER AS rank FROM touched) WHERE rank <= 8",
    "evidence_for_document": f"WITH {EVIDENCE} SELECT document_id, evidence_id, subject_name, object_name, 'place' AS subject_type, predicate FROM ev",
    "stable_ids": f"WITH {DOCS} SELECT doc_id, id, text_hash, substr(sha256(source_name || chr(10) || '' || chr(10) || url), 1, 16) AS short_hash FROM docs",
    "normalize_names": f"WITH {DOCS} SELECT doc_id, {norm('title')} AS title_norm, sha256({norm('text')}) AS text_norm_hash FROM docs",
    "sentences": f"WITH {DOCS}, {SENTENCES.format(source='docs')} SELECT doc_id, sentence_no::INTEGER AS sentence_no, sentence FROM sentences",
    "quote_windows": f"WITH {DOCS}, {MENTIONS} SELECT id, name, quote, contains(lower(text), lower(quote)) AS verbatim FROM quoted",
    "dev_entities": f"WITH {DOCS}, {MENTIONS} SELECT id, pos, name, entity_type, quote, round(confidence, 6) AS confidence FROM quoted WHERE contains(lower(text), lower(quote))",
    "co_mentions": f"WITH {DOCS}, {MENTIONS}, {CO} SELECT id, sentence_no::INTEGER AS sentence_no, subject, object, quote, round(confidence, 6) AS confidence FROM co",
    "resolved_relations": f"{CORPUS} SELECT evidence_id, edge_id, subject_id, object_id, id AS document_id, source_side, round(confidence, 6) AS confidence FROM cev",
    "valid_extractions": f"WITH {DOCS} SELECT id AS document_id, text_hash FROM docs WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0",
    "cache_hit_miss": f"WITH {DOCS} SELECT source_name, count(*) FILTER (hit)::BIGINT AS hits, count(*) FILTER (NOT hit)::BIGINT AS misses FROM (SELECT source_name, doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS hit FROM docs) GROUP BY source_name",
    "replace_documents": f"""WITH {EVIDENCE}, batch AS (SELECT *, substr(document_id, 5)::BIGINT AS o FROM ev),
        fresh AS (SELECT * FROM batch WHERE o % 10 = 0 AND predicate = 'CO_MENTIONED_WITH'), after_ AS (SELECT * FROM batch WHERE o % 10 <> 0 UNION ALL SELECT * FROM fresh)
        SELECT 'evidence' AS item, count(*)::BIGINT AS n FROM after_ UNION ALL SELECT 'edges', count(DISTINCT edge_id)::BIGINT FROM after_
        UNION ALL SELECT 'removed', (SELECT count(*) FROM ev)::BIGINT - count(*)::BIGINT FROM after_ UNION ALL SELECT 'observed', 0::BIGINT""",
    "discovery_rank_dedup": "SELECT page_id, host, rank FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id)::INTEGER AS rank FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, row_number() OVER (PARTITION BY url ORDER BY page_id) AS seen FROM pages) WHERE seen = 1) WHERE rank <= 5",
    "url_safety": "SELECT page_id, url, CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN false WHEN regexp_matches(url, '[\\x00-\\x20\\x7f]') THEN false WHEN regexp_matches(lower(url), '^https?://[^/?#]*@') THEN false WHEN regexp_matches(lower(url), '^https?://(localhost|[^/:?#]*\\.localhost)(:|/|\\?|#|$)') THEN false WHEN regexp_matches(lower(url), '^https?://(\\d+|0x[0-9a-f]+|[0-9.]+|\\[.*)(:|/|\\?|#|$)') THEN false ELSE true END AS safe FROM pages",
    "independence": f"WITH {EVIDENCE}, {touched('ev')}, {INDEPENDENCE} SELECT entity_id, round(independence_score, 6) AS independence_score, units::INTEGER AS units, sides::INTEGER AS sides, docs_n::BIGINT AS documents, total::BIGINT AS total, (independence_score >= 0.45 AND sides >= 2) AS passed FROM indep",
    "specificity": f"WITH {EVIDENCE}, {KEPT}, {touched('kev')}, {SPECIFICITY} SELECT entity_id, round(predicate_score, 6) AS predicate_score, round(quote_score, 6) AS quote_score, round(degree_penalty, 6) AS degree_penalty, round(specificity_score, 6) AS specificity_score FROM specificity",
    "temporal_concentration": f"WITH touched AS (SELECT user_id AS entity_id, event_type AS source_side, ts AS published_at FROM events), {temporal('touched', 'touched')} SELECT entity_id, total::BIGINT AS total, max_window::BIGINT AS max_window, span_days::INTEGER AS span_days, round(lift, 6) AS lift, round(temporal_score, 6) AS score, strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start FROM temporal",
    "graph_projection_degree": f"WITH {EVIDENCE}, pr AS (SELECT DISTINCT least(subject_id, object_id) AS u, greatest(subject_id, object_id) AS v FROM ev) SELECT entity_id, sum(d)::BIGINT AS degree FROM (SELECT u AS entity_id, CASE WHEN u = v THEN 2 ELSE 1 END AS d FROM pr UNION ALL SELECT v, 1 FROM pr WHERE u <> v) GROUP BY entity_id",
    "betweenness": f"WITH {EVIDENCE}, {KEPT}, {NODES} SELECT entity_id, entity_name, round(betweenness, 6) AS betweenness FROM between_",
    "bridge_ranking": f"""WITH {EVIDENCE}, {KEPT}, {NODES}, {touched('kev')}, {INDEPENDENCE}, {SPECIFICITY}, {temporal('touched', 'kev')},
        final AS (SELECT entity_id, entity_name, betweenness, degree, sides, independence_score, specificity_score, temporal_score, {clamp('0.30 * independence_score + 0.25 * specificity_score + 0.15 * temporal_score')} AS final_score
                  FROM between_ JOIN indep USING (entity_id) JOIN specificity USING (entity_id) JOIN temporal USING (entity_id))
        SELECT entity_name, round(betweenness, 6) AS bridge_score, degree::BIGINT AS degree, round(independence_score, 6) AS independence_score, round(specificity_score, 6) AS specificity_score, round(temporal_score, 6) AS temporal_score, round(final_score, 6) AS final_score,
               CASE WHEN independence_score < 0.2 OR specificity_score < 0.25 THEN 'discard' WHEN final_score >= 0.35 THEN 'needs_more_evidence' ELSE 'degraded' END AS status
        FROM final ORDER BY round(final_score, 9) DESC, round(betweenness, 9) DESC, entity_id LIMIT 10""",
    "attention": f"WITH {DOCS} SELECT id, round({ATTENTION}, 6) AS attention FROM docs",
    "small_notes": f"""{CORPUS}, {CORPUS_BETWEEN}, ec AS (SELECT edge_id, count(*) AS times, count(DISTINCT source_side) AS sides FROM cev GROUP BY edge_id),
        nov AS (SELECT cev.id, {clamp(f"0.45 / sqrt(times) + 0.30 * {clamp('4 * greatest(x.b, y.b)')} + 0.15 * (CASE WHEN sides >= 2 THEN 1.0 ELSE 0.0 END)")} AS novelty FROM cev JOIN ec USING (edge_id) JOIN cbet x ON x.entity_id = subject_id JOIN cbet y ON y.entity_id = object_id),
        best AS (SELECT id, max(novelty) AS structural FROM nov GROUP BY id),
        notes AS (SELECT d.id, structural, {ATTENTION} AS attention FROM docs d JOIN best USING (id) WHERE published_at >= (SELECT max(published_at) FROM docs) - INTERVAL 21 DAYS),
        scored AS (SELECT *, {clamp('0.55 * structural + 0.45 * (1 - attention)')} AS score FROM notes)
        SELECT id AS document_id, round(attention, 6) AS attention_score, round(structural, 6) AS structural_novelty_score, round(score, 6) AS score FROM scored
        WHERE 1 - attention >= 0.35 AND structural >= 0.05 AND score >= 0.2 ORDER BY round(score, 9) DESC, id LIMIT 10""",
    "morning_readings": f"""{CORPUS}, {CORPUS_BETWEEN}, bounds AS (SELECT max(published_at) - INTERVAL 14 DAYS AS lo, max(published_at) AS hi FROM docs),
        official AS (SELECT docs.* FROM docs, bounds WHERE source_side = 'official_government' AND published_at BETWEEN lo AND hi),
        oparts AS (SELECT id, unnest(l) AS part, generate_subscripts(l, 1) AS k FROM (SELECT id, string_split(regexp_replace(regexp_replace(text, '([.!?])([{OPENERS}])', '\\1 \\2', 'g'), '([.!?])\\s+([{OPENERS}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM official)),
        ochunks AS (SELECT id, k, i, CASE WHEN length(part) <= {SENTENCE_CHARS} THEN part ELSE {ws(f'substr(part, (i * {SENTENCE_CHARS} + 1)::INTEGER, {SENTENCE_CHARS})')} END AS sentence FROM (SELECT *, unnest(range(0, greatest(1, (length(part) + {SENTENCE_CHARS - 1}) // {SENTENCE_CHARS}))) AS i FROM oparts)),
        onorm AS (SELECT id, k, i, {norm('sentence')} AS norm FROM ochunks WHERE sentence <> ''),
        non AS (SELECT cev.* FROM cev, bounds WHERE source_side <> 'official_government' AND published_at BETWEEN lo AND hi),
        ends AS (SELECT subject_id AS entity_id, source_side FROM non UNION ALL SELECT object_id, source_side FROM non),
        per AS (SELECT entity_id, count(*) AS n, count(DISTINCT source_side) AS sides FROM ends GROUP BY entity_id),
        said AS (SELECT entity_id, count(*) AS mentions, count(*) FILTER ({DENIED}) AS denials FROM (SELECT DISTINCT c.entity_id, o.id, o.k, o.i, o.norm FROM cent c JOIN normed t ON t.pos = c.pos JOIN onorm o ON contains(' ' || o.norm || ' ', ' ' || t.alias_norm || ' ')) GROUP BY entity_id),
        rows_ AS (SELECT entity_id, name, n, coalesce(mentions, 0) AS mentions, coalesce(denials, 0) > 0 AS denied, {clamp(f"0.35 * least(1.0, n / 5) + 0.30 * least(1.0, sides / 2) + 0.20 * {clamp('4 * b')} + (CASE WHEN coalesce(denials, 0) > 0 THEN 0.15 ELSE 0.0 END)")} AS score
                  FROM per JOIN cbet USING (entity_id) LEFT JOIN said USING (entity_id) WHERE coalesce(denials, 0) > 0 OR coalesce(mentions, 0) = 0)
        SELECT name AS entity_name, CASE WHEN denied THEN 'official_denial_or_correction' ELSE 'possible_silence' END AS status, round(score, 6) AS score, n::BIGINT AS non_official, mentions::BIGINT AS mentions FROM rows_ ORDER BY round(score, 9) DESC, entity_id LIMIT 10""",
    "property_graph_nodes": f"""WITH {EVIDENCE} SELECT {hashed('ent_', 24, "'place'", 'lower(n_name)')} AS node_id, 'Entity' AS label FROM nation UNION ALL SELECT DISTINCT document_id, 'Document' FROM ev UNION ALL SELECT DISTINCT edge_id, 'Assertion' FROM ev UNION ALL SELECT evidence_id, 'Evidence' FROM ev""",
    "property_graph_edges": f"""WITH {EVIDENCE}, a AS (SELECT DISTINCT edge_id, subject_id, object_id FROM ev) SELECT subject_id AS src, object_id AS dst, 'ASSERTS' AS kind, edge_id AS via FROM a UNION ALL SELECT edge_id, subject_id, 'SUBJECT', '' FROM a UNION ALL SELECT edge_id, object_id, 'OBJECT', '' FROM a
        UNION ALL SELECT evidence_id, edge_id, 'SUPPORTS', '' FROM ev UNION ALL SELECT evidence_id, document_id, 'FROM_DOCUMENT', '' FROM ev""",
}
