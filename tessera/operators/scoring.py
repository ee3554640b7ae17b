"""Bridge ranking and its four sceptical controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clamp01
from tessera.operators import centrality
from tessera.operators.graph_store import PAYLOAD, evidence_for_entities, is_evidence, touching
from tessera.plans.config import Scoring

#: How specific a type is, and words that name a role.
TYPE_SCORES = {"person": 0.78, "organization": 0.72, "company": 0.72, "event": 0.74, "place": 0.48, "other": 0.10}
UNKNOWN_TYPE_SCORE = 0.35
ROLE_WORDS = ("director", "coordinador", "secretar", "gobernador", "president")


def notes(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the notes whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs)))


def independence(touched: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Source, side and document diversity of each entity's evidence. touched: entity_id, evidence columns."""
    side, name = F.coalesce(F.nullif("source_side", F.lit("")), F.lit("unknown")), F.coalesce(F.nullif("source_name", F.lit("")), F.lit("unknown"))
    rows = touched.select("entity_id", side.alias("side"), name.alias("name"), F.coalesce("document_id", F.lit("")).alias("document"))
    # counted by side and name first, and documents apart, so that no document carries sets
    found = rows.groupBy("entity_id", "side", "name").agg(F.count("*").alias("n")).groupBy("entity_id").agg(
        F.array_sort(F.collect_set(F.concat("side", F.lit(":"), "name"))).alias("independent_units"), F.array_sort(F.collect_set("side")).alias("source_sides"),
        F.array_sort(F.collect_set("name")).alias("source_names"), F.sum("n").alias("total_evidence_count"),
    )
    documents = rows.select("entity_id", "document").distinct().groupBy("entity_id").agg(F.count("*").alias("documents"))
    found = found.withColumnRenamed("entity_id", "entity").join(documents.withColumnRenamed("entity_id", "of"), F.col("entity").eqNullSafe(F.col("of")))
    found = found.select(F.col("entity").alias("entity_id"), "independent_units", "source_sides", "source_names", "documents", "total_evidence_count")
    units, sides = F.size("independent_units"), F.size("source_sides")
    score = clamp01(
        0.45 * F.least(F.lit(1.0), F.log2(units + 1) / 2)
        + 0.45 * F.when(sides >= 2, 1.0).when(F.size("source_names") >= 2, 0.35).otherwise(0.15)
        + 0.10 * F.least(F.lit(1.0), F.col("documents") / 3)
    )
    collapsed = F.greatest(F.lit(0), F.col("total_evidence_count") - units)
    return found.withColumns({"independence_score": score, "collapsed_evidence_count": collapsed}).select(
        "*",
        ((F.col("independence_score") >= scoring.independence_threshold) & (sides >= 2)).alias("independence_passed"),
        notes((collapsed > 0, F.concat(F.lit("collapsed_correlated_evidence="), collapsed.cast("string"))), (sides < 2, "single_source_side"), (units < 2, "single_independent_unit")).alias("independence_notes"),
    )


def quote_score(quote: Column | str = "quote") -> Column:
    """Specificity of one quote: digits, roles, capitalised words, length."""
    q = F.coalesce(F.col(quote) if isinstance(quote, str) else quote, F.lit(""))
    role = F.lower(q).rlike("|".join(ROLE_WORDS))
    proper = F.size(F.filter(F.split(q, "(?U)\\s+"), lambda x: x.rlike("^\\p{Lu}") & (F.length(x) > 3)))
    return clamp01(
        0.20 + F.when(q.rlike("(?U)\\d"), 0.20).otherwise(0.0) + F.when(role, 0.20).otherwise(0.0) + F.least(F.lit(0.30), proper * 0.04) + 0.10 * F.when(F.length(q).between(80, 450), 1.0).otherwise(0.65)
    )


def specificity(touched: DataFrame, candidates: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Predicate, quote, type and degree scores. candidates: entity_id, entity_name, entity_type, degree, source_sides."""
    own, specific = is_evidence(), is_evidence() & (F.coalesce("predicate", F.lit("")) != "CO_MENTIONED_WITH")
    found = touched.groupBy("entity_id").agg(
        F.sum(own.cast("int")).alias("n"), F.sum(specific.cast("int")).alias("specific"), F.avg(F.when(own, quote_score())).alias("quotes"), F.sum((~own).cast("int")).alias("excluded")
    )
    rows = candidates.join(found, "entity_id", "left").fillna(0, ["n", "specific", "excluded"])
    kinds = F.lit(UNKNOWN_TYPE_SCORE)
    for kind, value in TYPE_SCORES.items():
        kinds = F.when(F.col("entity_type") == kind, value).otherwise(kinds)
    rows = rows.withColumns(
        {
            "predicate_score": F.when(F.col("n") == 0, 0.35).otherwise(0.35 + 0.45 * F.col("specific") / F.col("n")),
            "quote_score": F.coalesce("quotes", F.lit(0.0)),
            "type_score": kinds,
            "degree_penalty": 1 / (1 + F.greatest(F.lit(0), F.col("degree") - 6) / 6),
        }
    )
    score = clamp01(0.35 * F.col("predicate_score") + 0.25 * F.col("quote_score") + 0.25 * F.col("type_score") + 0.15 * F.col("degree_penalty"))
    claim = F.concat(F.col("entity_name"), F.lit(" links "), F.coalesce(F.nullif(F.array_join("source_sides", ", "), F.lit("")), F.lit("unclassified sources")), F.lit("; the concrete claim needs human verification."))
    return rows.withColumn("specificity_score", score).select(
        "entity_id", "specificity_score", (F.col("specificity_score") >= scoring.specificity_threshold).alias("specificity_passed"), "predicate_score", "quote_score", "type_score", "degree_penalty", claim.alias("minimal_claim"),
        notes((F.col("excluded") > 0, F.concat(F.lit("inference_assertions_excluded_from_specificity="), F.col("excluded").cast("string"))), (F.col("specific") == 0, "only_co_mentions"), (F.col("entity_type") == "place", "place_entities_are_often_broad")).alias("specificity_notes"),
    )


def temporal(touched: DataFrame, corpus: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Concentration of each entity's dated evidence in its best window. corpus: published_at of all evidence.

    Evidence is first counted by entity and time. All frames begin at the first row, so that each takes one
    pass: what a window holds is a difference of running sums, and it has several sides if the next
    change of side falls into it.
    """
    days = scoring.temporal_window_days
    span = corpus.agg(F.greatest(F.lit(1), F.datediff(F.max("published_at"), F.min("published_at")) + 1).alias("span"))
    dated = touched.where("published_at is not null")
    side = F.coalesce("source_side", F.lit("unknown"))
    times = dated.groupBy("entity_id", "published_at").agg(F.count("*").alias("n"), F.min(side).alias("low"), F.max(side).alias("high"))
    order = "PARTITION BY entity_id ORDER BY published_at"
    running = times.selectExpr(
        "*", f"sum(n) OVER ({order} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days} DAYS FOLLOWING) AS reached",
        f"coalesce(sum(n) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before", f"low <> high OR low <> lag(low) OVER ({order}) AS changed",
    )
    later = f"min(CASE WHEN changed THEN published_at END) OVER ({order} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    seen = running.selectExpr("entity_id", "published_at", "n", "reached - before AS inside", f"low <> high OR coalesce({later} <= published_at + INTERVAL {days} DAYS, false) AS several")
    first = F.struct("inside", -F.unix_micros(F.col("published_at").cast("timestamp")))
    best = seen.groupBy("entity_id").agg(F.sum("n").alias("total"), F.max_by(F.struct("inside", "several", F.col("published_at").alias("start")), first).alias("best"))
    # one row holds the corpus span
    rows = best.crossJoin(F.broadcast(span)).select("entity_id", "total", "span", "best.*")
    enough = F.col("total") >= 2
    wide = F.col("span") > days
    lift = F.when(wide, (F.col("inside") / F.col("total")) / F.least(F.lit(1.0), F.lit(float(days)) / F.col("span"))).otherwise(1.0)
    base = F.when(wide, clamp01((lift - 1) / 3)).otherwise(0.15)
    score = F.when(F.col("several"), clamp01(base + 0.15)).otherwise(base)
    return rows.select(
        "entity_id", F.when(enough, score).otherwise(0.0).alias("temporal_score"), F.when(enough, F.col("inside")).otherwise(F.col("total")).alias("max_window_evidence_count"), F.col("total").alias("total_dated_count"),
        F.when(enough, F.col("span")).otherwise(0).alias("corpus_span_days"), F.when(enough, lift).otherwise(0.0).alias("lift_over_uniform"), F.when(enough, F.col("start")).alias("window_start"),
        F.when(enough, F.timestamp_add("DAY", F.lit(days), F.col("start"))).alias("window_end"),
        F.when(enough, notes((~wide, "corpus_span_not_wider_than_window"), (F.col("several"), "multi_side_evidence_inside_window"))).otherwise(F.array(F.lit("insufficient_temporal_evidence"))).alias("temporal_notes"),
    ).withColumn("temporal_passed", F.col("temporal_score") >= scoring.temporal_threshold)


def null_model(candidates: DataFrame, samples: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """How improbable each observed betweenness is among random graphs. candidates: entity_id, bridge_score; samples: node, betweenness."""
    b, seen = F.col("betweenness"), F.col("bridge_score")
    rows = candidates.select("entity_id", "bridge_score").join(samples.withColumnRenamed("node", "entity_id"), "entity_id", "left")
    # summed as decimals, so that the mean doesn't depend on the order of rows: an observed value may be just the mean
    mean = F.sum(b.cast("decimal(38,18)")).cast("double") / F.count(b)
    found = rows.groupBy("entity_id", "bridge_score").agg(F.count(b).alias("samples"), mean.alias("mean"), F.stddev_pop(b).alias("std"), F.sum((b >= seen).cast("int")).alias("above"))
    some = F.col("samples") > 0
    p = F.when(some, (F.col("above") + 1) / (F.col("samples") + 1)).otherwise(1.0)
    z = F.when(~some, 0.0).when(F.col("std") > 0, (seen - F.col("mean")) / F.col("std")).when(seen <= F.col("mean"), 0.0).otherwise(10.0)
    score = clamp01(1 - p)
    return found.select(
        "entity_id", "samples", F.coalesce("mean", F.lit(0.0)).alias("null_mean"), F.coalesce("std", F.lit(0.0)).alias("null_std"), p.alias("p_value"), z.alias("z_score"), score.alias("null_score"),
        (some & (p <= scoring.null_model_alpha) & (score >= scoring.improbability_threshold)).alias("null_passed"),
        F.when(some, notes((seen <= F.col("mean"), "not_above_null_mean"), (score < scoring.improbability_threshold, "below_improbability_threshold"))).otherwise(F.array(F.lit("insufficient_graph_for_null_model"))).alias("null_notes"),
    )


def status(scoring: Scoring = Scoring()) -> Column:
    """Reading status from the scores; the temporal control never gates."""
    return (
        F.when((F.col("independence_score") < 0.2) | (F.col("specificity_score") < 0.25), "discard")
        .when(F.col("independence_passed") & F.col("null_passed") & F.col("specificity_passed") & (F.col("final_score") >= scoring.min_final_score), "promote_for_human_review")
        .when(F.col("final_score") >= 0.35, "needs_more_evidence")
        .otherwise("degraded")
    )


def candidates(entities: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The entities with the greatest betweenness, of any type but other, that have neighbours; ties by entity_id."""
    pairs = centrality.project(edges).persist()
    ends = centrality.incidence(pairs).select("node")
    nodes = entities.select(F.col("canonical_id").alias("node")).union(ends).distinct()
    scores = centrality.betweenness(nodes, pairs)
    known = entities.select(F.col("canonical_id").alias("node"), "canonical_name", "entity_type")
    rows = scores.join(centrality.degrees(pairs), "node").join(known, "node", "left")
    rows = rows.where("entity_type is null or entity_type <> 'other'")
    return rows.select(
        F.col("node").alias("entity_id"), F.coalesce("canonical_name", "node").alias("entity_name"), F.coalesce("entity_type", F.lit("other")).alias("entity_type"), F.col("betweenness").alias("bridge_score"), "degree", "source_sides"
    ).orderBy(F.desc("bridge_score"), "entity_id").limit(limit)


def review(found: DataFrame, evidence: DataFrame, samples: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Candidates with the four controls, final score, status and caveats. evidence: with ends and predicate."""
    touched = touching(evidence).join(found.select("entity_id"), "entity_id", "left_semi")
    rows = (
        found.join(independence(touched, scoring).drop("source_sides"), "entity_id", "left")
        .join(null_model(found, samples, scoring), "entity_id", "left")
        .join(specificity(touched, found, scoring), "entity_id", "left")
        .join(temporal(touched, evidence.select("published_at"), scoring), "entity_id", "left")
    )
    # an entity without evidence has the scores of an empty list: one side fewer than two, no units
    rows = rows.fillna({"independence_score": 0.45 * 0.15, "independence_passed": False, "temporal_score": 0.0, "temporal_passed": False, "total_evidence_count": 0})
    rows = rows.withColumn("final_score", clamp01(0.30 * F.col("independence_score") + 0.30 * F.col("null_score") + 0.25 * F.col("specificity_score") + 0.15 * F.col("temporal_score")))
    local = F.concat(F.lit("The simplest explanation is the local prominence of "), F.col("entity_name"), F.lit(" within one family of sources."))
    public = F.concat(F.lit("The simplest explanation is a public convergence of topics around "), F.col("entity_name"), F.lit("; it implies neither coordination nor causation."))
    sides = F.size(F.array_distinct(F.transform(F.coalesce("independent_units", F.array().cast("array<string>")), lambda u: F.substring_index(u, ":", 1))))
    return rows.withColumns(
        {
            "status": status(scoring),
            "caveats": notes((~F.col("independence_passed"), "Independent convergence is below the threshold."), (~F.col("null_passed"), "Betweenness does not clearly exceed the null model."), (~F.col("specificity_passed"), "The claim is still too broad."), (~F.col("temporal_passed"), "There is no strong temporal anomaly in this window.")),
            "simplest_explanation": F.when(sides >= 2, public).otherwise(local),
        }
    )


def reviewed(entities: DataFrame, edges: DataFrame, evidence: DataFrame, top_n: int = 10, scoring: Scoring = Scoring()) -> DataFrame:
    """The candidates for the best bridges, three for each wanted; with their review unless it is switched off."""
    found = candidates(entities, edges, top_n * 3 if scoring.enabled else top_n)
    if not scoring.enabled:
        return found
    pairs = centrality.project(edges)
    nodes = entities.select(F.col("canonical_id").alias("node")).union(centrality.incidence(pairs).select("node"))
    return review(found, evidence, centrality.null_betweenness(pairs, nodes, scoring.null_model_samples, scoring.null_model_seed), scoring)


def discover_bridges(entities: DataFrame, edges: DataFrame, evidence: DataFrame, top_n: int = 10, scoring: Scoring = Scoring(), found: DataFrame | None = None) -> DataFrame:
    """The reviewed bridges, best first, each with its newest evidence. found: reviewed(), where it is at hand."""
    found = reviewed(entities, edges, evidence, top_n, scoring) if found is None else found
    if scoring.enabled:
        found = found.orderBy(F.desc("final_score"), F.desc("bridge_score"), F.desc(F.size("source_sides")), "entity_id")
    newest = evidence_for_entities(evidence, 6).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rank", *PAYLOAD))).alias("evidence"))
    return found.limit(top_n).join(newest, "entity_id", "left")
