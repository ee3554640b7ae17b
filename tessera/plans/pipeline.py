"""The whole run: stored documents -> extractions -> graph -> bridges and signals, over snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import centrality, export, extraction, graph_store, property_store, resolution, scoring, signals
from tessera.plans.config import AppConfig
from tessera.sources import collect
from tessera.sources.web import Fetcher

DOCUMENT = (
    "id STRING, source_name STRING, source_kind STRING, source_side STRING, url STRING, title STRING, text STRING, author STRING, published_at TIMESTAMP, fetched_at TIMESTAMP, "
    "raw_html_path STRING, metadata MAP<STRING,STRING>, page MAP<STRING,STRING>, text_hash STRING"
)
STORED = "document_id STRING, text_hash STRING, provider STRING, model STRING, payload_json STRING, created_at TIMESTAMP"
ENTITY = "canonical_id STRING, canonical_name STRING, entity_type STRING, aliases ARRAY<STRING>, resolution_reason STRING, confidence DOUBLE"
EVIDENCE = "evidence_id STRING, edge_id STRING, document_id STRING, assertion_type STRING, confidence DOUBLE, quote STRING, source_name STRING, source_side STRING, url STRING, title STRING, published_at TIMESTAMP, extraction_method STRING"
ENDS = "edge_id STRING, subject_id STRING, predicate STRING, object_id STRING"


@dataclass
class Engine:
    """The staged entry points over one snapshot store."""

    spark: SparkSession
    config: AppConfig

    def __post_init__(self):
        self.store = graph_store.SnapshotStore(self.spark, self.config.project.database_path)
        self.connect = property_store.connector(self.config.graph.neo4j) if self.config.graph.backend == "neo4j" else None

    def _evidence(self) -> DataFrame:
        """Stored evidence; that of the older layout gets its cautious values."""
        return graph_store.with_legacy_defaults(self.store.read("evidence", EVIDENCE)).select(*graph_store.EVIDENCE)

    def documents(self) -> DataFrame:
        """All stored documents, newest first."""
        return self.store.read("documents", DOCUMENT).orderBy(F.desc("published_at"), "id")

    def get_document(self, ident: str) -> DataFrame:
        """The document of that id: one row or none."""
        return self.store.read("documents", DOCUMENT).where(F.col("id") == ident)

    def collect(self, fetcher: Fetcher | None = None) -> int:
        """Collect and ingest what the enabled sources hold; no request is made without any."""
        found = collect.collect(self.spark, self.config, fetcher)
        return self.ingest(found) if found is not None else 0

    def ingest(self, collected: DataFrame) -> int:
        """Insert or replace documents by id; the same address under another id is refused."""
        self.store.begin()
        old = self.store.read("documents", DOCUMENT)
        # a document without a text or a title is none
        collected = collected.select(*old.columns).where("trim(coalesce(text, '')) <> '' and trim(coalesce(title, '')) <> ''").persist()
        both = graph_store.upsert(old, collected, "id")
        if not export.repeated_keys(both, "url").isEmpty():
            raise ValueError("one address has two documents")
        self.store.commit({"documents": both})
        return collected.count()

    def _catalogue(self) -> DataFrame:
        rows = [(k, e.name, e.entity_type, j, a) for k, e in enumerate(self.config.known_entities) for j, a in enumerate([e.name, *e.aliases])]
        return self.spark.createDataFrame(rows, "pos int, name string, entity_type string, alias_pos int, alias string")

    def _stored(self) -> DataFrame:
        return self.store.read("extractions", STORED)

    def _valid(self) -> DataFrame:
        return extraction.valid_extractions(self._stored(), self.store.read("documents", DOCUMENT), *extraction.cache_identity(self.config))

    def extract(self, provider: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Extract what has no valid extraction. provider: documents -> (document_id, entities, relations, warnings),
        whose results are grounded; without one, the catalogue is matched."""
        self.store.begin()
        docs = self.store.read("documents", DOCUMENT)
        name, model, fingerprint = extraction.cache_identity(self.config)
        extraction.check_policy(fingerprint)
        todo = extraction.split_by_cache(docs, self._valid())[1] if self.config.llm.cache_extractions else docs
        if provider is None:
            both = extraction.with_found(todo, self._catalogue()).where(F.size("found") > 0).persist()
            found = extraction.extract_entities(todo, self._catalogue(), both).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "entity_type", "quote", "confidence"))).alias("e"))
            pairs = extraction.co_mentions(todo, self._catalogue(), both).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "i", "j", "subject", "subject_type", "predicate", "object", "object_type", "quote", "confidence", "assertion_type"))).alias("r"))
            rows = todo.select("id", "text_hash").join(found, "id", "left").join(pairs, "id", "left")
            drop = lambda c, *names: F.transform(F.coalesce(c, F.array().cast(rows.schema[c].dataType)), lambda x: x.dropFields(*names))
            rows = rows.select(F.col("id").alias("document_id"), "text_hash", drop("e", "pos").alias("entities"), drop("r", "sentence_no", "i", "j").alias("relations"), F.array(F.lit("development extractor: CO_MENTIONED_WITH only states that both occur in the text")).alias("warnings"))
            rows = rows.withColumns({"provider": F.lit(name), "model": F.lit(model), "cache_policy_fingerprint": F.lit(fingerprint)})
        else:
            rows = extraction.ground(provider(todo), todo, self.config, name, model, fingerprint)
        payload = F.to_json(F.struct("document_id", "text_hash", "provider", "model", "cache_policy_fingerprint", "entities", "relations", "warnings"))
        fresh = rows.select("document_id", "text_hash", "provider", "model", payload.alias("payload_json"), F.current_timestamp().alias("created_at")).persist()
        self.store.commit({"extractions": graph_store.upsert(self._stored(), fresh, "document_id")})
        return fresh.count()

    def map_graph(self) -> dict[str, int]:
        """Resolve all valid extractions and replace the evidence of all stored documents."""
        self.store.begin()
        docs = self.store.read("documents", DOCUMENT)
        valid = self._valid().persist()
        name, model, _ = extraction.cache_identity(self.config)
        entities = valid.select(F.col("document_id").alias("id"), F.posexplode("entities").alias("pos", "e")).select("id", "pos", "e.*")
        relations = valid.select(F.col("document_id").alias("id"), F.posexplode("relations").alias("sentence_no", "r")).select("id", "sentence_no", F.lit(0).alias("i"), F.lit(0).alias("j"), "r.*")
        seeds = resolution.seed_aliases(self.spark, self.config)
        names = resolution.distinct_names(resolution.mentioned(entities, relations))
        resolved = resolution.resolve_names(names, seeds, self.config.resolver.similarity_threshold).persist()
        found = resolution.resolve_relations(relations, resolved, docs, f"{name}:{model}").persist()
        evidence, ends, observed = graph_store.upsert_relations(self._evidence(), self.store.read("ends", ENDS), found, docs.select(F.col("id").alias("document_id")))
        written = {"entities": resolved.count(), "edge_writes": found.count(), "evidence_writes": observed.count()}
        known = graph_store.upsert_entities(self.store.read("entities", ENTITY), resolution.canonical_entities(names, resolved, seeds))
        self.store.commit({"entities": known, "evidence": evidence, "ends": ends, "edges": graph_store.roll_up_edges(evidence, ends)})
        if self.connect:
            property_store.load(self.store.read("entities", ENTITY), found.dropDuplicates(["evidence_id"]), self.connect)
        return written

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(entities, edges, evidence with the ends of its edge)."""
        edges = self.store.read("edges")
        evidence = self._evidence()
        if edges is None:
            edges = graph_store.roll_up_edges(evidence, self.store.read("ends", ENDS))
        return self.store.read("entities", ENTITY), edges, graph_store.all_evidence(evidence, edges)

    def discover(self, top_n: int = 10) -> DataFrame:
        """Ranked bridges; also written as JSON. An empty graph writes nothing."""
        entities, edges, evidence = self.graph()
        # ranked once; the reports cover every reviewed candidate
        found = scoring.reviewed(entities, edges, evidence, top_n, self.config.scoring).persist()
        rows = scoring.discover_bridges(entities, edges, evidence, top_n, self.config.scoring, found).persist()
        if not edges.isEmpty() or not entities.isEmpty():
            export.write_json(rows, f"{self.config.project.output_dir}/bridge_candidates.json")
            if self.config.scoring.enabled:
                export.write_json(found.orderBy(F.desc("final_score"), "entity_id"), f"{self.config.project.output_dir}/skeptic_reports.json")
        return rows

    def signals(self) -> tuple[DataFrame, DataFrame]:
        """(small notes, morning readings); also written as JSON. Switched off, both are empty and nothing is written."""
        entities, edges, evidence = self.graph()
        docs = self.store.read("documents", DOCUMENT)
        m = lambda k: F.try_element_at("metadata", F.lit(k))
        weights = self.spark.createDataFrame([(s.name, s.attention_weight) for s in self.config.sources] or [("", 0.7)], "source_name string, source_weight double")
        docs = docs.join(F.broadcast(weights), "source_name", "left").withColumns(  # sources: the configuration's size
            {
                "dated": signals.document_time(),
                "attention_weight": F.coalesce(m("source_attention_weight").try_cast("double"), "source_weight", F.lit(0.7)),
                "feed_rank": F.coalesce(*(F.nullif(m(k), F.lit("0")) for k in ("feed_rank", "listing_rank", "archive_rank"))).try_cast("int"),
            }
        )
        nodes = entities.select(F.col("canonical_id").alias("node")).union(centrality.incidence(centrality.project(edges)).select("node"))
        scores = centrality.betweenness(nodes, centrality.project(edges))
        notes = signals.small_notes(docs, evidence, scores, self.config.signals)
        readings = signals.morning_readings(docs, evidence, entities, scores, self.config.signals)
        if not self.config.signals.enabled:
            return notes.limit(0), readings.limit(0)
        out = self.config.project.output_dir
        notes, readings = notes.persist(), readings.persist()
        export.write_json(notes, f"{out}/small_notes.json")
        export.write_json(readings, f"{out}/morning_readings.json")
        both = notes.agg(F.collect_list(F.struct("*")).alias("small_notes")).crossJoin(readings.agg(F.collect_list(F.struct("*")).alias("morning_readings")))  # two rows
        export.write_json(both, f"{out}/signals.json")
        return notes, readings

    def run(self, collected: DataFrame | None = None, provider: Callable[[DataFrame], DataFrame] | None = None, collect: bool = False, fetcher: Fetcher | None = None) -> dict:
        """Collect (the given documents, and with collect what the sources hold), extract, map, discover, signal."""
        written = (self.ingest(collected) if collected is not None else 0) + (self.collect(fetcher) if collect else 0)
        stats = {"documents_collected": written, "documents_extracted": self.extract(provider)}
        stats |= self.map_graph()
        bridges = self.discover()
        notes, readings = self.signals()
        return stats | {"bridges": bridges.count(), "small_notes": notes.count(), "morning_readings": readings.count()}
