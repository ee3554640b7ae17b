"""Landed documents as a stream: each micro-batch is upserted, so a batch delivered twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import normalize_ws, text_hash
from tessera.plans.pipeline import DOCUMENT, Engine


def landed(engine: Engine, folder: str) -> DataFrame:
    """Stream of documents from JSON lines in a folder; texts are normalised and hashed on the way in."""
    rows = engine.spark.readStream.schema(DOCUMENT).json(folder)
    return rows.withColumns({"text": normalize_ws("text"), "title": normalize_ws("title"), "text_hash": text_hash("text")}).where("text <> '' and title <> ''")


def start(engine: Engine, folder: str, checkpoint: str, map_each: bool = False) -> StreamingQuery:
    """Ingest all that has landed, then stop; map_each also extracts and maps after each batch."""

    def batch(rows: DataFrame, _: int) -> None:
        if rows.isEmpty():
            return
        engine.ingest(rows.dropDuplicates(["id"]))
        if map_each:
            engine.extract()
            engine.map_graph()

    return landed(engine, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
