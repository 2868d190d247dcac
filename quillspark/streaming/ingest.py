"""Streaming: repeatable ingest of a landing folder, running counts, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def stream_documents(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def ingest(docs: DataFrame, target: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Each batch's new texts, once each, appended to ``target``; a batch that is run again adds nothing twice.

    What is stored is keyed by batch, so a repeated batch overwrites its own part, and
    texts are compared with those of earlier batches only.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = store.with_hash(batch)
        keep = fresh.groupBy("text_hash").agg(F.min(key).alias(key))
        try:
            old = spark.read.parquet(target).where(F.col("batch") < number).select("text_hash")
            keep = keep.join(old, "text_hash", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.join(keep, ["text_hash", key], "left_semi").dropDuplicates(["text_hash"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(docs: DataFrame, by: str) -> DataFrame:
    """Counts by a column, for output mode ``complete``."""
    return docs.groupBy(by).agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; with ``late``, a watermark bounds the state of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
