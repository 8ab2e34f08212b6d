"""Continuous versions of the catalogue operators.

Sources are file streams. Every writer takes a checkpoint location and either
the file sink or ``foreachBatch`` with a folder per batch, so a replayed batch
overwrites itself and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import labels
from docspark.functions.basics import rounded
from docspark.functions.entities import with_entities
from docspark.functions.text import classifier_text
from docspark.operators.duplicates import with_content_hash
from docspark.operators.maintenance import generate_alerts
from docspark.operators.rules import classify_cascade


def file_stream(
    spark: SparkSession, folder: str, pattern: str, schema,
    max_files: int = 1000,
) -> DataFrame:
    """New parquet files of a table, a bounded number per micro-batch.

    The table may be one file or a folder of part files; a path with a
    pattern in it matches either.
    """
    path = f"{folder}/{pattern[:-1]}[{pattern[-1]}]"
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", str(max_files)).parquet(path)


def drain(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"
) -> None:
    """Process everything that has arrived into a file sink, then stop."""
    query = stream.writeStream.format(fmt).option(
        "checkpointLocation", checkpoint).option("path", path).outputMode(
        "append").trigger(availableNow=True).start()
    query.awaitTermination()


def drain_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append",
) -> None:
    query = stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).outputMode(mode).trigger(
        availableNow=True).start()
    query.awaitTermination()


def watch_archive(docs: DataFrame) -> DataFrame:
    """Enrich arriving documents: entities, class, review flags. Stateless."""
    found = with_entities(docs, prefix="e_")
    prepared = found.withColumn(
        "classifier_text", classifier_text("ocr_text", "filename", "rel_path"))
    decided = classify_cascade(prepared, sb_ad="e_sb_ad_reference")
    return decided.withColumns({
        "needs_review": labels.needs_review("ocr_confidence", "confidence"),
        "is_critical": labels.is_critical("predicted_type", "confidence"),
    }).drop("classifier_text", "ocr_text")


def in_flight_dedup(
    arrivals: DataFrame, key: str, moment: str, window: str
) -> DataFrame:
    """A path is processed once within the window; older state is dropped."""
    return arrivals.withWatermark(moment, window).dropDuplicatesWithinWatermark([key])


def hash_dedup(
    docs: DataFrame, known: DataFrame, moment: str, window: str, text: str = "text"
) -> DataFrame:
    """New contents only: once per window in the stream, and never when the
    catalogue already has the hash. The window bounds the state."""
    hashed = with_content_hash(docs, text).drop(text)
    fresh = hashed.withWatermark(moment, window).dropDuplicatesWithinWatermark(
        ["sha256_hash"])
    return fresh.join(known.select("sha256_hash").distinct(), "sha256_hash", "left_anti")


def commit_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Writer for ``foreachBatch``: rows and status counts per batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        # The counts come from the written table, not from a second pass over
        # the source.
        stored = batch.sparkSession.read.parquet(f"{path}/rows/batch={number}")
        stored.groupBy("status").agg(F.count("*").alias("documents")).write.mode(
            "overwrite").parquet(f"{path}/summary/batch={number}")

    return write


def alert_stream(docs: DataFrame) -> DataFrame:
    return generate_alerts(docs)


def processing_metrics(log: DataFrame) -> DataFrame:
    """Processed, errors, mean duration and documents per hour of work."""
    seconds = F.sum(F.col("duration_s").cast("decimal(18,6)")).cast("double")
    return log.groupBy().agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        rounded(seconds / F.count("*"), 3).alias("avg_duration_s"),
        rounded(F.try_divide(F.count("*").cast("double"), seconds / 3600), 1).alias(
            "per_hour"))


def latest_state(path: str) -> Callable[[DataFrame, int], None]:
    """Writer for complete mode: the newest state under its batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def archive_rate(
    docs: DataFrame, moment: str, window: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """Documents per tumbling window; rows later than ``late`` are dropped."""
    return docs.withWatermark(moment, late).groupBy(
        F.window(moment, window)).agg(F.count("*").alias("documents")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"),
        "documents")


def document_feed(docs: DataFrame) -> DataFrame:
    """One JSON message per archived document, for a file or Kafka sink."""
    return docs.select(F.to_json(F.struct(
        F.lit("new_document").alias("event"), "id", "filename",
        "aircraft_registration", "doc_type", "category")).alias("value"))
