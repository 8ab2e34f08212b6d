"""File inventory, archive layout, exports and annotation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.basics import file_suffix, null_to_blank
from docspark.functions.paths import file_name, strip_long_path_prefix, wanted_file

ARCHIVE_LAYOUT = ["area", "aircraft", "folder", "kind"]


def wanted_files(listed: DataFrame, extensions: Sequence[str] | None = None) -> DataFrame:
    """The wanted rows of a listing with ``rel_path``; adds name and extension."""
    return listed.filter(wanted_file("rel_path", extensions)).withColumns({
        "filename": file_name("rel_path"),
        "extension": F.regexp_replace(F.lower(file_suffix(file_name("rel_path"))), r"^\.", "")})


def archive_inventory(
    spark: SparkSession, root: str, extensions: Sequence[str] | None = None
) -> DataFrame:
    """Wanted files below ``root`` with path, size and time. The content
    column is never selected, so no file is read."""
    listed = spark.read.format("binaryFile").option(
        "recursiveFileLookup", "true").load(root).select(
        F.substring_index(F.col("path"), root.rstrip("/") + "/", -1).alias("rel_path"),
        (F.col("length") / 1024).alias("file_size_kb"),
        F.col("modificationTime").alias("mtime"))
    return wanted_files(listed, extensions).select(
        "rel_path", "filename", "extension", "file_size_kb", "mtime")


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """One path per line; blank lines and comments are left out."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("path")).filter(
        (F.col("path") != "") & ~F.col("path").startswith("#"))


def targeted_import(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each listed path with its state: found, or error when it is absent."""
    known = inventory.select(
        strip_long_path_prefix("path").alias("_k"), F.lit(True).alias("_f")).distinct()
    return wanted.withColumn("_k", strip_long_path_prefix("path")).join(
        known, "_k", "left").select(
        "path", F.when(F.col("_f"), "found").otherwise("error").alias("state"))


def archive_layout(docs: DataFrame) -> DataFrame:
    """Add the partition columns; rows without a registration are pending."""
    def part(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    return docs.withColumns({
        "area": F.when(
            null_to_blank("aircraft_registration") == "", "pending").otherwise("archive"),
        "aircraft": part("aircraft_registration", "UNKN"),
        "folder": part("category", "Divers"), "kind": part("doc_type", "Other")})


def write_archive(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Write documents laid out by aircraft, category and type.

    Rebalancing by layout avoids one small file per task and folder, and the
    adaptive planner splits the folders that hold too many rows.
    """
    archive_layout(docs).hint("rebalance", *ARCHIVE_LAYOUT).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy(*ARCHIVE_LAYOUT).parquet(path)


def export_rows(docs: DataFrame) -> DataFrame:
    """The fixed projection of the document export."""
    percent = F.when(
        F.coalesce("ocr_confidence", F.lit(0.0)) != 0,
        F.concat(F.format_string("%.1f", "ocr_confidence"), F.lit("%"))).otherwise("")
    return docs.select(
        F.col("id").alias("ID"), F.col("filename").alias("Fichier"),
        null_to_blank("aircraft_registration").alias("Avion"),
        null_to_blank("doc_type").alias("Type"),
        null_to_blank("category").alias("Catégorie"),
        null_to_blank("es_reference").alias("Réf_ES"),
        null_to_blank("ata_chapter").alias("ATA"), percent.alias("OCR"),
        F.when(F.col("manually_corrected"), "Oui").otherwise("Non").alias("Corrigé"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("")).alias("Date"))


def export_csv(docs: DataFrame, path: str) -> None:
    export_rows(docs).write.mode("overwrite").option("header", "true").option(
        "encoding", "UTF-8").csv(path)


def metrics_report(overall: DataFrame, per_class: DataFrame) -> DataFrame:
    """One nested row: the scores and a map label -> class scores. The number
    of labels bounds the map."""
    classes = per_class.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "label", F.struct("precision", "recall", "f1", "support"))))).alias("per_class"))
    return overall.withColumn("per_class", classes.scalar())


def write_metrics_report(overall: DataFrame, per_class: DataFrame, path: str) -> None:
    metrics_report(overall, per_class).write.mode("overwrite").json(path)


def annotation_split(annotated: DataFrame, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """``train`` or ``eval`` by a stable hash of the id."""
    digest = F.conv(F.substring(F.md5(
        F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10)
    share = digest.cast("double") / float(16 ** 8)
    return annotated.withColumn(
        "split", F.when(share < train_share, "train").otherwise("eval"))


def export_annotations(annotated: DataFrame, path: str, **options) -> None:
    """JSON lines per split; documents without spans are left out."""
    annotation_split(annotated.filter(F.size("entities") > 0), **options).write.mode(
        "overwrite").partitionBy("split").json(path)


def annotation_stats(annotated: DataFrame) -> DataFrame:
    return annotated.select(F.explode("entities.label").alias("label")).groupBy(
        "label").agg(F.count("*").alias("spans"))
