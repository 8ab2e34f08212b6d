"""Exact duplicates by content hash, and copies of the same file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.operators.scale import join_to_groups
from docspark.session import stored


def with_content_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("sha256_hash", F.sha2(F.col(text).cast("binary"), 256))


def _first_ids(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("sha256_hash").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies")).filter(
        F.col("copies") > 1)


def exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose content occurred before, with the first row's id."""
    hashed = stored(with_content_hash(docs.select("id", text), text).drop(text), "hashes")
    matched = join_to_groups(
        hashed, _first_ids(hashed), ["sha256_hash"], "copies", "id")
    return matched.filter(F.col("id") > F.col("first_id")).select(
        "id", "sha256_hash", F.col("first_id").alias("duplicate_of"))


def flag_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows without their text, with ``is_duplicate``."""
    hashed = stored(with_content_hash(docs, text).drop(text), "hashes")
    matched = join_to_groups(
        hashed, _first_ids(hashed.select("id", "sha256_hash")), ["sha256_hash"],
        "copies", "id", how="left")
    return matched.withColumn(
        "is_duplicate", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)),
    ).drop("first_id", "copies")


def best_copies(files: DataFrame) -> DataFrame:
    """Per file name with several copies: the copy to keep.

    A copy in a folder named after the registration in the file name wins,
    then the least nested one, then the first path.
    """
    rows = files.select("filename", "path", "file_size_kb")
    parts = F.split("path", "/")
    prefix = F.regexp_extract("filename", r"^(TS-IN[A-Z])_", 1)
    named = prefix.isin(fv.FLEET_REGISTRATIONS)
    in_folder = named & F.array_contains(
        F.transform(parts, lambda p: F.upper(p)), prefix)
    ranked = rows.withColumns({
        "_match": (~in_folder).cast("int"),
        "_depth": F.when(in_folder, 0).otherwise(F.size(parts))})
    sizes = ranked.groupBy("filename").agg(
        F.count("*").alias("copies"),
        F.min(F.struct("_match", "_depth", "path")).alias("_best"))
    return sizes.filter(F.col("copies") > 1).select(
        "filename", F.col("_best.path").alias("keeper"), "copies")


def copies_to_delete(files: DataFrame) -> DataFrame:
    """Every copy but the keeper, with the space it frees."""
    rows = files.select("filename", "path", "file_size_kb")
    matched = join_to_groups(
        rows, best_copies(files), ["filename"], "copies", "path")
    return matched.filter(F.col("path") != F.col("keeper")).select(
        "filename", "path", "keeper", (F.col("file_size_kb") / 1024).alias("mb"))

