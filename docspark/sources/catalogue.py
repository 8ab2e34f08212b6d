"""Typed reading of stored catalogue tables, and keyed table updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": """
        id bigint, sha256_hash string, filename string, original_path string,
        file_size_kb double, mime_type string, doc_type string, category string,
        subcategory string, ata_chapter string, status string,
        aircraft_registration string, es_reference string, item_number string,
        part_number string, serial_number string, work_order_number string,
        sb_ad_reference string, document_date string, effectivity string,
        extracted_entities string, ocr_text string, ocr_confidence double,
        ocr_pages int, ocr_engine string, ocr_quality_score double,
        validation_warnings string, classifier_confidence double,
        classifier_scores map<string,double>, embedding array<float>,
        search_tokens array<string>, aircraft_id int, check_id bigint,
        created_at timestamp_ntz, updated_at timestamp_ntz,
        archived_at timestamp_ntz, is_duplicate boolean, is_critical boolean,
        needs_review boolean, manually_corrected boolean, linked_wp string,
        duplicate_of bigint, notes string""",
    "aircraft": """
        id int, registration string, msn string, model string,
        aircraft_type string, variant string, manufacturer string,
        airline string, delivery_date date, lessor string, notes string,
        archive_path string""",
    "aircraft_checks": """
        id bigint, es_reference string, check_type string, aircraft_id int,
        start_date date, end_date date, station string, description string,
        total_documents int, work_orders_count int, jobcards_count int,
        defect_reports_count int, ncr_count int, confirmed_by_rct boolean,
        rct_document_id bigint, created_at timestamp_ntz,
        updated_at timestamp_ntz""",
    "alerts": """
        id bigint, title string, message string, severity string,
        alert_type string, aircraft_registration string, document_id bigint,
        es_reference string, resolved boolean, resolved_at timestamp_ntz,
        resolved_by string, created_at timestamp_ntz""",
}
DEFAULTS: dict[str, dict[str, object]] = {
    "documents": {
        "is_duplicate": False, "is_critical": False, "needs_review": False,
        "manually_corrected": False, "status": "PENDING", "ocr_pages": 0,
        "validation_warnings": "[]"},
    "aircraft": {"aircraft_type": "CEO"},
    "aircraft_checks": {
        "confirmed_by_rct": False, "total_documents": 0, "work_orders_count": 0,
        "jobcards_count": 0, "defect_reports_count": 0, "ncr_count": 0},
    "alerts": {"resolved": False, "severity": "info"},
}


def read_catalogue(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table with its declared types; absent columns and values take the
    declared defaults. The schema is given, so no file is opened to infer it."""
    frame = spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")
    defaults = DEFAULTS[table]
    return frame.select(*[
        F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
        for c in frame.columns])


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], mode: str = "update"
) -> DataFrame:
    """Insert source rows whose key is new; on a known key ``update``
    replaces the values and ``ignore`` keeps them."""
    if mode not in ("update", "ignore"):
        raise ValueError(f"unknown mode {mode}")
    values = [c for c in target.columns if c not in keys]
    new = source.select(*keys, F.struct(*values).alias("_new"))
    old = target.select(*keys, F.struct(*values).alias("_old"))
    first, second = ("_new", "_old") if mode == "update" else ("_old", "_new")
    merged = old.join(new, list(keys), "full").withColumn(
        "_row", F.coalesce(first, second))
    return merged.select(*[
        F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in target.columns])


def insert_where_not_exists(
    target: DataFrame, source: DataFrame, keys: Sequence[str]
) -> DataFrame:
    return target.unionByName(
        source.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def with_defaults(frame: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return frame.select(*[
        F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
        for c in frame.columns])
