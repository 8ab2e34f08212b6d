"""Ingest in batches with one published version each (T3, T4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.duplicates import with_content_hash
from docspark.operators.ingest import Archive
from docspark.plans.classification import CASCADE_CTES, CASCADE_SELECT
from docspark.plans.functions import ENTITIES_SQL
from docspark.plans.registry import plan
from docspark.session import scratch_path
from docspark.sources.bindings import Tables
from docspark.streaming import streams as st
from docspark.streaming.ledger import dedup_writer, published_rows

BATCHES = 3


def _drained(t: Tables, docs: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    """Runs `write` over batches of `docs` with rising ids. Each arrives as the
    files that parallel tasks wrote, and the stream takes all there are."""
    last = docs.agg(F.max("id")).first()[0] or 0
    step = last // BATCHES + 1
    for i in range(BATCHES):
        docs.filter((F.col("id") >= i * step) & (F.col("id") < (i + 1) * step)).write.mode(
            "append").parquet(f"{folder}/arrivals")
        stream = t.spark.readStream.schema(docs.schema).parquet(f"{folder}/arrivals")
        st.drain_batches(stream, write, f"{folder}/checkpoint")


def ingested(t: Tables, folder: str) -> Archive:
    docs = t.text("id", "filename", "rel_path", "ocr_text", "ocr_confidence", "text")
    archive = Archive(t.spark, f"{folder}/archive")
    archive.seed(aircraft=t.aircraft().select("id", "registration", "model", F.lit(False).alias("created")))
    _drained(t, docs, folder, archive.writer("watch", "text"))
    return archive


@plan("t04_ingest_archive", "WITH " + ENTITIES_SQL.strip() + """,
tx AS (SELECT t.id, t.filename, t.rel_path, t.ocr_text, en.sb_ad_reference FROM cat_text t JOIN en ON en.id = t.id),
""" + CASCADE_CTES.replace("AS body FROM cat_text)", "AS body FROM tx)") + ",\nfin AS (" + CASCADE_SELECT.strip() + """),
h AS (SELECT id, ocr_confidence, min(id) OVER (PARTITION BY coalesce(sha256(text), CAST(id AS VARCHAR))) AS first FROM cat_text)
SELECT h.id, CASE WHEN h.id = first THEN 'ARCHIVED' ELSE 'DUPLICATE' END AS status, nullif(first, h.id) AS duplicate_of,
  CASE WHEN h.id = first THEN fin.predicted_type END AS doc_type, CASE WHEN h.id = first THEN fin.method END AS method,
  CASE WHEN h.id = first THEN en.es_reference END AS es_reference,
  CASE WHEN h.id = first THEN h.ocr_confidence < 60 OR fin.confidence < 0.5 END AS needs_review
FROM h JOIN fin ON fin.id = h.id JOIN en ON en.id = h.id""")
def t04_ingest(t: Tables) -> DataFrame:
    archive = ingested(t, scratch_path(t.spark, "ingest"))
    docs = archive.table("documents").select("id", "doc_type", "method", "es_reference", "needs_review")
    return archive.table("results").select("id", "status", "duplicate_of").join(docs, "id", "left")


@plan("t04_ingest_alerts", """
SELECT id AS document_id, 'OCR faible confiance — ' || filename AS title, 'warning' AS severity FROM (
  SELECT *, min(id) OVER (PARTITION BY coalesce(sha256(text), CAST(id AS VARCHAR))) AS first FROM cat_text)
WHERE id = first AND ocr_confidence > 0 AND ocr_confidence < 50""")
def t04_alerts(t: Tables) -> DataFrame:
    return ingested(t, scratch_path(t.spark, "ingest")).table("alerts").select("document_id", "title", "severity")


@plan("t03_ledger_dedup_stream", """
SELECT sha256(text) AS sha256_hash, min(id) AS id FROM cat_documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM cat_documents WHERE status = 'ARCHIVED') GROUP BY 1""")
def t03_ledger(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "ledger")
    docs = t.documents("id", "text").withColumn("at", F.timestamp_seconds(F.col("id")))
    known = with_content_hash(t.documents("id", "text", "status").filter("status = 'ARCHIVED'")).select(
        "sha256_hash", "id", F.lit(0).alias("at"))
    write = dedup_writer(t.spark, folder, "at", known=known)
    _drained(t, docs, folder, write)
    return published_rows(t.spark, folder).select("sha256_hash", "id")
