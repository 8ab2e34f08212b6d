"""Streaming queries (T) and SQL functions (G): drain a file stream over the
given tables into the shared folder and return the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.entities import ENTITY_FIELDS
from docspark.functions.spans import annotate_spans
from docspark.functions.sql import register_sql_functions
from docspark.plans.classification import CASCADE_CTES, CASCADE_SELECT
from docspark.plans.functions import _ATA_CASE, ENTITIES_SQL, spans_sql
from docspark.plans.maintenance import ALERTS_SQL, c10
from docspark.plans.registry import plan
from docspark.session import scratch_path
from docspark.sources.bindings import Tables
from docspark.streaming import streams as st


class StreamTables(Tables):
    """The same bindings over file streams; joins stay out of the stream."""

    def raw(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return st.file_stream(self.spark, self.folder, f"{name}.parquet", schema)


def _live(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


def _drained(t: Tables, stream: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    path = scratch_path(t.spark, name)
    st.drain(stream, f"{path}/data", f"{path}/checkpoint", fmt)
    if fmt == "text":
        return t.spark.read.text(f"{path}/data")
    return t.spark.read.schema(stream.schema).parquet(f"{path}/data")


_WATCH_FIELDS = ", ".join(f"en.{f} AS e_{f}" for f in ENTITY_FIELDS if f != "ata_description")


@plan("t01_watch_archive", "WITH " + ENTITIES_SQL.strip() + """,
tx AS (SELECT t.id, t.filename, t.rel_path, t.ocr_text, en.sb_ad_reference FROM cat_text t JOIN en ON en.id = t.id),
""" + CASCADE_CTES.replace("AS body FROM cat_text)", "AS body FROM tx)") + ",\nfin AS (" + CASCADE_SELECT.strip() + f""")
SELECT fin.*, t.filename, t.rel_path, t.ocr_confidence, {_WATCH_FIELDS},
  CASE regexp_extract(en.ata_chapter, '(\\d{{2}})', 1) {_ATA_CASE} END AS e_ata_description,
  t.ocr_confidence < 60 OR fin.confidence < 0.5 AS needs_review, fin.predicted_type = 'AD' AND fin.confidence > 0.7 AS is_critical
FROM fin JOIN cat_text t ON t.id = fin.id JOIN en ON en.id = fin.id""")
def t01(t: Tables) -> DataFrame:
    docs = _live(t).text("id", "filename", "rel_path", "ocr_text", "ocr_confidence")
    return _drained(t, st.watch_archive(docs), "watch")


def _events(t: Tables) -> DataFrame:
    return _live(t).processing_log().withColumn("at", F.col("at").cast("timestamp"))


@plan("t02_in_flight_dedup", """
SELECT DISTINCT user_id || '/' || event_type AS path FROM events""")
def t02(t: Tables) -> DataFrame:
    arrivals = _live(t).raw("events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"),
        F.col("ts").cast("timestamp").alias("at"))
    return _drained(
        t, st.in_flight_dedup(arrivals, "path", "at", "400 days"), "inflight").select("path")


@plan("t03_hash_dedup_stream", """
SELECT DISTINCT sha256(text) AS sha256_hash FROM cat_documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM cat_documents WHERE status = 'ARCHIVED')""")
def t03(t: Tables) -> DataFrame:
    from docspark.operators.duplicates import with_content_hash

    docs = _live(t).documents("id", "text").withColumn(
        "at", F.timestamp_seconds(F.col("id")))
    known = with_content_hash(
        t.documents("text", "status").filter("status = 'ARCHIVED'"))
    return _drained(
        t, st.hash_dedup(docs, known, "at", "36500 days"), "hashes").select("sha256_hash")


@plan("t04_batch_commit", """
SELECT status, count(*) AS documents FROM cat_import_log GROUP BY status""")
def t04(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "commit")
    rows = _live(t).raw("lineitem").select(F.expr("""CASE l_returnflag WHEN 'N' THEN
        'imported' WHEN 'A' THEN 'duplicate' ELSE 'error' END""").alias("status"),
        "l_orderkey", "l_linenumber")
    st.drain_batches(rows, st.commit_batches(path), f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/summary").groupBy("status").agg(
        F.sum("documents").alias("documents"))


@plan("t05_alert_stream", ALERTS_SQL)
def t05(t: Tables) -> DataFrame:
    return _drained(t, c10(_live(t)), "alerts")


@plan("t06_processing_metrics_stream", """
SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'error') AS errors,
  RND[CAST(sum(CAST(duration_s AS DECIMAL(18,6))) AS DOUBLE) / count(*);3] AS avg_duration_s,
  RND[count(*) / (CAST(sum(CAST(duration_s AS DECIMAL(18,6))) AS DOUBLE) / 3600);1] AS per_hour FROM cat_processing_log""")
def t06(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "metrics")
    st.drain_batches(
        st.processing_metrics(_events(t)), st.latest_state(path),
        f"{path}-checkpoint", "complete")
    states = t.spark.read.parquet(path)
    newest = states.agg(F.max("batch").alias("b")).scalar()
    return states.filter(F.col("batch") == newest).drop("batch")


@plan("t07_archive_rate_windows", """
SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", count(*) AS documents FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def t07(t: Tables) -> DataFrame:
    found = _drained(t, st.archive_rate(_events(t), "at"), "rate")
    return found.select(
        F.col("start").cast("timestamp_ntz").alias("start"),
        F.col("end").cast("timestamp_ntz").alias("end"), "documents")


@plan("t08_new_document_feed", """
SELECT id, 'new_document' AS event, filename, aircraft_registration, doc_type, category FROM cat_text WHERE status = 'ARCHIVED'""")
def t08(t: Tables) -> DataFrame:
    docs = _live(t).documents(
        "id", "filename", "aircraft_registration", "doc_type", "category", "status")
    messages = st.document_feed(docs.filter("status = 'ARCHIVED'"))
    schema = """event string, id bigint, filename string,
        aircraft_registration string, doc_type string, category string"""
    return _drained(t, messages, "feed", "text").select(
        F.from_json("value", schema).alias("m")).select("m.*")


@plan("g02_span_rows", "WITH " + spans_sql() + " SELECT label, count(*) AS spans FROM spans GROUP BY label")
def g02(t: Tables) -> DataFrame:
    spans = t.text("id", "ocr_text").select(
        "id", F.explode(annotate_spans()("ocr_text")).alias("s"))
    return spans.groupBy("s.label").agg(F.count("*").alias("spans"))


@plan("g03_sql_functions", """
SELECT id, CASE WHEN regexp_full_match(right(upper(aircraft_registration), 2), 'N[B-RTU]') THEN aircraft_registration END AS registration,
  ltrim(regexp_replace(es_reference, '^ES', ''), '0') AS number,
  CASE doc_type WHEN 'Other' THEN 'OTHER' ELSE doc_type END AS doc_type,
  CASE WHEN category LIKE 'Check _' THEN right(category, 1) WHEN right(upper(category), 1) IN ('A', 'C', 'D') THEN right(upper(category), 1) END AS letter FROM cat_documents""")
def g03(t: Tables) -> DataFrame:
    register_sql_functions(t.spark)
    t.documents(
        "id", "aircraft_registration", "es_reference", "doc_type", "category",
    ).createOrReplaceTempView("docspark_sql_documents")
    return t.spark.sql("""
        SELECT id, normalise_registration(right(aircraft_registration, 2)) AS registration,
          normalise_es(es_reference) AS number,
          normalise_doc_type(upper(doc_type)) AS doc_type, check_letter(category) AS letter
        FROM docspark_sql_documents""")
