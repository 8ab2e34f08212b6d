"""The catalogue tables, bound to the given star-schema tables.

Every operator works on column roles, so the same code runs on a real
catalogue. ``Tables`` derives those roles from the given tables. Each method
takes the columns it should deliver and performs only the joins they need:
the text, the embeddings and the labels are never read for a query that does
not ask for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DOC_EXPRESSIONS = {
    "id": "doc_id",
    "text": "text",
    "lang": "lang",
    "source": "source",
    "n_chars": "n_chars",
    "created_at": "ts",
    "embedding": "embedding",
    "quality": "quality",
    "toxic": "toxic",
    "doc_type": """CASE doc_id % 8 WHEN 0 THEN 'Work Order' WHEN 1 THEN 'Jobcard'
        WHEN 2 THEN 'Defect Report' WHEN 3 THEN 'AD' WHEN 4 THEN 'SB'
        WHEN 5 THEN 'Specs' WHEN 6 THEN 'RCT' ELSE 'Other' END""",
    "aircraft_id": "CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id % 25 AS INT) END",
    "check_id": "CASE WHEN doc_id % 5 <> 4 THEN doc_id % 120 END",
    "es_reference": """CASE WHEN doc_id % 5 <> 4 THEN
        'ES' || lpad(CAST(doc_id % 120 + 1000 AS STRING), 6, '0') END""",
    "aircraft_registration": """CASE WHEN doc_id % 17 <> 0 THEN
        'TS-IN' || chr(65 + doc_id % 25) END""",
    "category": """CASE doc_id % 8 WHEN 3 THEN 'AD' WHEN 4 THEN 'SB' WHEN 5 THEN 'Specs'
        WHEN 7 THEN NULL ELSE CASE doc_id % 3 WHEN 0 THEN 'Check A'
        WHEN 1 THEN 'Check C' ELSE 'Check D' END END""",
    "ata_chapter": """CASE WHEN doc_id % 6 <> 5 THEN
        'ATA ' || CAST(21 + doc_id % 13 AS STRING) END""",
    "status": """CASE WHEN doc_id % 10 < 7 THEN 'ARCHIVED'
        WHEN doc_id % 10 < 9 THEN 'PENDING' ELSE 'ERROR' END""",
    "ocr_confidence": "CAST(doc_id * 37 % 1001 AS DOUBLE) / 10",
    "classifier_confidence": "CAST(doc_id * 53 % 1001 AS DOUBLE) / 1000",
    "file_size_kb": "CAST(n_chars AS DOUBLE) / 1024",
    "needs_review": "coalesce(quality = 0, false)",
    "is_critical": "coalesce(toxic = 1, false)",
    "manually_corrected": "doc_id % 11 = 0",
    "archived_at": "CASE WHEN doc_id % 10 < 7 THEN ts END",
    "ocr_engine": "CASE WHEN doc_id % 2 = 0 THEN 'pdfplumber' ELSE 'ocr_v5_tesseract' END",
    "filename": """CASE
        WHEN doc_id % 4 = 0 AND doc_id % 5 <> 4
          THEN 'ES' || lpad(CAST(doc_id % 120 + 1000 AS STRING), 6, '0') || '.pdf'
        WHEN doc_id % 4 = 1 AND doc_id % 17 <> 0 AND doc_id % 5 <> 4
          THEN 'TS-IN' || chr(65 + doc_id % 25) || '_CHECK A_ES'
            || lpad(CAST(doc_id % 120 + 1000 AS STRING), 6, '0') || '_RCT.pdf'
        WHEN doc_id % 4 = 2
          THEN 'A320-' || CAST(21 + doc_id % 13 AS STRING) || '-'
            || CAST(1000 + doc_id % 500 AS STRING) || '.pdf'
        ELSE lpad(CAST(doc_id % 1000 AS STRING), 4, '0') || '.pdf' END""",
    "work_order_number": "'WO-' || CAST(10000 + doc_id AS STRING)",
    "part_number": "'PN' || CAST(doc_id * 7 AS STRING) || '-A'",
    "serial_number": "'SN' || CAST(doc_id * 3 AS STRING)",
    "sb_ad_reference": """CASE doc_id % 8
        WHEN 3 THEN 'AD 2024-' || lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0')
          || '-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')
        WHEN 4 THEN 'A320-' || CAST(21 + doc_id % 13 AS STRING) || '-'
          || CAST(1000 + doc_id % 500 AS STRING) END""",
    "item_number": """CASE WHEN doc_id % 8 = 1 THEN
        lpad(CAST(doc_id % 1000 AS STRING), 4, '0') END""",
    "extracted_entities": """CASE
        WHEN lang = 'en' THEN '{"msn": "' || CAST(1000 + (doc_id % 25) * 37 AS STRING)
          || '", "source": ["' || source || '"]}'
        WHEN lang = 'fr' THEN '{"serial_number": "' || CAST(n_chars AS STRING) || '"}' END""",
    "validation_warnings": """CASE WHEN doc_id % 17 = 0
        THEN '["immatriculation manquante", "' || lang || '"]' ELSE '[]' END""",
}
_NEEDS_EVENTS = {"created_at", "archived_at"}
_NEEDS_EMBEDDINGS = {"embedding"}
_NEEDS_LABELS = {"quality", "toxic", "needs_review", "is_critical"}
DOCUMENT_COLUMNS = [
    c for c in _DOC_EXPRESSIONS if c not in ("text",)]

_PATH = """'Aircraft/' || coalesce(aircraft_registration, 'UNKNOWN') || '/' ||
    coalesce(category, 'Old doc') || '/' ||
    CASE doc_type WHEN 'Work Order' THEN 'WORKORDER' WHEN 'Jobcard' THEN 'JOBCARD'
      WHEN 'Defect Report' THEN 'DEFECT REPORT' WHEN 'RCT' THEN 'RCT'
      WHEN 'AD' THEN 'AD' WHEN 'SB' THEN 'SB' ELSE 'MISC' END || '/' || filename"""
_OCR_TEXT = """CASE WHEN id % 3 <> 2 THEN 'A/C ' ||
      coalesce(aircraft_registration, '--') || chr(10) ELSE '' END ||
    'WORK ORDER: WO-' || CAST(10000 + id AS STRING) || chr(10) ||
    'P/N: PN' || CAST(id * 7 AS STRING) || '-A S/N: SN' || CAST(id * 3 AS STRING)
    || ' ' || coalesce(ata_chapter, '') || chr(10) ||
    CASE WHEN doc_type = 'Work Order' THEN 'Linked WP ES' ||
      lpad(CAST((id + 8) % 120 + 1000 AS STRING), 6, '0') || chr(10) ELSE '' END ||
    'MSN ' || CAST(1000 + (id % 25) * 37 AS STRING) || ' DATE: ' ||
    lpad(CAST(1 + id % 28 AS STRING), 2, '0') || '/03/2024' || chr(10) || text"""
_TEXT_EXTRA = {
    "rel_path": (_PATH, {"aircraft_registration", "category", "doc_type", "filename"}),
    "ocr_text": (
        _OCR_TEXT, {"id", "aircraft_registration", "ata_chapter", "doc_type", "text"}),
}


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Use all cores for work on texts when the scan has too few tasks.

    A file with a single row group is read by one task, however many cores
    there are. A large table has more splits than cores and stays as it is.
    """
    if frame.isStreaming:
        return frame
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.select(key).rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, key)


class Tables:
    """Lazy catalogue frames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self, *columns: str) -> DataFrame:
        wanted = list(columns) or DOCUMENT_COLUMNS
        frame = self.raw("documents")
        if "text" in wanted:
            frame = spread(frame, "doc_id")
        if _NEEDS_EVENTS & set(wanted):
            events = self.raw("events").select(
                F.col("event_id").alias("doc_id"), "ts")
            frame = frame.join(events, "doc_id", "left")
        if _NEEDS_EMBEDDINGS & set(wanted):
            vectors = self.raw("embeddings").select(
                F.col("vec_id").alias("doc_id"), "embedding")
            frame = frame.join(vectors, "doc_id", "left")
        if _NEEDS_LABELS & set(wanted):
            labels = self.raw("labels").select("doc_id", "quality", "toxic")
            frame = frame.join(labels, "doc_id", "left")
        return frame.select(
            *[F.expr(_DOC_EXPRESSIONS[c]).alias(c) for c in wanted])

    def text(self, *columns: str) -> DataFrame:
        """Documents plus ``rel_path`` and ``ocr_text``."""
        extra = [c for c in columns if c in _TEXT_EXTRA]
        base = {c for c in columns if c not in _TEXT_EXTRA}
        for c in extra:
            base |= _TEXT_EXTRA[c][1]
        frame = self.documents(*sorted(base))
        return frame.select(*[
            F.expr(_TEXT_EXTRA[c][0]).alias(c) if c in _TEXT_EXTRA else F.col(c)
            for c in columns])

    def aircraft(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
        return joined.select(
            F.col("n_nationkey").alias("id"),
            F.expr("'TS-IN' || chr(65 + n_nationkey)").alias("registration"),
            F.expr("CAST(1000 + n_nationkey * 37 AS STRING)").alias("msn"),
            F.expr("""CASE WHEN n_nationkey IN (11, 12) THEN 'A320-251N'
                ELSE 'A320-214' END""").alias("model"),
            F.expr("CASE WHEN n_nationkey IN (11, 12) THEN 'NEO' ELSE 'CEO' END")
            .alias("aircraft_type"),
            F.col("r_name").alias("lessor"))

    def checks(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.expr("'ES' || lpad(CAST(s_suppkey + 1000 AS STRING), 6, '0')")
            .alias("es_reference"),
            F.expr("""CASE s_suppkey % 3 WHEN 0 THEN 'Check A' WHEN 1 THEN 'Check C'
                ELSE 'Check D' END""").alias("check_type"),
            F.col("s_nationkey").alias("aircraft_id"),
            F.expr("DATE '2024-01-01' + CAST(s_suppkey % 28 AS INT)")
            .alias("start_date"),
            F.expr("""CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2024-01-01' +
                CAST(s_suppkey % 28 + 5 + s_suppkey % 9 AS INT) END""")
            .alias("end_date"))

    def alerts(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'error'").select(
            F.col("event_id").alias("id"),
            F.expr("event_id % 500").alias("document_id"),
            F.expr("'TS-IN' || chr(CAST(65 + user_id % 25 AS INT))")
            .alias("aircraft_registration"),
            F.expr("""CASE WHEN value >= 50 THEN 'critical' WHEN value >= 10
                THEN 'warning' ELSE 'info' END""").alias("severity"),
            F.expr("""CASE WHEN event_id % 2 = 0 THEN 'ocr_low_confidence'
                ELSE 'processing_error' END""").alias("alert_type"),
            F.expr("event_id % 3 = 0").alias("resolved"),
            F.col("ts").alias("created_at"))

    def page_text(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("bundle_id"), F.col("turn").alias("page_no"),
            F.expr("""CASE WHEN (conv_id + turn) % 3 = 0 THEN 'WORK ORDER' || chr(10)
                  || 'ES ' || lpad(CAST(conv_id * 10 + turn AS STRING), 6, '0') || chr(10)
                WHEN (conv_id + turn) % 3 = 1 THEN 'A/C TS-IN' ||
                  chr(CAST(65 + conv_id % 25 AS INT)) || chr(10)
                ELSE '' END || text""").alias("page_text"))

    def page_ocr(self) -> DataFrame:
        """Three recognition attempts per page."""
        attempts = F.expr("""explode(array(
            named_struct('engine', 'tesseract', 'attempt', 1),
            named_struct('engine', 'tesseract', 'attempt', 2),
            named_struct('engine', 'opencv', 'attempt', 1)))""")
        return self.raw("conversations").select(
            "conv_id", "turn", "text", attempts.alias("a")).select(
            F.col("conv_id").alias("document_id"), F.col("turn").alias("page_no"),
            F.col("a.engine").alias("engine"), F.col("a.attempt").alias("attempt"),
            "text",
            F.expr("""CAST((conv_id * 31 + turn * 17 + a.attempt * 211
                + length(a.engine) * 97) % 1001 AS DOUBLE) / 10""").alias("confidence"))

    def predictions(self) -> DataFrame:
        return self.documents(
            "id", "doc_type", "ocr_confidence", "classifier_confidence").select(
            "id", F.col("doc_type").alias("y_true"), "ocr_confidence",
            F.col("classifier_confidence").alias("confidence"),
            F.expr("""CASE WHEN id % 7 < 5 THEN doc_type WHEN id % 7 = 5
                THEN 'Work Order' ELSE 'Unknown' END""").alias("y_pred"))

    def ocr_runs(self) -> DataFrame:
        return self.documents("id", "ocr_confidence", "needs_review").select(
            "id", F.col("ocr_confidence").alias("old_confidence"),
            F.expr("CAST(id * 41 % 1001 AS DOUBLE) / 10").alias("new_confidence"),
            F.col("needs_review").alias("old_review"),
            F.expr("id * 41 % 1001 < 550").alias("new_review"))

    def files(self, *columns: str) -> DataFrame:
        """Organised files; French documents also have an old copy."""
        wanted = columns or ("path", "filename", "file_size_kb", "mtime")
        base = self.text(
            "id", "filename", "rel_path", "file_size_kb", "created_at", "lang")
        places = F.array_compact(F.array(
            F.expr("'ORGANISED/' || split_part(rel_path, '/', 2) || '/' || filename"),
            F.when(F.col("lang") == "fr", F.concat(
                F.lit("ORGANISED/Divers/Old/"), "filename"))))
        return base.select(
            F.explode(places).alias("path"), "filename", "file_size_kb",
            F.col("created_at").alias("mtime")).select(*wanted)

    def wide(self) -> DataFrame:
        """Large fact with the same roles, from orders, customers and parts."""
        orders, customers = self.raw("orders"), self.raw("customer")
        parts = self.raw("part")
        size = parts.agg(F.count("*").alias("n")).scalar()
        return (
            orders.join(customers, orders.o_custkey == customers.c_custkey)
            .withColumn("part_slot", F.col("o_orderkey") % size)
            .join(parts, F.col("part_slot") == parts.p_partkey, "left")
            .select(
                F.col("o_orderkey").alias("id"),
                F.col("o_orderpriority").alias("doc_type"),
                F.col("p_type").alias("category"),
                F.expr("""CASE o_orderstatus WHEN 'F' THEN 'ARCHIVED' WHEN 'O'
                    THEN 'PENDING' ELSE 'ERROR' END""").alias("status"),
                F.col("c_nationkey").alias("aircraft_id"),
                F.expr("'TS-IN' || chr(65 + c_nationkey)")
                .alias("aircraft_registration"),
                F.expr("CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 10")
                .alias("ocr_confidence"),
                F.col("o_orderdate").alias("created_at")))

    def import_log(self) -> DataFrame:
        """One row per imported file, from the largest given table."""
        lines, suppliers = self.raw("lineitem"), self.raw("supplier")
        return lines.join(
            suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
            F.expr("CAST(date_trunc('year', l_shipdate) AS DATE)").alias("run"),
            F.expr("'TS-IN' || chr(65 + s_nationkey)").alias("aircraft"),
            F.expr("""CASE l_returnflag WHEN 'N' THEN 'imported'
                WHEN 'A' THEN 'duplicate' ELSE 'error' END""").alias("status"),
            F.col("l_quantity").alias("duration_s"))

    def processing_log(self) -> DataFrame:
        """One row per processed document, in id order."""
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.expr("CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END")
            .alias("status"),
            F.col("value").alias("duration_s"), F.col("ts").alias("at"))
