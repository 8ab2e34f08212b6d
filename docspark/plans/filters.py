"""Filter, paging and set queries (F, L, U) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators import filters as flt
from docspark.operators.duplicates import with_content_hash
from docspark.plans.registry import plan
from docspark.sources.bindings import Tables

AS_OF = "TIMESTAMP_NTZ '2024-01-03 00:00:00'"


@plan("f01_list_documents", """
SELECT id, doc_type, aircraft_registration, category, es_reference, needs_review FROM cat_documents
WHERE aircraft_registration ILIKE '%in%' AND category ILIKE '%check%' AND ata_chapter ILIKE '%2%'
  AND es_reference ILIKE '%es00_0%' AND status = 'ARCHIVED' AND NOT needs_review""")
def f01(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "doc_type", "aircraft_registration", "category", "es_reference",
        "ata_chapter", "status", "needs_review")
    return flt.list_documents(
        docs, aircraft="in", category="check", ata="2", es_reference="es00_0",
        status="ARCHIVED", needs_review=False).drop("ata_chapter", "status")


# The order shows in which rows are the first ones.
@plan("f01_list_documents_sorted", """
SELECT id, doc_type, ocr_confidence FROM cat_documents WHERE status = 'ARCHIVED'
ORDER BY ocr_confidence ASC NULLS LAST, id LIMIT 40""")
def f01_sorted(t: Tables) -> DataFrame:
    docs = t.documents("id", "doc_type", "ocr_confidence", "status")
    return flt.list_documents(docs, status="ARCHIVED", sort="ocr_confidence", descending=False).limit(40).drop("status")


@plan("f02_documents_of_aircraft", """
SELECT id, category, doc_type, created_at FROM cat_documents
WHERE aircraft_registration ILIKE 'ts-inb' AND category ILIKE '%check%'
ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50""")
def f02(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "category", "doc_type", "created_at", "aircraft_registration")
    return flt.documents_of_aircraft(docs, "ts-inb", category="check").drop(
        "aircraft_registration")


@plan("f03_review_queue", """
SELECT id, validation_warnings FROM cat_text WHERE needs_review AND validation_warnings LIKE '%immatriculation%'""")
def f03(t: Tables) -> DataFrame:
    docs = t.documents("id", "needs_review", "validation_warnings")
    return flt.review_queue(docs, "immatriculation").drop("needs_review")


@plan("f04_search_within", """
SELECT id, filename, doc_type FROM cat_text WHERE contains(lower(filename), '0101')
  OR contains(lower(coalesce(aircraft_registration, '')), '0101') OR contains(lower(coalesce(es_reference, '')), '0101')
  OR contains(lower(doc_type), '0101')""")
def f04(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "filename", "aircraft_registration", "es_reference", "doc_type")
    return flt.search_within(docs, "0101", [
        "filename", "aircraft_registration", "es_reference", "doc_type"]).select(
        "id", "filename", "doc_type")


@plan("f05_reprocess_candidates", """
SELECT id, ocr_confidence FROM cat_documents WHERE ocr_confidence < 50""")
def f05(t: Tables) -> DataFrame:
    return flt.reprocess_candidates(t.documents("id", "ocr_confidence"), below=50)


@plan("f05_reprocess_candidates_limited", """
SELECT id, needs_review FROM cat_documents WHERE needs_review ORDER BY id LIMIT 100""")
def f05_limited(t: Tables) -> DataFrame:
    return flt.reprocess_candidates(
        t.documents("id", "needs_review"), review_only=True, limit=100)


@plan("f06_recent", """
SELECT id, coalesce(created_at, archived_at) AS moment FROM cat_documents
WHERE coalesce(created_at, archived_at) >= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 1 DAY""")
def f06(t: Tables) -> DataFrame:
    docs = t.documents("id", "created_at", "archived_at")
    return flt.recent(docs, "today", F.expr(AS_OF)).select(
        "id", F.coalesce("created_at", "archived_at").alias("moment"))


@plan("f07_off_fleet", """
SELECT id, aircraft_registration FROM cat_documents WHERE aircraft_registration NOT IN ('TS-INP', 'TS-INQ')""")
def f07(t: Tables) -> DataFrame:
    return flt.off_fleet(
        t.documents("id", "aircraft_registration"), ["TS-INP", "TS-INQ"])


@plan("f08_confidence_between", """
SELECT id, ocr_confidence FROM cat_documents WHERE ocr_confidence BETWEEN 55 AND 75""")
def f08(t: Tables) -> DataFrame:
    return flt.confidence_between(t.documents("id", "ocr_confidence"), 55, 75)


@plan("f08_confidence_slices", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, id FROM cat_documents WHERE ocr_confidence > 0 AND ocr_confidence {c}"
    for k, c in {"processed": "> 0", "low": "< 60", "good": ">= 80", "below_70": "< 70"}.items()))
def f08_slices(t: Tables) -> DataFrame:
    docs = t.documents("id", "ocr_confidence")
    parts = [
        flt.confidence_slice(docs, k).select(F.lit(k).alias("kind"), "id")
        for k in ("processed", "low", "good", "below_70")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan("f09_training_rows", """
SELECT id, doc_type, length(ocr_text) AS chars FROM cat_text
WHERE doc_type IS NOT NULL AND upper(doc_type) <> 'OTHER' AND length(ocr_text) > 100""")
def f09(t: Tables) -> DataFrame:
    rows = flt.training_rows(t.text("id", "doc_type", "ocr_text"), longer_than=100)
    return rows.select("id", "doc_type", F.length("ocr_text").cast("bigint").alias("chars"))


_CHECK_DOCS = """
WITH f AS (SELECT id, category, es_reference FROM cat_documents
  WHERE aircraft_registration ILIKE '%TS-INC%' AND category ILIKE '%Check C%'),
n AS (SELECT count(*) FILTER (WHERE upper(es_reference) = '{ref}') AS k FROM f)
SELECT f.* FROM f, n WHERE k = 0 OR upper(es_reference) = '{ref}'"""


def _documents_of_check(t: Tables, reference: str) -> DataFrame:
    docs = t.documents("id", "category", "es_reference", "aircraft_registration")
    return flt.documents_of_check(docs, "TS-INC", "C", reference).drop(
        "aircraft_registration")


@plan("f10_documents_of_check", _CHECK_DOCS.format(ref="ES001052"))
def f10(t: Tables) -> DataFrame:
    return _documents_of_check(t, "ES001052")


@plan("f10_documents_of_check_fallback", _CHECK_DOCS.format(ref="ES009999"))
def f10_fallback(t: Tables) -> DataFrame:
    return _documents_of_check(t, "ES009999")


@plan("f11_engine_files", """
SELECT id, filename FROM (SELECT id, left(filename, 3) || '.' || lang || '.pdf' AS filename FROM cat_text)
WHERE filename LIKE '0%.%.pdf'""")
def f11(t: Tables) -> DataFrame:
    return flt.engine_files(t.documents("id", "filename", "lang").select(
        "id", F.concat(F.left("filename", F.lit(3)), F.lit("."), "lang", F.lit(".pdf"))
        .alias("filename")))


@plan("f12_document_by_id", "SELECT id, doc_type, text FROM cat_documents WHERE id = 42")
def f12(t: Tables) -> DataFrame:
    return flt.document_by_id(t.documents("id", "doc_type", "text"), 42)


@plan("l01_paginate", """
SELECT id, created_at, (SELECT count(*) FROM cat_documents) AS total,
  CAST(ceil((SELECT count(*) FROM cat_documents) / 30.0) AS BIGINT) AS pages
FROM cat_documents ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 30 OFFSET 60""")
def l01(t: Tables) -> DataFrame:
    return flt.paginate(t.documents("id", "created_at"), page=3, size=30)


@plan("l01_paginate_wide", """
SELECT id, created_at, (SELECT count(*) FROM cat_wide) AS total,
  CAST(ceil((SELECT count(*) FROM cat_wide) / 50.0) AS BIGINT) AS pages
FROM cat_wide ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50""")
def l01_wide(t: Tables) -> DataFrame:
    return flt.paginate(t.wide().select("id", "created_at"), page=2, size=50)


@plan("l02_top_ata", """
SELECT ata_chapter, count(*) AS count FROM cat_documents WHERE ata_chapter IS NOT NULL
GROUP BY ata_chapter ORDER BY count DESC, ata_chapter LIMIT 8""")
def l02(t: Tables) -> DataFrame:
    return flt.top_ata(t.documents("ata_chapter"), 8)


@plan("l03_recent_alerts", """
SELECT id, severity, resolved, created_at FROM (
  SELECT * FROM cat_alerts ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20) WHERE NOT resolved""")
def l03(t: Tables) -> DataFrame:
    return flt.recent_alerts(t.alerts()).select(
        "id", "severity", "resolved", "created_at")


@plan("l04_model_leaderboard", """
SELECT lang AS model_name, CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / nullif(count(quality), 0) AS accuracy
FROM cat_documents GROUP BY lang""")
def l04(t: Tables) -> DataFrame:
    models = t.documents("lang", "quality").groupBy(F.col("lang").alias("model_name")).agg(
        F.try_divide(
            F.count_if(F.col("quality") == 1).cast("double"), F.count("quality"))
        .alias("accuracy"))
    return flt.model_leaderboard(models)


@plan("l05_document_register", """
SELECT id, filename, doc_type, aircraft_registration, category, RND[ocr_confidence;1] AS ocr_confidence FROM cat_text""")
def l05(t: Tables) -> DataFrame:
    return flt.document_register(t.documents(
        "id", "filename", "doc_type", "aircraft_registration", "category",
        "ocr_confidence"))


@plan("u02_new_hashes", """
SELECT sha256(text) AS sha256_hash FROM cat_documents WHERE lang <> 'en'
EXCEPT SELECT sha256(text) FROM cat_documents WHERE status = 'ARCHIVED'""")
def u02(t: Tables) -> DataFrame:
    hashed = with_content_hash(t.documents("id", "text", "lang", "status")).drop("text")
    return flt.new_hashes(
        hashed.filter("lang <> 'en'"), hashed.filter("status = 'ARCHIVED'"))


@plan("u03_known_on_both", """
SELECT sha256(text) AS sha256_hash FROM cat_documents WHERE lang <> 'en'
INTERSECT SELECT sha256(text) FROM cat_documents WHERE status = 'ARCHIVED'""")
def u03(t: Tables) -> DataFrame:
    hashed = with_content_hash(t.documents("id", "text", "lang", "status")).drop("text")
    return flt.known_on_both(
        hashed.filter("lang <> 'en'"), hashed.filter("status = 'ARCHIVED'"))
