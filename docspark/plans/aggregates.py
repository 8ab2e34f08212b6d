"""Aggregate queries (A) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import labels
from docspark.operators import aggregates as agg
from docspark.operators.duplicates import flag_duplicates
from docspark.operators.joins import aircraft_with_counts
from docspark.plans.registry import plan
from docspark.sources.bindings import Tables

ENTITY_FIELDS = [
    "aircraft_registration", "es_reference", "ata_chapter", "serial_number",
    "part_number", "item_number", "work_order_number", "sb_ad_reference"]


@plan("a01_global_kpis", """
SELECT count(*) AS total_documents,
  count(*) FILTER (WHERE status = 'ARCHIVED') AS archived,
  count(*) FILTER (WHERE status = 'ERROR') AS errors,
  count(*) FILTER (WHERE is_critical) AS critical,
  count(*) FILTER (WHERE needs_review) AS needs_review,
  count(embedding) AS with_embedding,
  RND[MEAN[ocr_confidence];1] AS avg_ocr, RND[MEAN[classifier_confidence];2] AS avg_classifier,
  RND[TOTAL[file_size_kb] / 1024;1] AS total_mb,
  count(DISTINCT aircraft_registration) AS aircraft, count(DISTINCT es_reference) AS checks
FROM cat_documents""")
def a01(t: Tables) -> DataFrame:
    return agg.global_kpis(t.documents(
        "aircraft_registration", "es_reference", "status", "is_critical",
        "needs_review", "embedding", "ocr_confidence", "classifier_confidence",
        "file_size_kb"))


@plan("a02_dashboard_kpis", """
SELECT count(*) AS total_documents, count(*) FILTER (WHERE status = 'ARCHIVED') AS archived,
  coalesce(RND[MEAN[CASE WHEN ocr_confidence > 0 THEN ocr_confidence END];2], 0) AS avg_ocr_confidence,
  count(*) FILTER (WHERE needs_review) AS needs_review,
  RND[count(*) FILTER (WHERE status = 'ARCHIVED') / CAST(greatest(count(*), 1) AS DOUBLE) * 100;1] AS archive_rate_pct,
  count(*) FILTER (WHERE is_critical) AS critical_ads,
  (SELECT count(*) FROM cat_alerts WHERE NOT resolved) AS active_alerts,
  (SELECT count(*) FROM cat_aircraft) AS total_aircraft
FROM cat_documents""")
def a02(t: Tables) -> DataFrame:
    return agg.dashboard_kpis(
        t.documents("status", "ocr_confidence", "needs_review", "is_critical"),
        t.alerts(), t.aircraft())


@plan("a03_system_health", """
SELECT CASE WHEN count(*) FILTER (WHERE status = 'ERROR') < 10 THEN 'healthy' ELSE 'degraded' END AS status,
  count(*) AS total_documents, count(*) FILTER (WHERE status = 'ARCHIVED') AS archived,
  count(*) FILTER (WHERE status = 'ERROR') AS errors,
  count(*) FILTER (WHERE rn > 1) AS duplicates_detected,
  coalesce(RND[MEAN[ocr_confidence];2], 0) AS avg_ocr_confidence,
  (SELECT count(*) FROM cat_alerts WHERE NOT resolved) AS active_alerts
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS rn FROM cat_documents)""")
def a03(t: Tables) -> DataFrame:
    docs = flag_duplicates(t.documents("id", "text", "status", "ocr_confidence"))
    return agg.system_health(docs, t.alerts())


@plan("a04_stage_coverage", """
SELECT RND[count(*) FILTER (WHERE aircraft_registration <> '') / CAST(greatest(count(*), 1) AS DOUBLE);3] AS entities,
  RND[MEAN[classifier_confidence];3] AS classifier,
  RND[count(embedding) / CAST(greatest(count(*), 1) AS DOUBLE);3] AS embedding
FROM cat_documents WHERE status = 'ARCHIVED'""")
def a04(t: Tables) -> DataFrame:
    return agg.stage_coverage(t.documents(
        "status", "aircraft_registration", "classifier_confidence", "embedding"))


@plan("a05_by_type", """
SELECT doc_type, count(*) AS documents, RND[MEAN[ocr_confidence];1] AS avg_ocr,
  RND[MEAN[classifier_confidence];2] AS avg_classifier, RND[TOTAL[file_size_kb] / 1024;1] AS size_mb,
  count(*) FILTER (WHERE is_critical) AS critical
FROM cat_documents GROUP BY doc_type""")
def a05(t: Tables) -> DataFrame:
    return agg.by_type(t.documents(
        "doc_type", "ocr_confidence", "classifier_confidence", "file_size_kb",
        "is_critical"))


@plan("a06_stats_by_type", """
SELECT doc_type, count(*) AS count, RND[nullif(MEAN[ocr_confidence], 0);1] AS avg_ocr_confidence
FROM cat_documents GROUP BY doc_type""")
def a06(t: Tables) -> DataFrame:
    return agg.stats_by_type(t.documents("doc_type", "ocr_confidence"))


@plan("a06_stats_by_type_wide", """
SELECT doc_type, count(*) AS count, RND[nullif(MEAN[ocr_confidence], 0);1] AS avg_ocr_confidence
FROM cat_wide GROUP BY doc_type""")
def a06_wide(t: Tables) -> DataFrame:
    return agg.stats_by_type(t.wide())


@plan("a07_by_aircraft", """
SELECT d.aircraft_registration, a.msn, a.model, count(*) AS documents,
  count(DISTINCT d.doc_type) AS types, count(DISTINCT d.category) AS categories,
  RND[MEAN[d.ocr_confidence];1] AS avg_ocr, count(*) FILTER (WHERE d.is_critical) AS critical,
  CAST(min(d.archived_at) AS DATE) AS first_document, CAST(max(d.archived_at) AS DATE) AS last_document
FROM cat_documents d LEFT JOIN cat_aircraft a ON a.id = d.aircraft_id
WHERE d.aircraft_registration IS NOT NULL GROUP BY d.aircraft_registration, a.msn, a.model""")
def a07(t: Tables) -> DataFrame:
    return agg.by_aircraft(t.documents(
        "aircraft_registration", "aircraft_id", "doc_type", "category",
        "ocr_confidence", "is_critical", "archived_at"), t.aircraft())


@plan("a08_stats_by_aircraft", """
SELECT a.registration, count(d.id) AS count FROM cat_aircraft a
LEFT JOIN cat_documents d ON d.aircraft_registration = a.registration GROUP BY a.registration""")
def a08(t: Tables) -> DataFrame:
    return agg.stats_by_aircraft(t.documents("aircraft_registration"), t.aircraft())


@plan("a09_by_category", """
SELECT category, count(*) AS count FROM cat_documents WHERE category IS NOT NULL GROUP BY category""")
def a09(t: Tables) -> DataFrame:
    return agg.by_category(t.documents("category"))


@plan("a09_by_category_wide", """
SELECT category, count(*) AS count FROM cat_wide WHERE category IS NOT NULL GROUP BY category""")
def a09_wide(t: Tables) -> DataFrame:
    return agg.by_category(t.wide())


@plan("a10_by_ata", """
SELECT ata_chapter, count(*) AS documents, count(DISTINCT aircraft_registration) AS aircraft,
  RND[MEAN[ocr_confidence];1] AS avg_ocr, count(*) FILTER (WHERE is_critical) AS critical
FROM cat_documents WHERE ata_chapter IS NOT NULL GROUP BY ata_chapter""")
def a10(t: Tables) -> DataFrame:
    return agg.by_ata(t.documents(
        "ata_chapter", "aircraft_registration", "ocr_confidence", "is_critical"))


@plan("a11_monthly_archive", """
SELECT CAST(date_trunc('month', archived_at) AS DATE) AS month,
  strftime(date_trunc('month', archived_at), '%Y-%m') AS label, count(*) AS archived,
  count(DISTINCT aircraft_registration) AS active_aircraft,
  RND[MEAN[ocr_confidence];1] AS avg_ocr, count(*) FILTER (WHERE is_critical) AS critical
FROM cat_documents WHERE archived_at IS NOT NULL GROUP BY date_trunc('month', archived_at)""")
def a11(t: Tables) -> DataFrame:
    return agg.monthly_archive(t.documents(
        "archived_at", "aircraft_registration", "ocr_confidence", "is_critical"))


@plan("a12_monthly_evolution", """
SELECT CAST(year(created_at) AS VARCHAR) || '-' || lpad(CAST(month(created_at) AS VARCHAR), 2, '0') AS period,
  count(*) AS count
FROM cat_wide WHERE status = 'ARCHIVED' GROUP BY year(created_at), month(created_at)
ORDER BY year(created_at) DESC, month(created_at) DESC LIMIT 6""")
def a12(t: Tables) -> DataFrame:
    return agg.monthly_evolution(t.wide())


@plan("a13_ocr_quality_bands", """
SELECT CASE WHEN ocr_confidence >= 90 THEN '90-100% — Excellent' WHEN ocr_confidence >= 70 THEN '70-90% — Bon'
    WHEN ocr_confidence >= 50 THEN '50-70% — Moyen' WHEN ocr_confidence > 0 THEN '0-50% — Faible'
    ELSE 'Non traité' END AS band,
  count(*) AS documents, RND[MEAN[file_size_kb];1] AS avg_kb, count(DISTINCT aircraft_registration) AS aircraft
FROM cat_documents GROUP BY 1""")
def a13(t: Tables) -> DataFrame:
    return agg.quality_bands(t.documents(
        "ocr_confidence", "file_size_kb", "aircraft_registration"))


@plan("a14_ocr_distribution", """
SELECT CASE WHEN ocr_confidence >= 90 THEN '90-100%' WHEN ocr_confidence >= 75 THEN '75-89%'
    WHEN ocr_confidence >= 50 THEN '50-74%' WHEN ocr_confidence >= 25 THEN '25-49%'
    WHEN ocr_confidence > 0 THEN '1-24%' ELSE '0%' END AS band, count(*) AS count
FROM cat_documents GROUP BY 1""")
def a14(t: Tables) -> DataFrame:
    return agg.band_counts(
        t.documents("ocr_confidence"), labels.distribution_band("ocr_confidence"))


@plan("a15_reprocess_buckets", """
SELECT CASE WHEN coalesce(ocr_confidence, 0) = 0 THEN '0%' WHEN ocr_confidence < 25 THEN '1-24%'
    WHEN ocr_confidence < 50 THEN '25-49%' WHEN ocr_confidence < 75 THEN '50-74%' ELSE '75-99%' END AS band,
  count(*) AS count
FROM cat_documents WHERE needs_review GROUP BY 1""")
def a15(t: Tables) -> DataFrame:
    docs = t.documents("ocr_confidence", "needs_review").filter("needs_review")
    return agg.band_counts(docs, labels.reprocess_band("ocr_confidence"))


@plan("a16_anomalies", """
SELECT count(*) FILTER (WHERE status = 'ARCHIVED' AND aircraft_registration IS NULL) AS no_aircraft,
  count(*) FILTER (WHERE status = 'ARCHIVED' AND ata_chapter IS NULL) AS no_ata,
  count(*) FILTER (WHERE status = 'ARCHIVED' AND es_reference IS NULL) AS no_reference,
  count(*) FILTER (WHERE needs_review) AS needs_review
FROM cat_documents""")
def a16(t: Tables) -> DataFrame:
    return agg.anomalies(t.documents(
        "status", "aircraft_registration", "ata_chapter", "es_reference", "needs_review"))


@plan("a17_coverage_by_aircraft", """
SELECT a.registration AS aircraft, count(d.id) AS total_docs, count(DISTINCT d.doc_type) AS nb_types,
  coalesce(RND[MEAN[d.ocr_confidence];1], 0) AS avg_ocr,
  count(d.id) FILTER (WHERE d.manually_corrected) AS validated,
  RND[count(DISTINCT d.doc_type) / CAST((SELECT count(DISTINCT doc_type) FROM cat_documents) AS DOUBLE) * 100;0] AS coverage_pct
FROM cat_aircraft a LEFT JOIN cat_documents d ON d.aircraft_registration = a.registration
GROUP BY a.registration""")
def a17(t: Tables) -> DataFrame:
    return agg.coverage_by_aircraft(t.documents(
        "aircraft_registration", "doc_type", "ocr_confidence", "manually_corrected"),
        t.aircraft())


@plan("a18_archive_quality_score", """
SELECT RND[coalesce(MEAN[CASE WHEN ocr_confidence > 0 THEN ocr_confidence END], 0) * 0.4e0
  + coalesce(MEAN[CASE WHEN status = 'ARCHIVED' THEN classifier_confidence END], 0) * 100 * 0.3e0
  + (1 - (count(*) FILTER (WHERE status = 'ARCHIVED' AND aircraft_registration IS NULL)
      + count(*) FILTER (WHERE needs_review)) / CAST(greatest(count(*), 1) AS DOUBLE)) * 100 * 0.3e0;1] AS quality_score
FROM cat_documents""")
def a18(t: Tables) -> DataFrame:
    return agg.archive_quality_score(t.documents(
        "status", "ocr_confidence", "classifier_confidence", "aircraft_registration",
        "needs_review"))


@plan("a19_validation_rate", """
SELECT count(*) FILTER (WHERE status = 'ARCHIVED' AND manually_corrected) AS manually_corrected,
  RND[count(*) FILTER (WHERE status = 'ARCHIVED' AND manually_corrected)
    / CAST(greatest(count(*) FILTER (WHERE status = 'ARCHIVED'), 1) AS DOUBLE) * 100;1] AS human_validation_pct,
  count(*) FILTER (WHERE status = 'PENDING') AS pending_count
FROM cat_documents""")
def a19(t: Tables) -> DataFrame:
    return agg.validation_rate(t.documents("status", "manually_corrected"))


@plan("a20_aircraft_stats", """
SELECT a.registration, a.model, count(d.id) AS total_docs,
  count(d.id) FILTER (WHERE d.doc_type = 'Work Order') AS work_orders,
  count(d.id) FILTER (WHERE d.doc_type = 'Jobcard') AS jobcards,
  count(d.id) FILTER (WHERE d.doc_type = 'AD') AS ads, count(d.id) FILTER (WHERE d.doc_type = 'SB') AS sbs,
  RND[MEAN[d.ocr_confidence];4] AS avg_ocr_confidence, max(d.created_at) AS last_archived
FROM cat_aircraft a LEFT JOIN cat_documents d ON d.aircraft_id = a.id GROUP BY a.id, a.registration, a.model""")
def a20(t: Tables) -> DataFrame:
    return agg.aircraft_stats(t.documents(
        "aircraft_id", "doc_type", "ocr_confidence", "created_at"), t.aircraft())


@plan("a21_check_stats", """
SELECT c.es_reference, c.check_type, a.registration, a.msn, a.model, c.start_date, c.end_date,
  CAST(c.end_date - c.start_date AS INT) AS duration_days, count(d.id) AS documents,
  count(d.id) FILTER (WHERE d.doc_type = 'Jobcard') AS jobcards,
  count(d.id) FILTER (WHERE d.doc_type = 'Work Order') AS work_orders,
  count(d.id) FILTER (WHERE d.doc_type = 'Defect Report') AS defects
FROM cat_checks c LEFT JOIN cat_aircraft a ON a.id = c.aircraft_id LEFT JOIN cat_documents d ON d.check_id = c.id
GROUP BY c.id, c.es_reference, c.check_type, a.registration, a.msn, a.model, c.start_date, c.end_date""")
def a21(t: Tables) -> DataFrame:
    return agg.check_stats(
        t.checks(), t.aircraft(), t.documents("check_id", "doc_type"))


@plan("a22_type_by_category", """
SELECT category, doc_type, count(*) AS count FROM cat_documents GROUP BY category, doc_type""")
def a22(t: Tables) -> DataFrame:
    return agg.type_by_category(t.documents("category", "doc_type"))


@plan("a23_quality_by_type", """
SELECT *, avg_ocr < 60 AS weak_ocr, avg_classifier < 0.5 AS weak_classifier FROM (
  SELECT doc_type, count(*) AS count, RND[MEAN[ocr_confidence];1] AS avg_ocr,
    RND[MEAN[classifier_confidence];2] AS avg_classifier
  FROM cat_documents GROUP BY doc_type)""")
def a23(t: Tables) -> DataFrame:
    return agg.quality_by_type(t.documents(
        "doc_type", "ocr_confidence", "classifier_confidence"))


@plan("a24_global_flags", """
SELECT count(*) FILTER (WHERE needs_review) AS needs_review, count(*) FILTER (WHERE is_critical) AS is_critical,
  count(*) FILTER (WHERE manually_corrected) AS manually_corrected FROM cat_documents""")
def a24(t: Tables) -> DataFrame:
    return agg.global_flags(t.documents(
        "needs_review", "is_critical", "manually_corrected"))


_OCR_SUMMARY = """
SELECT count(*) AS documents, RND[MEAN[ocr_confidence];1] AS mean, RND[median(ocr_confidence);2] AS median,
  min(ocr_confidence) AS min, max(ocr_confidence) AS max,
  count(*) FILTER (WHERE ocr_confidence >= 80) AS good,
  count(*) FILTER (WHERE ocr_confidence >= 60 AND ocr_confidence < 80) AS mid,
  count(*) FILTER (WHERE ocr_confidence < 60) AS low,
  RND[count(*) FILTER (WHERE ocr_confidence >= 80) / CAST(count(*) AS DOUBLE) * 100;0] AS good_pct,
  RND[count(*) FILTER (WHERE ocr_confidence >= 60 AND ocr_confidence < 80) / CAST(count(*) AS DOUBLE) * 100;0] AS mid_pct,
  RND[count(*) FILTER (WHERE ocr_confidence < 60) / CAST(count(*) AS DOUBLE) * 100;0] AS low_pct
FROM %s WHERE ocr_confidence <> 0"""


@plan("a25_ocr_summary", _OCR_SUMMARY % "cat_documents")
def a25(t: Tables) -> DataFrame:
    return agg.ocr_summary(t.documents("ocr_confidence"))


@plan("a25_ocr_summary_wide", _OCR_SUMMARY % "cat_wide")
def a25_wide(t: Tables) -> DataFrame:
    return agg.ocr_summary(t.wide())


@plan("a26_engine_distribution", """
SELECT coalesce(ocr_engine, 'inconnu') AS value, count(*) AS count FROM cat_documents GROUP BY 1""")
def a26_engine(t: Tables) -> DataFrame:
    return agg.value_distribution(t.documents("ocr_engine"), "ocr_engine", "inconnu")


@plan("a26_type_distribution", """
SELECT coalesce(doc_type, 'inconnu') AS value, count(*) AS count FROM cat_documents GROUP BY 1""")
def a26_type(t: Tables) -> DataFrame:
    return agg.value_distribution(t.documents("doc_type"), "doc_type", "inconnu")


@plan("a27_discovery_report", """
WITH f AS (SELECT coalesce(aircraft_registration, '?') AS a, coalesce(category, '?') AS c, file_size_kb FROM cat_documents)
SELECT 'total' AS level, 'all' AS key, count(*) AS files, RND[TOTAL[file_size_kb] / 1024;1] AS mb FROM f
UNION ALL SELECT 'aircraft', a, count(*), RND[TOTAL[file_size_kb] / 1024;1] FROM f GROUP BY a
UNION ALL SELECT 'category', c, count(*), RND[TOTAL[file_size_kb] / 1024;1] FROM f GROUP BY c""")
def a27(t: Tables) -> DataFrame:
    return agg.discovery_report(t.documents(
        "aircraft_registration", "category", "file_size_kb"))


@plan("a28_archive_tree", """
WITH d AS (SELECT aircraft_registration AS aircraft, coalesce(category, 'Sans categorie') AS category,
  coalesce(doc_type, 'Autre') AS doc_type FROM cat_documents WHERE aircraft_registration IS NOT NULL)
SELECT 1 AS level, aircraft, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS doc_type, count(*) AS count
FROM d GROUP BY aircraft
UNION ALL SELECT 2, aircraft, category, NULL, count(*) FROM d GROUP BY aircraft, category
UNION ALL SELECT 3, aircraft, category, doc_type, count(*) FROM d GROUP BY aircraft, category, doc_type""")
def a28(t: Tables) -> DataFrame:
    return agg.archive_tree(t.documents("aircraft_registration", "category", "doc_type"))


@plan("a28_archive_tree_documents", """
SELECT aircraft_registration AS aircraft, coalesce(category, 'Sans categorie') AS category,
  coalesce(doc_type, 'Autre') AS doc_type, id, filename, es_reference,
  RND[nullif(ocr_confidence, 0);1] AS ocr_confidence, needs_review, is_critical
FROM cat_text WHERE aircraft_registration IS NOT NULL""")
def a28_documents(t: Tables) -> DataFrame:
    return agg.archive_tree_documents(t.documents(
        "aircraft_registration", "category", "doc_type", "id", "filename",
        "es_reference", "ocr_confidence", "needs_review", "is_critical"))


@plan("a29_path_tree", """
WITH p AS (SELECT string_split(path, '/') AS parts FROM cat_files),
e AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p)
SELECT array_to_string(parts[1:depth], '/') AS node,
  CASE WHEN depth = 1 THEN '' ELSE array_to_string(parts[1:depth - 1], '/') END AS parent,
  depth, CASE WHEN depth < len(parts) THEN 'folder' ELSE 'file' END AS kind, count(*) AS files
FROM e GROUP BY ALL""")
def a29(t: Tables) -> DataFrame:
    return agg.path_tree(t.files("path"))


@plan("a30_checks_by_letter", """
WITH k AS (SELECT id, aircraft_registration AS aircraft, category,
    regexp_replace(upper(coalesce(es_reference, '')), '^ES', '') AS ref FROM cat_documents),
f AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY aircraft NULLS FIRST, id) AS rn FROM k WHERE ref <> ''),
l AS (SELECT aircraft, CASE WHEN upper(category) LIKE 'CHECK A' THEN 'A' WHEN upper(category) LIKE 'CHECK C' THEN 'C'
    WHEN upper(category) LIKE 'CHECK D' THEN 'D' WHEN right(upper(category), 1) IN ('A','C','D') THEN right(upper(category), 1)
    ELSE '?' END AS letter FROM f WHERE rn = 1)
SELECT letter, aircraft, count(*) AS checks FROM l GROUP BY letter, aircraft""")
def a30(t: Tables) -> DataFrame:
    return agg.checks_by_letter(t.documents(
        "id", "aircraft_registration", "es_reference", "category").select(
        "id", F.col("aircraft_registration").alias("aircraft"), "es_reference",
        F.col("category").alias("check_type")))


@plan("a31_fleet_summary", """
WITH c AS (SELECT a.aircraft_type, a.registration, count(d.id) AS doc_count FROM cat_aircraft a
  LEFT JOIN cat_documents d ON upper(d.aircraft_registration) = upper(a.registration)
  GROUP BY a.aircraft_type, a.registration)
SELECT count(*) FILTER (WHERE aircraft_type = 'NEO') AS neo, count(*) FILTER (WHERE aircraft_type = 'CEO') AS ceo,
  count(*) FILTER (WHERE doc_count > 0) AS with_documents, CAST(sum(doc_count) AS BIGINT) AS total_documents FROM c""")
def a31(t: Tables) -> DataFrame:
    return agg.fleet_summary(
        aircraft_with_counts(t.aircraft(), t.documents("aircraft_registration")))


@plan("a32_type_share", """
SELECT doc_type, count(*) AS count,
  RND[count(*) / CAST((SELECT count(*) FROM cat_documents) AS DOUBLE) * 100;1] AS share_pct,
  RND[count(*) FILTER (WHERE is_critical) / CAST(count(*) AS DOUBLE) * 100;1] AS critical_pct
FROM cat_documents GROUP BY doc_type""")
def a32(t: Tables) -> DataFrame:
    return agg.type_share(t.documents("doc_type", "is_critical"))


@plan("a33_import_summary", """
SELECT run, aircraft, count(*) AS found, count(*) FILTER (WHERE status = 'imported') AS imported,
  count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'error') AS errors,
  RND[TOTAL[duration_s];1] AS elapsed_s,
  coalesce(RND[count(*) FILTER (WHERE status = 'imported') / nullif(TOTAL[duration_s], 0);2], 0) AS throughput
FROM cat_import_log GROUP BY run, aircraft""")
def a33(t: Tables) -> DataFrame:
    return agg.import_summary(t.import_log())


@plan("a34_label_counts", """
SELECT category AS label, count(*) AS count FROM cat_wide GROUP BY category HAVING count(*) >= 5""")
def a34(t: Tables) -> DataFrame:
    return agg.label_counts(t.wide(), "category", at_least=5)


@plan("a35_entity_fill_report", " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f} <> '') AS filled, "
    f"count(*) FILTER (WHERE coalesce({f}, '') = '') AS empty FROM cat_text"
    for f in ENTITY_FIELDS))
def a35(t: Tables) -> DataFrame:
    return agg.entity_fill_report(t.documents(*ENTITY_FIELDS), ENTITY_FIELDS)


@plan("a35_entity_fill_per_document", "SELECT id, " + " + ".join(
    f"CAST(coalesce({f}, '') <> '' AS INT)" for f in ENTITY_FIELDS)
    + " AS filled, " + " + ".join(
    f"CAST(coalesce({f}, '') = '' AS INT)" for f in ENTITY_FIELDS)
    + " AS empty FROM cat_text")
def a35_documents(t: Tables) -> DataFrame:
    return agg.entity_fill_per_document(
        t.documents("id", *ENTITY_FIELDS), ENTITY_FIELDS)


_RULE_SQL = {
    "ata_chapter": "\\d{2}(-\\d{2,4})?", "serial_number": "[A-Z0-9\\-]{3,20}",
    "es_reference": "(ES\\d{6,8}|\\d{6,8})", "part_number": "[A-Z0-9\\-]{4,20}",
    "sb_ad_reference": "(\\d{2}-\\d{2,5}-\\d{2,6}|(?:SB|AD)[-\\s]?\\w+)",
    "work_order_number": "[A-Z0-9\\-]{3,20}"}


@plan("a36_validation_report", " UNION ALL ".join(
    f"SELECT '{f}' AS field, "
    f"count(*) FILTER (WHERE {f} <> '' AND regexp_full_match(trim({f}), '{r}')) AS valid, "
    f"count(*) FILTER (WHERE {f} <> '' AND NOT regexp_full_match(trim({f}), '{r}')) AS suspect, "
    f"count(*) FILTER (WHERE coalesce({f}, '') = '') AS empty FROM cat_text"
    for f, r in _RULE_SQL.items()))
def a36(t: Tables) -> DataFrame:
    return agg.validation_report(t.documents(*_RULE_SQL), list(_RULE_SQL))


@plan("a37_fleet_msn_report", """
SELECT a.registration, coalesce(nullif(a.msn, ''), 'MANQUANT') AS msn, count(d.id) AS documents
FROM cat_aircraft a LEFT JOIN cat_documents d ON d.aircraft_registration = a.registration
GROUP BY a.registration, a.msn""")
def a37(t: Tables) -> DataFrame:
    return agg.fleet_msn_report(t.aircraft(), t.documents("aircraft_registration"))


@plan("a38_uploads_by_day", """
SELECT CAST(coalesce(created_at, archived_at) AS DATE) AS day, count(*) AS uploads FROM cat_documents GROUP BY 1""")
def a38(t: Tables) -> DataFrame:
    return agg.uploads_by_day(t.documents("created_at", "archived_at"))


@plan("a39_relabel_impact", """
SELECT count(*) FILTER (WHERE rel_path ILIKE '%EAD%') AS ead_to_ad,
  count(*) FILTER (WHERE rel_path ILIKE '%ADSB%') AS adsb_to_sb,
  count(*) FILTER (WHERE rel_path ILIKE '%SB%' AND rel_path NOT ILIKE '%ADSB%' AND rel_path NOT ILIKE '%EAD%') AS sb_to_sb
FROM (SELECT 'SB' || lang || source || filename AS rel_path, category FROM cat_text
  WHERE category IN ('Check A', 'Check C', 'Check D'))""")
def a39(t: Tables) -> DataFrame:
    docs = t.documents("category", "lang", "source", "filename").select(
        "category", F.lit("SPECS").alias("doc_type"),
        F.concat(F.lit("SB"), "lang", "source", "filename").alias("filename"))
    return agg.relabel_impact(docs)


@plan("a40_low_confidence_counts", """
WITH d AS (SELECT doc_type, coalesce(aircraft_registration, 'INCONNU') AS a, coalesce(ocr_confidence, 0) < 60 AS low FROM cat_documents)
SELECT 'type' AS level, doc_type AS key, count(*) AS documents, count(*) FILTER (WHERE low) AS low FROM d GROUP BY doc_type
UNION ALL SELECT 'aircraft', a, count(*), count(*) FILTER (WHERE low) FROM d GROUP BY a""")
def a40(t: Tables) -> DataFrame:
    return agg.low_confidence_counts(t.documents(
        "doc_type", "aircraft_registration", "ocr_confidence"))


@plan("a40_low_confidence_rows", """
SELECT id, ocr_confidence, doc_type, filename FROM cat_text WHERE coalesce(ocr_confidence, 0) < 60 ORDER BY id LIMIT 20""")
def a40_rows(t: Tables) -> DataFrame:
    return agg.low_confidence_rows(t.documents(
        "id", "ocr_confidence", "doc_type", "filename"))


@plan("a41_view_row_counts", """
SELECT 'documents' AS view, count(*) AS rows FROM cat_documents
UNION ALL SELECT 'kpis', 1
UNION ALL SELECT 'by_type', count(DISTINCT doc_type) FROM cat_documents
UNION ALL SELECT 'by_aircraft', count(DISTINCT aircraft_registration) FROM cat_documents
UNION ALL SELECT 'monthly', count(DISTINCT date_trunc('month', archived_at)) FROM cat_documents
UNION ALL SELECT 'by_ata', count(DISTINCT ata_chapter) FROM cat_documents
UNION ALL SELECT 'checks', count(*) FROM cat_checks
UNION ALL SELECT 'alerts', count(*) FROM cat_alerts
UNION ALL SELECT 'quality', count(DISTINCT CASE WHEN ocr_confidence >= 90 THEN 4 WHEN ocr_confidence >= 70 THEN 3
  WHEN ocr_confidence >= 50 THEN 2 WHEN ocr_confidence > 0 THEN 1 ELSE 0 END) FROM cat_documents""")
def a41(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "aircraft_registration", "aircraft_id", "doc_type", "category",
        "check_id", "ata_chapter", "ocr_confidence", "is_critical", "archived_at",
        "file_size_kb", "status")
    fleet = t.aircraft()
    return agg.row_counts({
        "documents": docs,
        "kpis": a01(t),
        "by_type": docs.groupBy("doc_type").count(),
        "by_aircraft": agg.by_aircraft(docs, fleet),
        "monthly": agg.monthly_archive(docs),
        "by_ata": agg.by_ata(docs),
        "checks": agg.check_stats(t.checks(), fleet, docs),
        "alerts": t.alerts(),
        "quality": agg.quality_bands(docs)})

