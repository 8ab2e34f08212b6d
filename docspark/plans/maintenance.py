"""Catalogue corrections (C) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.operators import maintenance as fix
from docspark.plans.functions import MSN_SQL, _q
from docspark.plans.joins import REGISTRATION_FROM_MSN_SQL, _LINKED_SQL
from docspark.plans.registry import plan
from docspark.sources.bindings import Tables


@plan("c01_apply_patches", """
SELECT d.id, CASE WHEN l.toxic = 1 THEN 'AD' ELSE d.doc_type END AS doc_type, CASE WHEN l.quality = 0 THEN 'Old doc' ELSE d.category END AS category,
  l.doc_id IS NOT NULL OR d.manually_corrected AS manually_corrected FROM cat_documents d LEFT JOIN labels l ON l.doc_id = d.id""")
def c01(t: Tables) -> DataFrame:
    patches = t.raw("labels").select(
        F.col("doc_id").alias("id"), F.expr("CASE WHEN toxic = 1 THEN 'AD' END").alias("doc_type"),
        F.expr("CASE WHEN quality = 0 THEN 'Old doc' END").alias("category"))
    return fix.apply_patches(
        t.documents("id", "doc_type", "category", "manually_corrected"), patches,
        ["doc_type", "category"])


@plan("c02_resolve_alerts", """
SELECT id, severity, resolved OR severity = 'info' AS resolved,
  CASE WHEN severity = 'info' THEN TIMESTAMP '2024-02-01 00:00:00' END AS resolved_at FROM cat_alerts""")
def c02(t: Tables) -> DataFrame:
    alerts = t.alerts().select("id", "severity", "resolved")
    return fix.resolve_alerts(
        alerts, alerts.filter("severity = 'info'"),
        F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


def _named(t: Tables) -> DataFrame:
    """Specs in check folders with telling names."""
    return t.documents("id", "category", "lang", "filename", "manually_corrected").select(
        "id", F.expr("CASE WHEN lang = 'en' THEN 'SPECS' ELSE 'Jobcard' END").alias("doc_type"),
        "category", F.expr("""CASE id % 5 WHEN 0 THEN 'x_ead_' WHEN 1 THEN 'EADSB' WHEN 2
            THEN 'q_adsb_' WHEN 3 THEN 'SB' ELSE 'p_SB' END || filename""").alias("filename"),
        "manually_corrected")


@plan("c03_relabel_check_specs", """
WITH d AS (SELECT id, CASE WHEN lang = 'en' THEN 'SPECS' ELSE 'Jobcard' END AS doc_type, category,
  CASE id % 5 WHEN 0 THEN 'x_ead_' WHEN 1 THEN 'EADSB' WHEN 2 THEN 'q_adsb_' WHEN 3 THEN 'SB' ELSE 'p_SB' END || filename AS filename, manually_corrected AS mc FROM cat_text),
a AS (SELECT *, CASE WHEN category IN ('Check A','Check C','Check D') AND doc_type = 'SPECS' AND filename ILIKE '%EAD%' THEN 'AD' ELSE doc_type END AS t1 FROM d),
b AS (SELECT *, CASE WHEN category IN ('Check A','Check C','Check D') AND t1 = 'SPECS' AND filename ILIKE '%ADSB%' THEN 'SB' ELSE t1 END AS t2 FROM a),
c AS (SELECT *, CASE WHEN category IN ('Check A','Check C','Check D') AND t2 = 'SPECS' AND filename ILIKE 'SB%' THEN 'SB' ELSE t2 END AS t3 FROM b)
SELECT id, t3 AS doc_type, category, filename, mc OR t3 <> doc_type AS manually_corrected FROM c""")
def c03(t: Tables) -> DataFrame:
    return fix.relabel_check_specs(_named(t))


def _phrases(words) -> str:
    return " OR ".join(f"contains(upper(filename), {_q(w.upper())})" for w in words)


_AD_NAMES = """CASE id % 4 WHEN 0 THEN 'EASA Form ' WHEN 1 THEN 'Weight Report ' WHEN 2 THEN 'etops ' ELSE '' END || filename"""


@plan("c04_relabel_false_ads", f"""
WITH d AS (SELECT id, doc_type, category, {_AD_NAMES} AS filename, classifier_confidence, manually_corrected FROM cat_text),
k AS (SELECT *, CASE WHEN NOT (doc_type = 'AD' AND classifier_confidence < 0.36) THEN 'untouched' WHEN {_phrases(fv.CERTIFICATE_PHRASES)} THEN 'certificate'
  WHEN {_phrases(fv.SPECS_PHRASES)} THEN 'specs' ELSE 'manual' END AS decision FROM d)
SELECT id, CASE decision WHEN 'certificate' THEN 'Certificate' WHEN 'specs' THEN 'Specs' ELSE doc_type END AS doc_type,
  CASE decision WHEN 'certificate' THEN 'Certificates' WHEN 'specs' THEN 'Specs' ELSE category END AS category,
  manually_corrected OR decision IN ('certificate', 'specs') AS manually_corrected, decision FROM k""")
def c04(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "doc_type", "category", "filename", "classifier_confidence",
        "manually_corrected").withColumn("filename", F.expr(
            "CASE id % 4 WHEN 0 THEN 'EASA Form ' WHEN 1 THEN 'Weight Report ' "
            "WHEN 2 THEN 'etops ' ELSE '' END || filename"))
    return fix.relabel_false_ads(docs).drop("filename", "classifier_confidence")


@plan("c04_fix_registrations", """
SELECT id, 'aircraft_registration' AS field, aircraft_registration AS old, 'TS-INP' AS new, 'path_confirms' AS rule
FROM cat_text WHERE aircraft_registration = 'TS-INC' AND lang = 'en'""")
def c04_registrations(t: Tables) -> DataFrame:
    docs = t.text("id", "aircraft_registration", "rel_path", "lang").withColumn(
        "rel_path", F.when(F.col("lang") == "en", F.concat(
            F.lit("ts-inp/"), "rel_path")).otherwise(F.col("rel_path")))
    return fix.fix_registrations(docs, fv.REGISTRATION_FIXES)


@plan("c05_relabel_by_pattern", """
WITH d AS (SELECT id, doc_type, category, manually_corrected, CASE lang WHEN 'fr' THEN 'x D&B y Chart ' WHEN 'de' THEN '0.' WHEN 'es' THEN 'chart_R0' ELSE '' END || filename AS filename FROM cat_text),
k AS (SELECT *, filename ILIKE '%d&b%chart%' OR filename ILIKE '%dent%buckle%' OR filename ILIKE '%chart_r0%' AS chart, filename LIKE '0%.%.pdf' AS engine FROM d)
SELECT id, CASE WHEN chart THEN 'D&B Chart' WHEN engine THEN 'Specs' ELSE doc_type END AS doc_type,
  CASE WHEN chart THEN 'Structural_Repair' WHEN engine THEN 'Engine File' ELSE category END AS category,
  manually_corrected OR chart OR engine AS manually_corrected FROM k""")
def c05(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "doc_type", "category", "manually_corrected", "filename", "lang").withColumn(
        "filename", F.expr("""CASE lang WHEN 'fr' THEN 'x D&B y Chart ' WHEN 'de' THEN '0.'
            WHEN 'es' THEN 'chart_R0' ELSE '' END || filename""")).drop("lang")
    return fix.relabel_by_pattern(docs).drop("filename")


@plan("c06_reassign_registration", """
SELECT id, CASE WHEN aircraft_registration = 'TS-INO' THEN 'TS-INQ' ELSE aircraft_registration END AS aircraft_registration,
  CASE WHEN aircraft_registration = 'TS-INO' THEN 16 ELSE aircraft_id END AS aircraft_id FROM cat_documents""")
def c06(t: Tables) -> DataFrame:
    return fix.reassign_registration(
        t.documents("id", "aircraft_registration", "aircraft_id"), t.aircraft(),
        "TS-INO", "TS-INQ")


@plan("c07_autodetect_msn", f"""
WITH m AS (SELECT registration FROM cat_aircraft WHERE aircraft_type = 'CEO'),
v AS (SELECT aircraft_registration AS registration, {MSN_SQL} AS msn FROM cat_text),
k AS (SELECT registration, msn, count(*) AS votes, row_number() OVER (PARTITION BY registration ORDER BY count(*) DESC, msn) AS rn
  FROM v WHERE msn IS NOT NULL GROUP BY 1, 2)
SELECT m.registration, k.msn AS detected_msn, k.votes, CASE WHEN k.msn IS NULL THEN 'none'
  WHEN (m.registration = 'TS-INP' AND k.msn <> '2158') OR (m.registration = 'TS-INQ' AND k.msn <> '3012') THEN 'conflict' ELSE 'updated' END AS result
FROM m LEFT JOIN k ON k.registration = m.registration AND k.rn = 1""")
def c07(t: Tables) -> DataFrame:
    fleet = t.aircraft().filter("aircraft_type = 'CEO'").withColumn(
        "msn", F.lit(None).cast("string"))
    docs = t.text("aircraft_registration", "extracted_entities", "ocr_text")
    return fix.autodetect_msn(fleet, docs, fv.KNOWN_MSN)


_RE_EXTRACT = REGISTRATION_FROM_MSN_SQL.replace("FROM cat_text)", "FROM waiting)")


@plan("c08_re_extract_registration", f"""
WITH waiting AS (SELECT id, filename, ocr_text || ' ' || rel_path AS ocr_text FROM cat_text WHERE needs_review AND contains(validation_warnings, 'immatriculation')),
f AS ({_RE_EXTRACT})
SELECT f.id, coalesce(f.registration, d.aircraft_registration) AS aircraft_registration, f.method, f.registration IS NULL AS needs_review,
  CASE WHEN f.registration IS NULL THEN d.validation_warnings ELSE '[]' END AS validation_warnings FROM f JOIN cat_text d ON d.id = f.id""")
def c08(t: Tables) -> DataFrame:
    return fix.re_extract_registration(t.text(
        "id", "filename", "rel_path", "ocr_text", "aircraft_registration",
        "needs_review", "validation_warnings"))


@plan("c09_linked_wp_repair", "WITH " + _LINKED_SQL.strip() + """,
o AS (SELECT id, category FROM cat_text WHERE doc_type = 'Work Order' AND status = 'ARCHIVED' AND ocr_text ILIKE '%linked%wp%'),
c AS (SELECT r.id, r.ref, r.pos, d.category, row_number() OVER (PARTITION BY r.id, r.ref ORDER BY d.id) AS rn
  FROM r JOIN cat_documents d ON d.es_reference ILIKE '%' || r.num || '%'
  WHERE d.doc_type = 'Work Order' AND d.category IN ('Check A', 'Check B', 'Check C', 'Check D')),
f AS (SELECT id, arg_min(category, pos) AS cat FROM c WHERE rn = 1 GROUP BY id)
SELECT o.id, o.category AS old_category, f.cat AS new_category, CASE WHEN f.cat IS NULL THEN 'SKIP' WHEN f.cat = o.category THEN 'OK' ELSE 'FIX' END AS state
FROM o LEFT JOIN f ON f.id = o.id""")
def c09(t: Tables) -> DataFrame:
    return fix.linked_wp_repair(t.text(
        "id", "doc_type", "status", "category", "es_reference", "ocr_text"))


ALERTS_SQL = """
SELECT id AS document_id, aircraft_registration, 'OCR faible confiance — ' || filename AS title,
  'Confiance OCR: ' || printf('%.1f', ocr_confidence) || '%. Vérification manuelle recommandée.' AS message, 'warning' AS severity, 'ocr_low_confidence' AS alert_type
FROM cat_text WHERE ocr_confidence > 0 AND ocr_confidence < 50
UNION ALL SELECT id, aircraft_registration, 'Document sans immatriculation — ' || filename,
  '''' || filename || ''' n''a pas d''immatriculation reconnue. Placé dans En_Attente/. Vérification manuelle requise.', 'warning', 'ocr_low_confidence'
FROM cat_text WHERE aircraft_registration IS NULL AND lang <> 'en'"""


@plan("c10_generate_alerts", ALERTS_SQL)
def c10(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "aircraft_registration", "filename", "ocr_confidence", "lang")
    return fix.generate_alerts(
        docs.withColumn("file_present", F.col("lang") == "en"))


@plan("c11_purge_report", """
SELECT 'before' AS phase, 'alerts' AS "table", count(*) AS rows FROM cat_alerts UNION ALL SELECT 'before', 'aircraft', count(*) FROM cat_aircraft
UNION ALL SELECT 'after', 'alerts', 0 UNION ALL SELECT 'after', 'aircraft', 2""")
def c11(t: Tables) -> DataFrame:
    alerts, fleet = t.alerts(), t.aircraft()
    return fix.purge_report(
        {"alerts": alerts, "aircraft": fleet},
        {"alerts": alerts.filter("false"),
         "aircraft": fix.purge_fleet(fleet, fv.KEPT_AIRCRAFT)})


@plan("c12_patch_aircraft", """
SELECT id, registration, CASE WHEN aircraft_type = 'NEO' THEN NULL ELSE msn END AS msn,
  CASE WHEN aircraft_type = 'NEO' THEN 'patched' ELSE lessor END AS lessor,
  CASE WHEN aircraft_type = 'NEO' THEN DATE '2020-05-17' END AS delivery_date FROM cat_aircraft""")
def c12(t: Tables) -> DataFrame:
    fleet = t.aircraft().select(
        "id", "registration", "msn", "lessor", F.lit(None).cast("date").alias("delivery_date"),
        "aircraft_type")
    patches = fleet.filter("aircraft_type = 'NEO'").select("id", F.expr("""inline(array(
        named_struct('field', 'msn', 'value', ''),
        named_struct('field', 'lessor', 'value', 'patched'),
        named_struct('field', 'delivery_date', 'value', '2020-05-17'),
        named_struct('field', 'registration', 'value', 'XX')))"""))
    return fix.patch_aircraft(fleet.drop("aircraft_type"), patches)
