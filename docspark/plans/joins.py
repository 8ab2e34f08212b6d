"""Join queries (J) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.registration import registration_from_msn
from docspark.operators import joins
from docspark.operators.duplicates import exact_duplicates, with_content_hash
from docspark.plans.registry import plan
from docspark.sources.bindings import Tables


@plan("j01_document_facts", """
SELECT d.id, d.filename, d.doc_type, d.category, d.ata_chapter, d.status, d.aircraft_registration, d.es_reference,
  d.item_number, d.part_number, d.serial_number, d.ocr_confidence, d.ocr_engine, d.classifier_confidence,
  d.file_size_kb, d.is_critical, d.needs_review, CAST(d.archived_at AS DATE) AS archive_date,
  CAST(date_trunc('month', d.archived_at) AS DATE) AS archive_month,
  CAST(date_trunc('week', d.archived_at) AS DATE) AS archive_week,
  CAST(year(d.archived_at) AS INT) AS year, CAST(month(d.archived_at) AS INT) AS month,
  a.model, a.msn, c.es_reference AS check_es, c.check_type
FROM cat_text d LEFT JOIN cat_aircraft a ON a.id = d.aircraft_id LEFT JOIN cat_checks c ON c.id = d.check_id""")
def j01(t: Tables) -> DataFrame:
    return joins.document_facts(t.documents(
        "id", "filename", "doc_type", "category", "ata_chapter", "status",
        "aircraft_registration", "es_reference", "item_number", "part_number",
        "serial_number", "ocr_confidence", "ocr_engine", "classifier_confidence",
        "file_size_kb", "is_critical", "needs_review", "archived_at",
        "aircraft_id", "check_id"), t.aircraft(), t.checks())


@plan("j02_document_summary", """
SELECT d.id, d.filename, d.doc_type, d.category, d.aircraft_registration, d.es_reference, d.ata_chapter,
  d.ocr_confidence, d.classifier_confidence, d.status, d.is_critical, d.created_at,
  a.model AS aircraft_model, a.msn AS aircraft_msn, c.check_type
FROM cat_text d LEFT JOIN cat_aircraft a ON a.id = d.aircraft_id LEFT JOIN cat_checks c ON c.id = d.check_id""")
def j02(t: Tables) -> DataFrame:
    return joins.document_summary(t.documents(
        "id", "filename", "doc_type", "category", "aircraft_registration",
        "es_reference", "ata_chapter", "ocr_confidence", "classifier_confidence",
        "status", "is_critical", "created_at", "aircraft_id", "check_id"),
        t.aircraft(), t.checks())


@plan("j03_aircraft_with_counts", """
SELECT a.id, a.registration, a.model, a.msn, coalesce(a.aircraft_type, 'CEO') AS aircraft_type, a.lessor,
  (SELECT count(*) FROM cat_documents d WHERE d.aircraft_registration ILIKE a.registration) AS doc_count
FROM cat_aircraft a""")
def j03(t: Tables) -> DataFrame:
    return joins.aircraft_with_counts(
        t.aircraft(), t.documents("aircraft_registration"))


@plan("j03_aircraft_with_counts_wide", """
SELECT a.id, a.registration, a.model, a.msn, coalesce(a.aircraft_type, 'CEO') AS aircraft_type, a.lessor, count(d.id) AS doc_count
FROM cat_aircraft a LEFT JOIN cat_wide d ON upper(d.aircraft_registration) = upper(a.registration)
GROUP BY ALL""")
def j03_wide(t: Tables) -> DataFrame:
    return joins.aircraft_with_counts(t.aircraft(), t.wide())


@plan("j04_check_document_counts", """
SELECT c.id, a.registration, c.es_reference, c.check_type, c.start_date, count(*) AS documents
FROM cat_checks c JOIN cat_aircraft a ON a.id = c.aircraft_id
JOIN cat_documents d ON d.aircraft_registration = a.registration
  AND d.es_reference ILIKE '%' || regexp_replace(upper(c.es_reference), '^ES', '') || '%'
GROUP BY ALL""")
def j04(t: Tables) -> DataFrame:
    return joins.check_document_counts(
        t.checks(), t.aircraft(), t.documents("aircraft_registration", "es_reference"))


@plan("j05_resolve_aircraft", """
WITH u AS (SELECT id, regexp_replace(upper(trim(es_reference)), '^ES', '') AS own,
    regexp_replace(nullif(regexp_extract(upper(filename), '(ES\\d{4,8})', 1), ''), '^ES', '') AS named
  FROM cat_text WHERE aircraft_registration IS NULL),
n AS (SELECT DISTINCT num FROM (SELECT own AS num FROM u UNION ALL SELECT named FROM u) WHERE num <> ''),
v AS (SELECT n.num, d.aircraft_registration AS reg, count(*) AS votes FROM n JOIN cat_documents d
  ON d.es_reference ILIKE '%' || n.num || '%' WHERE d.aircraft_registration <> '' GROUP BY 1, 2),
b AS (SELECT num, reg, votes FROM (SELECT *, row_number() OVER (PARTITION BY num ORDER BY votes DESC, reg) AS rn FROM v) WHERE rn = 1)
SELECT u.id, coalesce(o.reg, f.reg) AS aircraft_registration, coalesce(o.votes, f.votes) AS votes,
  CASE WHEN o.reg IS NOT NULL THEN 'reference' WHEN f.reg IS NOT NULL THEN 'filename' END AS method
FROM u LEFT JOIN b o ON o.num = u.own LEFT JOIN b f ON f.num = u.named""")
def j05(t: Tables) -> DataFrame:
    docs = t.documents("id", "es_reference", "filename", "aircraft_registration")
    return joins.resolve_aircraft(
        docs.filter(F.col("aircraft_registration").isNull()), docs)


_LINKED_SQL = """
w AS (SELECT id, text_refs.ref, text_refs.pos FROM (
    SELECT id, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM (
      SELECT id, list_distinct_ordered AS refs FROM (
        SELECT id, list_transform(CASE WHEN len(a) > 0 THEN a ELSE b END, lambda x: replace(x, ' ', '')) AS list_distinct_ordered FROM (
          SELECT id,
            regexp_extract_all(array_to_string(regexp_extract_all(ocr_text, '(?i)(?:linked\\s+wp|wp\\s+linked)\\s*[:\\-]?\\s*((?:ES\\s*\\d{4,8}\\s*[/,]?\\s*)+)', 1), '|'), '(?i)ES\\s*\\d{4,8}') AS a,
            regexp_extract_all(ocr_text, '(?i)(?:linked|wp)\\s+.*?(ES\\s*\\d{4,8})', 1) AS b
          FROM cat_text)))) text_refs),
r AS (SELECT id, ref, min(pos) AS pos,
  CASE WHEN ltrim(regexp_replace(ref, '(?i)^ES\\s*', ''), '0') = '' THEN '0' ELSE ltrim(regexp_replace(ref, '(?i)^ES\\s*', ''), '0') END AS num
  FROM w GROUP BY id, ref)"""


@plan("j06_resolve_linked_wp", "WITH " + _LINKED_SQL + """,
c AS (SELECT r.id, r.ref, r.pos, d.category, row_number() OVER (PARTITION BY r.id, r.ref ORDER BY d.id) AS rn
  FROM r JOIN cat_documents d ON d.es_reference ILIKE '%' || r.num || '%'
  WHERE d.doc_type = 'Work Order' AND d.category IN ('Check A', 'Check B', 'Check C', 'Check D')),
f AS (SELECT id, ref, category, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM c WHERE rn = 1)
SELECT id, category AS linked_category, ref AS linked_ref FROM f WHERE k = 1""")
def j06(t: Tables) -> DataFrame:
    return joins.resolve_linked_wp(
        t.text("id", "ocr_text"),
        t.documents("id", "doc_type", "category", "es_reference"))


_RCT_SQL = """
x AS (SELECT id, filename, aircraft_registration AS reg,
    coalesce(nullif(regexp_extract(upper(filename), '(TS-[A-Z]{3})_CHECK\\s*([ABCD])_([A-Z]{0,2}\\d{4,8})_RCT', 3), ''),
      nullif(regexp_extract(upper(ocr_text), 'WORK\\s*PACKAGE\\s*REF\\s*[:\\s]+([A-Z]{0,2}\\d{4,8})', 1), ''),
      nullif(regexp_extract(upper(ocr_text), 'W\\.?P\\.?\\s*REF\\s*[:\\s]+([A-Z]{0,2}\\d{4,8})', 1), '')) AS wp,
    coalesce(nullif(regexp_extract(upper(filename), '(TS-[A-Z]{3})_CHECK\\s*([ABCD])_([A-Z]{0,2}\\d{4,8})_RCT', 2), ''),
      nullif(regexp_extract(upper(ocr_text), '\\bCHECK\\s*([ABCD])\\b', 1), ''),
      nullif(regexp_extract(upper(ocr_text), '\\bVISITE\\s*([ABCD])\\b', 1), '')) AS letter
  FROM rct_docs),
rr AS (SELECT x.id AS rid, wp, 'Check ' || letter AS ctype, a.id AS aid, row_number() OVER (PARTITION BY wp ORDER BY x.id DESC) AS rn
  FROM x LEFT JOIN cat_aircraft a ON a.registration = x.reg
  WHERE reg IS NOT NULL AND wp IS NOT NULL AND letter IN ('A', 'C', 'D')),
r1 AS (SELECT * FROM rr WHERE rn = 1 AND aid IS NOT NULL),
cc AS (SELECT coalesce(c.es_reference, r1.wp) AS es_reference, c.id, coalesce(r1.ctype, c.check_type) AS check_type,
  coalesce(r1.aid, c.aircraft_id) AS aircraft_id, r1.rid IS NOT NULL AS confirmed_by_rct, r1.rid AS rct_document_id
  FROM cat_checks c FULL JOIN r1 ON r1.wp = c.es_reference)"""
# In the given tables the records that carry a release name are job cards.
_RCT_DOCS = "rct_docs AS (SELECT * FROM cat_text WHERE doc_type IN ('RCT', 'Jobcard')),"


def _release_docs(t: Tables) -> DataFrame:
    return t.text(
        "id", "filename", "doc_type", "aircraft_registration", "ocr_text").withColumn(
        "doc_type", F.when(F.col("doc_type") == "Jobcard", "RCT").otherwise(
            F.col("doc_type")))


@plan("j07_rct_confirmed_checks", "WITH " + _RCT_DOCS + _RCT_SQL + " SELECT * FROM cc")
def j07(t: Tables) -> DataFrame:
    return joins.rct_confirmed_checks(t.checks(), t.aircraft(), _release_docs(t))


@plan("j07_rct_backfill", "WITH " + _RCT_DOCS + _RCT_SQL + """
SELECT d.id, d.es_reference, d.category AS old_category, cc.check_type AS new_category
FROM cat_documents d JOIN cc ON cc.es_reference = d.es_reference AND cc.confirmed_by_rct
WHERE d.id <> cc.rct_document_id AND d.category IS DISTINCT FROM cc.check_type""")
def j07_backfill(t: Tables) -> DataFrame:
    return joins.rct_backfill(
        t.documents("id", "es_reference", "category"), j07(t))


@plan("j08_incremental_files", """
WITH k AS (SELECT '\\\\?\\' || rel_path AS path, sha256(text) AS h FROM cat_text WHERE status = 'ARCHIVED')
SELECT id, rel_path AS path, sha256(text) AS sha256_hash FROM cat_text
WHERE '\\\\?\\' || rel_path NOT IN (SELECT path FROM k) AND sha256(text) NOT IN (SELECT h FROM k)""")
def j08(t: Tables) -> DataFrame:
    files = with_content_hash(t.text("id", "rel_path", "text", "status")).drop("text")
    known = files.filter("status = 'ARCHIVED'").select(
        F.concat(F.lit("\\\\?\\"), "rel_path").alias("path"), "sha256_hash")
    return joins.incremental_files(
        files.select("id", F.col("rel_path").alias("path"), "sha256_hash"), known)


@plan("j09_load_hits", """
SELECT id, doc_type, status FROM cat_documents WHERE id IN (SELECT document_id FROM cat_alerts)""")
def j09(t: Tables) -> DataFrame:
    return joins.load_hits(
        t.documents("id", "doc_type", "status"),
        t.alerts().select(F.col("document_id").alias("id")))


@plan("j10_exact_duplicates", """
SELECT id, sha256(text) AS sha256_hash, first AS duplicate_of FROM (
  SELECT id, text, min(id) OVER (PARTITION BY text) AS first FROM cat_documents) WHERE id > first""")
def j10(t: Tables) -> DataFrame:
    return exact_duplicates(t.documents("id", "text"))


@plan("j11_repair_paths", """
WITH disk AS (SELECT path, mtime, lower(regexp_extract(path, '[^/]*$')) AS nm,
    nullif(regexp_extract(upper(regexp_extract(path, '[^/]*$')), '(ES\\d{4,8})', 1), '') AS es FROM cat_files WHERE path LIKE '%/TS-IN%'),
m AS (SELECT id, filename, lower(filename) AS nm, nullif(regexp_extract(upper(filename), '(ES\\d{4,8})', 1), '') AS es
  FROM cat_text WHERE status = 'ERROR'),
n AS (SELECT nm, count(*) AS n, arg_max(path, (mtime, path)) AS p FROM disk GROUP BY nm),
e AS (SELECT es, count(*) AS n, arg_max(path, (mtime, path)) AS p FROM disk WHERE es IS NOT NULL GROUP BY es)
SELECT m.id, m.filename, coalesce(n.p, e.p) AS new_path,
  CASE WHEN coalesce(n.n, e.n) > 1 THEN 'multiple' WHEN coalesce(n.n, e.n) = 1 THEN 'updated' ELSE 'not_found' END AS result
FROM m LEFT JOIN n ON n.nm = m.nm LEFT JOIN e ON e.es = m.es""")
def j11(t: Tables) -> DataFrame:
    missing = t.documents("id", "filename", "status").filter(
        "status = 'ERROR'").select("id", "filename")
    disk = t.files("path", "mtime").filter(F.col("path").like("%/TS-IN%"))
    return joins.repair_paths(missing, disk)


@plan("j12_merge_scores", """
WITH f AS (SELECT id, ocr_confidence / 100 AS s FROM cat_documents WHERE needs_review),
v AS (SELECT id, classifier_confidence AS s FROM cat_documents WHERE is_critical)
SELECT coalesce(f.id, v.id) AS id, coalesce(f.s, 0) AS fts_score, coalesce(v.s, 0) AS sem_score
FROM f FULL JOIN v ON v.id = f.id""")
def j12(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "needs_review", "is_critical", "ocr_confidence", "classifier_confidence")
    return joins.merge_scores(
        docs.filter("needs_review").select(
            "id", (F.col("ocr_confidence") / 100).alias("fts_score")),
        docs.filter("is_critical").select(
            "id", F.col("classifier_confidence").alias("sem_score")))


@plan("j14_aircraft_get_or_create", """
SELECT registration, model, false AS created FROM cat_aircraft WHERE aircraft_type = 'CEO'
UNION ALL SELECT DISTINCT upper(aircraft_registration), 'A320-214', true FROM cat_documents
WHERE aircraft_registration <> '' AND upper(aircraft_registration) NOT IN (SELECT registration FROM cat_aircraft WHERE aircraft_type = 'CEO')""")
def j14(t: Tables) -> DataFrame:
    return joins.aircraft_get_or_create(
        t.documents("aircraft_registration"), t.aircraft().filter("aircraft_type = 'CEO'"))


@plan("j15_check_get_or_create", """
SELECT es_reference, check_type, aircraft_id, false AS inferred FROM cat_checks
UNION ALL SELECT es_reference, CASE WHEN upper(category) IN ('CHECK A', 'CHECK C', 'CHECK D') THEN category ELSE 'Check A' END, aid, true FROM (
  SELECT d.es_reference, d.category, a.id AS aid, row_number() OVER (PARTITION BY d.es_reference ORDER BY d.id) AS rn
  FROM cat_documents d JOIN cat_aircraft a ON a.registration = d.aircraft_registration
  WHERE d.es_reference <> '' AND d.es_reference NOT IN (SELECT es_reference FROM cat_checks)) WHERE rn = 1""")
def j15(t: Tables) -> DataFrame:
    return joins.check_get_or_create(
        t.documents("id", "es_reference", "category", "aircraft_registration"),
        t.checks(), t.aircraft())


@plan("j16_delete_documents", """
SELECT 'document' AS kind, id FROM cat_documents WHERE status <> 'ERROR'
UNION ALL SELECT 'alert', id FROM cat_alerts WHERE document_id NOT IN (SELECT id FROM cat_documents WHERE status = 'ERROR')""")
def j16(t: Tables) -> DataFrame:
    docs = t.documents("id", "status")
    kept, alerts = joins.delete_documents(
        docs, t.alerts(), docs.filter("status = 'ERROR'"))
    return kept.select(F.lit("document").alias("kind"), "id").unionByName(
        alerts.select(F.lit("alert").alias("kind"), "id"))


@plan("j17_drop_orphan_aircraft", """
SELECT id, registration FROM cat_aircraft WHERE NOT (registration IN ('TS-INO', 'TS-INB', 'TS-INY')
  AND registration NOT IN (SELECT aircraft_registration FROM cat_documents WHERE aircraft_registration <> 'TS-INO'))""")
def j17(t: Tables) -> DataFrame:
    docs = t.documents("aircraft_registration").filter(
        "aircraft_registration <> 'TS-INO'")
    return joins.drop_orphan_aircraft(
        t.aircraft(), docs, ["TS-INO", "TS-INB", "TS-INY"]).select("id", "registration")


_MSN_MAP = "CASE %s WHEN '1597' THEN 'TS-INP' WHEN '6333' THEN 'TS-INQ' WHEN '2158' THEN 'TS-INP' WHEN '3012' THEN 'TS-INQ' END"


def _direct_sql(source: str) -> str:
    return (
        f"coalesce(list_filter(list_transform(regexp_extract_all({source}, '(?i)\\bTS[\\s\\-]?IN[A-Z]\\b'), "
        "lambda x: 'TS-' || right(upper(x), 3)), lambda x: x BETWEEN 'TS-INC' AND 'TS-INU' AND x <> 'TS-INS')[1], "
        f"'TS-IN' || list_min(regexp_extract_all(upper({source}), 'TS[\\s\\-]?IN([C-RTU])', 1)))")


def _msn_sql(source: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({source}, '(?i)\\bMSN[\\s:]*([0-9]{{3,6}})\\b', 1), ''), "
        f"CASE WHEN contains({source}, '1597') THEN '1597' WHEN contains({source}, '6333') THEN '6333' "
        f"WHEN contains({source}, '2158') THEN '2158' WHEN contains({source}, '3012') THEN '3012' END)")


REGISTRATION_FROM_MSN_SQL = f"""
SELECT id, CASE WHEN direct IS NOT NULL THEN direct WHEN {_MSN_MAP % 'msn'} IS NOT NULL THEN {_MSN_MAP % 'msn'}
    WHEN contains(upper(filename), 'INP') THEN 'TS-INP' WHEN contains(upper(filename), 'INQ') THEN 'TS-INQ'
    WHEN contains(filename, '1597') THEN 'TS-INP' WHEN contains(filename, '6333') THEN 'TS-INQ'
    WHEN contains(filename, '2158') THEN 'TS-INP' WHEN contains(filename, '3012') THEN 'TS-INQ' END AS registration,
  CASE WHEN direct IS NOT NULL THEN 'direct' WHEN {_MSN_MAP % 'msn'} IS NOT NULL THEN 'msn_' || msn
    WHEN contains(upper(filename), 'INP') OR contains(upper(filename), 'INQ') THEN 'filename_context'
    WHEN contains(filename, '1597') THEN 'filename_msn_1597' WHEN contains(filename, '6333') THEN 'filename_msn_6333'
    WHEN contains(filename, '2158') THEN 'filename_msn_2158' WHEN contains(filename, '3012') THEN 'filename_msn_3012'
    ELSE 'not_found' END AS method
FROM (SELECT id, filename, coalesce({_direct_sql('ocr_text')}, {_direct_sql('filename')}) AS direct,
  coalesce({_msn_sql('ocr_text')}, {_msn_sql('filename')}) AS msn FROM cat_text)"""


@plan("j18_registration_from_msn", REGISTRATION_FROM_MSN_SQL)
def j18(t: Tables) -> DataFrame:
    return t.text("id", "filename", "ocr_text").select(
        "id", registration_from_msn("ocr_text", "filename").alias("r")).select(
        "id", "r.registration", "r.method")
