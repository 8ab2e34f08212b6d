"""Order-dependent queries (W) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators import windows as win
from docspark.operators.duplicates import best_copies, copies_to_delete
from docspark.operators.joins import linked_references
from docspark.operators.aggregates import distinct_checks
from docspark.operators.scale import majority_value
from docspark.plans.joins import _LINKED_SQL
from docspark.plans.registry import plan
from docspark.sources.bindings import Tables


@plan("w01_majority_value", """
SELECT es_reference, aircraft_registration, votes FROM (
  SELECT es_reference, aircraft_registration, count(*) AS votes,
    row_number() OVER (PARTITION BY es_reference ORDER BY count(*) DESC, aircraft_registration) AS rn
  FROM cat_documents WHERE es_reference IS NOT NULL AND aircraft_registration IS NOT NULL
  GROUP BY es_reference, aircraft_registration) WHERE rn = 1""")
def w01(t: Tables) -> DataFrame:
    rows = t.documents("es_reference", "aircraft_registration").dropna()
    return majority_value(rows, ["es_reference"], "aircraft_registration")


@plan("w02_first_by_priority", "WITH " + _LINKED_SQL + """
SELECT id, ref AS reference FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM r) WHERE rn = 1""")
def w02(t: Tables) -> DataFrame:
    refs = linked_references(t.text("id", "ocr_text"))
    return win.first_non_null_by_priority(refs, "id", "pos", "reference")


_BOUNDARIES = [
    ("WORK\\s*ORDER", "WORK_ORDER"), ("ORDRE\\s+D.EXECUTION", "JOBCARD"),
    ("MAINTENANCE\\s+JOB\\s+CARD", "JOBCARD"), ("DEFECT\\s+REPORT", "DEFECT_REPORT"),
    ("RAPPORT\\s+DE\\s+CONTROLE", "WORK_ORDER"),
    ("MAINTENANCE\\s+AND\\s+PERFORMANCE\\s+LOG", "ATL"),
    ("NON.CONFORMITY\\s+REPORT|NCR\\s+N", "NCR"),
    ("RELEASE\\s+TO\\s+SERVICE|CERTIFICATE\\s+OF\\s+RELEASE", "CERTIFICATE"),
    ("AIRWORTHINESS\\s+DIRECTIVE|SB/AD/CN", "AD"), ("SERVICE\\s+BULLETIN", "SB")]
_TYPE_CASE = " ".join(
    f"WHEN regexp_matches(head, '(?i){p}') THEN '{k}'" for p, k in _BOUNDARIES)
SEGMENT_SQL = f"""
ln AS (SELECT bundle_id, page_no, list_filter(list_transform(regexp_split_to_array(page_text, '\\r\\n|\\n|\\r'),
    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM cat_page_text),
hd AS (SELECT bundle_id, page_no, array_to_string(lines[1:20], chr(10)) AS head, array_to_string(lines[1:5], chr(10)) AS top FROM ln),
an AS (SELECT bundle_id, page_no, CASE {_TYPE_CASE} END AS doc_type,
    nullif(regexp_extract(head, '(?i)\\bES\\s*0*(\\d{{4,8}})\\b', 1), '') AS num,
    nullif(upper(regexp_extract(head, '(?i)\\b(TS-[A-Z]{{2,4}})\\b', 1)), '') AS aircraft,
    regexp_matches(top, '(?i)\\bES\\s*0*(\\d{{4,8}})\\b') AS es_top FROM hd),
st AS (SELECT *, 'ES' || CASE WHEN length(num) < 6 THEN lpad(num, 6, '0') ELSE num END AS es_reference,
    doc_type IS NOT NULL OR (num IS NOT NULL AND es_top) AS starts,
    least(1.0::DOUBLE, (CASE WHEN doc_type IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN num IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN doc_type IS NULL AND num IS NOT NULL AND es_top THEN 1 ELSE 0 END
      + CASE WHEN aircraft IS NOT NULL THEN 1 ELSE 0 END) / 6.0::DOUBLE) AS confidence FROM an),
sg AS (SELECT bundle_id, page_no, starts, doc_type, es_reference, aircraft, confidence,
    CAST(sum(CASE WHEN starts OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY bundle_id ORDER BY page_no) AS BIGINT) AS segment
  FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY page_no) AS rn FROM st))"""


@plan("w03_segment_pages", "WITH " + SEGMENT_SQL.strip()
      + " SELECT bundle_id, page_no, starts, doc_type, es_reference, aircraft, RND[confidence;4] AS confidence, segment FROM sg")
def w03(t: Tables) -> DataFrame:
    from docspark.functions.basics import rounded

    return win.segment_pages(t.page_text()).withColumn(
        "confidence", rounded(F.col("confidence"), 4))


@plan("w04_segment_metadata", "WITH " + SEGMENT_SQL.strip() + """,
m AS (SELECT bundle_id, segment, arg_min(doc_type, page_no) FILTER (WHERE doc_type IS NOT NULL) AS doc_type,
  arg_min(es_reference, page_no) FILTER (WHERE es_reference IS NOT NULL) AS es_reference,
  arg_min(aircraft, page_no) FILTER (WHERE aircraft IS NOT NULL) AS aircraft,
  RND[arg_min(confidence, page_no);4] AS confidence, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS pages
  FROM sg GROUP BY bundle_id, segment)
SELECT *, concat_ws('_', aircraft, doc_type, es_reference, 'p' || (first_page + 1) || '-' || (last_page + 1),
  'seg' || CASE WHEN segment < 1000 THEN lpad(CAST(segment AS VARCHAR), 3, '0') ELSE CAST(segment AS VARCHAR) END) || '.pdf' AS filename
FROM m""")
def w04(t: Tables) -> DataFrame:
    return win.segment_metadata(win.segment_pages(t.page_text()))


_BEST_SQL = """
WITH k AS (SELECT *, list_contains(list_transform(string_split(path, '/'), lambda p: upper(p)), regexp_extract(filename, '^(TS-IN[B-RTU])_', 1))
    AND regexp_matches(filename, '^TS-IN[B-RTU]_') AS inside FROM cat_files),
b AS (SELECT filename, path, file_size_kb, count(*) OVER (PARTITION BY filename) AS copies,
  first_value(path) OVER (PARTITION BY filename ORDER BY CASE WHEN inside THEN 0 ELSE 1 END,
    CASE WHEN inside THEN 0 ELSE len(string_split(path, '/')) END, path) AS keeper FROM k)
"""


@plan("w05_best_copy", _BEST_SQL + "SELECT DISTINCT filename, keeper, copies FROM b WHERE copies > 1")
def w05(t: Tables) -> DataFrame:
    return best_copies(t.files())


@plan("w05_copies_to_delete", _BEST_SQL
      + "SELECT filename, path, keeper, file_size_kb / 1024 AS mb FROM b WHERE copies > 1 AND path <> keeper")
def w05_delete(t: Tables) -> DataFrame:
    return copies_to_delete(t.files())


DESTINATION_SQL = """
dest AS (SELECT id, CASE WHEN coalesce(aircraft_registration, '') = '' THEN 'En_Attente' ELSE
    concat_ws('/', upper(aircraft_registration),
      CASE lower(category) WHEN 'check a' THEN 'Checks/Check_A' WHEN 'check c' THEN 'Checks/Check_C' WHEN 'check d' THEN 'Checks/Check_D'
        WHEN 'ad' THEN 'Navigabilite/AD' WHEN 'sb' THEN 'Navigabilite/SB' WHEN 'specs' THEN 'Technique/Specs' ELSE 'Divers' END,
      CASE doc_type WHEN 'Work Order' THEN 'Work_Order' WHEN 'Jobcard' THEN 'Job_Card' WHEN 'AD' THEN 'AD' WHEN 'SB' THEN 'SB'
        WHEN 'Defect Report' THEN 'Defect_Report' WHEN 'RCT' THEN 'RCT' END) END AS folder,
  coalesce(upper(aircraft_registration), 'UNKN') || '_' || CASE doc_type WHEN 'Work Order' THEN 'WO' WHEN 'Jobcard' THEN 'JC'
      WHEN 'Defect Report' THEN 'DR' WHEN 'AD' THEN 'AD' WHEN 'SB' THEN 'SB' WHEN 'Specs' THEN 'SPECS' WHEN 'RCT' THEN 'RCT' ELSE 'OTHER' END
    || '_' || replace(coalesce(es_reference, sb_ad_reference, work_order_number, item_number, CAST(id AS VARCHAR)), ' ', '_')
    || CASE WHEN ata_chapter IS NOT NULL THEN '_ATA' || ata_chapter ELSE '' END || '.pdf' AS name
  FROM cat_text)"""


@plan("w06_unique_destination", "WITH " + DESTINATION_SQL.strip() + """
SELECT id, folder, CASE WHEN row_number() OVER (PARTITION BY folder, name ORDER BY id) = 1 THEN name
  ELSE left(name, length(name) - 4) || '_' || id || '.pdf' END AS name FROM dest""")
def w06(t: Tables) -> DataFrame:
    return win.organised_plan(t.documents(
        "id", "aircraft_registration", "category", "doc_type", "es_reference",
        "sb_ad_reference", "work_order_number", "item_number", "ata_chapter"))


@plan("w07_dedup_keep_first", """
SELECT id, aircraft, es_reference, check_type FROM (
  SELECT id, aircraft_registration AS aircraft, es_reference, category AS check_type,
    row_number() OVER (PARTITION BY regexp_replace(upper(es_reference), '^ES', '') ORDER BY aircraft_registration NULLS FIRST, id) AS rn
  FROM cat_documents WHERE regexp_replace(upper(coalesce(es_reference, '')), '^ES', '') <> '') WHERE rn = 1""")
def w07(t: Tables) -> DataFrame:
    rows = t.documents("id", "aircraft_registration", "es_reference", "category")
    return distinct_checks(rows.select(
        "id", F.col("aircraft_registration").alias("aircraft"), "es_reference",
        F.col("category").alias("check_type")))


@plan("w09_running_statistics", """
SELECT id, count(*) OVER w AS processed, count(*) FILTER (WHERE status = 'error') OVER w AS errors,
  RND[CAST(sum(CAST(duration_s AS DECIMAL(18,6))) OVER w AS DOUBLE) / count(*) OVER w;3] AS avg_duration_s
FROM cat_processing_log WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING)""")
def w09(t: Tables) -> DataFrame:
    return win.running_statistics(t.processing_log())


@plan("w10_context_budget", """
WITH p AS (SELECT id, n_chars, row_number() OVER (ORDER BY ocr_confidence DESC, id) AS rank FROM cat_documents),
u AS (SELECT *, sum(n_chars) OVER (ORDER BY rank) AS used FROM p)
SELECT rank, id, n_chars FROM u WHERE used <= 20000""")
def w10(t: Tables) -> DataFrame:
    rows = t.documents("id", "n_chars", "ocr_confidence")
    return win.context_budget(
        rows, [F.desc("ocr_confidence"), F.asc("id")], F.col("n_chars"), 20000,
    ).select("rank", "id", "n_chars")


@plan("w11_last_n_periods", """
SELECT strftime(date_trunc('month', created_at), '%Y-%m') AS period, count(*) AS count
FROM cat_wide GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def w11(t: Tables) -> DataFrame:
    counted = t.wide().groupBy(
        F.date_format("created_at", "yyyy-MM").alias("period")).agg(
        F.count("*").alias("count"))
    return win.last_n_periods(counted, "period", 12)


@plan("w12_latest_per_key", """
SELECT filename, path, mtime FROM (
  SELECT *, row_number() OVER (PARTITION BY filename ORDER BY mtime DESC NULLS LAST, path DESC) AS rn FROM cat_files) WHERE rn = 1""")
def w12(t: Tables) -> DataFrame:
    return win.latest_per_key(t.files("filename", "path", "mtime"))
