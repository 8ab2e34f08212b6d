"""The catalogue tables once more, as SQL for the independent checker.

The checker knows only the given tables, so each SQL twin starts with the
``WITH`` clauses it needs, added here in dependency order.
"""

from __future__ import annotations

import re

VIEWS = {
    "cat_aircraft": """
SELECT n.n_nationkey AS id, 'TS-IN' || chr(65 + n.n_nationkey) AS registration,
  CAST(1000 + n.n_nationkey * 37 AS VARCHAR) AS msn,
  CASE WHEN n.n_nationkey IN (11, 12) THEN 'A320-251N' ELSE 'A320-214' END AS model,
  CASE WHEN n.n_nationkey IN (11, 12) THEN 'NEO' ELSE 'CEO' END AS aircraft_type,
  r.r_name AS lessor
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "cat_checks": """
SELECT s_suppkey AS id, 'ES' || lpad(CAST(s_suppkey + 1000 AS VARCHAR), 6, '0') AS es_reference,
  CASE s_suppkey % 3 WHEN 0 THEN 'Check A' WHEN 1 THEN 'Check C' ELSE 'Check D' END AS check_type,
  s_nationkey AS aircraft_id, DATE '2024-01-01' + CAST(s_suppkey % 28 AS INT) AS start_date,
  CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 28 + 5 + s_suppkey % 9 AS INT) END AS end_date
FROM supplier""",
    "cat_documents": """
SELECT b.*,
  CASE WHEN aircraft_id IS NOT NULL THEN 'TS-IN' || chr(65 + aircraft_id) END AS aircraft_registration,
  CASE doc_type WHEN 'AD' THEN 'AD' WHEN 'SB' THEN 'SB' WHEN 'Specs' THEN 'Specs' WHEN 'Other' THEN NULL
    ELSE CASE id % 3 WHEN 0 THEN 'Check A' WHEN 1 THEN 'Check C' ELSE 'Check D' END END AS category,
  CASE WHEN id % 6 <> 5 THEN 'ATA ' || CAST(21 + id % 13 AS VARCHAR) END AS ata_chapter,
  CASE WHEN id % 10 < 7 THEN 'ARCHIVED' WHEN id % 10 < 9 THEN 'PENDING' ELSE 'ERROR' END AS status,
  CAST(id * 37 % 1001 AS DOUBLE) / 10 AS ocr_confidence,
  CAST(id * 53 % 1001 AS DOUBLE) / 1000 AS classifier_confidence,
  CAST(n_chars AS DOUBLE) / 1024 AS file_size_kb,
  coalesce(quality = 0, false) AS needs_review, coalesce(toxic = 1, false) AS is_critical,
  id % 11 = 0 AS manually_corrected, CASE WHEN id % 10 < 7 THEN created_at END AS archived_at,
  CASE WHEN id % 2 = 0 THEN 'pdfplumber' ELSE 'ocr_v5_tesseract' END AS ocr_engine,
  CASE WHEN id % 5 <> 4 THEN id % 120 END AS check_id
FROM (
  SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars, e.ts AS created_at, v.embedding,
    l.quality, l.toxic,
    CASE d.doc_id % 8 WHEN 0 THEN 'Work Order' WHEN 1 THEN 'Jobcard' WHEN 2 THEN 'Defect Report'
      WHEN 3 THEN 'AD' WHEN 4 THEN 'SB' WHEN 5 THEN 'Specs' WHEN 6 THEN 'RCT' ELSE 'Other' END AS doc_type,
    CASE WHEN d.doc_id % 17 <> 0 THEN CAST(d.doc_id % 25 AS INT) END AS aircraft_id,
    CASE WHEN d.doc_id % 5 <> 4 THEN 'ES' || lpad(CAST(d.doc_id % 120 + 1000 AS VARCHAR), 6, '0') END AS es_reference
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id
    LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id) b""",
    "cat_alerts": """
SELECT event_id AS id, event_id % 500 AS document_id,
  'TS-IN' || chr(CAST(65 + user_id % 25 AS INT)) AS aircraft_registration,
  CASE WHEN value >= 50 THEN 'critical' WHEN value >= 10 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN event_id % 2 = 0 THEN 'ocr_low_confidence' ELSE 'processing_error' END AS alert_type,
  event_id % 3 = 0 AS resolved, ts AS created_at
FROM events WHERE event_type = 'error'""",
    "cat_page_text": """
SELECT conv_id AS bundle_id, turn AS page_no,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN 'WORK ORDER' || chr(10) || 'ES ' || lpad(CAST(conv_id * 10 + turn AS VARCHAR), 6, '0') || chr(10)
    WHEN (conv_id + turn) % 3 = 1 THEN 'A/C TS-IN' || chr(CAST(65 + conv_id % 25 AS INT)) || chr(10) ELSE '' END || text AS page_text
FROM conversations""",
    "cat_wide": """
SELECT o.o_orderkey AS id, o.o_orderpriority AS doc_type, p.p_type AS category,
  CASE o.o_orderstatus WHEN 'F' THEN 'ARCHIVED' WHEN 'O' THEN 'PENDING' ELSE 'ERROR' END AS status,
  c.c_nationkey AS aircraft_id, 'TS-IN' || chr(65 + c.c_nationkey) AS aircraft_registration,
  CAST(o.o_orderkey * 37 % 1001 AS DOUBLE) / 10 AS ocr_confidence, o.o_orderdate AS created_at
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)""",
    "cat_text": """
SELECT *,
  'Aircraft/' || coalesce(aircraft_registration, 'UNKNOWN') || '/' || coalesce(category, 'Old doc') || '/' ||
  CASE doc_type WHEN 'Work Order' THEN 'WORKORDER' WHEN 'Jobcard' THEN 'JOBCARD' WHEN 'Defect Report' THEN 'DEFECT REPORT'
    WHEN 'RCT' THEN 'RCT' WHEN 'AD' THEN 'AD' WHEN 'SB' THEN 'SB' ELSE 'MISC' END || '/' || filename AS rel_path,
  CASE WHEN id % 3 <> 2 THEN 'A/C ' || coalesce(aircraft_registration, '--') || chr(10) ELSE '' END ||
  'WORK ORDER: WO-' || CAST(10000 + id AS VARCHAR) || chr(10) ||
  'P/N: PN' || CAST(id * 7 AS VARCHAR) || '-A S/N: SN' || CAST(id * 3 AS VARCHAR) || ' ' || coalesce(ata_chapter, '') || chr(10) ||
  CASE WHEN doc_type = 'Work Order' THEN 'Linked WP ES' || lpad(CAST((id + 8) % 120 + 1000 AS VARCHAR), 6, '0') || chr(10) ELSE '' END ||
  'MSN ' || CAST(1000 + (id % 25) * 37 AS VARCHAR) || ' DATE: ' || lpad(CAST(1 + id % 28 AS VARCHAR), 2, '0') || '/03/2024' || chr(10) ||
  text AS ocr_text
FROM (
  SELECT *,
    CASE WHEN id % 4 = 0 AND es_reference IS NOT NULL THEN es_reference || '.pdf'
      WHEN id % 4 = 1 AND aircraft_registration IS NOT NULL AND es_reference IS NOT NULL
        THEN aircraft_registration || '_CHECK A_' || es_reference || '_RCT.pdf'
      WHEN id % 4 = 2 THEN 'A320-' || CAST(21 + id % 13 AS VARCHAR) || '-' || CAST(1000 + id % 500 AS VARCHAR) || '.pdf'
      ELSE lpad(CAST(id % 1000 AS VARCHAR), 4, '0') || '.pdf' END AS filename,
    'WO-' || CAST(10000 + id AS VARCHAR) AS work_order_number,
    'PN' || CAST(id * 7 AS VARCHAR) || '-A' AS part_number, 'SN' || CAST(id * 3 AS VARCHAR) AS serial_number,
    CASE doc_type WHEN 'AD' THEN 'AD 2024-' || lpad(CAST(id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0')
      WHEN 'SB' THEN 'A320-' || CAST(21 + id % 13 AS VARCHAR) || '-' || CAST(1000 + id % 500 AS VARCHAR) END AS sb_ad_reference,
    CASE WHEN doc_type = 'Jobcard' THEN lpad(CAST(id % 1000 AS VARCHAR), 4, '0') END AS item_number,
    CASE WHEN lang = 'en' THEN '{"msn": "' || CAST(1000 + (id % 25) * 37 AS VARCHAR) || '", "source": ["' || source || '"]}'
      WHEN lang = 'fr' THEN '{"serial_number": "' || CAST(n_chars AS VARCHAR) || '"}' END AS extracted_entities,
    CASE WHEN aircraft_registration IS NULL THEN '["immatriculation manquante", "' || lang || '"]' ELSE '[]' END AS validation_warnings
  FROM cat_documents) f""",
    "cat_files": """
SELECT 'ORGANISED/' || split_part(rel_path, '/', 2) || '/' || filename AS path, filename, file_size_kb, created_at AS mtime FROM cat_text
UNION ALL
SELECT 'ORGANISED/Divers/Old/' || filename, filename, file_size_kb, created_at FROM cat_text WHERE lang = 'fr'""",
    "cat_page_ocr": """
SELECT c.conv_id AS document_id, c.turn AS page_no, a.engine, a.attempt, c.text,
  CAST((c.conv_id * 31 + c.turn * 17 + a.attempt * 211 + length(a.engine) * 97) % 1001 AS DOUBLE) / 10 AS confidence
FROM conversations c CROSS JOIN (VALUES ('tesseract', 1), ('tesseract', 2), ('opencv', 1)) AS a(engine, attempt)""",
    "cat_predictions": """
SELECT id, doc_type AS y_true, ocr_confidence, classifier_confidence AS confidence,
  CASE WHEN id % 7 < 5 THEN doc_type WHEN id % 7 = 5 THEN 'Work Order' ELSE 'Unknown' END AS y_pred
FROM cat_documents""",
    "cat_ocr_runs": """
SELECT id, ocr_confidence AS old_confidence, CAST(id * 41 % 1001 AS DOUBLE) / 10 AS new_confidence,
  needs_review AS old_review, id * 41 % 1001 < 550 AS new_review FROM cat_documents""",
    "cat_processing_log": """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  value AS duration_s, ts AS at FROM events""",
    "cat_import_log": """
SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS run,
  'TS-IN' || chr(65 + s_nationkey) AS aircraft,
  CASE l_returnflag WHEN 'N' THEN 'imported' WHEN 'A' THEN 'duplicate' ELSE 'error' END AS status,
  l_quantity AS duration_s
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
}


def _needed(sql: str, found: list[str]) -> None:
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql) and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names; ``sql`` may bring its own."""
    found: list[str] = []
    _needed(sql, found)
    if not found:
        return sql
    clauses = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in found)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {clauses},\n{body[5:]}"
    return f"WITH {clauses}\n{body}"


def mean(expression: str) -> str:
    """Order-independent mean, as the Spark side computes it."""
    return f"{total(expression)} / nullif(count({expression}), 0)"


def total(expression: str) -> str:
    return f"CAST(sum(CAST({expression} AS DECIMAL(28,10))) AS DOUBLE)"


def rounded(expression: str, digits: str) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"
