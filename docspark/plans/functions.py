"""Projection (P) and scalar-function (X) queries with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions import entities as ent
from docspark.functions import labels, names, paths, registration, text
from docspark.functions.basics import rounded
from docspark.functions.spans import annotate_spans
from docspark.functions.vectors import cosine
from docspark.operators.joins import date_parts
from docspark.plans.registry import plan
from docspark.plans.windows import DESTINATION_SQL
from docspark.sources.bindings import Tables


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(
        _q(x) if isinstance(x, str) else ("NULL" if x is None else str(x))
        for x in row) + ")" for row in rows)


def _first(source: str, patterns, group: int = 1, prefix: str = "") -> str:
    tries = ", ".join(
        f"nullif(regexp_extract({source}, {_q(prefix + p)}, {group}), '')" for p in patterns)
    return f"coalesce({tries})" if len(patterns) > 1 else tries


# --- P: projections ---------------------------------------------------------


@plan("p01_normalise_doc_type", f"""
WITH m(k, v) AS (VALUES {_values(fv.TYPE_NAME_TO_VALUE.items())}),
s AS (SELECT id, replace(lower(doc_type), ' ', '-') AS raw FROM cat_documents)
SELECT id, raw, coalesce(m.v, raw) AS doc_type FROM s LEFT JOIN m ON m.k = regexp_replace(upper(raw), '[ -]', '_', 'g')""")
def p01(t: Tables) -> DataFrame:
    raw = t.documents("id", "doc_type").select(
        "id", F.replace(F.lower("doc_type"), F.lit(" "), F.lit("-")).alias("raw"))
    return raw.withColumn("doc_type", labels.normalise_doc_type("raw"))


@plan("p02_path_metadata", f"""
WITH p AS (SELECT id, filename, substr(rel_path, 10) AS path FROM cat_text),
s AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT id, CASE WHEN upper(parts[1]) IN ('TS-INP','TS-INQ','TS-IML','TS-INN','TS-INM') THEN upper(parts[1]) END AS aircraft_registration,
  coalesce(parts[2], '') AS category,
  coalesce(list_filter(list_transform(parts, lambda x: CASE upper(x) WHEN 'JOBCARD' THEN 'Jobcard' WHEN 'JOB CARD' THEN 'Jobcard'
    WHEN 'WORKORDER' THEN 'Work Order' WHEN 'WORK ORDER' THEN 'Work Order' WHEN 'DEFECT REPORT' THEN 'Defect Report'
    WHEN 'NCR' THEN 'NCR' WHEN 'RCT' THEN 'RCT' END), lambda x: x IS NOT NULL)[1], '') AS subcategory,
  'ES' || nullif(regexp_extract(upper(path), 'ES(\\d{{6,8}})', 1), '') AS es_reference,
  nullif(regexp_extract(upper(filename), '(A3\\d{{2}}-\\d{{2}}[A-Z]?\\d{{3,5}}[A-Z]?)', 1), '') AS sb_ad_reference,
  'ATA ' || nullif(regexp_extract(upper(path), 'ATA[\\s\\-]?(\\d{{2}})', 1), '') AS ata_chapter,
  nullif(regexp_extract(upper(filename), '^(\\d{{3,4}})\\.PDF$', 1), '') AS item_number,
  lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) AS extension FROM s""")
def p02(t: Tables) -> DataFrame:
    rows = t.text("id", "filename", "rel_path").select(
        "id", "filename", F.substring("rel_path", 10, 10000).alias("path"))
    return rows.select("id", paths.path_metadata("path", "filename").alias("m")).select(
        "id", "m.*")


_DISCOVERY = " ".join(
    f"WHEN contains(lower(rel_path), {_q(k)}) THEN {_q(v)}" for k, v in fv.DISCOVERY_CATEGORIES)


@plan("p03_discovery_metadata", f"""
SELECT id, list_filter(string_split(rel_path, '/'), lambda x: regexp_full_match(upper(x), 'TS-IN[B-RTU]'))[1] AS aircraft_registration,
  CASE {_DISCOVERY} END AS category, nullif(regexp_extract(upper(rel_path), 'ES\\d{{5,7}}'), '') AS es_reference FROM cat_text""")
def p03(t: Tables) -> DataFrame:
    return t.text("id", "rel_path").select(
        "id", paths.discovery_metadata("rel_path").alias("m")).select("id", "m.*")


def _segment_case(pairs, alias) -> str:
    cases = " ".join(f"WHEN contains(u, {_q(k)}) THEN {_q(v)}" for k, v in pairs)
    return f"CASE {cases} END AS {alias}"


@plan("p04_category_from_path", f"""
WITH s AS (SELECT id, unnest(string_split(rel_path, '/')) AS seg, unnest(range(len(string_split(rel_path, '/')))) AS pos FROM cat_text),
l AS (SELECT id, pos, {_segment_case(fv.SEGMENT_CATEGORIES, 'c')}, {_segment_case(fv.SEGMENT_SUBCATEGORIES, 's')}
  FROM (SELECT id, pos, upper(seg) AS u FROM s))
SELECT id, coalesce(arg_max(c, pos) FILTER (WHERE c IS NOT NULL), '') AS category,
  coalesce(arg_max(s, pos) FILTER (WHERE s IS NOT NULL), '') AS subcategory FROM l GROUP BY id""")
def p04(t: Tables) -> DataFrame:
    return t.text("id", "rel_path").select(
        "id", paths.category_from_path("rel_path").alias("m")).select("id", "m.*")


_FLEET_VALUES = ", ".join(
    f"({i}, {_q(r)})" for i, r in enumerate(fv.ACTIVE_REGISTRATIONS + fv.FLEET_REGISTRATIONS))


@plan("p05_registration_from_path", f"""
WITH fleet(o, r) AS (VALUES {_FLEET_VALUES})
SELECT d.id, arg_min(f.r, f.o) AS aircraft_registration FROM cat_text d
LEFT JOIN fleet f ON contains(upper(d.rel_path), f.r) GROUP BY d.id""")
def p05(t: Tables) -> DataFrame:
    return t.text("id", "rel_path").select(
        "id", registration.registration_from_path("rel_path").alias(
            "aircraft_registration"))


_PROFILE_ROWS = _values(
    (i, n, s["filename_regex"], s["confidence"], len(s["keywords"]))
    for i, (n, s) in enumerate(fv.PROFILES.items()))
_PROFILE_WORDS = _values((n, w) for n, s in fv.PROFILES.items() for w in s["keywords"])
PROFILE_SQL = f"""
pr(o, profile, rx, conf, n) AS (VALUES {_PROFILE_ROWS}), pw(profile, kw) AS (VALUES {_PROFILE_WORDS}),
ph AS (SELECT d.id, pw.profile, count(*) AS hits FROM cat_text d JOIN pw ON contains(lower(d.rel_path), pw.kw) GROUP BY 1, 2),
ps AS (SELECT d.id, pr.profile, pr.o, coalesce(ph.hits, 0) / pr.n::DOUBLE * pr.conf::DOUBLE
    + CASE WHEN pr.rx IS NOT NULL AND regexp_matches(lower(d.filename), pr.rx) THEN pr.conf::DOUBLE ELSE 0 END AS score
  FROM cat_text d CROSS JOIN pr LEFT JOIN ph ON ph.id = d.id AND ph.profile = pr.profile),
pf AS (SELECT id, CASE WHEN score > 0 THEN profile ELSE 'unknown' END AS profile, RND[least(score, 1.0);3] AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, o) AS rn FROM ps) WHERE rn = 1)"""


@plan("p06_profile_from_path", "WITH " + PROFILE_SQL.strip() + " SELECT * FROM pf")
def p06(t: Tables) -> DataFrame:
    return t.text("id", "rel_path").select(
        "id", paths.profile_from_path("rel_path").alias("m")).select("id", "m.*")


@plan("p07_profile_config", "WITH " + PROFILE_SQL.strip() + f""",
cfg(profile, display, prefix, max_chars, required) AS (VALUES {_values(
    (n, s["display"], s["prefix"], s["max_chars"], ",".join(s["required"])) for n, s in fv.PROFILES.items())})
SELECT pf.id, pf.profile, coalesce(cfg.display, 'Document (' || pf.profile || ')') AS display, coalesce(cfg.prefix, '') AS prefix,
  cfg.max_chars, coalesce(cfg.required, '') AS required FROM pf LEFT JOIN cfg ON cfg.profile = pf.profile""")
def p07(t: Tables) -> DataFrame:
    from docspark.operators.rules import profile_config

    rows = p06(t).select("id", "profile")
    return profile_config(rows, "profile").withColumn(
        "required", F.array_join("required", ","))


_ENTITY_COLUMNS = [
    "es_reference", "sb_ad_reference", "work_order_number", "item_number",
    "serial_number", "ata_chapter"]


@plan("p08_suggested_filename", """
WITH r AS (SELECT *, CASE doc_type WHEN 'Work Order' THEN coalesce(es_reference, work_order_number) WHEN 'RCT' THEN coalesce(es_reference, work_order_number)
    WHEN 'Jobcard' THEN coalesce(item_number, es_reference) WHEN 'AD' THEN coalesce(sb_ad_reference, es_reference)
    WHEN 'SB' THEN coalesce(sb_ad_reference, es_reference) WHEN 'Specs' THEN coalesce(replace(ata_chapter, 'ATA ', 'ATA'), es_reference)
    ELSE coalesce(es_reference, item_number) END AS ref, replace(coalesce(category, ''), ' ', '_') AS cat,
  CASE doc_type WHEN 'Other' THEN 'Doc' ELSE replace(doc_type, ' ', '_') END AS ty FROM cat_text)
SELECT id, concat_ws('_', coalesce(aircraft_registration, 'UNKNOWN'), nullif(cat, ''), CASE WHEN ty <> cat THEN ty END,
  regexp_replace(ref, '\\s', '_', 'g')) || '.pdf' AS name FROM r""")
def p08(t: Tables) -> DataFrame:
    rows = t.documents(
        "id", "aircraft_registration", "doc_type", "category", "filename",
        *_ENTITY_COLUMNS)
    return rows.select("id", names.suggested_filename(
        "aircraft_registration", "doc_type", "category",
        {c: F.col(c) for c in _ENTITY_COLUMNS}, "filename").alias("name"))


@plan("p09_organised_destination", "WITH " + DESTINATION_SQL.strip() + " SELECT * FROM dest")
def p09(t: Tables) -> DataFrame:
    rows = t.documents(
        "id", "aircraft_registration", "category", "doc_type", *_ENTITY_COLUMNS)
    return rows.select("id", names.organised_destination(
        "id", "aircraft_registration", "category", "doc_type",
        {c: F.col(c) for c in _ENTITY_COLUMNS}).alias("d")).select("id", "d.folder", "d.name")


@plan("p10_name_from_path", """
SELECT id, replace(array_to_string(string_split(rel_path, '/')[2:], '_'), ':', '_') AS name FROM cat_text""")
def p10(t: Tables) -> DataFrame:
    return t.text("id", "rel_path").select("id", paths.name_from_path("rel_path").alias("name"))


@plan("p11_name_from_metadata", """
WITH n AS (SELECT id, filename, concat_ws('_', aircraft_registration, category, es_reference, doc_type, 'ATA' || ata_chapter)
  || '_' || filename AS new_name FROM cat_text)
SELECT id, new_name, CASE WHEN new_name = filename OR starts_with(filename, left(regexp_replace(new_name, '\\.[^.]*$', ''), 20))
  THEN 'no_change' ELSE 'rename' END AS decision FROM n""")
def p11(t: Tables) -> DataFrame:
    rows = t.documents(
        "id", "aircraft_registration", "category", "es_reference", "doc_type",
        "ata_chapter", "filename")
    return rows.select("id", "filename", names.name_from_metadata(
        "aircraft_registration", "category", "es_reference", "doc_type",
        "ata_chapter", "filename").alias("new_name")).select(
        "id", "new_name", names.rename_decision("filename", "new_name").alias("decision"))


@plan("p12_collapse_repeated_prefix", """
WITH d AS (SELECT id, coalesce(aircraft_registration, 'TS-INA') || '_' || doc_type || '_' || filename AS once,
    coalesce(aircraft_registration, 'TS-INA') || '_' || doc_type || '_' || coalesce(aircraft_registration, 'TS-INA') || '_' || doc_type || '_' || filename AS twice FROM cat_text)
SELECT id, twice AS filename, once AS collapsed, true AS repeated FROM d""")
def p12(t: Tables) -> DataFrame:
    rows = t.documents("id", "aircraft_registration", "doc_type", "filename")
    part = F.concat_ws(
        "_", F.coalesce("aircraft_registration", F.lit("TS-INA")), "doc_type")
    return rows.select("id", F.concat_ws("_", part, part, "filename").alias("filename")).withColumns({
        "collapsed": names.collapse_repeated_prefix("filename"),
        "repeated": names.repeated_prefix("filename")})


_META = ["aircraft", "doc_type", "category", "es_reference", "ata_chapter", "sb_ad_reference"]


def _metadata() -> dict:
    return {"aircraft": F.col("aircraft_registration"), **{
        c: F.col(c) for c in _META[1:]}}


_EMBED_SQL = """
WITH m AS (SELECT id, filename, ocr_text, nullif(concat_ws(' ', 'aircraft ' || aircraft_registration, 'type ' || doc_type, 'category ' || category,
  'reference ' || es_reference, 'ata ' || ata_chapter, 'service bulletin airworthiness directive ' || sb_ad_reference), '') AS meta FROM cat_text),
e AS (SELECT id, concat_ws(' ', 'Job Card maintenance task:', 'filename ' || filename, meta, meta,
  regexp_replace(replace({body}, chr(10), ' '), '^\\s+|\\s+$', '', 'g')) AS t FROM m)
SELECT id, length({out}) AS chars, md5({out}) AS digest FROM e"""


def _embedding_rows(t: Tables, **window) -> DataFrame:
    rows = t.text(
        "id", "filename", "ocr_text", "aircraft_registration", *_META[1:])
    value = text.embedding_text(
        "ocr_text", "filename", _metadata(), "Job Card maintenance task: ", **window)
    return rows.select("id", value.alias("t")).select(
        "id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("digest"))


@plan("p13_embedding_text", _EMBED_SQL.format(body="ocr_text", out="t"))
def p13(t: Tables) -> DataFrame:
    return _embedding_rows(t)


@plan("p14_classifier_text", """
WITH c AS (SELECT id, lower(ocr_text) || ' FILENAME ' || lower(translate(filename, '-_.', '   ')) || ' PATH ' || lower(replace(rel_path, '/', ' ')) AS t FROM cat_text)
SELECT id, length(t) AS chars, md5(t) AS digest FROM c""")
def p14(t: Tables) -> DataFrame:
    value = text.classifier_text("ocr_text", "filename", "rel_path")
    return t.text("id", "ocr_text", "filename", "rel_path").select(
        "id", value.alias("t")).select(
        "id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("digest"))


@plan("p14_short_classifier_text", """
WITH c AS (SELECT id, ocr_text || ' FILE ' || filename || ' PATH ' || array_to_string(string_split(rel_path, '/')[-4:], ' ') AS t FROM cat_text)
SELECT id, length(t) AS chars, md5(t) AS digest FROM c""")
def p14_short(t: Tables) -> DataFrame:
    value = text.short_classifier_text("ocr_text", "filename", "rel_path")
    return t.text("id", "ocr_text", "filename", "rel_path").select(
        "id", value.alias("t")).select(
        "id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("digest"))


@plan("p15_entity_features", """
SELECT id, CAST(aircraft_registration IS NOT NULL AS INT) AS has_aircraft_reg, CAST(es_reference IS NOT NULL AS INT) AS has_es_ref,
  CAST(ata_chapter IS NOT NULL AS INT) AS has_ata_chapter, 1 AS has_part_number, 1 AS has_serial_number,
  CAST(sb_ad_reference IS NOT NULL AS INT) AS has_doc_ref, 0 AS has_date, 0 AS has_airline,
  CAST(coalesce(aircraft_registration, '') LIKE '%TS-INP%' AS INT) AS is_ts_inp,
  CAST(coalesce(aircraft_registration, '') LIKE '%TS-INQ%' AS INT) AS is_ts_inq,
  CAST(coalesce(sb_ad_reference, '') LIKE 'AD%' AS INT) AS doc_ref_is_ad, CAST(coalesce(sb_ad_reference, '') LIKE 'SB%' AS INT) AS doc_ref_is_sb
FROM cat_text""")
def p15(t: Tables) -> DataFrame:
    columns = {
        "aircraft_registration": "aircraft_registration",
        "es_reference": "es_reference", "ata_chapter": "ata_chapter",
        "part_number": "part_number", "serial_number": "serial_number",
        "doc_ref": "sb_ad_reference"}
    rows = t.documents("id", *columns.values())
    return rows.select("id", *ent.entity_features(
        {k: F.col(v) for k, v in columns.items()}))


@plan("p16_check_letter", """
WITH v AS (SELECT id, CASE id % 4 WHEN 0 THEN upper(replace(category, ' ', '_')) WHEN 1 THEN right(category, 1) || ' check'
  WHEN 2 THEN '4' || right(category, 1) ELSE category END AS check_type FROM cat_documents)
SELECT id, check_type, CASE WHEN right(upper(check_type), 2) IN ('_A','_C','_D') THEN right(upper(check_type), 1)
  WHEN regexp_matches(upper(check_type), 'CHECK\\s*[ACD]') THEN regexp_extract(upper(check_type), 'CHECK\\s*([ACD])', 1)
  WHEN regexp_matches(upper(check_type), '[ACD]\\s*CHECK') THEN regexp_extract(upper(check_type), '([ACD])\\s*CHECK', 1)
  WHEN right(upper(check_type), 1) IN ('A','C','D') THEN right(upper(check_type), 1) END AS letter FROM v""")
def p16(t: Tables) -> DataFrame:
    rows = t.documents("id", "category").select("id", F.expr(
        """CASE id % 4 WHEN 0 THEN upper(replace(category, ' ', '_'))
        WHEN 1 THEN right(category, 1) || ' check'
        WHEN 2 THEN '4' || right(category, 1) ELSE category END""").alias("check_type"))
    return rows.withColumn("letter", labels.check_letter("check_type"))


@plan("p17_review_flags", """
SELECT id, ocr_confidence < 60 OR classifier_confidence < 0.5 AS needs_review,
  doc_type = 'AD' AND classifier_confidence > 0.7 AS is_critical,
  ocr_confidence > 0 AND ocr_confidence < 50 AS reprocess, ocr_confidence < 55 OR trim(text) = '' AS run_review
FROM cat_documents""")
def p17(t: Tables) -> DataFrame:
    return t.documents(
        "id", "doc_type", "ocr_confidence", "classifier_confidence", "text").select(
        "id", labels.needs_review("ocr_confidence", "classifier_confidence").alias("needs_review"),
        labels.is_critical("doc_type", "classifier_confidence").alias("is_critical"),
        labels.reprocess_flag("ocr_confidence").alias("reprocess"),
        labels.run_review("ocr_confidence", "text").alias("run_review"))


@plan("p18_quality_action", """
SELECT id, CASE WHEN ocr_confidence IS NULL OR ocr_confidence = 0 THEN '—' WHEN ocr_confidence >= 85 THEN 'Archive fiable'
  WHEN ocr_confidence >= 70 THEN 'Acceptable' ELSE 'Retraitement recommandé' END AS action FROM cat_documents""")
def p18(t: Tables) -> DataFrame:
    return t.documents("id", "ocr_confidence").select(
        "id", labels.quality_action("ocr_confidence").alias("action"))


@plan("p19_age_label", """
WITH a AS (SELECT id, created_at, datediff('second', created_at, TIMESTAMP '2024-01-10 00:00:00') - CASE WHEN
    date_trunc('second', created_at) <> created_at THEN 1 ELSE 0 END AS s FROM cat_documents)
SELECT id, CASE WHEN created_at IS NULL THEN '—' WHEN s < 60 THEN 'À l''instant'
  WHEN s < 3600 THEN 'Il y a ' || CAST(round(s / 60.0) AS INT) || ' min' WHEN s < 86400 THEN 'Il y a ' || CAST(round(s / 3600.0) AS INT) || ' h'
  WHEN s < 604800 THEN 'Il y a ' || CAST(round(s / 86400.0) AS INT) || ' j' ELSE strftime(created_at, '%d/%m/%Y') END AS age FROM a""")
def p19(t: Tables) -> DataFrame:
    return t.documents("id", "created_at").select("id", labels.age_label(
        "created_at", F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).alias("age"))


@plan("p20_alert_status", """
SELECT id, severity, CAST(created_at AS DATE) AS created_on, CASE WHEN resolved THEN 'Résolu' ELSE 'Actif' END AS status FROM cat_alerts""")
def p20(t: Tables) -> DataFrame:
    return t.alerts().select(
        "id", "severity", F.to_date("created_at").alias("created_on"),
        labels.resolution_label("resolved").alias("status"))


# --- X: scalar functions ----------------------------------------------------

# The checker's expressions know no look-around and only ASCII word edges, so
# its twins spell the edges out.
_EDGE_L, _EDGE_R = "(?:^|[^\\pL\\pN_])", "(?:$|[^\\pL\\pN_])"
_DEGRADED_SQL = [
    ("(?i)(?:^|[^\\pL\\pN_])([ETI]N[OPQRSTU])" + _EDGE_R, 1),
    ("(?i)[\\pL\\pN_](!N[OPQRSTU])" + _EDGE_R, 1),
    ("(?i)" + _EDGE_L + "([OE]{1,2}N[OPQRSTU])" + _EDGE_R, 1),
    ("(?i)A/?C[^\\n]*\\n[^\\n]{0,10}(IN[A-Z])", 1),
    ("(?i)A/?C[^\\n]*\\n[^\\n]{0,5}([NQ]{2}|NP|NO)" + _EDGE_R, 1)]
_CASCADE_SQL = [
    "(?im)" + p.replace("(?=\\s*\\n|\\s*!)", "(?:\\s*\\n|\\s*!)") for p in fv.REGISTRATION_PATTERNS]


def _edges(pattern: str) -> str:
    out = pattern
    if out.startswith("(?im)\\b"):
        out = "(?im)" + _EDGE_L + out[len("(?im)\\b"):]
    if out.endswith("\\b"):
        out = out[:-2] + _EDGE_R
    return out


def _normal_sql(value: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(right(upper({value}), 2), 'N[B-RTU]') "
        f"THEN 'TS-I' || right(upper({value}), 2) END")


_LISTED_SQL = (
    "CASE WHEN contains({u}, 'TS-INP') THEN 'TS-INP' WHEN contains({u}, 'TS-INQ') THEN 'TS-INQ' "
    + " ".join(f"WHEN contains({{u}}, '{r}') THEN '{r}'" for r in fv.FLEET_REGISTRATIONS) + " END")
_MISREAD_SQL = "coalesce(" + ", ".join(
    [_normal_sql(f"regexp_extract(ocr_text, {_q(p)}, {g})") for p, g in _DEGRADED_SQL]
    + [_normal_sql(f"regexp_extract(ocr_text, {_q(_edges(p))}, 1)") for p in _CASCADE_SQL]) + ")"
REGISTRATION_SQL = (
    f"coalesce({_LISTED_SQL.format(u='upper(filename)')}, "
    f"{_LISTED_SQL.format(u='upper(ocr_text)')}, {_MISREAD_SQL})")


@plan("x01_extract_registration",
      f"SELECT id, {REGISTRATION_SQL} AS aircraft_registration FROM cat_text")
def x01(t: Tables) -> DataFrame:
    return t.text("id", "filename", "ocr_text").select(
        "id", registration.extract_registration("ocr_text", "filename").alias(
            "aircraft_registration"))


@plan("x02_normalise_registration", f"""
WITH v AS (SELECT id, CASE id % 4 WHEN 0 THEN aircraft_registration WHEN 1 THEN lower(right(aircraft_registration, 3))
  WHEN 2 THEN right(aircraft_registration, 2) ELSE 'OE' || right(aircraft_registration, 2) END AS raw FROM cat_documents)
SELECT id, raw, {_normal_sql('raw')} AS registration FROM v""")
def x02(t: Tables) -> DataFrame:
    rows = t.documents("id", "aircraft_registration").select("id", F.expr(
        """CASE id % 4 WHEN 0 THEN aircraft_registration
        WHEN 1 THEN lower(right(aircraft_registration, 3))
        WHEN 2 THEN right(aircraft_registration, 2)
        ELSE 'OE' || right(aircraft_registration, 2) END""").alias("raw"))
    return rows.withColumn(
        "registration", registration.normalise_registration("raw"))


def _fields_plan(name: str, fields: list[str]):
    sql = "SELECT id, " + ", ".join(
        f"{_first('upper(ocr_text)', fv.ENTITY_PATTERNS[f])} AS {f}" for f in fields)

    @plan(name, sql + " FROM cat_text")
    def build(t: Tables) -> DataFrame:
        rows = t.text("id", "ocr_text").select("id", F.upper("ocr_text").alias("u"))
        return rows.select("id", *[ent.extract_field("u", f).alias(f) for f in fields])

    return build


x03 = _fields_plan("x03_extract_es_reference", ["es_reference"])
x04 = _fields_plan("x04_extract_part_serial", ["part_number", "serial_number"])
x05 = _fields_plan("x05_extract_ata_work_order", ["ata_chapter", "work_order_number"])
x06 = _fields_plan("x06_extract_sb_ad_item", ["sb_ad_reference", "item_number"])


@plan("x07_extract_date_effectivity", f"""
WITH e AS (SELECT id, {_first('upper(ocr_text)', fv.ENTITY_PATTERNS['document_date'])} AS document_date,
  nullif(regexp_replace({_first('upper(ocr_text)', fv.ENTITY_PATTERNS['effectivity'])}, '^\\s+|\\s+$', '', 'g'), '') AS effectivity FROM cat_text)
SELECT *, CASE WHEN regexp_full_match(document_date, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime(document_date, '%d/%m/%Y') AS DATE) END AS parsed_date FROM e""")
def x07(t: Tables) -> DataFrame:
    rows = t.text("id", "ocr_text").select("id", F.upper("ocr_text").alias("u"))
    return rows.select(
        "id", ent.extract_field("u", "document_date").alias("document_date"),
        ent.extract_field("u", "effectivity").alias("effectivity")).withColumn(
        "parsed_date", ent.parse_document_date("document_date"))


_F = {f: _first("u", p) for f, p in fv.ENTITY_PATTERNS.items()}
_ATA_CASE = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in fv.ATA_DESCRIPTIONS.items())
_RCT_NAME = _q(fv.RCT_FILENAME)
ENTITIES_SQL = f"""
en AS (SELECT id, coalesce({REGISTRATION_SQL},
    {_normal_sql(f"regexp_extract(n, {_RCT_NAME}, 1)")}, nullif(regexp_extract(n, {_RCT_NAME}, 1), '')) AS aircraft_registration,
  coalesce({_F['es_reference']}, nullif(regexp_extract(n, '(ES\\d{{6,8}})', 1), '')) AS es_reference,
  {_F['part_number']} AS part_number, {_F['serial_number']} AS serial_number,
  coalesce({_F['ata_chapter']}, 'ATA ' || nullif(regexp_extract(n, 'ATA[\\s-]?(\\d{{2}})', 1), '')) AS ata_chapter,
  {_F['work_order_number']} AS work_order_number,
  coalesce({_F['sb_ad_reference']}, nullif(regexp_extract(n, '(A3\\d{{2}}-\\d{{2}}-\\d{{3,5}}[A-Z]?)', 1), '')) AS sb_ad_reference,
  coalesce({_F['item_number']}, nullif(regexp_extract(n, '^(\\d{{3,4}})(?:\\.PDF)?$', 1), '')) AS item_number,
  {_F['document_date']} AS document_date,
  nullif(regexp_replace({_F['effectivity']}, '^\\s+|\\s+$', '', 'g'), '') AS effectivity,
  coalesce(nullif(regexp_extract(n, {_RCT_NAME}, 3), ''), {_first('u', fv.RCT_WP_PATTERNS)}) AS linked_wp,
  'CHECK_' || coalesce(nullif(regexp_extract(n, {_RCT_NAME}, 2), ''), {_first('u', fv.RCT_CHECK_PATTERNS)}) AS check_type
  FROM (SELECT id, filename, ocr_text, upper(ocr_text) AS u, upper(filename) AS n FROM cat_text))"""


@plan("x08_extract_entities", "WITH " + ENTITIES_SQL.strip()
      + f" SELECT *, CASE regexp_extract(ata_chapter, '(\\d{{2}})', 1) {_ATA_CASE} END AS ata_description FROM en")
def x08(t: Tables) -> DataFrame:
    rows = ent.with_entities(t.text("id", "filename", "ocr_text"), prefix="e_")
    return rows.select("id", *[F.col("e_" + f).alias(f) for f in ent.ENTITY_FIELDS])


@plan("a36_validation_report_extracted", "WITH " + ENTITIES_SQL.strip() + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f} <> '' AND regexp_full_match({f}, {_q(r)})) AS valid, "
    f"count(*) FILTER (WHERE {f} <> '' AND NOT regexp_full_match({f}, {_q(r)})) AS suspect, "
    f"count(*) FILTER (WHERE coalesce({f}, '') = '') AS empty FROM en" for f, r in fv.FORMAT_RULES.items()))
def a36_extracted(t: Tables) -> DataFrame:
    from docspark.operators.aggregates import validation_report

    rows = ent.with_entities(t.text("filename", "ocr_text"))
    return validation_report(rows, list(fv.FORMAT_RULES))


@plan("x09_rct_anchor", f"""
SELECT id, coalesce({_normal_sql(f"regexp_extract(upper(filename), {_RCT_NAME}, 1)")}, nullif(regexp_extract(upper(filename), {_RCT_NAME}, 1), '')) AS registration,
  'CHECK_' || coalesce(nullif(regexp_extract(upper(filename), {_RCT_NAME}, 2), ''), {_first('upper(ocr_text)', fv.RCT_CHECK_PATTERNS)}) AS check_type,
  coalesce(nullif(regexp_extract(upper(filename), {_RCT_NAME}, 3), ''), {_first('upper(ocr_text)', fv.RCT_WP_PATTERNS)}) AS linked_wp FROM cat_text""")
def x09(t: Tables) -> DataFrame:
    return t.text("id", "filename", "ocr_text").select(
        "id", ent.rct_anchor("ocr_text", "filename").alias("a")).select("id", "a.*")


@plan("x10_normalise_es", """
SELECT id, es_reference, coalesce(nullif(ltrim(regexp_replace(es_reference, '(?i)^ES\\s*', ''), '0'), ''), CASE WHEN es_reference IS NOT NULL THEN '0' END) AS number FROM cat_documents""")
def x10(t: Tables) -> DataFrame:
    return t.documents("id", "es_reference").withColumn(
        "number", ent.normalise_es("es_reference"))


@plan("x11_linked_wp_refs", """
WITH a AS (SELECT id, regexp_extract_all(array_to_string(regexp_extract_all(ocr_text, '(?i)(?:linked\\s+wp|wp\\s+linked)\\s*[:\\-]?\\s*((?:ES\\s*\\d{4,8}\\s*[/,]?\\s*)+)', 1), '|'), '(?i)ES\\s*\\d{4,8}') AS a,
  regexp_extract_all(ocr_text, '(?i)(?:linked|wp)\\s+.*?(ES\\s*\\d{4,8})', 1) AS b FROM cat_text),
c AS (SELECT id, unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS r, unnest(range(len(CASE WHEN len(a) > 0 THEN a ELSE b END))) AS pos FROM a),
d AS (SELECT id, replace(r, ' ', '') AS r, min(pos) AS pos FROM c GROUP BY 1, 2)
SELECT t.id, coalesce(string_agg(d.r, ',' ORDER BY d.pos), '') AS refs FROM cat_text t LEFT JOIN d ON d.id = t.id GROUP BY t.id""")
def x11(t: Tables) -> DataFrame:
    return t.text("id", "ocr_text").select(
        "id", F.array_join(ent.linked_wp_refs("ocr_text"), ",").alias("refs"))


def _profile_entity_sql() -> str:
    parts = []
    for name, (pattern, group) in fv.PROFILE_PATTERNS.items():
        users = [p for p, s in fv.PROFILES.items() if name in s["entities"]]
        test = f"pf.profile IN ({', '.join(map(_q, users))})"
        if name in fv.GENERIC_PROFILE_ENTITIES:
            test = f"({test} OR pf.profile = 'unknown')"
        parts.append(
            f"SELECT d.id, {_q(name)} AS entity, regexp_extract_all(d.ocr_text, {_q(pattern)}, {group}) AS f "
            f"FROM cat_text d JOIN pf ON pf.id = d.id WHERE {test}")
    return " UNION ALL ".join(parts)


@plan("x12_profile_entities", "WITH " + PROFILE_SQL.strip()
      + f", al AS ({_profile_entity_sql()}) SELECT id, entity, CAST(len(f) AS BIGINT) AS matches, f[1] AS first FROM al WHERE len(f) > 0")
def x12(t: Tables) -> DataFrame:
    rows = t.text("id", "rel_path", "ocr_text").select(
        "id", paths.profile_from_path("rel_path")["profile"].alias("profile"), "ocr_text")
    found = rows.select("id", F.explode(
        ent.profile_entities("ocr_text", "profile")).alias("entity", "f"))
    return found.select(
        "id", "entity", F.size("f").cast("bigint").alias("matches"),
        F.get("f", F.lit(0)).alias("first"))


def _compact_sql(field: str) -> str:
    joined = "(?i)" + "|".join(f"(?:{p})" for p in fv.COMPACT_ENTITY_PATTERNS[field])
    count = len(fv.COMPACT_ENTITY_PATTERNS[field])
    return "nullif(" + " || ".join(
        f"regexp_extract(ocr_text, {_q(joined)}, {g + 1})" for g in range(count)) + ", '')"


@plan("x13_compact_entities", f"""
WITH e AS (SELECT id, upper({_compact_sql('aircraft_registration')}) AS reg,
  regexp_replace(upper({_compact_sql('es_reference')}), '\\s', '', 'g') AS es_reference, {_compact_sql('ata_chapter')} AS ata_chapter,
  {_compact_sql('part_number')} AS part_number, {_compact_sql('serial_number')} AS serial_number, {_compact_sql('doc_ref')} AS doc_ref FROM cat_text)
SELECT id, CASE WHEN regexp_full_match(reg, 'IN[A-Z]') THEN 'TS-' || reg ELSE reg END AS aircraft_registration, es_reference, ata_chapter,
  part_number, serial_number, doc_ref FROM e""")
def x13(t: Tables) -> DataFrame:
    return t.text("id", "ocr_text").select(
        "id", ent.compact_entities_first("ocr_text").alias("e")).select("id", "e.*")


def _compact_all_sql(field: str) -> str:
    joined = _q("(?i)" + "|".join(f"(?:{p})" for p in fv.COMPACT_ENTITY_PATTERNS[field]))
    count = len(fv.COMPACT_ENTITY_PATTERNS[field])
    value = " || ".join(f"regexp_extract(m, {joined}, {g + 1})" for g in range(count))
    return (
        f"LEFT JOIN (SELECT id, string_agg(v, '|' ORDER BY pos) AS {field} FROM (SELECT id, v, min(pos) AS pos FROM ("
        f"SELECT id, pos, regexp_replace({value}, '^\\s+|\\s+$', '', 'g') AS v FROM (SELECT id, unnest(ms) AS m, unnest(range(len(ms))) AS pos "
        f"FROM (SELECT id, regexp_extract_all(ocr_text, {joined}) AS ms FROM cat_text))) WHERE v <> '' GROUP BY id, v) GROUP BY id) "
        f"AS t_{field} ON t_{field}.id = t.id")


@plan("x13_compact_entities_all", "SELECT t.id, " + ", ".join(
    f"coalesce(t_{f}.{f}, '') AS {f}" for f in fv.COMPACT_ENTITY_PATTERNS)
    + " FROM (SELECT id FROM cat_text) t " + " ".join(map(_compact_all_sql, fv.COMPACT_ENTITY_PATTERNS)))
def x13_all(t: Tables) -> DataFrame:
    rows = t.text("id", "ocr_text").select(
        "id", ent.compact_entities_all("ocr_text").alias("e"))
    return rows.select("id", *[
        F.array_join(F.col(f"e.{f}"), "|").alias(f) for f in fv.COMPACT_ENTITY_PATTERNS])


def spans_sql(airlines: tuple[str, ...] = ()) -> str:
    """Common tables up to `spans` (id, start, end, label): per pattern the
    matches with running sums as places, minus what an earlier one covers."""
    patterns = [(label, p) for label, many in fv.SPAN_PATTERNS.items() for p in many]
    if airlines:
        patterns.append(("AIRLINE", rf"\b({'|'.join(re.escape(a) for a in airlines)})\b"))
    parts = ["sp_text AS MATERIALIZED (SELECT id, coalesce(ocr_text, '') AS t FROM cat_text)"]
    before = "SELECT CAST(NULL AS BIGINT) AS id, 0 AS \"start\", 0 AS \"end\", '' AS label WHERE false"
    parts.append(f"sp_taken0 AS MATERIALIZED ({before})")
    for k, (label, pattern) in enumerate(patterns, 1):
        rx = _q(f"(?i){pattern}")
        parts.append(f"""sp_cand{k} AS MATERIALIZED (SELECT id, e - length(g) AS "start", e AS "end", {_q(label)} AS label FROM (
  SELECT id, g, CAST(sum(length(s) + length(m)) OVER (PARTITION BY id ORDER BY i) AS INT) AS e FROM (
    SELECT id, unnest(m) AS m, unnest(g) AS g, unnest(s[1:len(m)]) AS s, unnest(range(len(m))) AS i FROM (
      SELECT id, regexp_extract_all(t, {rx}, 0) AS m, regexp_extract_all(t, {rx}, 1) AS g, regexp_split_to_array(t, {rx}) AS s
      FROM sp_text WHERE regexp_matches(t, {rx}))))),
sp_taken{k} AS MATERIALIZED (SELECT * FROM sp_taken{k - 1} UNION ALL SELECT * FROM sp_cand{k} c WHERE NOT EXISTS (
  SELECT 1 FROM sp_taken{k - 1} o WHERE o.id = c.id AND o."start" < c."end" AND c."start" < o."end"))""")
    parts.append(f"spans AS (SELECT * FROM sp_taken{len(patterns)})")
    return ",\n".join(parts)


@plan("x14_annotate_spans", "WITH " + spans_sql() + ' SELECT id, "start", "end", label FROM spans')
def x14(t: Tables) -> DataFrame:
    spans = t.text("id", "ocr_text").select(
        "id", F.explode(annotate_spans()("ocr_text")).alias("s"))
    return spans.select("id", "s.start", "s.end", "s.label")


# Words of the given texts stand in for operator names.
_AIRLINES = ("MSN", "WORK ORDER", "DATE")


@plan("x14_annotate_spans_airlines", "WITH " + spans_sql(_AIRLINES) + " SELECT id, \"start\", \"end\" FROM spans WHERE label = 'AIRLINE'")
def x14_airlines(t: Tables) -> DataFrame:
    spans = t.text("id", "ocr_text").select(
        "id", F.explode(annotate_spans(_AIRLINES)("ocr_text")).alias("s"))
    return spans.filter("s.label = 'AIRLINE'").select("id", "s.start", "s.end")


_MSN_JSON = "coalesce(" + ", ".join(
    f"CASE WHEN regexp_full_match(trim(json_extract_string(extracted_entities, '$.{k}')), '\\d{{3,5}}') "
    f"THEN trim(json_extract_string(extracted_entities, '$.{k}')) END" for k in fv.MSN_ENTITY_KEYS) + ")"
MSN_SQL = f"coalesce({_MSN_JSON}, {_first('ocr_text', fv.MSN_PATTERNS)})"


@plan("x15_extract_msn", f"SELECT id, {MSN_SQL} AS msn FROM cat_text")
def x15(t: Tables) -> DataFrame:
    return t.text("id", "ocr_text", "extracted_entities").select(
        "id", registration.any_msn("extracted_entities", "ocr_text").alias("msn"))


_HITS = " + ".join(
    f"CAST(regexp_matches(ocr_text, {_q(p)}) AS INT)" for p in fv.QUICK_PATTERNS)


@plan("x16_content_score", f"""
SELECT id, least(({_HITS}) * 2.0::DOUBLE, 12.0) AS score, least(95.0::DOUBLE + least(({_HITS}) * 2.0::DOUBLE, 12.0), 99.0) AS native FROM cat_text""")
def x16(t: Tables) -> DataFrame:
    return t.text("id", "ocr_text").select(
        "id", ent.content_score("ocr_text").alias("score"),
        ent.native_confidence("ocr_text").alias("native"))


TOKENS_SQL = (
    "list_filter(regexp_split_to_array(concat_ws(' ', regexp_replace(lower(filename), '[_\\-.&]', ' ', 'g'), "
    "lower(coalesce(aircraft_registration, '')), lower(coalesce(es_reference, '')), lower(doc_type), "
    "lower(coalesce(category, '')), lower(ocr_text)), '\\s+'), lambda x: x <> '')")


@plan("x17_search_tokens", f"""
SELECT id, len(list_distinct({TOKENS_SQL})) AS tokens, list_contains({TOKENS_SQL}, 'linked') AS has_linked FROM cat_text""")
def x17(t: Tables) -> DataFrame:
    rows = t.text(
        "id", "filename", "aircraft_registration", "es_reference", "doc_type",
        "category", "ocr_text")
    tokens = text.search_tokens("filename", [
        "aircraft_registration", "es_reference", "doc_type", "category"], "ocr_text")
    return rows.select("id", tokens.alias("t")).select(
        "id", F.size("t").cast("bigint").alias("tokens"),
        F.array_contains("t", "linked").alias("has_linked"))


@plan("x18_date_parts", """
SELECT id, CAST(created_at AS DATE) AS archive_date, CAST(date_trunc('month', created_at) AS DATE) AS archive_month,
  CAST(date_trunc('week', created_at) AS DATE) AS archive_week, CAST(year(created_at) AS INT) AS year,
  CAST(month(created_at) AS INT) AS month, strftime(created_at, '%Y-%m') AS label FROM cat_documents""")
def x18(t: Tables) -> DataFrame:
    return t.documents("id", "created_at").select(
        "id", *date_parts(F.col("created_at")),
        F.date_format("created_at", "yyyy-MM").alias("label"))


_FORMATS = {k: v for k, v in fv.FORMAT_RULES.items() if k not in ("document_date", "effectivity")}


@plan("x19_format_check", "SELECT id, " + ", ".join(
    f"CASE WHEN {f} <> '' THEN regexp_full_match(trim({f}), {_q(r)}) END AS {f}" for f, r in _FORMATS.items())
    + " FROM cat_text")
def x19(t: Tables) -> DataFrame:
    return t.documents("id", *_FORMATS).select(
        "id", *[ent.format_valid(f, f).alias(f) for f in _FORMATS])


@plan("x19_profile_warnings", "WITH " + PROFILE_SQL.strip() + """,
w AS (SELECT d.id, pf.profile, array_to_string(list_filter([
    CASE WHEN pf.profile IN ('job_card', 'work_order') AND coalesce(d.aircraft_registration, '') = '' THEN 'missing aircraft_reg' END,
    CASE WHEN pf.profile IN ('job_card', 'amm', 'mel') AND coalesce(d.ata_chapter, '') = '' THEN 'missing ata_chapter' END,
    CASE WHEN pf.profile = 'cmm' AND coalesce(d.part_number, '') = '' THEN 'missing part_number' END,
    CASE WHEN pf.profile = 'service_bulletin' AND coalesce(d.sb_ad_reference, '') = '' THEN 'missing sb_number' END,
    CASE WHEN pf.profile = 'work_order' AND coalesce(d.work_order_number, '') = '' THEN 'missing work_order' END,
    CASE WHEN pf.profile IN ('job_card', 'work_order') AND d.aircraft_registration <> '' AND NOT regexp_full_match(d.aircraft_registration, 'TS-I[A-Z]{2}') THEN 'format aircraft_reg' END,
    CASE WHEN pf.profile IN ('job_card', 'amm') AND d.ata_chapter <> '' AND NOT regexp_full_match(d.ata_chapter, '\\d{2}-\\d{2}(-\\d{2})?') THEN 'format ata_chapter' END,
    CASE WHEN pf.profile = 'service_bulletin' AND d.sb_ad_reference <> '' AND NOT regexp_matches(d.sb_ad_reference, '^[A-Z]\\d{3}-\\d{2}-\\d{3,4}') THEN 'format sb_number' END
  ], lambda x: x IS NOT NULL), '|') AS warnings FROM cat_text d JOIN pf ON pf.id = d.id)
SELECT * FROM w""")
def x19_warnings(t: Tables) -> DataFrame:
    from docspark.operators.rules import profile_warnings

    fields = {
        "aircraft_reg": "aircraft_registration", "ata_chapter": "ata_chapter",
        "part_number": "part_number", "sb_number": "sb_ad_reference",
        "work_order": "work_order_number"}
    rows = t.text("id", "rel_path", *fields.values()).withColumn(
        "profile", paths.profile_from_path("rel_path")["profile"])
    return rows.select("id", "profile", F.array_join(
        profile_warnings("profile", {k: F.col(v) for k, v in fields.items()}), "|")
        .alias("warnings"))


@plan("x20_alpha_quality", """
WITH q AS (SELECT id, least(100.0::DOUBLE, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))
  * (length(regexp_replace(text, '[^\\pL]', '', 'g')) / greatest(length(text), 1)::DOUBLE) * 5) AS q FROM cat_documents)
SELECT id, RND[q;4] AS quality FROM q""")
def x20(t: Tables) -> DataFrame:
    return t.documents("id", "text").select(
        "id", rounded(text.alpha_quality("text"), 4).alias("quality"))


@plan("x21_arbitration_reasons", """
SELECT id, array_to_string(list_filter([CASE WHEN classifier_confidence < 0.85 THEN 'low_confidence' END,
  CASE WHEN category <> '' AND category <> doc_type THEN 'entity_conflict' END,
  CASE WHEN doc_type IN ('AD', 'SB') AND regexp_matches(upper(filename), 'ES0|ES1|ES2|WO-') THEN 'filename_conflict' END],
  lambda x: x IS NOT NULL), '|') AS reasons FROM cat_text""")
def x21(t: Tables) -> DataFrame:
    return t.documents(
        "id", "filename", "doc_type", "classifier_confidence", "category").select(
        "id", F.array_join(labels.arbitration_reasons(
            "filename", "doc_type", "classifier_confidence", "category"), "|")
        .alias("reasons"))


@plan("x22_json_entities", """
SELECT id, coalesce(array_to_string(list_sort(json_keys(extracted_entities)), ','), '') AS keys,
  coalesce(len(json_keys(extracted_entities)), 0) AS entities, contains(validation_warnings, 'immatriculation') AS mentions_registration FROM cat_text""")
def x22(t: Tables) -> DataFrame:
    keys = F.coalesce(
        F.json_object_keys("extracted_entities"), F.array().cast("array<string>"))
    mentions = F.exists(
        F.from_json("validation_warnings", "array<string>"),
        lambda w: w.contains("immatriculation"))
    return t.documents("id", "extracted_entities", "validation_warnings").select(
        "id", F.array_join(F.sort_array(keys), ",").alias("keys"),
        F.size(keys).cast("bigint").alias("entities"),
        mentions.alias("mentions_registration"))


@plan("x23_cosine_similarity", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.vec_id, b.vec_id AS other_id, list_dot_product(a.e, b.e)
    / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-8) AS c
  FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, other_id, RND[c;6] AS cosine FROM c""")
def x23(t: Tables) -> DataFrame:
    a = t.raw("embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"),
        F.col("x").alias("y"))
    return a.join(b, "vec_id").select(
        "vec_id", "other_id", rounded(cosine("x", "y"), 6).alias("cosine"))


@plan("x24_rank_order", """
SELECT d.id, e.user_id AS rank, d.doc_type FROM events e JOIN cat_documents d ON d.id = e.event_id""")
def x24(t: Tables) -> DataFrame:
    from docspark.operators.search import by_ranking

    ranking = t.raw("events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("rank"))
    return by_ranking(t.documents("id", "doc_type"), ranking)


@plan("x25_strip_long_path_prefix", "SELECT id, rel_path AS path FROM cat_text")
def x25(t: Tables) -> DataFrame:
    long = t.text("id", "rel_path").select(
        "id", F.concat(F.lit("  \\\\?\\"), "rel_path").alias("long"))
    return long.select("id", paths.strip_long_path_prefix("long").alias("path"))
