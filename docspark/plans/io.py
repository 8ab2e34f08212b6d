"""Source and sink queries (S). Writers write below the shared folder and the
query reads the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.spans import annotate_spans
from docspark.operators import evaluation as ev
from docspark.plans.classification import _CLASS_SQL
from docspark.plans.registry import plan
from docspark.session import scratch_path, stored
from docspark.sources import catalogue, files
from docspark.sources.bindings import Tables


# Paths as a walk would list them: some hidden, foreign, temporary or shouting.
_LISTED = """CASE id % 9 WHEN 0 THEN '.trash/' || rel_path WHEN 1 THEN 'Program Files/' || rel_path
  WHEN 2 THEN '__MACOSX/' || rel_path WHEN 3 THEN 'Old/~$' || filename WHEN 4 THEN rel_path || '.tmp'
  WHEN 5 THEN upper(rel_path) ELSE rel_path END"""


@plan("s01_archive_inventory", f"""
WITH l AS (SELECT {_LISTED} AS rel_path, file_size_kb FROM cat_text),
n AS (SELECT *, string_split(rel_path, '/')[-1] AS filename FROM l)
SELECT rel_path, filename, lower(regexp_extract(filename, '[.]([^.]+)$', 1)) AS extension, file_size_kb FROM n
WHERE lower(regexp_extract(filename, '[.]([^.]+)$', 1)) IN ({', '.join(repr(e) for e in fv.INVENTORY_EXTENSIONS)})
  AND len(list_filter(string_split(rel_path, '/')[1:-2], lambda p: starts_with(p, '.') OR p = '__MACOSX'
    OR lower(p) IN ({', '.join(repr(e) for e in fv.EXCLUDED_DIRECTORIES)}))) = 0
  AND NOT starts_with(filename, '~$') AND NOT starts_with(filename, '._')""")
def s01(t: Tables) -> DataFrame:
    listed = t.text("id", "rel_path", "filename", "file_size_kb").select(
        F.expr(_LISTED).alias("rel_path"), "file_size_kb")
    return files.wanted_files(listed).select(
        "rel_path", "filename", "extension", "file_size_kb")


@plan("s02_read_catalogue", """
SELECT id, doc_type, ocr_confidence, coalesce(quality = 0, false) AS needs_review, false AS is_duplicate, 0 AS ocr_pages,
  '[]' AS validation_warnings, coalesce(CASE WHEN lang = 'en' THEN status END, 'PENDING') AS status, created_at FROM cat_documents""")
def s02(t: Tables) -> DataFrame:
    stored = t.documents(
        "id", "doc_type", "ocr_confidence", "quality", "status", "lang", "created_at")
    folder = scratch_path(t.spark, "catalogue")
    stored.select(
        "id", "doc_type", "ocr_confidence", (F.col("quality") == 0).alias("needs_review"),
        F.when(F.col("lang") == "en", F.col("status")).alias("status"), "created_at",
    ).write.parquet(f"{folder}/documents")
    return catalogue.read_catalogue(t.spark, folder, "documents").select(
        "id", "doc_type", "ocr_confidence", "needs_review", "is_duplicate", "ocr_pages",
        "validation_warnings", "status", "created_at")


@plan("s03_write_archive", """
SELECT id, es_reference, CASE WHEN aircraft_registration IS NULL THEN 'pending' ELSE 'archive' END AS area, coalesce(aircraft_registration, 'UNKN') AS aircraft,
  coalesce(category, 'Divers') AS folder, doc_type AS kind FROM cat_documents""")
def s03(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "archive")
    files.write_archive(t.documents(
        "id", "es_reference", "aircraft_registration", "category", "doc_type"), path)
    return t.spark.read.parquet(path).select("id", "es_reference", *files.ARCHIVE_LAYOUT)


def _labels(t: Tables) -> DataFrame:
    return t.raw("labels").select(
        F.col("doc_id").alias("id"), F.lit("label").alias("doc_type"),
        F.col("quality").cast("string").alias("status"))


@plan("s04_upsert_update", """
SELECT coalesce(l.doc_id, d.id) AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'label' ELSE d.doc_type END AS doc_type,
  CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS VARCHAR) ELSE d.status END AS status
FROM (SELECT * FROM cat_documents WHERE lang = 'en') d FULL JOIN labels l ON l.doc_id = d.id""")
def s04(t: Tables) -> DataFrame:
    target = t.documents("id", "doc_type", "status", "lang").filter("lang = 'en'").drop("lang")
    return catalogue.upsert(target, _labels(t), ["id"], "update")


@plan("s04_upsert_ignore", """
SELECT coalesce(d.id, l.doc_id) AS id, CASE WHEN d.id IS NOT NULL THEN d.doc_type ELSE 'label' END AS doc_type,
  CASE WHEN d.id IS NOT NULL THEN d.status ELSE CAST(l.quality AS VARCHAR) END AS status
FROM (SELECT * FROM cat_documents WHERE lang = 'en') d FULL JOIN labels l ON l.doc_id = d.id""")
def s04_ignore(t: Tables) -> DataFrame:
    target = t.documents("id", "doc_type", "status", "lang").filter("lang = 'en'").drop("lang")
    return catalogue.upsert(target, _labels(t), ["id"], "ignore")


@plan("s05_insert_where_not_exists", """
SELECT es_reference, check_type FROM cat_checks UNION ALL
SELECT es_reference, 'Check A' FROM (SELECT DISTINCT es_reference FROM cat_documents WHERE es_reference IS NOT NULL)
WHERE es_reference NOT IN (SELECT es_reference FROM cat_checks)""")
def s05(t: Tables) -> DataFrame:
    source = t.documents("es_reference").dropna().distinct().withColumn(
        "check_type", F.lit("Check A"))
    return catalogue.insert_where_not_exists(
        t.checks().select("es_reference", "check_type"), source, ["es_reference"])


@plan("s06_export_csv", """
SELECT CAST(id AS VARCHAR) AS "ID", filename AS "Fichier", aircraft_registration AS "Avion", doc_type AS "Type",
  category AS "Catégorie", es_reference AS "Réf_ES", ata_chapter AS "ATA",
  CASE WHEN ocr_confidence <> 0 THEN printf('%.1f', ocr_confidence) || '%' END AS "OCR",
  CASE WHEN manually_corrected THEN 'Oui' ELSE 'Non' END AS "Corrigé", strftime(created_at, '%Y-%m-%d') AS "Date" FROM cat_text""")
def s06(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "export")
    files.export_csv(t.documents(
        "id", "filename", "aircraft_registration", "doc_type", "category",
        "es_reference", "ata_chapter", "ocr_confidence", "manually_corrected",
        "created_at"), path)
    columns = "ID Fichier Avion Type Catégorie Réf_ES ATA OCR Corrigé Date".split()
    schema = ", ".join(f"`{c}` string" for c in columns)
    read = t.spark.read.schema(schema).option("header", "true").csv(path)
    return read.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])


@plan("s07_write_metrics_report", "WITH " + _CLASS_SQL.strip() + """
SELECT label, support, RND[p;4] AS precision, RND[r;4] AS recall, RND[f;4] AS f1,
  (SELECT RND[sum(hits) / sum(support)::DOUBLE;4] FROM f1) AS accuracy FROM f1""")
def s07(t: Tables) -> DataFrame:
    path, rows = scratch_path(t.spark, "metrics"), t.predictions()
    files.write_metrics_report(
        ev.classification_metrics(rows), ev.classification_report(rows), path)
    schema = """accuracy double, per_class map<string,
        struct<precision:double,recall:double,f1:double,support:bigint>>"""
    return t.spark.read.schema(schema).json(path).select(
        "accuracy", F.explode("per_class").alias("label", "s")).select(
        "label", "s.support", "s.precision", "s.recall", "s.f1", "accuracy")


@plan("s08_export_annotations")
def s08(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "annotations")
    # Written once: the filter on spans would annotate every text again.
    annotated = stored(t.text("id", "doc_type", "ocr_text").filter(
        F.length("ocr_text") > 100).withColumn("entities", annotate_spans()("ocr_text")), "annotated")
    files.export_annotations(annotated, path)
    schema = """id bigint, doc_type string, split string,
        entities array<struct<start:int,end:int,label:string>>"""
    written = t.spark.read.schema(schema).json(path)
    return written.select("split", F.explode("entities.label").alias("label")).groupBy(
        "split", "label").agg(F.count("*").alias("spans"))


@plan("s09_read_path_list", """
SELECT rel_path AS path, CASE WHEN rel_path IN (SELECT rel_path FROM cat_text WHERE status = 'ARCHIVED') THEN 'found' ELSE 'error' END AS state FROM cat_text""")
def s09(t: Tables) -> DataFrame:
    path, rows = scratch_path(t.spark, "paths"), t.text("rel_path", "status")
    rows.select("rel_path").write.text(path)
    inventory = rows.filter("status = 'ARCHIVED'").select(F.col("rel_path").alias("path"))
    return files.targeted_import(files.read_path_list(t.spark, path), inventory)
