"""Tables and dashboards under change: merge on read (S4, C1), pages by rank
(L1), dashboards from deltas (A1, A17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators import aggregates as agg
from docspark.operators.ranks import RankIndex
from docspark.operators.views import CellView
from docspark.plans.registry import plan
from docspark.sources.bindings import Tables
from docspark.sources.keyed import KeyedTable

_FIELDS = ["id", "doc_type", "status", "aircraft_registration"]


@plan("s04_delta_upsert", """
WITH b AS (SELECT id, doc_type, status, aircraft_registration FROM cat_documents WHERE id % 100 <> 7)
SELECT id, CASE WHEN id % 50 = 2 THEN 'Specs' ELSE doc_type END AS doc_type,
  CASE WHEN id % 200 = 1 THEN 'PENDING' WHEN id % 100 = 1 THEN 'ERROR' ELSE status END AS status, aircraft_registration FROM b
UNION ALL SELECT -id - 1, 'Other', 'PENDING', NULL FROM cat_documents WHERE id % 100 = 3""")
def s04_delta(t: Tables) -> DataFrame:
    docs = t.documents(*_FIELDS)
    table = KeyedTable.create(docs, "id")
    table.put(docs.filter("id % 100 = 1").withColumn("status", F.lit("ERROR")))
    table.patch(docs.filter("id % 50 = 2").select("id", F.lit("Specs").alias("doc_type")))
    # Half of these are there already and stay as they are.
    fresh = docs.filter("id % 100 = 3").select(
        F.explode(F.array(-F.col("id") - 1, F.col("id"))).alias("id"), F.lit("Other").alias("doc_type"),
        F.lit("PENDING").alias("status"))
    table.insert_new(fresh)
    table.compact()
    table.delete(docs.filter("id % 100 = 7"))
    table.patch(docs.filter("id % 200 = 1").select("id", F.lit("PENDING").alias("status")))
    return table.read()


@plan("l01_paginate_deep", """
SELECT id, doc_type, ocr_confidence, CAST(row_number() OVER (ORDER BY ocr_confidence DESC, id) AS BIGINT) AS rank
FROM cat_wide ORDER BY ocr_confidence DESC, id LIMIT 25 OFFSET 10000""")
def l01_deep(t: Tables) -> DataFrame:
    rows = t.wide().select("id", "doc_type", "ocr_confidence")
    return RankIndex(rows, [F.desc("ocr_confidence"), F.asc("id")]).page(10_000, 25)


def _changed(t: Tables, view: CellView, docs: DataFrame) -> CellView:
    """All documents, then some rewritten, some taken off, some added again."""
    view.apply(added=docs.filter("id % 4 <> 0"))
    view.apply(added=docs.filter("id % 4 = 0").withColumn("status", F.lit("ERROR")))
    old = docs.filter("id % 4 = 0").withColumn("status", F.lit("ERROR"))
    view.apply(added=docs.filter("id % 4 = 0"), removed=old)
    gone = docs.filter("id % 9 = 5")
    view.apply(removed=gone)
    view.compact()
    view.apply(added=gone.filter("id % 2 = 1"))
    return view


_LEFT = "SELECT * FROM cat_documents WHERE NOT (id % 9 = 5 AND id % 2 = 0)"


@plan("a01_kpis_from_deltas", f"""
SELECT count(*) AS total_documents, count(*) FILTER (WHERE status = 'ARCHIVED') AS archived,
  count(*) FILTER (WHERE status = 'ERROR') AS errors, count(*) FILTER (WHERE is_critical) AS critical,
  count(*) FILTER (WHERE needs_review) AS needs_review, count(embedding) AS with_embedding,
  RND[MEAN[ocr_confidence];1] AS avg_ocr, RND[MEAN[classifier_confidence];2] AS avg_classifier,
  RND[TOTAL[file_size_kb] / 1024;1] AS total_mb,
  count(DISTINCT aircraft_registration) AS aircraft, count(DISTINCT es_reference) AS checks
FROM ({_LEFT}) d""")
def a01_deltas(t: Tables) -> DataFrame:
    docs = t.documents(
        "id", "aircraft_registration", "es_reference", "status", "is_critical", "needs_review", "embedding",
        "ocr_confidence", "classifier_confidence", "file_size_kb")
    view = CellView(t.spark, ["aircraft_registration", "es_reference"], agg.kpi_cells)
    return agg.kpis_of_cells(_changed(t, view, docs).read())


@plan("a17_coverage_from_deltas", f"""
WITH kept AS ({_LEFT})
SELECT a.registration AS aircraft, count(d.id) AS total_docs, count(DISTINCT d.doc_type) AS nb_types,
  coalesce(RND[MEAN[d.ocr_confidence];1], 0) AS avg_ocr,
  count(d.id) FILTER (WHERE d.manually_corrected) AS validated,
  RND[count(DISTINCT d.doc_type) / CAST((SELECT count(DISTINCT doc_type) FROM kept) AS DOUBLE) * 100;0] AS coverage_pct
FROM cat_aircraft a LEFT JOIN kept d ON d.aircraft_registration = a.registration GROUP BY a.registration""")
def a17_deltas(t: Tables) -> DataFrame:
    docs = t.documents("id", "aircraft_registration", "doc_type", "status", "ocr_confidence", "manually_corrected")
    view = CellView(t.spark, ["aircraft_registration", "doc_type"], agg.coverage_cells)
    return agg.coverage_of_cells(_changed(t, view, docs).read(), t.aircraft())
