"""No row is lost to a cap, a null key or a table made of part files."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.functions.vectors import cosine_literal
from docspark.operators import evaluation as ev
from docspark.operators import maintenance as fix
from docspark.operators.filters import list_documents
from docspark.operators.ocr_fusion import document_text
from docspark.operators.scale import join_to_groups, running_sums
from docspark.operators.windows import context_budget, running_statistics, segment_pages
from docspark.streaming import streams as st

SF_DIR = "/root/testdata/sf0.001"


def test_budget_takes_all_short_passages(spark):
    rows = spark.range(30).select("id", F.lit("x").alias("t"))
    assert context_budget(rows, [F.asc("id")], F.length("t"), 100).count() == 30


def test_budget_cuts_at_first_row_over(spark):
    random.seed(2)
    lengths = [random.choice([0, 1, 5, 40]) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "id long, n long").repartition(7)
    want, used = [], 0
    for i, n in enumerate(lengths):
        used += n
        if used <= 600:
            want.append((i, n, i + 1))
    got = context_budget(frame, [F.asc("id")], F.col("n"), 600)
    assert sorted(tuple(r) for r in got.select("id", "n", "rank").collect()) == want


@pytest.mark.parametrize("width", [64, 200])
def test_vectors_of_other_length_have_no_score(spark, width):
    rows = spark.createDataFrame(
        [([1.0] * width,), ([1.0] * (width - 1),), ([1.0] * (width + 1),), (None,)], "v array<double>")
    got = [r[0] for r in rows.select(cosine_literal("v", [2.0] * width)).collect()]
    assert got[0] == pytest.approx(1.0) and got[1:] == [None, None, None]


def test_long_document_is_one_row(spark):
    pages = spark.range(1001).select(
        F.lit(1).alias("document_id"), F.col("id").alias("page_no"), F.concat(F.lit("p"), "id").alias("text"))
    rows = document_text(pages).collect()
    assert len(rows) == 1 and rows[0].text == "\n\n".join(f"p{i}" for i in range(1001))
    assert document_text(pages, pages_per_part=500).count() == 3


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(1, None, 2), (None, "a", 3), (None, None, 4), (2, "a", 5)], "id long, p string, v long")
    sums = running_sums(rows, ["id"], F.floor(F.col("id") / 10), {"s": F.col("v")}, ["p"])
    assert sorted((r.v, r.s) for r in sums.collect()) == [(2, 6), (3, 3), (4, 4), (5, 8)]
    groups = rows.groupBy("p").agg(F.count("*").alias("n"))
    assert join_to_groups(rows, groups, ["p"], "n", "v").count() == 4
    log = spark.createDataFrame([(None, "ok", 1.0), (10**12, "error", 2.0), (5, "ok", 3.0)], "id long, status string, duration_s double")
    assert sorted(r.processed for r in running_statistics(log).collect()) == [1, 2, 3]
    pages = spark.createDataFrame([(None, 0, "x"), (None, 1, "y"), (1, 0, "z")], "bundle_id long, page_no long, page_text string")
    assert segment_pages(pages).count() == 3
    truths = spark.createDataFrame([(None, "a"), ("a", "a"), (None, "b")], "y_true string, y_pred string")
    assert sorted(r.row_pct for r in ev.confusion_matrix(truths).collect()) == [50.0, 50.0, 100.0]
    labelled = spark.range(40).select("id", F.expr("CASE WHEN id % 2 = 0 THEN 'x' END").alias("c"))
    split = ev.stratified_split(labelled, "c").groupBy("c", "is_test").count().collect()
    assert sorted((str(r.c), r.is_test, r["count"]) for r in split) == [
        ("None", False, 16), ("None", True, 4), ("x", False, 16), ("x", True, 4)]


def test_last_patch_wins(spark):
    docs = spark.createDataFrame([(1, "A", False), (2, "B", False)], "id long, doc_type string, manually_corrected boolean")
    patches = spark.createDataFrame([(1, "Z", 1), (1, "C", 2), (1, None, 3)], "id long, doc_type string, seq long")
    got = sorted(tuple(r) for r in fix.apply_patches(docs, patches, ["doc_type"], "seq").collect())
    assert got == [(1, "C", True), (2, "B", False)]
    assert fix.apply_patches(docs, patches, ["doc_type"]).filter("id = 1").first().doc_type == "Z"
    aircraft = spark.createDataFrame([(1, "old")], "id long, model string")
    changes = spark.createDataFrame([(1, "model", "x", 2), (1, "model", "y", 1)], "id long, field string, value string, seq long")
    assert fix.patch_aircraft(aircraft, changes, "seq").first().model == "x"
    assert fix.patch_aircraft(aircraft, changes).first().model == "y"


def test_list_is_sorted(spark):
    docs = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, filename string")
    assert [r.id for r in list_documents(docs, sort="filename").collect()] == [4, 1, 3, 2]
    assert [r.id for r in list_documents(docs, sort="filename", descending=False).collect()] == [3, 1, 4, 2]


def test_stream_reads_part_files(spark, tmp_path):
    rows = spark.range(90).select("id", F.timestamp_seconds(F.col("id")).alias("at"), (F.col("id") % 30).cast("string").alias("path"))
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = st.file_stream(spark, str(tmp_path), "events.parquet", rows.schema, max_files=1)
    st.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(90))
    again = st.file_stream(spark, str(tmp_path), "events.parquet", rows.schema, max_files=1)
    st.drain(st.in_flight_dedup(again, "path", "at", "1 hour"), str(tmp_path / "once"), str(tmp_path / "state2"))
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "once")).collect()) == sorted(str(i) for i in range(30))


def test_inventory_of_a_folder(spark, tmp_path):
    from docspark.sources.files import archive_inventory

    for name in ("a.pdf", "b/C.DOCX", ".git/d.pdf", "lib/e.pdf", "~$f.doc", "._g.doc", "h.exe"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * 512)
    got = {(r.rel_path, r.filename, r.extension, r.file_size_kb) for r in archive_inventory(spark, str(tmp_path)).collect()}
    assert got == {("a.pdf", "a.pdf", "pdf", 0.5), ("b/C.DOCX", "C.DOCX", "docx", 0.5)}


@pytest.mark.parametrize("name", ["s08_export_annotations", "m17_annotator_agreement"])
def test_texts_are_annotated_in_one_scan(spark, name, monkeypatch):
    """Before, the filter on spans and the second annotator annotated every
    text again: the expression stood twice in what was executed."""
    from docspark.plans import PLANS, classification, io

    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    count = F.udf(seen, "string")
    for module in (classification, io):
        annotate = module.annotate_spans
        monkeypatch.setattr(module, "annotate_spans", lambda annotate=annotate, **options: (
            lambda text: annotate(**options)(F.coalesce(count(text), F.lit("")))))
    rows = PLANS[name].run(spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert rows and read.value <= docs
