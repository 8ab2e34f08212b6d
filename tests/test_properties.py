"""Skew, idempotence and brute-force checks on small fixtures."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from docspark.operators import evaluation as ev
from docspark.operators import maintenance as fix
from docspark.operators.duplicates import copies_to_delete, exact_duplicates
from docspark.operators.scale import (
    contains_aggregate, contains_join, join_to_groups, majority_value, running_sums)
from docspark.operators.windows import segment_metadata, segment_pages
from docspark.sources import catalogue, files
from docspark.sources.files import archive_layout


def test_hot_key_join_is_complete(spark):
    rows = spark.range(6000).withColumn(
        "k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    joined = join_to_groups(rows, groups, ["k"], "n", "id")
    assert joined.count() == 6000
    assert joined.filter("k = 0").agg(F.max("first")).first()[0] == 0


def test_running_sums_cross_blocks(spark):
    random.seed(3)
    data = [(i, random.choice("ab"), random.randint(0, 9)) for i in range(500)]
    frame = spark.createDataFrame(data, "id long, p string, v long")
    found = running_sums(
        frame, ["id"], F.floor(F.col("id") / 7), {"s": F.col("v")}, ["p"])
    sums, expected = defaultdict(int), {}
    for i, p, v in data:
        sums[p] += v
        expected[i] = sums[p]
    assert {r.id: r.s for r in found.collect()} == expected


def test_contains_join_is_exact(spark):
    hay = spark.createDataFrame([("ES001042",), ("ES1042",), ("AB",)], "h string")
    needles = spark.createDataFrame([("1042",), ("ES",), ("B",), ("zz",)], "n string")
    found = {(r.h, r.n) for r in contains_join(hay, "h", needles, "n").collect()}
    assert found == {
        (h, n) for h in ("ES001042", "ES1042", "AB")
        for n in ("1042", "ES", "B", "zz") if n in h}


def test_majority_ties_take_least(spark):
    rows = spark.createDataFrame(
        [("k", "b"), ("k", "a"), ("k", "c"), ("k", "c"), ("m", "z"), ("m", "y")],
        "k string, v string")
    got = {r.k: (r.v, r.votes) for r in majority_value(rows, ["k"], "v").collect()}
    assert got == {"k": ("c", 2), "m": ("y", 1)}


def test_segments_of_a_long_bundle(spark):
    """One bundle over several blocks, against a plain loop."""
    pages = spark.range(10000).select(
        F.lit(1).alias("bundle_id"), F.col("id").alias("page_no"),
        F.when(F.col("id") % 37 == 5, "WORK ORDER\nES 001234").otherwise("text")
        .alias("page_text"))
    expected, segment = {}, 0
    for i in range(10000):
        if i == 0 or i % 37 == 5:
            segment += 1
        expected[i] = segment
    found = segment_pages(pages)
    assert {r.page_no: r.segment for r in found.collect()} == expected
    assert segment_metadata(found).count() == segment


def test_duplicates_with_a_hot_copy(spark):
    docs = spark.range(900).select("id", F.when(
        F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_duplicates(docs).collect()
    assert len(found) == 299 and {r.duplicate_of for r in found} == {0}


def test_best_copy_prefers_matching_folder(spark):
    rows = [("ORG/Divers/TS-INQ_A.pdf", "TS-INQ_A.pdf"),
            ("ORG/TS-INQ/deep/er/TS-INQ_A.pdf", "TS-INQ_A.pdf"),
            ("ORG/x/y/b.pdf", "b.pdf"), ("ORG/b.pdf", "b.pdf")]
    frame = spark.createDataFrame(
        [(p, n, 10.0) for p, n in rows], "path string, filename string, file_size_kb double")
    doomed = {r.path for r in copies_to_delete(frame).collect()}
    assert doomed == {"ORG/Divers/TS-INQ_A.pdf", "ORG/x/y/b.pdf"}


def test_split_keeps_proportions(spark):
    rows = spark.range(1000).select("id", F.when(
        F.col("id") < 333, "hot").when(F.col("id") < 336, "rare").otherwise("rest").alias("y"))
    split = ev.stratified_split(rows, "y")
    counts = {r.y: (r.t, r.n) for r in split.groupBy("y").agg(
        F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert counts == {"hot": (67, 333), "rest": (133, 664)}


def test_relabel_is_idempotent(spark, tables):
    docs = tables.documents(
        "id", "doc_type", "category", "filename", "manually_corrected")
    once = fix.relabel_by_pattern(docs)
    assert once.exceptAll(fix.relabel_by_pattern(once)).count() == 0


def test_upsert_is_idempotent(spark, tables):
    target = tables.documents("id", "doc_type", "status")
    source = target.filter("id % 2 = 0").withColumn("status", F.lit("X"))
    once = catalogue.upsert(target, source, ["id"])
    twice = catalogue.upsert(once, source, ["id"])
    assert once.exceptAll(twice).count() == 0
    assert catalogue.upsert(target, source, ["id"], "ignore").exceptAll(target).count() == 0


def test_archive_round_trip(spark, tables, tmp_path):
    docs = tables.documents("id", "aircraft_registration", "category", "doc_type")
    files.write_archive(docs, str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    assert stored.count() == docs.count()
    pending = archive_layout(docs).filter("area = 'pending'").count()
    assert stored.filter("area = 'pending'").count() == pending


def test_inventory_skips_unwanted(spark, tmp_path):
    for name in ("TS-INP/a.pdf", "TS-INP/~$b.pdf", "bin/c.pdf", "x/._d.pdf", "y/e.exe"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * 2048)
    found = files.archive_inventory(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.file_size_kb) for r in found] == [("TS-INP/a.pdf", 2.0)]


def test_texts_are_not_read_for_dashboards(spark, tables):
    from docspark.plans import PLANS

    for name in ("a01_global_kpis", "a17_coverage_by_aircraft", "j03_aircraft_with_counts"):
        plan = PLANS[name].build(tables)._jdf.queryExecution().executedPlan().toString()
        assert "text#" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_contains_aggregate_equals_pairs(spark):
    chance = random.Random(3)
    hay = [(f"ES{chance.randrange(10 ** 6):06d}", i % 5, i) for i in range(300)] + [(None, 1, 9), ("", 2, 9)]
    needles = [str(n) for n in (0, 1, 7, 12, 404, 9999)] + ["ES", "no", "1"]
    left = spark.createDataFrame(hay, "h string, g int, v long")
    right = spark.createDataFrame([(n,) for n in needles], "n string")
    got = {tuple(r) for r in contains_aggregate(
        left, "h", right, "n", [F.sum("v").alias("s"), F.min("v").alias("m")], by=["g"]).select("n", "g", "s", "m").collect()}
    want = {}
    for n in set(needles):
        for h, g, v in hay:
            if h and n in h:
                want.setdefault((n, g), []).append(v)
    assert got == {(n, g, sum(vs), min(vs)) for (n, g), vs in want.items()}


def test_a_one_digit_needle_is_no_hot_key(spark):
    """Each map task sends one row for the needle, however many hold it."""
    left = spark.range(40_000).selectExpr("concat('ES', lpad(cast(id AS STRING), 6, '1')) AS h", "id AS v").repartition(6)
    right = spark.createDataFrame([("1",)], "n string")
    found = contains_aggregate(left, "h", right, "n", [F.sum("v").alias("s"), F.count("*").alias("c")])
    row = found.first()
    assert row["c"] > 30_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Partial sums stand before the only exchange by the needle.
    assert plan.index("partial_sum(v") > plan.index("Exchange hashpartitioning(n")
    assert "SortMergeJoin [n" not in plan.split("partial_sum(v")[1]


def test_a_group_is_the_whole_match_only_between_boundaries():
    from docspark.functions.spans import _is_whole

    assert _is_whole(r"\b(ES\s?\d{6})\b") and _is_whole(r"\b(a (?:b|[)])+c)\b")
    assert not any(map(_is_whole, (r"\bMSN\s*(\d+)\b", r"\b(a)(b)\b", r"\b(a|b)x(c)\b", r"\b(?:a)(b)\b", r"(a)")))
