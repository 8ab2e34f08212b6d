"""Inverted lists against plain similarity to every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.indexes.vectors import UNLISTED, VectorIndex, recall
from docspark.operators.search import vector_search

ROWS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("kind", T.StringType())])


@pytest.fixture(scope="module")
def points():
    """Clusters of uneven size; one holds a third of all rows."""
    random = np.random.Generator(np.random.PCG64(1))
    centres = random.normal(0, 1, (12, 16))
    sizes = [400] + [73] * 11
    found = [c + random.normal(0, .35, 16) for c, s in zip(centres, sizes, strict=True) for _ in range(s)]
    rows = [(i, [float(np.float32(x)) for x in v], "ab"[i % 2]) for i, v in enumerate(found)]
    odd = [(5000, None, "a"), (5001, [0.0] * 16, "a"), (5002, [1.0, 2.0], "b"), (5003, [1.0] * 15 + [None], "a")]
    return [*rows, *[(6000 + i, rows[7][1], "b") for i in range(40)], rows[3], *odd]


@pytest.fixture(scope="module")
def index(spark, points):
    return VectorIndex.build(spark.createDataFrame(points, ROWS).repartition(4), payload=["kind"], lists=24)


def test_every_row_with_an_embedding_is_indexed(index, points):
    assert index.rows.count() == sum(v is not None for _, v, _ in points)
    assert {r["id"] for r in index.rows.filter(F.col("list") == UNLISTED).collect()} == {5001, 5002, 5003}


@pytest.mark.parametrize("k,minimum", [(1, None), (25, .1), (60, .3), (5000, None)])
def test_exact_search_equals_the_scan(spark, index, points, k, minimum):
    docs = spark.createDataFrame(points, ROWS)
    for at in (0, 7, 500):
        vector = points[at][1]
        want = vector_search(docs, vector, k, minimum=-2.0 if minimum is None else minimum).collect()
        got = index.nearest(vector, k, minimum=-2.0 if minimum is None else minimum).collect()
        assert [(r["id"], r["similarity"]) for r in got] == [(r["id"], r["sem_score"]) for r in want]


def test_search_by_payload(spark, index, points):
    vector = points[30][1]
    want = vector_search(spark.createDataFrame(points, ROWS).filter("kind = 'b'"), vector, 9, -2.0).collect()
    got = index.nearest(vector, 9, minimum=-2.0, where=F.col("kind") == "b").collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]


def test_a_search_reads_the_lists_it_needs(index, points):
    read = index.nearest(points[500][1], 5, probes=3)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan or "PartitionFilters: [isnotnull(list#" in plan
    lists = index.probed(points[500][1], 5, None, lambda held: index.rows_of(held).withColumn("similarity", F.lit(.95)).limit(5))
    assert 0 < len(lists) < len(index.numbers)


def test_exact_batch_equals_brute_force_and_probing_recalls_it(spark, index, points):
    clean = [(i, v) for i, v, _ in points if v is not None and len(v) == 16 and None not in v and any(v)]
    queries = [(i, v) for i, v in clean if i % 20 == 0][:60]
    frame = spark.createDataFrame(queries, "query_id long, vector array<float>")
    e = np.array([v for _, v in clean])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    want = {}
    for i, v in queries:
        s = np.round(e @ (np.array(v) / np.linalg.norm(v)), 6)
        order = sorted(range(len(clean)), key=lambda j: (-s[j], clean[j][0]))[:10]
        want[i] = [round(float(s[j]), 5) for j in order]
    exact = index.nearest_of_each(frame, 10)
    got = {}
    for r in exact.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(round(r["similarity"], 5))
    assert set(got) == set(want)
    for i, sims in want.items():
        assert np.allclose(got[i], sims, atol=2e-5)
    assert recall(index.nearest_of_each(frame, 10, probes=6), exact) >= 0.9


def test_recall_on_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = VectorIndex.build(rows)
    exact = index.nearest_of_each(queries, 10)
    assert exact.count() == 10 * queries.count()
    # The given vectors have no clusters, so many lists must be probed; how
    # many is learned on other rows than those asked afterwards.
    learned = rows.filter("id % 20 = 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    probes = index.probes_for(learned, 10, 0.95)
    assert probes < len(index.numbers)
    assert recall(index.nearest_of_each(queries, 10, probes=probes), exact) >= 0.9


def test_added_rows_are_found(spark, points):
    frame = spark.createDataFrame(points, ROWS)
    index = VectorIndex.build(frame.filter("id % 3 <> 0"), payload=["kind"], lists=10).add(frame.filter("id % 3 = 0"))
    assert index.rows.count() == sum(v is not None for _, v, _ in points)
    assert index.rows.groupBy("list").agg(F.max("angle").alias("a")).join(index.lists, "list").filter("a > radius").isEmpty()
    vector = points[0][1]
    want = [r["id"] for r in vector_search(frame, vector, 20, -2.0).collect()]
    assert [r["id"] for r in index.nearest(vector, 20, minimum=-2.0).collect()] == want


def test_empty_and_odd_tables(spark):
    none = VectorIndex.build(spark.createDataFrame([], ROWS))
    assert none.nearest([1.0, 2.0], 3).collect() == []
    one = VectorIndex.build(spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, None, "b")], ROWS))
    found = one.nearest([3.0, 4.0], 3).collect()
    assert [(r["id"], math.isclose(r["similarity"], 1)) for r in found] == [(1, True)]
    assert one.add(spark.createDataFrame([(9, [4.0, 3.0], "z")], ROWS)).nearest([4.0, 3.0], 1).first()["id"] == 9


def test_batch_of_copies_and_many_blocks_equals_brute_force(spark, monkeypatch):
    """Ties in the rounded similarity go by id, in whatever group they are;
    before, every pair was an interpreted product (10 000 rows took minutes)."""
    from docspark.indexes import vectors

    monkeypatch.setattr(vectors, "GROUP_QUERIES", 16)
    monkeypatch.setattr(vectors, "GROUP_ROWS", 100)
    monkeypatch.setattr(vectors, "CHUNK_QUERIES", 5)
    random = np.random.Generator(np.random.PCG64(4))
    distinct = random.normal(0, 1, (90, 8)).astype(np.float32).round(1)
    e = distinct[random.integers(0, 90, 3000) * (random.random(3000) < .7).astype(int)].astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "id long, embedding array<float>").repartition(5)
    asked = frame.filter("id % 40 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in VectorIndex.build(frame).nearest_of_each(asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    e = e.astype(np.float32).astype(float)
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    assert len(got) == 75
    for i, found in got.items():
        s = np.round(unit @ unit[i], 6)
        order = sorted(range(len(e)), key=lambda j: (-s[j], j))[:10]
        assert found == [(j, pytest.approx(s[j], abs=1e-9)) for j in order]


def test_batch_multiplies_blocks_in_tasks(spark, index, points):
    asked = spark.createDataFrame([(1, points[0][1])], "query_id long, vector array<float>")
    plan = index.nearest_of_each(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
