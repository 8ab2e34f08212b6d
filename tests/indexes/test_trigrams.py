"""The trigram index against a scan of the texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.indexes.trigrams import TrigramIndex, conditions, search_text

ROWS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("block", T.StringType())])


@pytest.fixture(scope="module")
def rows():
    random = np.random.Generator(np.random.PCG64(2))
    words = ["alpha", "Beta", "ES0010", "éclair", "x", "", "100%", "a_b", "中文字", "TS-INA", "zz top", "q7"]
    found = [(i, f"{i:04d}.pdf", " ".join(random.choice(words, random.integers(0, 12))), "k") for i in range(600)]
    long = "lorem ipsum " * 20000 + "needle at the very end of a long text"
    return [*found, (700, None, None, None), (701, "", "", ""), (702, "A", "b", "z"), (703, "long", long, ""), found[5], found[5],
            *[(800 + i, "same", "one text in many rows", None) for i in range(300)]]


@pytest.fixture(scope="module")
def index(spark, rows):
    docs = spark.createDataFrame(rows, ROWS).repartition(3).withColumnRenamed("block", "kind")
    return TrigramIndex.build(docs, ["name", "body"], block_docs=64)


NEEDLES = ["a", "A", "q", "7", "es", "q7", "x ", "ES0", "es00", "ES0010", "éCl", "中", "中文字", "%", "100%", "a_b", "0%0", "pdf",
           "zz top", "needle at the very end of a long text", "one text in many rows", "no such thing", "top alpha", "", "\u0001",
           "b", "lorem ipsum lorem ipsum lorem ipsum lorem"]


@pytest.mark.parametrize("needle", NEEDLES)
def test_equals_the_scan(index, rows, needle):
    low = needle.lower()
    scan = index.texts.withColumn("t", search_text(["name", "body"]))
    test = F.col("t").like(f"%{low}%") if "%" in low or "_" in low else F.contains("t", F.lit(low))
    want = sorted(r["id"] for r in scan.filter(test).collect())
    assert sorted(r["id"] for r in index.containing(needle).collect()) == want


def test_all_rows_and_columns_stay(index, rows):
    assert index.texts.count() == len(rows)
    assert set(index.containing("alpha").columns) == {"id", "name", "body", "kind"}
    assert index.postings.filter(F.size("slots") != F.col("n")).isEmpty()
    assert index.texts.groupBy("block").count().agg(F.max("count")).first()[0] <= 64


def test_candidates_shrink_with_the_needle(index, rows):
    sizes = [index.candidates([n]).count() for n in ("e", "nee", "needle at the")]
    assert sizes[0] > sizes[1] >= sizes[2] == 1
    assert len(index.shards_of(conditions("q7"))) == 1
    assert len(index.shards_of(conditions("es00"))) == 2
    plan = index._named(conditions("q7"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan


def test_several_needles_and_none(index):
    got = {r["id"] for r in index.candidates(["q7", "needle at the"]).collect()}
    assert {r["id"] for r in index.containing("q7").collect()} | {703} <= got
    assert index.candidates([]).count() == 0


def test_conditions():
    assert conditions("ab") == ["ab"] and conditions("abcd") == ["abc", "bcd"] and conditions("") == []
    assert conditions("ab%abc_z") == ["abc", "z"]


def test_empty_table(spark):
    index = TrigramIndex.build(spark.createDataFrame([], ROWS).drop("block"), ["name", "body"])
    assert index.containing("abc").collect() == [] and index.containing("").collect() == []


def test_postings_are_made_in_tasks_and_equal_brute_force(spark, monkeypatch):
    """Before, a row for every trigram of every document was shuffled."""
    import pyarrow as pa
    from docspark.indexes import trigrams as tri
    random = np.random.Generator(np.random.PCG64(5))
    texts = ["".join(random.choice(list("abcé中😀\u0002"), random.integers(0, 60))) for _ in range(300)]
    texts[7], texts[8] = "ab" * 500 + "z", ""
    monkeypatch.setattr(tri, "STRETCH", 64, raising=False)
    monkeypatch.setattr(tri, "MOST_PAIRS", 500, raising=False)
    blocks, slots = np.arange(300) // 64, np.arange(300) % 64
    batches = [pa.RecordBatch.from_arrays([pa.array(blocks[a:a + 50]), pa.array(slots[a:a + 50].astype(np.int32)), pa.array(texts[a:a + 50])],
                                          names=["block", "slot", "text"]) for a in range(0, 300, 50)]
    got = {(r["trigram"], r["block"], s) for out in tri._post(iter(batches)) for r in out.to_pylist() for s in r["slots"]}
    assert got == {((t + "\u0002\u0002")[i:i + 3], int(b), int(s)) for t, b, s in zip(texts, blocks, slots) for i in range(len(t))}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string")
    index = TrigramIndex.build(docs.repartition(2), ["body"], block_docs=64)
    places = {(r["block"], r["slot"]): r["body"] for r in index.texts.collect()}
    held = {(r["trigram"], places[r["block"], s]) for r in index.postings.collect() for s in r["slots"]}
    assert held == {((t.lower() + "\u0002\u0002")[i:i + 3], t) for t in texts for i in range(len(t))}
