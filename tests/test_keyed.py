"""Merge on read against a plain dictionary; pages by rank against a sort."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators.ranks import RankIndex
from docspark.sources.journal import Journal
from docspark.sources.keyed import KeyedTable

SCHEMA = "id long, a string, b double"


def held(table, version=None):
    rows = table.read(version).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: (r["a"], r["b"]) for r in rows}


def frame(spark, model):
    return spark.createDataFrame([(k, *v) for k, v in model.items()], SCHEMA)


def test_changes_follow_the_model(spark):
    chance = random.Random(5)
    model = {i: (f"v{i}", float(i)) for i in range(40)} | {None: ("null key", None)}
    table = KeyedTable.create(frame(spark, model), "id", buckets=8)
    assert held(table) == model
    versions = [dict(model)]
    for step in range(4):
        puts = {chance.randrange(60): (f"p{step}", None) for _ in range(5)}
        table.put(frame(spark, puts))
        model |= puts
        versions.append(dict(model))
        patch = {i: f"q{step}" for i in chance.sample(range(80), 6)} | {None: f"n{step}"}
        table.patch(spark.createDataFrame(list(patch.items()), "id long, a string"))
        model |= {i: (a, model[i][1]) for i, a in patch.items() if i in model}
        versions.append(dict(model))
        fresh = {i: ("new", 1.0) for i in chance.sample(range(100), 6)}
        table.insert_new(frame(spark, fresh))
        model = fresh | model
        versions.append(dict(model))
        gone = chance.sample(range(60), 3)
        table.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
        for i in gone:
            model.pop(i, None)
        versions.append(dict(model))
        assert held(table) == model
    for version in (0, 3, 7):
        assert held(table, version) == versions[version]
    table.compact()
    assert held(table) == model and table.journal.read()[1]["deltas"] == []
    assert held(KeyedTable(spark, table.folder)) == model


def test_compaction_rewrites_only_touched_buckets(spark):
    model = {i: ("x", 0.0) for i in range(500)}
    table = KeyedTable.create(frame(spark, model), "id", buckets=32)
    before = table.journal.read()[1]["base"]
    table.patch(spark.createDataFrame([(3, "y"), (4, "z")], "id long, a string"))
    touched = table.compact()
    after = table.journal.read()[1]["base"]
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == {str(b) for b in touched}
    assert held(table) == model | {3: ("y", 0.0), 4: ("z", 0.0)}
    assert table.compact() == []


def test_a_crash_between_write_and_publish_changes_nothing(spark, monkeypatch):
    table = KeyedTable.create(frame(spark, {1: ("a", 1.0)}), "id", buckets=4)
    table.put(frame(spark, {2: ("b", 2.0)}))
    monkeypatch.setattr(Journal, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    for change in (table.compact, lambda: table.delete(spark.createDataFrame([(1,)], "id long"))):
        with pytest.raises(RuntimeError):
            change()
    monkeypatch.undo()
    assert held(KeyedTable(spark, table.folder)) == {1: ("a", 1.0), 2: ("b", 2.0)}


def test_a_delta_during_compaction_stays(spark, monkeypatch):
    table = KeyedTable.create(frame(spark, {i: ("a", 0.0) for i in range(20)}), "id", buckets=4)
    table.put(frame(spark, {3: ("b", 1.0)}))
    update = Journal.update

    def late(self, change, tries=20):
        monkeypatch.undo()
        KeyedTable(spark, table.folder).patch(spark.createDataFrame([(3, "c")], "id long, a string"))
        return update(self, change, tries)

    monkeypatch.setattr(Journal, "update", late)
    table.compact()
    assert held(table)[3] == ("c", 1.0) and len(table.journal.read()[1]["deltas"]) == 1


def test_empty_table(spark):
    table = KeyedTable.create(spark.createDataFrame([], SCHEMA), "id")
    assert held(table) == {}
    table.patch(spark.createDataFrame([(1, "x")], "id long, a string"))
    assert held(table) == {}
    table.put(frame(spark, {1: ("x", 1.0)}))
    table.compact()
    assert held(table) == {1: ("x", 1.0)}


@pytest.mark.parametrize("range_rows", [7, 100, 10 ** 6])
def test_pages_by_rank(spark, range_rows):
    chance = random.Random(6)
    rows = [(i, chance.choice([1.0, 2.0, None, 3.5])) for i in range(333)]
    index = RankIndex(
        spark.createDataFrame(rows, "id long, v double").repartition(4), [F.desc_nulls_last("v"), F.asc("id")], range_rows=range_rows)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for offset, limit in ((0, 5), (6, 3), (100, 50), (330, 20), (333, 5), (0, 333), (10, 0)):
        got = [(r["id"], r["v"], r["rank"]) for r in index.page(offset, limit).collect()]
        assert got == [(*r, offset + i + 1) for i, r in enumerate(want[offset:offset + limit])]
    if range_rows == 7:
        assert len(index.ranges(100, 5)) <= 3 and len(index.before) > 20


def test_a_page_reads_its_ranges_only(spark):
    index = RankIndex(spark.range(1000).select("id"), [F.asc("id")], range_rows=100)
    page = index.page(500, 10)
    assert [r["id"] for r in page.collect()] == list(range(500, 510))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pages_of_nothing(spark):
    assert RankIndex(spark.range(0), [F.asc("id")]).page(0, 10).collect() == []
