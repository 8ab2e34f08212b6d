"""The token index against a plain set model, and its journal."""

import random

import pytest

from docspark.indexes.tokens import TokenIndex
from docspark.sources.journal import Conflict, Journal


def docs(spark, held):
    return spark.createDataFrame([(i, sorted(ts)) for i, ts in held.items()], "id long, tokens array<string>")


def visible(index):
    out = {}
    for r in index.rows().collect():
        out.setdefault(r["id"], set()).add(r["token"])
    return out


def test_inserts_deletes_and_merges_follow_the_model(spark):
    chance, index, model = random.Random(4), TokenIndex(spark), {}
    for step in range(9):
        fresh = {chance.randrange(40): {chance.choice("abcdef") for _ in range(3)} for _ in range(8)}
        index.insert(docs(spark, fresh), replace=True)
        model.update(fresh)
        if step % 3 == 1:
            gone = chance.sample(sorted(model), 3)
            index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
            for i in gone:
                model.pop(i)
        if step in (4, 8):
            assert index.merge()
        assert visible(index) == model
    for query in ("a", "a b", "c f", "zzz", "a a", "A B"):
        words = set(query.lower().split())
        all_of = {(i, len(words)) for i, ts in model.items() if words <= ts}
        any_of = {(i, len(words & ts)) for i, ts in model.items() if words & ts}
        assert {tuple(r) for r in index.search(query).collect()} == all_of
        assert {tuple(r) for r in index.search(query, any_of=True).collect()} == any_of


def test_search_reads_only_the_words_partitions(spark):
    index = TokenIndex(spark)
    index.insert(docs(spark, {i: {f"t{i % 50}", "all"} for i in range(300)}))
    plan = index.search("t7 all")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "ocr_text" not in plan
    assert index.search("t7 all").count() == 6


def test_merge_drops_hidden_rows_and_idle_tombstones(spark):
    index = TokenIndex(spark)
    for i in range(4):
        index.insert(docs(spark, {i: {"a"}, 10 + i: {"b"}}))
    index.delete(spark.createDataFrame([(2,), (99,)], "id long"))
    assert index.merge() and not index.merge()
    _, state = index.journal.read()
    assert len(state["segments"]) == 1 and state["tombstones"] == [] and state["segments"][0]["rows"] == 7
    index.insert(docs(spark, {2: {"a"}}))
    assert {r["id"] for r in index.search("a").collect()} == {0, 1, 2, 3}


def test_changes_during_a_merge_survive(spark, monkeypatch):
    index = TokenIndex(spark)
    for i in range(4):
        index.insert(docs(spark, {i: {"a"}}))
    write = TokenIndex._write

    def slow(self, rows):
        monkeypatch.setattr(TokenIndex, "_write", write)
        TokenIndex(spark, self.folder).delete(spark.createDataFrame([(1,)], "id long"))
        TokenIndex(spark, self.folder).insert(docs(spark, {7: {"a"}}))
        return write(self, rows)

    monkeypatch.setattr(TokenIndex, "_write", slow)
    assert index.merge()
    assert visible(index) == {0: {"a"}, 2: {"a"}, 3: {"a"}, 7: {"a"}}


def test_a_crash_before_publishing_changes_nothing(spark, monkeypatch):
    index = TokenIndex(spark)
    index.insert(docs(spark, {1: {"a"}}))
    monkeypatch.setattr(Journal, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.insert(docs(spark, {2: {"a"}}))
    monkeypatch.undo()
    assert visible(TokenIndex(spark, index.folder)) == {1: {"a"}}


def test_empty_index_and_documents(spark):
    index = TokenIndex(spark)
    assert index.search("a").collect() == [] and index.rows().collect() == [] and not index.merge()
    index.delete(spark.createDataFrame([(1,)], "id long"))
    index.insert(spark.createDataFrame([(1, None), (2, [])], "id long, tokens array<string>"))
    assert index.rows().collect() == []


def test_one_writer_wins_a_version(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "journal"))
    assert journal.read() == (-1, {})
    assert journal.publish({"a": 1}, -1) == 0
    with pytest.raises(Conflict):
        journal.publish({"a": 2}, -1)
    assert journal.update(lambda s: {"a": s["a"] + 1}) == 1 and journal.read() == (1, {"a": 2})
    assert journal.read(0) == (0, {"a": 1}) and journal.update(lambda s: None) == 1
    assert journal.versions() == [0, 1]


def test_insert_shuffles_its_rows_once(spark, monkeypatch):
    """Before, a second shuffle made the rows distinct."""
    written, write = [], TokenIndex._write
    monkeypatch.setattr(TokenIndex, "_write", lambda self, rows: written.append(rows) or write(self, rows))
    index = TokenIndex(spark)
    rows = [(1, ["a", "b", "a", None]), (1, ["b", "c"]), (2, ["a"]), (3, []), (4, None), (None, ["a"])]
    index.insert(spark.createDataFrame(rows, "id long, tokens array<string>"))
    assert "Exchange" not in written[0]._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["found"]) for r in index.search("a b c", any_of=True).collect()} == {(1, 3), (2, 1), (None, 1)}
    assert [tuple(r) for r in index.search("a b c").collect()] == [(1, 3)]
    assert index.rows().count() == 6
