"""Dashboards from deltas equal a full run after any changes."""

import random

from docspark.operators import aggregates as agg
from docspark.operators.views import CellView

SCHEMA = "id long, aircraft_registration string, doc_type string, ocr_confidence double, manually_corrected boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_coverage_follows_inserts_updates_and_deletes(spark):
    chance = random.Random(8)

    def row(i):
        return (i, chance.choice(["TS-INB", "TS-INC", None]), chance.choice(["AD", "SB", "RCT", None]),
                chance.choice([None, 10.1, 33.3, 99.9]), chance.choice([True, False, None]))

    fleet = spark.createDataFrame([("TS-INB",), ("TS-INC",), ("TS-IND",)], "registration string")
    view = CellView(spark, ["aircraft_registration", "doc_type"], agg.coverage_cells)
    table = {}
    for step in range(5):
        new = {i: row(i) for i in chance.sample(range(60), 12)}
        old = [table[i] for i in new if i in table]
        gone = chance.sample(sorted(table), min(5, len(table)))
        removed = [table[i] for i in gone if i not in new] + old
        view.apply(frame(spark, list(new.values())), frame(spark, removed) if removed else None)
        for i in gone:
            table.pop(i, None)
        table |= new
        if step == 2:
            view.compact()
        got = agg.coverage_of_cells(view.read(), fleet).collect()
        assert got == agg.coverage_by_aircraft(frame(spark, list(table.values())), fleet).collect()
    view.apply(removed=frame(spark, list(table.values())))
    assert view.read().count() == 0
    assert {r["total_docs"] for r in agg.coverage_of_cells(view.read(), fleet).collect()} == {0}


def test_a_change_is_taken_in_once(spark):
    view = CellView(spark, ["aircraft_registration", "doc_type"], agg.coverage_cells)
    rows = frame(spark, [(1, "TS-INB", "AD", 5.0, True)])
    for _ in range(3):
        view.apply(rows, source="watch", number=0)
    view.apply(rows, source="watch", number=1)
    assert [r["n"] for r in view.read().collect()] == [2]


def test_many_segments_are_merged(spark):
    view = CellView(spark, ["aircraft_registration", "doc_type"], agg.coverage_cells)
    for i in range(17):
        view.apply(frame(spark, [(i, "TS-INB", "AD", 1.0, False)]))
    assert len(view.journal.read()[1]["segments"]) <= 3
    assert [r["n"] for r in view.read().collect()] == [17]
