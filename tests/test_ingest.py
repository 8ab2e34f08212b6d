"""The ingest against plain rules, with replays, crashes and races."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators.duplicates import with_content_hash
from docspark.operators.ingest import SCHEMAS, Archive
from docspark.session import scratch_path
from docspark.sources.journal import Conflict, Journal
from docspark.streaming.ledger import HashLedger, dedup_writer, published_rows

BATCH = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("filename", T.StringType()), T.StructField("rel_path", T.StringType()),
    T.StructField("ocr_text", T.StringType()), T.StructField("ocr_confidence", T.DoubleType())])
FIRST = [
    (1, "a.pdf", "Aircraft/TS-IND/Check C/WORKORDER/a.pdf", "A/C TS-IND\nWORK ORDER: WO-1\nES001000 text one", 90.0),
    (2, "b.pdf", "Aircraft/TS-INB/Check A/WORKORDER/b.pdf", "A/C TS-INB\nWORK ORDER: WO-2\nES001001 text two", 40.0),
    (3, "c.pdf", "Aircraft/TS-IND/Check C/WORKORDER/c.pdf", "A/C TS-IND\nWORK ORDER: WO-1\nES001000 text one", 90.0),
    (4, "d.pdf", "x/d.pdf", None, 10.0)]
SECOND = [
    (11, "ES001000.pdf", "Aircraft/UNKNOWN/x/WORKORDER/e.pdf", "WORK ORDER\nno plane here", 80.0),
    (12, "f.pdf", "Aircraft/TS-INC/x/WORKORDER/f.pdf", "A/C TS-INC\nWORK ORDER\nLinked WP ES001000\nmore", 80.0),
    (13, "g.pdf", "x/g.pdf", FIRST[1][3], 80.0), (14, "h.pdf", "x/h.pdf", None, 80.0)]


def rows(archive, name, *columns, version=None):
    frame = archive.table(name, version)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def archive(spark):
    held = Archive(spark, scratch_path(spark, "ingest"))
    held.ingest(spark.createDataFrame(FIRST, BATCH), "watch", 0)
    held.ingest(spark.createDataFrame(SECOND, BATCH), "watch", 1)
    return held


def everything(archive):
    return {name: rows(archive, name, "*") for name in SCHEMAS}


def test_duplicates_in_the_batch_and_in_the_archive(archive):
    assert rows(archive, "results", "id", "batch", "status", "duplicate_of") == sorted([
        (1, 0, "ARCHIVED", None), (2, 0, "ARCHIVED", None), (3, 0, "DUPLICATE", 1), (4, 0, "ARCHIVED", None),
        (11, 1, "ARCHIVED", None), (12, 1, "ARCHIVED", None), (13, 1, "DUPLICATE", 2), (14, 1, "ARCHIVED", None)], key=repr)
    assert {r[0] for r in rows(archive, "documents", "id")} == {1, 2, 4, 11, 12, 14}
    assert {r[0] for r in rows(archive, "texts", "id")} == {1, 2, 4, 11, 12, 14}


def test_the_archive_completes_later_documents(archive):
    found = {r[0]: r[1:] for r in rows(archive, "documents", "id", "aircraft_registration", "registration_method", "category")}
    assert found[11][:2] == ("TS-IND", "reference") and found[1][:2] == ("TS-IND", "document")
    assert found[12][2] == found[1][2] == "Check C"
    assert found[4][:2] == (None, None)


def test_dimensions_and_alerts_belong_to_the_batch(archive):
    planes = rows(archive, "aircraft", "registration", "created")
    assert planes == [("TS-INB", True), ("TS-INC", True), ("TS-IND", True)]
    keys = {r[0]: r[1] for r in rows(archive, "aircraft", "registration", "id")}
    assert all(plane == keys.get(reg) for reg, plane in rows(archive, "documents", "aircraft_registration", "aircraft_id"))
    checks = {r[0]: r[1:] for r in rows(archive, "checks", "es_reference", "check_type", "confirmed")}
    assert checks["ES001000"] == ("Check C", False) and checks["ES001001"] == ("Check A", False)
    assert {r[0] for r in rows(archive, "alerts", "document_id")} == {2, 4}


def test_readers_see_whole_versions(archive):
    assert {r[0] for r in rows(archive, "documents", "id", version=0)} == {1, 2, 4}
    assert {r[0] for r in rows(archive, "alerts", "document_id", version=0)} == {2, 4}


def test_a_replayed_batch_changes_nothing(spark, archive):
    before, version = everything(archive), archive.journal.read()[0]
    assert archive.ingest(spark.createDataFrame(FIRST, BATCH), "watch", 0) == version
    assert archive.ingest(spark.createDataFrame(SECOND, BATCH), "watch", 1) == version
    assert everything(archive) == before


def test_a_half_written_batch_changes_nothing(spark, archive, monkeypatch):
    before, write = everything(archive), Archive._write

    def dies(self, name, frame):
        if name == "alerts":
            raise RuntimeError("lost")
        return write(self, name, frame)

    more = spark.createDataFrame([(21, "z.pdf", "x/z.pdf", "new text", 5.0)], BATCH)
    monkeypatch.setattr(Archive, "_write", dies)
    with pytest.raises(RuntimeError):
        archive.ingest(more, "watch", 2)
    monkeypatch.undo()
    assert everything(archive) == before
    again = Archive(spark, archive.folder)
    assert again.ingest(more, "other", 0) == archive.journal.read()[0]
    assert [r for r in rows(again, "results", "id", "source", "status") if r[0] == 21] == [(21, "other", "ARCHIVED")]


def test_a_batch_that_loses_the_race_sees_what_won(spark, monkeypatch):
    archive = Archive(spark, scratch_path(spark, "race"))
    archive.ingest(spark.createDataFrame(FIRST[:1], BATCH), "a", 0)
    publish, once = Journal.publish, []

    def slow(self, state, after):
        if not once and self.folder.endswith("/journal") and "race" in self.folder:
            once.append(1)
            Archive(spark, archive.folder).ingest(spark.createDataFrame([(50, "q.pdf", "x/q.pdf", "the same", 99.0)], BATCH), "b", 0)
        return publish(self, state, after)

    monkeypatch.setattr(Journal, "publish", slow)
    archive.ingest(spark.createDataFrame([(60, "r.pdf", "x/r.pdf", "the same", 99.0)], BATCH), "a", 1)
    got = {r[0]: r[1:] for r in rows(archive, "results", "id", "status", "duplicate_of")}
    assert got[60] == ("DUPLICATE", 50) and got[50] == ("ARCHIVED", None)


def test_release_records_confirm_checks(spark):
    archive = Archive(spark, scratch_path(spark, "rct"))
    archive.seed(
        aircraft=spark.createDataFrame([(7, "TS-IND", "A320", False)], "id long, registration string, model string, created boolean"),
        checks=spark.createDataFrame([("ES001500", "Check A", 7, False, 0)], SCHEMAS["checks"]))
    text = "RELEASE CERTIFICATE\nA/C TS-IND\nCHECK C\nLinked WP ES001500\n"
    archive.ingest(spark.createDataFrame([(1, "TS-IND_CHECK C_ES001500_RCT.pdf", "Aircraft/TS-IND/x/RCT/r.pdf", text, 90.0)], BATCH), "w", 0)
    kind = rows(archive, "documents", "doc_type", "check_reference")
    assert kind == [("RCT", "ES001500")]
    assert rows(archive, "checks", "es_reference", "check_type", "aircraft_id", "confirmed") == [("ES001500", "Check C", 7, True)]


def test_compaction_keeps_every_row(spark, archive):
    before = everything(archive)
    for name in SCHEMAS:
        archive.compact(name)
    assert everything(archive) == before and not archive.compact("documents")


def test_empty_batch(spark):
    archive = Archive(spark, scratch_path(spark, "empty"))
    assert archive.ingest(spark.createDataFrame([], BATCH), "w", 0) == 0
    assert rows(archive, "documents", "id") == [] and archive.journal.read()[1]["batches"] == {"w": 0}


# Ledger ----------------------------------------------------------------------

ARRIVALS = "id long, text string, at timestamp"


def arrivals(spark, *found):
    return spark.createDataFrame(found, "id long, text string, s long").select("id", "text", F.timestamp_seconds("s").alias("at"))


def test_ledger_finds_duplicates_across_batches_and_expires(spark):
    folder = scratch_path(spark, "dedup")
    write = dedup_writer(spark, folder, "at", horizon_seconds=100)
    write(arrivals(spark, (1, "a", 0), (2, "b", 0), (3, "a", 1), (4, None, 1)), 0)
    write(arrivals(spark, (5, "a", 50), (6, "c", 60)), 1)
    write(arrivals(spark, (7, "b", 500), (8, "c", 130)), 2)
    got = {r["id"] for r in published_rows(spark, folder).collect()}
    # b was last seen 500 seconds before; c too, as the batch's newest row counts.
    assert got == {1, 2, 4, 6, 7, 8}


def test_ledger_stays_bounded_and_replays_change_nothing(spark):
    folder = scratch_path(spark, "bounded")
    write = dedup_writer(spark, folder, "at", horizon_seconds=30)
    sizes = []
    for n in range(10):
        batch = arrivals(spark, *[(n * 100 + i, f"text {n} {i}", n * 20 + 1) for i in range(40)], (n * 100 + 99, "always", n * 20 + 1))
        write(batch, n)
        _, state = Journal(spark, f"{folder}/journal").read()
        sizes.append(sum(e["rows"] for e in state["ledger"]))
        write(batch, n)
        assert Journal(spark, f"{folder}/journal").read()[1] == state
    assert max(sizes) <= 3 * 41 and published_rows(spark, folder).count() == 10 * 40 + 1


def test_a_late_row_is_still_a_duplicate(spark):
    folder = scratch_path(spark, "late")
    write = dedup_writer(spark, folder, "at", horizon_seconds=1000)
    write(arrivals(spark, (1, "a", 900)), 0)
    write(arrivals(spark, (2, "a", 10), (3, "b", 950)), 1)
    assert {r["id"] for r in published_rows(spark, folder).collect()} == {1, 3}


def test_ledger_asks_only_the_batchs_partitions(spark):
    ledger = HashLedger(spark, scratch_path(spark, "asked"))
    held = with_content_hash(spark.range(500).selectExpr("id", "cast(id AS STRING) AS text", "0 AS at"))
    entry = ledger.write(held)
    one = held.filter("id = 77").select("sha256_hash")
    known = ledger.known([entry], one)
    assert [r["known_id"] for r in known.collect()] == [77]
    assert "PartitionFilters: [isnotnull(prefix" in known._jdf.queryExecution().executedPlan().toString()


def test_merged_segments_keep_the_last_sight(spark):
    ledger = HashLedger(spark, scratch_path(spark, "merged"))
    rows_ = spark.createDataFrame([("ab" * 32, 5, 10)], "sha256_hash string, id long, at long")
    entries = [ledger.write(rows_.withColumn("at", F.lit(10 * i)).withColumn("id", F.lit(9 - i))) for i in range(8)]
    kept = ledger.kept(entries)
    assert len(kept) == 1 and kept[0]["rows"] == 1 and kept[0]["newest"] == 70
    assert ledger.known(kept, rows_, since=65).first()["known_id"] == 2
    assert ledger.kept(entries, since=65) == [entries[7]]


def test_batches_arrive_as_files_of_many_tasks(spark, tmp_path):
    """Before, one task wrote and one file held each batch."""
    from docspark.plans import ingest
    from docspark.sources.bindings import Tables

    seen = []
    docs = spark.range(0, 3000, 1, 6)
    ingest._drained(Tables(spark, ""), docs, str(tmp_path), lambda batch, number: seen.append(
        (number, batch.agg({"id": "min"}).first()[0], batch.count(), batch.select(F.input_file_name()).distinct().count())))
    assert [s[:3] for s in seen] == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 1000)]
    assert all(s[3] >= 2 for s in seen)
