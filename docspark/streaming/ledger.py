"""Known content hashes outside the stream's state.

A dedup over years would keep years of hashes in the state store of a stream.
Here they are a table of segments, partitioned by the first digits of the
hash; each batch asks only the partitions its own hashes fall into, and adds
its new hashes as a segment. Hashes not seen within the horizon no longer
count; whole old segments are dropped, the others lose their old rows when
they are merged. The segments are named by whoever publishes them, so a batch
that was not published has left nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.duplicates import with_content_hash
from docspark.session import stored
from docspark.sources.journal import Journal

PREFIX = 2
#: Segments that are merged into one.
FAN = 8
_ROWS = "sha256_hash string, id long, at long, prefix string"


class HashLedger:
    """Segments of (sha256_hash, id, at) below `folder`. An entry names one:
    {"name", "rows", "newest"}."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def write(self, rows: DataFrame) -> dict:
        name = f"hashes-{uuid.uuid4().hex}"
        rows.select(
            "sha256_hash", F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"),
            F.left("sha256_hash", F.lit(PREFIX)).alias("prefix")).hint("rebalance", "prefix").write.partitionBy(
            "prefix").parquet(f"{self.folder}/{name}")
        held = self._read(name).agg(F.count("*").alias("n"), F.max("at").alias("newest")).first()
        return {"name": name, "rows": held["n"], "newest": held["newest"]}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.folder}/{name}")

    def rows(self, entries: Sequence[dict], since: int | None = None) -> DataFrame:
        found = self.spark.createDataFrame([], _ROWS)
        for entry in entries:
            if since is None or (entry["newest"] is not None and entry["newest"] >= since):
                found = found.union(self._read(entry["name"]))
        return found if since is None else found.filter(F.col("at") >= since)

    def known(self, entries: Sequence[dict], hashes: DataFrame, since: int | None = None) -> DataFrame:
        """(sha256_hash, known_id) of those among `hashes` that are known:
        the least id seen since then."""
        asked = hashes.select("sha256_hash").filter("sha256_hash IS NOT NULL").distinct()
        # At most 16 ^ PREFIX of them.
        prefixes = [r["p"] for r in asked.select(F.left("sha256_hash", F.lit(PREFIX)).alias("p")).distinct().collect()]
        held = self.rows(entries, since).filter(F.col("prefix").isin(prefixes) if prefixes else F.lit(False))
        return held.join(asked, "sha256_hash", "left_semi").groupBy("sha256_hash").agg(F.min("id").alias("known_id"))

    def kept(self, entries: Sequence[dict], since: int | None = None) -> list[dict]:
        """The entries that still count; when there are many, as one segment
        with the last sight of every hash."""
        alive = [e for e in entries if e["rows"] and (since is None or e["newest"] >= since)]
        if len(alive) < FAN:
            return alive
        rows = self.rows(alive, since).groupBy("sha256_hash").agg(F.min("id").alias("id"), F.max("at").alias("at"))
        return [self.write(rows)]


def new_contents(
    batch: DataFrame, ledger: HashLedger, entries: Sequence[dict], since: int | None = None,
) -> DataFrame:
    """(id, sha256_hash, duplicate_of) per row of `batch` (id, sha256_hash).

    The least id of a content is new unless the ledger knows the content;
    others are duplicates of it. Rows without content are all new. Repeated
    contents are plain minima, so one content may fill a batch.
    """
    keys = batch.select("id", "sha256_hash")
    first = keys.filter("sha256_hash IS NOT NULL").groupBy("sha256_hash").agg(F.min("id").alias("first_id"))
    owners = first.join(ledger.known(entries, keys, since), "sha256_hash", "left").select(
        "sha256_hash", "first_id", "known_id")
    seen = F.coalesce("known_id", F.when(F.col("id") != F.col("first_id"), F.col("first_id")))
    return keys.join(owners, "sha256_hash", "left").select("id", "sha256_hash", seen.alias("duplicate_of"))


def dedup_writer(
    spark: SparkSession, folder: str, moment: str, horizon_seconds: int | None = None,
    known: DataFrame | None = None, text: str = "text",
) -> Callable[[DataFrame, int], None]:
    """Writer for ``foreachBatch``: new contents go to ``folder``/rows, a part
    per batch. Rows, hashes and the batch number are published together; a
    replayed batch changes nothing, and a batch that ended half way leaves
    files nobody names. ``known`` (sha256_hash, id, at) starts the ledger."""
    journal, ledger = Journal(spark, f"{folder}/journal"), HashLedger(spark, f"{folder}/ledger")
    if known is not None and journal.read()[0] < 0:
        journal.publish({"last": -1, "rows": [], "ledger": [ledger.write(known)]}, -1)

    def write(batch: DataFrame, number: int) -> None:
        version, state = journal.read()
        if state.get("last", -1) >= number:
            return
        hashed = with_content_hash(batch, text).withColumn("at", F.unix_timestamp(moment))
        keys = stored(hashed.select("id", "sha256_hash", "at"), "arrivals")
        newest = keys.agg(F.max("at").alias("at")).first()["at"]
        since = None if horizon_seconds is None or newest is None else newest - horizon_seconds
        entries = state.get("ledger", [])
        decided = new_contents(keys, ledger, entries, since).filter("duplicate_of IS NULL").select("id")
        fresh = keys.join(decided, "id", "left_semi")
        name = f"part-{number}-{uuid.uuid4().hex}"
        fresh.write.parquet(f"{folder}/rows/{name}")
        # Every sight of a content renews it.
        added = ledger.write(keys.filter("sha256_hash IS NOT NULL").groupBy("sha256_hash").agg(
            F.min("id").alias("id"), F.max("at").alias("at")))
        journal.publish({
            "last": number, "rows": [*state.get("rows", []), name],
            "ledger": ledger.kept([*entries, added], since)}, version)

    return write


def published_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, sha256_hash, at) of the batches that were published."""
    _, state = Journal(spark, f"{folder}/journal").read()
    paths = [f"{folder}/rows/{name}" for name in state.get("rows", [])]
    schema = "id long, sha256_hash string, at long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
