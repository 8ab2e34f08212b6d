"""A table by key that is changed by delta files and merged when read.

The base lies in buckets of the key's hash. A change writes a small delta
(puts, patches of some columns, deletes) with the next sequence number and
publishes it; nothing is rewritten. A reader takes, per key and column, the
value with the highest number. Compaction rewrites the buckets that deltas
touch, and only these, into new parts; the journal names which part holds
which bucket, so a reader sees the table before or after, and a compaction
that dies leaves the old parts in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from docspark.session import scratch_path, stored
from docspark.sources.journal import Conflict, Journal, State

BUCKETS = 64


class KeyedTable:
    """`columns` by `key`; a null key is a key like any other."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.journal = Journal(spark, f"{folder}/journal")
        _, state = self.journal.read()
        self.key, self.buckets = state["key"], state["buckets"]
        self.schema = StructType.fromJson(state["schema"])
        self.columns = [f.name for f in self.schema]

    @classmethod
    def create(cls, rows: DataFrame, key: str, folder: str | None = None, buckets: int = BUCKETS) -> KeyedTable:
        """A table of rows with distinct keys."""
        spark = rows.sparkSession
        folder = folder or scratch_path(spark, "keyed")
        part = f"part-{uuid.uuid4().hex}"
        held = _write_buckets(rows, key, buckets, f"{folder}/base/{part}")
        Journal(spark, f"{folder}/journal").publish({
            "key": key, "buckets": buckets, "schema": rows.schema.jsonValue(),
            "base": {str(b): part for b in held}, "deltas": [], "next": 1}, -1)
        return cls(spark, folder)

    # Reading -------------------------------------------------------------------

    def _base(self, state: State, buckets: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/base/{part}/bucket={b}" for b, part in state["base"].items()
                 if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _events(self, state: State) -> DataFrame | None:
        found: DataFrame | None = None
        schema = StructType.fromJson(self.schema.jsonValue()).add("_op", StringType()).add("_sets", ArrayType(StringType()))
        for delta in state["deltas"]:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/delta/{delta['name']}").withColumn(
                "_seq", F.lit(delta["seq"]).cast("long"))
            found = rows if found is None else found.union(rows)
        return found

    def _merged(self, base: DataFrame, events: DataFrame | None) -> DataFrame:
        if events is None:
            return base
        same = F.col(self.key).eqNullSafe(F.col("_key"))
        keys = events.select(F.col(self.key).alias("_key")).distinct()
        old = base.join(keys, same, "left_semi").select(
            "*", F.lit("put").alias("_op"), F.lit(None).cast("array<string>").alias("_sets"), F.lit(0).cast("long").alias("_seq"))

        def value(name: str) -> Column:
            # Puts and deletes set every column, patches the named ones.
            sets = (F.col("_op") != "patch") | F.array_contains("_sets", name)
            return F.max(F.when(sets, F.struct("_seq", F.col(name).alias("v"))))["v"].alias(name)

        others = [c for c in self.columns if c != self.key]
        there = F.max(F.when(F.col("_op") != "patch", F.struct("_seq", (F.col("_op") == "put").alias("v"))))["v"]
        merged = old.union(events.select(*old.columns)).groupBy(self.key).agg(
            *[value(c) for c in others], there.alias("_there")).filter("_there").select(*self.columns)
        return base.join(keys, same, "left_anti").union(merged)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version; the newest by default."""
        _, state = self.journal.read(version)
        return self._merged(self._base(state), self._events(state))

    # Changing ------------------------------------------------------------------

    def _change(self, build: Callable[[], DataFrame]) -> int:
        """Publish a delta; after a conflict it is built again, since what it
        says may depend on the table."""
        while True:
            version, state = self.journal.read()
            rows, name = build(), f"delta-{uuid.uuid4().hex}"
            stored_rows = rows.withColumn("_b", _bucket(self.key, self.buckets))
            stored_rows = stored(stored_rows, "change")
            touched = sorted(r["_b"] for r in stored_rows.select("_b").distinct().collect())
            stored_rows.drop("_b").write.parquet(f"{self.folder}/delta/{name}")
            new = state | {"deltas": [*state["deltas"], {"name": name, "seq": state["next"], "buckets": touched}],
                           "next": state["next"] + 1}
            try:
                return self.journal.publish(new, version)
            except Conflict:
                continue

    def _full(self, rows: DataFrame, op: str, sets: Sequence[str] | None = None) -> DataFrame:
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns
                  else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        named = F.array(*map(F.lit, sets)) if sets else F.lit(None)
        return rows.select(*fields, F.lit(op).alias("_op"), named.cast("array<string>").alias("_sets"))

    def put(self, rows: DataFrame) -> int:
        """Insert or replace whole rows; keys are distinct."""
        return self._change(lambda: self._full(rows, "put"))

    def insert_new(self, rows: DataFrame) -> int:
        """Insert rows whose key is not there; others are ignored."""
        def fresh() -> DataFrame:
            there = self.read().select(F.col(self.key).alias("_key"))
            return self._full(rows.join(there, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti"), "put")

        return self._change(fresh)

    def patch(self, rows: DataFrame) -> int:
        """Set the columns `rows` has, for keys that are there; keys are distinct."""
        sets = [c for c in rows.columns if c != self.key]
        return self._change(lambda: self._full(rows, "patch", sets))

    def delete(self, keys: DataFrame) -> int:
        return self._change(lambda: self._full(keys.select(self.key).distinct(), "delete"))

    def compact(self) -> list[int]:
        """Merge all deltas into the buckets they touch; the buckets rewritten.
        Deltas published meanwhile stay."""
        version, state = self.journal.read()
        touched = sorted({b for d in state["deltas"] for b in d["buckets"]})
        if not touched:
            return []
        part = f"part-{uuid.uuid4().hex}"
        rows = self._merged(self._base(state, touched), self._events(state))
        held = _write_buckets(rows, self.key, self.buckets, f"{self.folder}/base/{part}")
        gone = {d["name"] for d in state["deltas"]}

        def change(now: State) -> State | None:
            if now["base"] != state["base"] or not gone <= {d["name"] for d in now["deltas"]}:
                return None
            base = {b: p for b, p in now["base"].items() if int(b) not in touched}
            return now | {"base": base | {str(b): part for b in held},
                          "deltas": [d for d in now["deltas"] if d["name"] not in gone]}

        self.journal.update(change)
        return touched


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, key: str, buckets: int, path: str) -> list[int]:
    """Write by bucket; the buckets that have rows."""
    rows.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    schema = StructType.fromJson(rows.schema.jsonValue()).add("bucket", IntegerType())
    held = rows.sparkSession.read.schema(schema).parquet(path)
    return sorted(r["bucket"] for r in held.select("bucket").distinct().collect())
