"""A stored token index that grows by segments.

Every insert writes a segment: (token, id), partitioned by a hash of the token
and sorted within. Every delete writes a tombstone: a set of ids. A journal
names the live ones, each with the number of the change it came with; a
tombstone hides the documents of segments written before it. Segments of like
size are merged into one, without hidden documents, when there are several,
and tombstones that hide nothing any more are dropped. A search reads the
partitions of its words from the live segments and never a text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import scratch_path
from docspark.sources.journal import Journal, State

BUCKETS = 64
#: Segments of one size class that are merged together.
FAN = 4
_ROWS = "token string, id long, bucket int"


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def words_of(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


class TokenIndex:
    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or scratch_path(spark, "token-index")
        self.journal = Journal(spark, f"{self.folder}/journal")

    # Changes -------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> dict:
        """A new segment, not yet live. A hot token is split over files."""
        name = f"segment-{uuid.uuid4().hex}"
        rows.select("token", "id", _bucket(F.col("token")).alias("bucket")).hint("rebalance", "bucket").sortWithinPartitions(
            "bucket", "token", "id").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return {"name": name, "rows": self._read(name).count()}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.folder}/{name}")

    def insert(self, docs: DataFrame, replace: bool = False) -> int:
        """Index (id, tokens) as a segment. With `replace`, earlier entries of
        the same ids are hidden by the same change."""
        # An id that comes twice may repeat a row; searches count tokens once.
        segment = self._write(docs.select(
            F.explode(F.array_distinct("tokens")).alias("token"), F.col("id").cast("long").alias("id")))
        tomb = self._tombstone(docs) if replace else None

        def change(state: State) -> State:
            at = state.get("next", 1)
            new = self._with(state, at + 1)
            if tomb:
                new["tombstones"].append(tomb | {"at": at})
            # A tombstone of the same change is older than its segment.
            new["segments"].append(segment | {"at": at, "purged": at})
            return new

        return self.journal.update(change)

    def _tombstone(self, ids: DataFrame) -> dict:
        name = f"tombstone-{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("long").alias("id")).distinct().write.parquet(f"{self.folder}/{name}")
        return {"name": name}

    def delete(self, ids: DataFrame) -> int:
        """Hide the documents (id) there are now; later inserts show again."""
        tomb = self._tombstone(ids)

        def change(state: State) -> State:
            new = self._with(state, state.get("next", 1) + 1)
            new["tombstones"].append(tomb | {"at": state.get("next", 1)})
            return new

        return self.journal.update(change)

    @staticmethod
    def _with(state: State, following: int) -> State:
        return {"segments": list(state.get("segments", [])), "tombstones": list(state.get("tombstones", [])), "next": following}

    def merge(self, fan: int = FAN) -> bool:
        """Merge the first size class that has `fan` segments. What was
        inserted or deleted meanwhile stays as it is."""
        _, state = self.journal.read()
        classes: dict[int, list[dict]] = {}
        for segment in state.get("segments", []):
            classes.setdefault(int(math.log(max(1, segment["rows"]), 4)), []).append(segment)
        chosen = next((s for _, s in sorted(classes.items()) if len(s) >= fan), None)
        if chosen is None:
            return False
        purged = max([t["at"] for t in state["tombstones"]], default=0)
        rows = self._visible(chosen, state["tombstones"]).select("token", "id").distinct()
        merged = self._write(rows) | {"at": max(s["at"] for s in chosen), "purged": max(purged, *[s["purged"] for s in chosen])}
        gone = {s["name"] for s in chosen}

        def change(now: State) -> State | None:
            if not gone <= {s["name"] for s in now["segments"]}:
                return None
            new = self._with(now, now["next"])
            new["segments"] = [s for s in new["segments"] if s["name"] not in gone] + ([merged] if merged["rows"] else [])
            new["tombstones"] = [t for t in new["tombstones"] if any(
                t["at"] > max(s["at"], s["purged"]) for s in new["segments"])]
            return new

        self.journal.update(change)
        return True

    # Searches ------------------------------------------------------------------

    def _visible(self, segments: Sequence[dict], tombstones: Sequence[dict], words: Sequence[str] | None = None) -> DataFrame:
        """Rows of segments that no later tombstone hides."""
        found: DataFrame | None = None
        for segment in segments:
            rows = self._read(segment["name"])
            if words is not None:
                rows = rows.filter(F.col("bucket").isin(self._buckets(words)) & F.col("token").isin(list(words)))
            since = max(segment["at"], segment["purged"])
            rows = rows.select("token", "id", F.lit(since).alias("since"))
            found = rows if found is None else found.union(rows)
        if found is None:
            return self.spark.createDataFrame([], "token string, id long, since int")
        hidden: DataFrame | None = None
        for tomb in tombstones:
            ids = self.spark.read.schema("id long").parquet(f"{self.folder}/{tomb['name']}").withColumn("until", F.lit(tomb["at"]))
            hidden = ids if hidden is None else hidden.union(ids)
        if hidden is None:
            return found
        last = hidden.groupBy(F.col("id").alias("_id")).agg(F.max("until").alias("until"))
        return found.join(last, (F.col("id").eqNullSafe(F.col("_id"))) & (F.col("until") > F.col("since")), "left_anti")

    def _buckets(self, words: Sequence[str]) -> list[int]:
        if not words:
            return []
        row = self.spark.range(1).select(*[_bucket(F.lit(w)).alias(f"b{i}") for i, w in enumerate(words)]).first()
        return sorted(set(row))

    def rows(self) -> DataFrame:
        """All visible (token, id)."""
        _, state = self.journal.read()
        return self._visible(state.get("segments", []), state.get("tombstones", [])).select("token", "id").distinct()

    def search(self, query: str, any_of: bool = False) -> DataFrame:
        """(id, found): documents with all (or any) of the query's words, and
        how many of them."""
        words = words_of(query)
        _, state = self.journal.read()
        hits = self._visible(state.get("segments", []), state.get("tombstones", []), words)
        counted = hits.groupBy("id").agg(F.countDistinct("token").cast("int").alias("found"))
        return counted if any_of else counted.filter(F.col("found") == len(words))
