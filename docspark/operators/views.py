"""Dashboards kept up to date from the rows that change.

A dashboard is computed from cells: additive measures per key, fine enough
that its distinct counts are counts of cells. A change of the table adds the
cells of the new rows and takes off those of the old ones; both are one small
segment with signed measures. The dashboard reads the sum of the segments and
leaves out cells without rows, so distinct values disappear with their last
row. Sums are exact (whole numbers and decimals): after any number of changes
the result is that of a full run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark.session import scratch_path
from docspark.sources.journal import Journal, State

#: Segments from which a change also merges them.
FAN = 16


class CellView:
    """The cells of a table: `cells` groups rows by `keys` into measures that
    add up, among them the row count `n`."""

    def __init__(
        self, spark: SparkSession, keys: Sequence[str], cells: Callable[[DataFrame], DataFrame], folder: str | None = None,
    ) -> None:
        self.spark, self.keys, self.cells = spark, list(keys), cells
        self.folder = folder or scratch_path(spark, "cells")
        self.journal = Journal(spark, f"{self.folder}/journal")

    def _segments(self, state: State) -> DataFrame | None:
        names = state.get("segments", [])
        if not names:
            return None
        schema = StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def _sum(self, rows: DataFrame) -> DataFrame:
        """Cells added up, in the types they have."""
        measures = [f for f in rows.schema if f.name not in self.keys]
        return rows.groupBy(*self.keys).agg(*[
            F.coalesce(F.sum(f.name), F.lit(0)).cast(f.dataType).alias(f.name) for f in measures])

    def _write(self, rows: DataFrame) -> str:
        name = f"cells-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def apply(
        self, added: DataFrame | None = None, removed: DataFrame | None = None,
        source: str | None = None, number: int | None = None,
    ) -> int:
        """Take in new rows, and take off old ones as they were; an update is
        both. With `source` and `number`, a change that was taken in before
        changes nothing."""
        signed: DataFrame | None = None
        for rows, sign in ((added, 1), (removed, -1)):
            if rows is None:
                continue
            cells = self.cells(rows)
            measures = [f for f in cells.schema if f.name not in self.keys]
            part = cells.select(*self.keys, *[
                (F.coalesce(F.col(f.name), F.lit(0)) * sign).cast(f.dataType).alias(f.name) for f in measures])
            signed = part if signed is None else signed.union(part)
        if signed is None:
            return self.journal.read()[0]
        if self._taken(self.journal.read()[1], source, number):
            return self.journal.read()[0]
        name = self._write(self._sum(signed))

        def change(state: State) -> State | None:
            if self._taken(state, source, number):
                return None
            new = state | {"segments": [*state.get("segments", []), name], "schema": signed.schema.jsonValue()}
            if source is not None:
                new["changes"] = state.get("changes", {}) | {source: number}
            return new

        version = self.journal.update(change)
        if len(self.journal.read()[1].get("segments", [])) >= FAN:
            self.compact()
        return version

    @staticmethod
    def _taken(state: State, source: str | None, number: int | None) -> bool:
        return source is not None and state.get("changes", {}).get(source, -1) >= number

    def read(self, version: int | None = None) -> DataFrame:
        """The cells that have rows."""
        _, state = self.journal.read(version)
        held = self._segments(state)
        if held is None:
            raise ValueError("no change was taken in yet")
        return self._sum(held).filter(F.col("n") != 0)

    def compact(self) -> None:
        """One segment without empty cells; changes taken in meanwhile stay."""
        _, state = self.journal.read()
        held = self._segments(state)
        if held is None or len(state["segments"]) < 2:
            return
        name, gone = self._write(self._sum(held).filter(F.col("n") != 0)), set(state["segments"])

        def change(now: State) -> State | None:
            if not gone <= set(now["segments"]):
                return None
            return now | {"segments": [name, *[s for s in now["segments"] if s not in gone]]}

        self.journal.update(change)
