"""Select by rank: any page of an order without passing the rows before it.

Rows are written once in ranges of the sort key. The number of rows of each
range is a small table; page n lies in the one or two ranges whose running
count covers its ranks, and only these are read and sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.session import scratch_path

RANGE_ROWS = 50_000


class RankIndex:
    """`frame` in ranges of `order`. The order should end with a unique
    column; rows that are equal in it have no fixed rank among themselves."""

    def __init__(
        self, frame: DataFrame, order: Sequence[Column], folder: str | None = None, range_rows: int = RANGE_ROWS,
    ) -> None:
        self.spark, self.order = frame.sparkSession, list(order)
        path = folder or scratch_path(self.spark, "ranks")
        self.total = frame.count()
        ranges = max(1, -(-self.total // range_rows))
        # An explicit number: small ranges are not merged.
        spread = frame.repartitionByRange(ranges, *self.order) if ranges > 1 else frame.coalesce(1)
        spread.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        self.schema = frame.schema
        self.rows = self.spark.read.schema(frame.withColumn("_range", F.lit(0)).schema).parquet(path)
        # One number per range.
        held = {r["_range"]: r["n"] for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}
        self.before, at = {}, 0
        for number in sorted(held):
            self.before[number] = (at, held[number])
            at += held[number]

    def ranges(self, offset: int, limit: int) -> list[int]:
        return [r for r, (first, n) in self.before.items() if first < offset + limit and first + n > offset]

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows with ranks offset + 1 to offset + limit, in order, and
        their `rank`."""
        wanted = self.ranges(offset, limit)
        if not wanted or limit <= 0:
            return self.rows.drop("_range").limit(0).withColumn("rank", F.lit(0).cast("long"))
        start = F.create_map(*[F.lit(x) for r in wanted for x in (r, self.before[r][0])])
        inside = Window.partitionBy("_range").orderBy(*self.order)
        ranked = self.rows.filter(F.col("_range").isin(wanted)).withColumn(
            "rank", F.row_number().over(inside) + F.element_at(start, F.col("_range")))
        return ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).drop("_range").orderBy("rank")
