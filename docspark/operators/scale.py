"""Building blocks that stay distributed when one key holds a third of all rows.

* ``best_per_key`` and ``majority_value`` are plain aggregates: the map side
  combines, so a hot key shuffles one partial row per task.
* ``join_to_groups`` salts only the keys whose share is large. At most
  ``HOT_SHARE`` keys can exceed ``1 / HOT_SHARE`` of the rows, so the set of
  hot keys has a proven bound and may be broadcast.
* ``running_sums`` computes prefix sums over blocks of the order key, so no
  task ever sorts a whole partition key.
* ``in_ranges`` cuts rows into ranges of their own order.
* ``contains_join`` turns a "contains" join into an equi join, and
  ``contains_aggregate`` sums up what contains a needle before any join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.session import stored

HOT_SHARE = 256
SALTS = 32


def best_per_key(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column],
    payload: Sequence[str],
) -> DataFrame:
    """The payload of the least row per key, in ``order`` (ascending)."""
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    row = F.struct(rank.alias("_rank"), *[F.col(c) for c in payload])
    picked = frame.groupBy(*keys).agg(F.min(row).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def majority_value(
    frame: DataFrame, keys: Sequence[str], value: str,
    weight: Column | None = None,
) -> DataFrame:
    """Most frequent value per key with its count; ties take the least."""
    weight = F.count("*") if weight is None else F.sum(weight)
    counted = frame.groupBy(*keys, value).agg(weight.alias("votes"))
    top = counted.groupBy(*keys).agg(
        F.min(F.struct((-F.col("votes")).alias("_v"), F.col(value))).alias("_t"))
    return top.select(
        *keys, F.col(f"_t.{value}").alias(value),
        (-F.col("_t._v")).alias("votes"))


def join_to_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str,
    spread_by: str, how: str = "inner",
) -> DataFrame:
    """Join rows to one-row-per-key groups; hot keys are salted. A null key
    is a key like any other.

    ``size`` is the group's row count. Only groups above ``1 / HOT_SHARE`` of
    all rows are replicated, and there are at most ``HOT_SHARE`` of them.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).scalar()
    hot = F.col(size) * HOT_SHARE > total
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    hot_keys = groups.filter(hot).select(
        *[F.col(k).alias(n) for k, n in named.items()], F.lit(True).alias("_hot"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    left = rows.join(F.broadcast(hot_keys), same, "left").drop(*named.values()).withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
        .otherwise(0).cast("int")).drop("_hot")
    right = groups.withColumn(
        "_salt",
        F.explode(F.sequence(
            F.lit(0), F.when(hot, F.lit(SALTS - 1)).otherwise(F.lit(0)))))
    right = right.withColumnsRenamed({**named, "_salt": "_salt_of"})
    return left.join(right, [*same, F.col("_salt") == F.col("_salt_of")], how).drop(
        "_salt", "_salt_of", *named.values())


def in_ranges(frame: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``frame`` with ``_range``, the number of the range of ``order`` a row
    lies in. Ranges hold about as many rows each, whatever the values, and
    follow each other in order; they are written once, so they stay fixed."""
    return stored(frame.repartitionByRange(*order).withColumn(
        "_range", F.spark_partition_id()), name)


def running_sums(
    frame: DataFrame, order: Sequence[str], block: Column,
    sums: Mapping[str, Column], partition: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums in ``order``.

    ``block`` must grow with the order and hold a bounded number of rows;
    sorting happens per block, and only block totals are summed in sequence.
    Null blocks and null partition values are groups like any other.
    """
    parts = list(partition)
    marked = frame.withColumn("_block", block)
    for name, value in sums.items():
        marked = marked.withColumn(f"_v_{name}", value)
    totals = marked.groupBy(*parts, "_block").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*parts).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, "_block", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}")
        for n in sums])
    inside = Window.partitionBy(*parts, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = marked
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(inside))
    keys = [*parts, "_block"]
    offsets = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    joined = local.join(offsets, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return joined.select(*frame.columns, *[
        (F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def _pieces(
    haystacks: DataFrame, haystack: str, needles: DataFrame, needle: str,
) -> DataFrame:
    """Haystack rows once per distinct substring of a length that occurs
    among the needles. Lengths are bounded by the longest key."""
    lengths = needles.agg(
        F.sort_array(F.collect_set(F.length(needle))).alias("lengths")).scalar()
    text, size = F.col(haystack), F.col("_size")
    sized = haystacks.withColumn("_size", F.explode(lengths)).filter(
        F.length(text) >= size)
    cuts = F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1),
        lambda at: F.substring(text, at, size))
    return sized.withColumn(needle, F.explode(F.array_distinct(cuts))).drop("_size")


def contains_join(
    haystacks: DataFrame, haystack: str, needles: DataFrame, needle: str,
    equal: Sequence[str] = (),
) -> DataFrame:
    """Pairs where ``haystack`` contains ``needle``, as an equi join.

    Both inputs should be distinct values; nothing is compared pairwise. A
    very short needle has very many pairs: where only their sum matters, use
    ``contains_aggregate``.
    """
    return _pieces(haystacks, haystack, needles, needle).join(needles, [*equal, needle])


def contains_aggregate(
    haystacks: DataFrame, haystack: str, needles: DataFrame, needle: str,
    aggregates: Sequence[Column], equal: Sequence[str] = (), by: Sequence[str] = (),
) -> DataFrame:
    """Per needle (and value of ``by``) the aggregates of the haystack rows
    that contain it, within the same values of ``equal``.

    Substrings are aggregated before they meet the needles, and Spark combines
    them before the shuffle: a needle of one digit, part of nearly every
    haystack, moves one row per task.
    """
    summed = _pieces(haystacks, haystack, needles, needle).groupBy(
        *equal, needle, *by).agg(*aggregates)
    return summed.join(needles.select(*equal, needle).distinct(), [*equal, needle], "left_semi")
