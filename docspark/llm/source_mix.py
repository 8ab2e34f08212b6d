"""Mixing overlapping sources to target weights by min-cost flow.

Documents are grouped by the set of sources they belong to. A group offers its
words once at cost 0, a second time at cost 1, a third time at cost 3: convex,
so the flow repeats nothing before all its alternatives are used once. Sources
ask for their quotas. The cheapest flow from groups to sources says how many
words every group gives to every source; groups and sources that no document
connects are independent, so each connected part is solved in its own task,
and a part holds one row per group of documents, never documents.

A group then takes its documents in the order of a seeded hash: whole rounds
first, the rest of the quota from the front of the order. The last document is
taken in part, so quotas are met to the word and every run takes the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.bytewords import NOT_SPACE, chunks
from docspark.llm.components import components
from docspark.session import stored

#: Cost of the n-th copy of a document.
REPEAT_COSTS = (0, 1, 3)
BUCKET_BITS = 16


def flow(
    supply: dict[str, int], members: dict[str, Sequence[str]], quota: dict[str, int],
    costs: Sequence[int] = REPEAT_COSTS,
) -> dict[tuple[str, str], int]:
    """Cheapest words from each group to each of its sources.

    Successive shortest paths with potentials. Quotas that the groups cannot
    meet are met as far as they go.
    """
    nodes = {name: i for i, name in enumerate(["", *[f"g{g}" for g in supply], *[f"s{s}" for s in quota], "t"])}
    graph: list[list[list[int]]] = [[] for _ in nodes]
    edges: dict[tuple[str, str], list[int]] = {}

    def edge(u: int, v: int, capacity: int, cost: int) -> list[int]:
        there, back = [v, capacity, cost, len(graph[v])], [u, 0, -cost, len(graph[u])]
        graph[u].append(there)
        graph[v].append(back)
        return back

    start, end = 0, nodes["t"]
    for g in sorted(supply):
        for cost in costs:
            edge(start, nodes[f"g{g}"], supply[g], cost)
        for s in sorted(members[g]):
            if s in quota:
                edges[g, s] = edge(nodes[f"g{g}"], nodes[f"s{s}"], len(costs) * supply[g], 0)
    for s in sorted(quota):
        edge(nodes[f"s{s}"], end, quota[s], 0)
    while True:
        best = [None] * len(graph)
        best[start], came = 0, {}
        queue, waiting = [start], {start}
        while queue:
            u = queue.pop(0)
            waiting.discard(u)
            for k, (v, capacity, cost, _) in enumerate(graph[u]):
                if capacity and (best[v] is None or best[u] + cost < best[v]):
                    best[v], came[v] = best[u] + cost, (u, k)
                    if v not in waiting:
                        waiting.add(v)
                        queue.append(v)
        if best[end] is None:
            return {k: e[1] for k, e in edges.items()}
        v, amount = end, None
        while v != start:
            u, k = came[v]
            amount = graph[u][k][1] if amount is None else min(amount, graph[u][k][1])
            v = u
        v = end
        while v != start:
            u, k = came[v]
            graph[u][k][1] -= amount
            graph[v][graph[u][k][3]][1] += amount
            v = u


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words, counted on the bytes of whole texts."""
    for batch in batches:
        counts = [np.diff(w.bounds) for w in chunks(batch.column("text"), NOT_SPACE)]
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sources"), pa.array(size, pa.int64())],
            names=["doc_id", "sources", "size"])


def ranked(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with their 0-based rank in code point order, null last.

    Sorted by range partitions; only one count per partition is summed up in
    sequence, so the values are never in one task.
    """
    parts = stored(
        values.repartitionByRange(F.col(column).asc_nulls_last())
        .sortWithinPartitions(F.col(column).asc_nulls_last())
        .withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last())
    return parts.withColumn("_at", F.row_number().over(inside) - 1).join(before, "_part").withColumn(
        "rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def capped_targets(sources: DataFrame, total: int, cap: int = max(1, len(REPEAT_COSTS))) -> DataFrame:
    """`sources` (weight, source_size) with `target`: shares of `total` by
    weight, at most `cap` times the source, the excess shared again by weight.

    Every round fixes the sources above the cap and shares the rest among the
    others. A round reads two sums; there are at most as many rounds as
    different ratios of size to weight, in practice two or three.
    """
    rows, fixed_before = stored(sources.withColumn("target", F.lit(None).cast("double")), "sources"), -1
    while True:
        sums = rows.agg(
            F.sum("target").alias("fixed"), F.count("target").alias("n_fixed"),
            F.sum(F.when(F.col("target").isNull(), F.col("weight"))).alias("open")).first()
        if not sums["open"]:
            return rows
        unit = (float(total) - float(sums["fixed"] or 0.0)) / float(sums["open"])
        share = F.col("weight") * F.lit(unit)
        if sums["n_fixed"] == fixed_before:
            return rows.withColumn("target", F.coalesce("target", share))
        fixed_before = sums["n_fixed"]
        limit = (F.lit(cap) * F.col("source_size")).cast("double")
        rows = stored(rows.withColumn("target", F.coalesce("target", F.when(share > limit, limit))), "sources")


def _solve(patterns: pd.DataFrame, quotas: pd.DataFrame) -> pd.DataFrame:
    """The flow of one connected part: words that each group gives in all."""
    supply = dict(zip(patterns["group"], patterns["supply"].astype(int)))
    members = {g: g.split(",") for g in supply}
    quota = {str(r): int(q) for r, q in zip(quotas["rank"], quotas["quota"])}
    given: dict[str, int] = dict.fromkeys(supply, 0)
    for (g, _), amount in flow(supply, members, quota).items():
        given[g] += amount
    return pd.DataFrame({"group": list(given), "given": list(given.values())})


def mix(
    docs: DataFrame, sources: Column | None = None, weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0, seed: str = "mix",
) -> DataFrame:
    """(doc_id, size, sources, source_size, target, taken), one row per row.

    `sources` is an array of the sources a document belongs to, by default
    its one `source`; null is a source of its own, last in order. `weights`
    repeat over the sources in code point order. `share` of all words is
    shared out. `size` is the number of words of the text, `taken` the words
    the mix takes of a row, repeats counted, at most 3 times its size. Empty
    and null texts have size 0 and take 0. Equal rows are rows of their own;
    which of them is taken in part is not told apart. With several sources,
    `source_size` and `target` are those of the first.
    """
    member = F.array("source") if sources is None else sources
    named = docs.select("doc_id", F.array_sort(F.array_distinct(member)).alias("sources"), F.col("text").cast("string").alias("text"))
    kinds = [f"{c} {named.schema[c].dataType.simpleString()}" for c in ("doc_id", "sources")]
    rows = stored(named.mapInArrow(_sizes, ", ".join([*kinds, "size long"])), "sizes")
    held = rows.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(
        F.sum("size").alias("source_size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked(held, "source").withColumn(
        "weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")))
    quotas = stored(capped_targets(weighed, int(total * share)).withColumn(
        "quota", F.floor(F.col("target") + 0.5).cast("long")), "quotas")

    # A group is named by the ranks of its sources.
    names = rows.select("sources").distinct()
    ranks = names.select("sources", F.explode("sources").alias("source")).join(
        quotas.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s")))
    groups = stored(ranks.groupBy("sources").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).select(
        "sources", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("group"),
        F.col("ranks")[0].alias("first"), F.col("ranks").alias("ranks")), "groups")
    together = groups.select("first", F.explode("ranks").alias("other")).filter("first <> other")
    part = components(together, "first", "other")
    quota_part = quotas.join(part, F.col("rank") == F.col("node"), "left").withColumn("part", F.coalesce("root", "rank"))
    size_of = rows.groupBy("sources").agg(F.sum("size").alias("supply"))
    same = F.col("s").eqNullSafe(F.col("sources"))
    supplies = groups.join(size_of.withColumnRenamed("sources", "s"), same).join(
        quota_part.select(F.col("rank").alias("first"), "part", "source_size", "target"), "first").select(
        "sources", "group", "part", "supply", "source_size", "target")
    supplies = stored(supplies, "supplies")
    given = supplies.groupBy("part").cogroup(quota_part.groupBy("part")).applyInPandas(
        _solve, "group string, given long")
    plans = stored(supplies.join(given, "group").select(
        F.col("sources").alias("s"), "group", "source_size", "target",
        F.expr("CASE WHEN supply > 0 THEN given DIV supply ELSE 0 END").alias("rounds"),
        F.expr("CASE WHEN supply > 0 THEN given % supply ELSE 0 END").alias("rest")), "plans")

    # Prefix sums over 2^16 buckets of the seeded order; only the bucket in
    # which a group's rest ends is sorted.
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    marked = rows.withColumn("h", order).withColumn("bucket", F.substring("h", 1, BUCKET_BITS // 4)).join(
        plans, F.col("sources").eqNullSafe(F.col("s"))).drop("s")
    so_far = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy("group", "bucket", "rest").agg(F.sum("size").alias("held")).withColumn(
        "before", F.coalesce(F.sum("held").over(so_far), F.lit(0))).filter(
        "before <= rest AND rest < before + held").select(F.col("group").alias("g"), F.col("bucket").alias("last"), "before")
    cut = marked.join(ends, F.col("group") == F.col("g"), "left").drop("g")
    whole = cut.filter("last IS NULL OR bucket <> last").withColumn("extra", F.expr("CASE WHEN bucket < last THEN size ELSE 0 END"))
    inside = Window.partitionBy("group").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    partly = cut.filter("bucket = last").withColumn("seen", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    partly = partly.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("seen")))).drop("seen")
    return whole.unionByName(partly).select(
        "doc_id", "size", "sources", "source_size", "target",
        (F.col("rounds") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """The contract's columns of `mix`, each document in its one source."""
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", "taken", F.get("sources", F.lit(0)).alias("source"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size / weight AS ratio,
    row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM s),
-- With the k smallest ratios at their cap, the others share by weight.
u AS (
  SELECT n.k, (t.total - coalesce(sum(3 * r.source_size), 0))::DOUBLE / (t.w - coalesce(sum(r.weight), 0)) AS unit
  FROM (SELECT k - 1 AS k FROM r) n CROSS JOIN (SELECT sum(source_size) AS total, sum(weight) AS w FROM r) t
  LEFT JOIN r ON r.k <= n.k GROUP BY n.k, t.total, t.w),
best AS (SELECT u.k, u.unit FROM u JOIN r ON r.k = u.k + 1 WHERE r.ratio >= u.unit ORDER BY u.k LIMIT 1),
q AS (
  SELECT source, source_size, CASE WHEN r.k <= best.k THEN (3 * source_size)::DOUBLE ELSE weight * unit END AS target
  FROM r, best),
o AS (
  SELECT d.*, q.source_size, q.target, floor(q.target + 0.5)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, source,
  CASE WHEN source_size = 0 THEN 0 ELSE
    quota // source_size * size + greatest(0, least(size, quota % source_size - seen)) END::BIGINT AS taken
FROM o
"""
