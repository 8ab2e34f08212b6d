"""Inverted lists over embeddings, searched approximately or exactly.

Centroids are fitted on a bounded sample (`SAMPLE_PER_LIST` rows per list, by
a hash of the id); every row is then indexed, stored under the number of its
nearest centroid. A search reads the lists it probes and nothing else, which
Spark does by partition pruning, and ranks their rows by exact similarity.

A list also keeps the largest angle between its centroid and a row. No row of
a list at angle a from the query is nearer than a minus that radius, so an
exact search first reads the nearest lists, and then only those whose bound
reaches the k-th similarity found there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark.functions.vectors import cosine_literal, dot, norm
from docspark.session import scratch_path, stored

SAMPLE_PER_LIST = 256
MOST_LISTS = 4096
#: Rise of a bound, above the rounding of angles.
SLACK = 1e-6
#: Rows without a direction or of another width; every search reads them.
UNLISTED = -1
#: Queries and rows that meet in one group of a batch search, and the queries
#: multiplied at once there; a batch has at most so many tasks.
GROUP_QUERIES, GROUP_ROWS, CHUNK_QUERIES, MOST_TASKS = 2048, 16_384, 256, 2000
#: Products added in another order differ by less.
ROUNDING = 1e-9


def _finite(vector: str) -> Column:
    return F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))


class VectorIndex:
    """An index in `folder`: rows by list, and one small table of lists."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        kept = spark.read.text(f"{folder}/schema", wholetext=True).first()["value"]
        self.rows = spark.read.schema(StructType.fromJson(json.loads(kept))).parquet(f"{folder}/rows")
        self.lists = spark.read.parquet(f"{folder}/lists")
        held = self.lists.orderBy("list").collect()
        self.numbers = np.array([r["list"] for r in held], dtype=int)
        self.sizes = np.array([r["rows"] for r in held], dtype=int)
        self.radius = np.array([r["radius"] for r in held])
        self.centroids = np.array([r["centroid"] for r in held], dtype=float).reshape(len(held), -1 if held else 0)

    @classmethod
    def build(
        cls, rows: DataFrame, folder: str | None = None, payload: Sequence[str] = (),
        lists: int | None = None, sample_per_list: int = SAMPLE_PER_LIST, seed: int = 7,
    ) -> VectorIndex:
        """Index (id, embedding, payload...). Rows without embedding are left
        out, as no search finds them. By default about sqrt(n) lists."""
        spark = rows.sparkSession
        folder = folder or scratch_path(spark, "vector-index")
        points = rows.filter("embedding IS NOT NULL").select("id", "embedding", *payload)
        proper = _finite("embedding") & F.coalesce(norm(F.col("embedding")) > 0, F.lit(False))
        widths = points.filter(proper).groupBy(F.size("embedding").alias("w")).count()
        top = widths.orderBy(F.desc("count"), F.desc("w")).first()
        width, n = (top["w"], top["count"]) if top else (0, 0)
        lists = max(2, lists or min(MOST_LISTS, round(math.sqrt(n))))
        listed = points.filter(proper & (F.size("embedding") == width))
        placed = points.withColumn("list", F.lit(UNLISTED)).withColumn("angle", F.lit(0.0)).limit(0)
        centroids = np.zeros((0, width))
        if n:
            share = min(1.0, lists * sample_per_list / n)
            chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
            features = listed.withColumn("_v", array_to_vector("embedding"))
            model = KMeans(
                k=lists, featuresCol="_v", predictionCol="list", distanceMeasure="cosine", seed=seed, maxIter=10,
            ).fit(features.filter(chosen))
            model.save(f"{folder}/model")
            centroids = np.array(model.clusterCenters())
            placed = _placed(model, listed, centroids)
        rest = points.filter(~(proper & (F.size("embedding") == width))).select(
            "*", F.lit(UNLISTED).alias("list"), F.lit(0.0).alias("angle"))
        columns = ["id", "embedding", *payload, "angle", "list"]
        everything = placed.select(*columns).union(rest.select(*columns))
        spark.createDataFrame([(everything.schema.json(),)], "value string").coalesce(1).write.text(f"{folder}/schema")
        # Rebalancing splits a list that holds very many rows over files.
        everything.hint("rebalance", "list").write.partitionBy(
            "list").parquet(f"{folder}/rows")
        cls._describe(spark, folder, centroids, everything.schema)
        return cls(spark, folder)

    @staticmethod
    def _describe(spark: SparkSession, folder: str, centroids: np.ndarray, schema: StructType) -> None:
        held = spark.read.schema(schema).parquet(f"{folder}/rows").groupBy(F.col("list").cast("int").alias("list")).agg(
            F.count("*").alias("rows"), F.max("angle").alias("radius"))
        _centroid_table(spark, centroids).join(held, "list").write.mode("overwrite").parquet(f"{folder}/lists")

    def add(self, rows: DataFrame) -> VectorIndex:
        """Index more rows under the centroids there are."""
        payload = [c for c in self.rows.columns if c not in ("id", "embedding", "angle", "list")]
        points = rows.filter("embedding IS NOT NULL").select("id", "embedding", *payload)
        proper = _finite("embedding") & F.coalesce(norm(F.col("embedding")) > 0, F.lit(False)) & (
            F.size("embedding") == self.centroids.shape[1])
        columns = [*points.columns, "angle", "list"]
        rest = points.filter(~proper) if len(self.centroids) else points
        more = rest.select("*", F.lit(0.0).alias("angle"), F.lit(UNLISTED).alias("list"))
        centroids = np.zeros((0, 0))
        if len(self.centroids):
            model = KMeansModel.load(f"{self.folder}/model")
            centroids = np.array(model.clusterCenters())
            more = more.union(_placed(model, points.filter(proper), centroids).select(*columns))
        more.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.folder}/rows")
        self._describe(self.spark, self.folder, centroids, self.rows.schema)
        return VectorIndex(self.spark, self.folder)

    # One query ---------------------------------------------------------------

    def _angles(self, vector: Sequence[float]) -> np.ndarray:
        q = np.asarray(vector, dtype=float)
        size = np.linalg.norm(q) * np.linalg.norm(self.centroids, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(size > 0, self.centroids @ q / size, 0.0)
        return np.arccos(np.clip(cosine, -1, 1))

    def rows_of(self, lists: Sequence[int]) -> DataFrame:
        return self.rows.filter(F.col("list").isin([UNLISTED, *map(int, lists)]))

    def nearest(
        self, vector: Sequence[float], k: int, probes: int | None = None, minimum: float | None = None,
        where: Column | None = None,
    ) -> DataFrame:
        """The k rows most similar to `vector`, by (similarity, id): exactly,
        or among the rows of the `probes` nearest lists. `where` restricts
        rows by payload; `minimum` drops what is not above it."""
        def best(lists: Sequence[int]) -> DataFrame:
            rows = self.rows_of(lists)
            rows = rows if where is None else rows.filter(where)
            scored = rows.withColumn("similarity", cosine_literal("embedding", vector))
            return scored.drop("embedding", "angle", "list").orderBy(F.desc("similarity"), "id").limit(k)

        found = best(self.probed(vector, k, probes, best))
        return found if minimum is None else found.filter(F.col("similarity") > minimum)

    def probed(self, vector: Sequence[float], k: int, probes: int | None, best) -> list[int]:
        """The lists to read; without `probes` all that can hold one of the k."""
        if len(vector) != self.centroids.shape[1] or not len(self.numbers):
            return list(self.numbers)
        angles = self._angles(vector)
        order = np.argsort(angles, kind="stable")
        if probes is not None:
            return list(self.numbers[order[:probes]])
        enough = int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1
        first = best(self.numbers[order[:enough]]).agg(
            F.count("similarity").alias("n"), F.min("similarity").alias("least")).first()
        if first["n"] < k:
            return list(self.numbers)
        bound = np.cos(np.maximum(0, angles - self.radius)) + SLACK
        return list(self.numbers[bound >= first["least"]])

    # Many queries --------------------------------------------------------------

    def nearest_of_each(
        self, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6,
    ) -> DataFrame:
        """(query_id, rank, id, similarity): the k nearest rows of every row
        of `queries` (query_id, vector), by similarity rounded to `digits`,
        then id; exactly, or among the `probes` nearest lists.

        Blocks of queries meet blocks of rows, and a block of queries multiplies
        only the lists one of them needs. Without `probes` a second round
        reads, for each query, the lists whose bound reaches its k-th
        similarity; vectors without clusters need nearly all, so the products
        grow with queries times rows, in tasks of bounded size.
        """
        usable = self._usable(queries)
        start = max(1, probes or math.ceil(math.sqrt(len(self.numbers))))
        wanted = usable.withColumns({"n": F.lit(0).cast("long"), "least": F.lit(None).cast("double")})
        found = stored(self._similar(wanted, k, digits, 0, start), "nearest")
        if probes is None:
            kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
            more = usable.join(kth, "query_id", "left")
            found = found.union(self._similar(more, k, digits, start, len(self.numbers)))
        rank = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
            "query_id", "rank", "id", "similarity")

    def _usable(self, queries: DataFrame) -> DataFrame:
        proper = F.col("vector").isNotNull() & _finite("vector") & (F.size("vector") == self.centroids.shape[1])
        return queries.filter(proper & (norm(F.col("vector")) > 0)).select(
            "query_id", "vector", norm(F.col("vector")).alias("_norm"))

    def _turns(self, queries: DataFrame) -> DataFrame:
        """Every query with every list, and the list's `turn` by angle."""
        numbers = F.array(*[F.lit(int(n)) for n in self.numbers]).cast("array<int>")
        lists = F.broadcast(self.lists.select("list", "centroid", "radius"))
        far = self._usable(queries).withColumn("list", F.explode(numbers)).join(lists, "list").withColumn(
            "far", _angle(F.col("vector"), F.col("centroid"))).drop("centroid")
        return far.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "list")))

    def probes_for(self, queries: DataFrame, k: int, share: float) -> int:
        """The least number of probes with which `queries` find `share` of
        their k nearest rows. Embeddings without clusters need many."""
        where = self.nearest_of_each(queries, k).join(self.rows.select("id", "list").distinct(), "id")
        turns = self._turns(queries).select("query_id", "list", "turn")
        # At most one count per list.
        held = where.join(turns, ["query_id", "list"], "left").groupBy(
            F.coalesce("turn", F.lit(0)).alias("turn")).count().orderBy("turn").collect()
        total, seen = sum(r["count"] for r in held), 0
        for r in held:
            seen += r["count"]
            if seen >= share * total:
                return max(1, r["turn"])
        return 1

    def _similar(self, queries: DataFrame, k: int, digits: int, above: int, upto: int) -> DataFrame:
        """(query_id, id, similarity) of the k best rows of each query, and
        more, among the lists of turns `above` < turn <= `upto`. A query that
        has `n` >= k rows already asks only the lists that can hold one of a
        similarity of `least`."""
        spark, rows = self.spark, self.rows.filter(F.col("list") != UNLISTED)
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, value double"
        # Stretches of lists; one that holds very many rows is cut by the id.
        cuts = np.maximum(1, -(-self.sizes // GROUP_ROWS))
        first = (np.cumsum(self.sizes) - self.sizes) // GROUP_ROWS
        parts = int((first + cuts).max(initial=0))
        dealt = spark.createDataFrame(
            [tuple(map(int, x)) for x in zip(self.numbers, first, cuts, strict=True)], "list int, first int, cuts int")
        blocks = max(1, -(-queries.count() // GROUP_QUERIES))
        tasks = min(MOST_TASKS, 4 * blocks * max(1, parts))
        asked = queries.select(
            "query_id", F.col("vector").cast("array<double>").alias("vector"), "n", "least",
            F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(max(0, parts - 1)))).alias("part"))
        held = rows.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("list").cast("int").alias("list")).join(
            F.broadcast(dealt), "list").select(
            "id", "embedding", "list", (F.col("first") + F.pmod(F.xxhash64("id", "embedding"), F.col("cuts"))).cast("int").alias("part"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        shared = spark.sparkContext.broadcast((self.numbers, self.radius, self.centroids))
        found = asked.repartition(tasks, "block", "part").groupBy("block", "part").cogroup(
            held.repartition(tasks, "block", "part").groupBy("block", "part")).applyInArrow(
            _best_pairs(shared, k, digits, above, upto), kinds)
        return found.select("query_id", "id", F.round(F.col("value").cast("decimal(28,10)"), digits).cast("double").alias("similarity"))


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def _summed(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of `a` and j of `b`, added up in the order of `dot`."""
    out = np.zeros(len(i))
    for x, y in zip(a.T, b.T, strict=True):
        out += x[i] * y[j]
    return out


def _asked_lists(shared, q: np.ndarray, size: np.ndarray, n: np.ndarray, least: np.ndarray, k: int, digits: int, above: int, upto: int):
    """Which of the index's lists each query asks."""
    _, radius, centroids = shared
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.nan_to_num(q @ centroids.T / (size[:, None] * np.linalg.norm(centroids, axis=1)))
    far = np.arccos(np.clip(cosine, -1, 1))
    turn = np.empty(far.shape, dtype=np.intp)
    np.put_along_axis(turn, np.argsort(far, axis=1, kind="stable"), np.arange(1, far.shape[1] + 1)[None, :], axis=1)
    bound = np.cos(np.maximum(0, far - radius)) + 10.0 ** -digits + SLACK
    return (turn > above) & (turn <= upto) & ((n < k)[:, None] | (bound >= least[:, None]))


def _kth_best(query: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which candidates can be among the k best of their query: those not
    behind k others, whatever the values between `low` and `high` are."""
    order = np.lexsort((place, -low, query))
    sorted_query = query[order]
    start = np.searchsorted(sorted_query, sorted_query)
    pivot = order[np.minimum(start + k - 1, np.searchsorted(sorted_query, sorted_query, side="right") - 1)]
    kept = np.empty(len(query), dtype=bool)
    few = np.searchsorted(sorted_query, sorted_query, side="right") - start <= k
    kept[order] = few | (high[order] > low[pivot]) | ((high[order] == low[pivot]) & (place[order] <= place[pivot]))
    return kept


def _best_pairs(shared, k: int, digits: int, above: int, upto: int):
    """(query_id, id, value) of one block of queries with one of rows: the k
    best of each query by rounded similarity, then id, and rows that rounding
    could bring among them."""
    unit, near = 10.0 ** digits, ROUNDING * 10.0 ** digits

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id") if len(rows) else rows
        names = ["query_id", "id", "value"]
        parts = [(queries.column("query_id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.float64()))]
        if len(queries) and len(rows):
            q, e = _matrix(queries.column("vector"), len(queries)), _matrix(rows.column("embedding"), len(rows))
            every = np.arange(max(len(q), len(e)))
            q_size, e_size = (np.sqrt(_summed(m, every[:len(m)], m, every[:len(m)])) for m in (q, e))
            count = np.nan_to_num(queries.column("n").to_numpy(zero_copy_only=False).astype(float))
            least = queries.column("least").to_numpy(zero_copy_only=False).astype(float)
            asked = _asked_lists(shared.value, q, q_size, count, least, k, digits, above, upto)
            listed = np.searchsorted(shared.value[0], rows.column("list").to_numpy())
            lists = np.unique(listed)
            needed = np.flatnonzero(asked[:, lists].any(axis=1))
            for at in range(0, len(needed), CHUNK_QUERIES):
                some = needed[at:at + CHUNK_QUERIES]
                # Rows of lists that none of these queries asks are not multiplied.
                mine = np.flatnonzero(asked[some].any(axis=0)[listed])
                s = q[some] @ e[mine].T
                s /= q_size[some][:, None]
                s /= e_size[mine]
                # Lengths beyond the range of doubles.
                s[np.isnan(s)] = -np.inf
                if not asked[np.ix_(some, lists)].all():
                    s[~asked[some][:, listed[mine]]] = -np.inf
                floor = np.full(len(some), -2.0)
                if len(mine) > k:
                    floor = np.maximum(floor, np.partition(s, len(mine) - k, axis=1)[:, len(mine) - k])
                known = count[some] >= k
                floor[known] = np.maximum(floor[known], least[some][known])
                i, j = np.nonzero(s >= (floor - 2 / unit - 2 * ROUNDING)[:, None])
                scaled = s[i, j] * unit
                best = _kth_best(i, np.floor(scaled - near + .5), np.floor(scaled + near + .5), mine[j], k)
                i, j = some[i[best]], mine[j[best]]
                value = _summed(q, i, e, j) / (e_size[j] * q_size[i])
                parts.append((queries.column("query_id").take(i), rows.column("id").take(j), pa.array(value)))
        return pa.concat_tables([pa.table(dict(zip(names, p, strict=True))) for p in parts])

    return run


def _placed(model: KMeansModel, points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`points` with the `list` of the nearest centroid and the `angle` to it."""
    near = model.transform(points.withColumn("_v", array_to_vector("embedding"))).drop("_v")
    table = _centroid_table(points.sparkSession, centroids)
    return near.join(F.broadcast(table), "list").withColumn(
        "angle", _angle(F.col("embedding"), F.col("centroid"))).drop("centroid")


def _angle(a: Column, b: Column) -> Column:
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def _centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame(
        [(i, [float(c) for c in row]) for i, row in enumerate(centroids)], "list int, centroid array<double>")


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """Share of the (query_id, id) pairs in `wanted` that `found` holds."""
    hit = wanted.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return hit.count() / max(1, wanted.count())
