"""Ranked lexical search: exact inner products over sparse ball trees.

A document is the sparse integer vector of its terms' saturated frequencies,
a query the vector of its terms' weights, and the score their inner product.
Documents are first reduced to the terms that queries ask for and written as
postings; corpus statistics come from all of them. Each task then groups the
documents of a batch into a ball tree. A subtree with centroid c and radius r
holds no score above q.c + |q| r. The bound is taken per group of terms (each
of the most frequent terms is a group of its own, the others share some),
which is the same inequality in each subspace and much tighter for sparse
queries; with few groups next to no subtree is left out. Bounds are floating
point and rounded up by more than their error; subtrees are visited best
first, and pruned only strictly below the k-th score, so ties by id stay
exact. Leaves are scored in integers.

Each task hands on at most k documents a query; Spark merges them. Queries
come in blocks of at most about `BLOCK_TERMS` terms, one pass each, so what is
broadcast stays bounded however many queries there are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.bytewords import ALPHANUMERIC, Words, chunks
from docspark.session import small_batches, stored

#: Terms of the queries of one block, repeats among queries included.
BLOCK_TERMS = 8192
LEAF = 8
#: Documents of one tree.
TREE_DOCS = 4096
#: Groups of terms with a radius each; the first `OWN` hold one term.
GROUPS, OWN = 2048, 2000
SKETCH = 16
#: Relative and absolute rise of a bound, far above the rounding error of
#: single-precision centroids and radii.
RELATIVE, ABSOLUTE = 1e-5, 1.0
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Distinct terms of a text; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)))


class Queries:
    """One block of queries: ids, distinct terms, and each query's term numbers."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        self.terms = sorted({t for _, t in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        held: dict[int | None, list[int]] = {}
        for item, term in rows:
            held.setdefault(item, []).append(number[term])
        self.ids = list(held)
        self.numbers = [np.array(sorted(held[i]), dtype=np.int64) for i in self.ids]
        words = next(chunks(pa.array(self.terms, pa.large_string()), ALPHANUMERIC))
        hashes = words.hashes(lower=True)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        if len(np.unique(hashes)) < len(self.terms):
            raise ValueError("two query terms share a 64-bit hash")

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known words, their term numbers)."""
        h = words.hashes(lower=True)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[at] == h)
        return known, self.by_hash[at[known]]


# Postings --------------------------------------------------------------------

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"


def _postings(shared):
    """n and the query terms with their counts, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        v = len(queries.terms)
        for batch in batches:
            for words in chunks(batch.column("text"), ALPHANUMERIC):
                known, number = queries.find(words)
                text = np.searchsorted(words.bounds, known, side="right") - 1
                cell, count = np.unique(text * v + number, return_counts=True)
                ends = pa.array(np.searchsorted(cell // v, np.arange(words.n_texts + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(words.first, words.n_texts),
                    pa.array(np.diff(words.bounds).astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array((cell % v).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "counts"])

    return run


# Ball tree -------------------------------------------------------------------

class BallTree:
    """Documents of one batch in leaf order, with centroid and radii per node.

    Geometry: coordinate t of a document is sqrt(w_t) f_t, of a query
    sqrt(w_t), so inner products are the scores.
    """

    def __init__(self, bounds: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray, group: np.ndarray) -> None:
        n = len(bounds) - 1
        root = np.sqrt(weight.astype(np.float64))
        point = value * root[term]
        directions = np.random.Generator(np.random.PCG64(11)).standard_normal((len(weight), SKETCH))
        sketch = np.empty((n, SKETCH))
        for k in range(SKETCH):
            sketch[:, k] = np.add.reduceat(point * directions[term, k], bounds[:-1])
        self.order = np.arange(n)
        self.start, self.end, self.left = [0], [n], [-1]
        at = 0
        while at < len(self.start):
            a, b = self.start[at], self.end[at]
            if b - a > LEAF:
                middle = (a + b) // 2
                self.order[a:b] = self._halves(self.order[a:b], sketch, middle - a)
                self.left[at] = len(self.start)
                self.start += [a, middle]
                self.end += [middle, b]
                self.left += [-1, -1]
            at += 1
        sizes = np.diff(bounds)[self.order]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        pick = np.arange(self.bounds[-1]) + np.repeat(bounds[self.order] - self.bounds[:-1], sizes)
        self.value = value[pick]
        # Only the terms that occur here have columns.
        self.here, self.term = np.unique(term[pick], return_inverse=True)
        self._measure(point[pick], group[self.here], np.repeat(np.arange(n), sizes))

    @staticmethod
    def _halves(rows: np.ndarray, sketch: np.ndarray, middle: int) -> np.ndarray:
        s = sketch[rows]
        far = s[np.argmax(((s - s.mean(axis=0)) ** 2).sum(axis=1))]
        other = s[np.argmax(((s - far) ** 2).sum(axis=1))]
        return rows[np.argpartition(s @ (other - far), middle)]

    def _measure(self, point: np.ndarray, group: np.ndarray, doc: np.ndarray) -> None:
        nodes, v = len(self.start), len(self.here)
        start, end, left = (np.array(x) for x in (self.start, self.end, self.left))
        # Sum, least and largest coordinate per term: of leaves from their
        # documents, of the others from their halves. Halves come later.
        leaves = np.flatnonzero(left < 0)
        order = leaves[np.argsort(start[leaves])]
        leaf = order[np.searchsorted(start[order], doc, side="right") - 1]
        cell = leaf * v + self.term
        self.centroid = np.bincount(cell, point, nodes * v).reshape(nodes, v).astype(np.float32)
        met = np.bincount(cell, minlength=nodes * v)
        most, least = np.zeros(nodes * v, dtype=np.float32), np.full(nodes * v, np.inf, dtype=np.float32)
        np.maximum.at(most, cell, point.astype(np.float32))
        np.minimum.at(least, cell, point.astype(np.float32))
        # A document without the term has 0 there.
        least[met < np.repeat(end - start, v)] = 0
        most, least = most.reshape(nodes, v), least.reshape(nodes, v)
        for k in range(nodes - 1, -1, -1):
            if left[k] >= 0:
                a, b = left[k], left[k] + 1
                self.centroid[k] = self.centroid[a] + self.centroid[b]
                np.maximum(most[a], most[b], out=most[k])
                np.minimum(least[a], least[b], out=least[k])
        self.centroid /= (end - start)[:, None].astype(np.float32)
        self.radius = np.zeros((nodes, GROUPS), dtype=np.float32)
        alone = np.flatnonzero(group < OWN)
        self.radius[:, group[alone]] = np.maximum(
            most[:, alone] - self.centroid[:, alone], self.centroid[:, alone] - least[:, alone])
        shared = np.flatnonzero(group[self.term] >= OWN)
        if len(shared):
            self._measure_shared(point[shared], self.term[shared], group, doc[shared])

    def _measure_shared(self, point: np.ndarray, term: np.ndarray, group: np.ndarray, doc: np.ndarray) -> None:
        """Radii of the groups of several terms, from every document below."""
        n_groups, tail = GROUPS - OWN, group >= OWN
        slot = doc * n_groups + group[term] - OWN
        for k in range(len(self.start)):
            a, b = self.start[k], self.end[k]
            part = slice(*np.searchsorted(doc, [a, b]))
            c = self.centroid[k].astype(np.float64)
            p, cross, n = point[part], 2 * point[part] * c[term[part]], (b - a) * n_groups
            at = slot[part] - a * n_groups
            own = np.bincount(group[tail] - OWN, c[tail] ** 2, n_groups)
            square = np.bincount(at, p * p - cross, n).reshape(-1, n_groups) + own
            size = np.bincount(at, p * p + cross, n).reshape(-1, n_groups) + own
            self.radius[k, OWN:] = np.sqrt(np.maximum(0, square + 1e-11 * size).max(axis=0))

    def ceilings(self, numbers: np.ndarray, root: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For each node, a number no score of the query below it exceeds."""
        at = np.searchsorted(self.here, numbers)
        at[at == len(self.here)] = 0
        held = self.here[at] == numbers
        inner = self.centroid[:, at[held]].astype(np.float64) @ root[numbers[held]]
        groups, slot = np.unique(group[numbers], return_inverse=True)
        length = np.sqrt(np.bincount(slot, root[numbers] ** 2))
        return (inner + self.radius[:, groups].astype(np.float64) @ length) * (1 + RELATIVE) + ABSOLUTE

    def scores(self, leaf: int, weight_here: np.ndarray) -> np.ndarray:
        a, b = self.start[leaf], self.end[leaf]
        cut = self.bounds[a:b + 1]
        parts = weight_here[self.term[cut[0]:cut[-1]]] * self.value[cut[0]:cut[-1]]
        return np.add.reduceat(parts, cut[:-1] - cut[0])


class Best:
    """The k best of what one query has met: score falling, then id, nulls last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score = np.zeros(0, dtype=np.int64)
        self.doc = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)
        #: Scores below it are of no use.
        self.least = 1

    def offer(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score, doc, null = (np.concatenate([old, new[good]]) for old, new in (
            (self.score, score), (self.doc, doc), (self.null, null)))
        kept = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[kept], doc[kept], null[kept]
        if len(kept) == self.k:
            self.least = max(1, int(self.score[-1]))


def _search_tree(tree: BallTree, doc: np.ndarray, null: np.ndarray, numbers: np.ndarray,
                 weight: np.ndarray, root: np.ndarray, group: np.ndarray, best: Best) -> int:
    """Best-first search of one tree for one query; the leaves it scored."""
    ceiling = tree.ceilings(numbers, root, group)
    weight_here, scored = None, 0
    queue = [(-ceiling[0], 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < best.least:
            return scored
        child = tree.left[node]
        if child >= 0:
            for n in (child, child + 1):
                if ceiling[n] >= best.least:
                    heapq.heappush(queue, (-ceiling[n], n))
            continue
        if weight_here is None:
            mine = np.zeros(len(weight), dtype=np.int64)
            mine[numbers] = weight[numbers]
            weight_here = mine[tree.here]
        rows = tree.order[tree.start[node]:tree.end[node]]
        best.offer(tree.scores(node, weight_here), doc[rows], null[rows])
        scored += 1
    return scored


def saturated(count: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), with m of a document of n terms."""
    if 50 * n_docs * int(n.max(initial=0)) < 2 ** 63:
        m = 50 + (50 * n_docs * n) // n_terms
    else:
        m = np.array([50 + (50 * n_docs * int(x)) // n_terms for x in n], dtype=np.int64)
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


def _groups(frequency: np.ndarray) -> np.ndarray:
    rank = np.empty(len(frequency), dtype=np.int64)
    rank[np.argsort(-frequency, kind="stable")] = np.arange(len(frequency))
    return np.where(rank < OWN, rank, OWN + (rank - OWN) % (GROUPS - OWN))


def _search(shared, k: int):
    """At most k documents a query from all batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, frequency, n_docs, n_terms = shared.value
        root, group = np.sqrt(weight.astype(np.float64)), _groups(frequency)
        best = [Best(k) for _ in queries.ids]
        useful = [numbers[weight[numbers] > 0] for numbers in queries.numbers]
        for batch in batches:
            lists = batch.column("terms")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            ids = batch.column("doc_id")
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            n = np.repeat(batch.column("n").to_numpy(), sizes)
            count = batch.column("counts").flatten().to_numpy().astype(np.int64)
            value = saturated(count, n, n_docs, n_terms)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            tree = BallTree(bounds, lists.flatten().to_numpy(), value, weight, group)
            for numbers, found in zip(useful, best, strict=True):
                if len(numbers):
                    _search_tree(tree, doc, null, numbers, weight, root, group, found)
        for item, found in zip(queries.ids, best, strict=True):
            if len(found.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(found.score), pa.int64()),
                    pa.array(found.doc, mask=found.null), pa.array(found.score)],
                    names=["item_id", "doc_id", "score"])

    return run


def _query_blocks(benchmark: DataFrame, block_terms: int) -> Iterator[Queries]:
    """Queries in blocks of about `block_terms` terms, by a hash of their id."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(
        F.col("text").cast("string"))).alias("term")).distinct()
    held = stored(rows, "query-terms")
    blocks = -(-held.count() // block_terms)
    for block in range(blocks):
        part = held.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if part:
            yield Queries([(r["item_id"], r["term"]) for r in part])


def lexical_search(
    docs: DataFrame, benchmark: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item.

    Only scores above 0 count; equal scores go by ascending id, nulls last.
    Items that share an id are one item with the terms of all, a null id is
    an id like any other, an item without terms has no rows. Rows of `docs`
    that share an id are ranked on their own. Null and empty texts have no
    terms and count nowhere. An empty table gives no rows. Other columns of
    both tables are not read. Words are told apart by 64-bit hashes.
    """
    with small_batches(docs.sparkSession, TREE_DOCS):
        found = _candidates(docs, benchmark, k, block_terms)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


def _candidates(docs: DataFrame, benchmark: DataFrame, k: int, block_terms: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of every task."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for queries in _query_blocks(benchmark, block_terms):
        postings = stored(rows.mapInArrow(_postings(spark.sparkContext.broadcast(queries)), POSTINGS), "postings")
        totals = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        # At most one number per term of the block.
        held = postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        frequency = np.zeros(len(queries.terms), dtype=np.int64)
        for r in held:
            frequency[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * int(f) + 1))) for f in frequency], dtype=np.int64)
        shared = spark.sparkContext.broadcast((queries, np.maximum(weight, 0), frequency, totals["docs"], totals["terms"]))
        # Written here: a tree holds one Arrow batch, whose size is set now.
        part = postings.filter(F.size("terms") > 0).mapInArrow(_search(shared, k), "item_id long, doc_id long, score long")
        found = found.union(stored(part, "candidates"))
    return found


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT rid, doc_id, len(ts) AS n, ts FROM t WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
v AS (SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)) AS f FROM p, s),
r AS (SELECT item_id, doc_id, sum(weight * f)::BIGINT AS score
  FROM q JOIN w USING (term) JOIN v USING (term) GROUP BY item_id, rid, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 50
"""
