"""Jaccard metric-space join: documents whose word shingles nearly agree.

The space is cut twice, each time by a triangle inequality, so no link is lost.

* **Regions.** Shingles have one global order, rare ones first. The pivots of
  a document are its first `n - ceil(t n) + 1` shingles: two sets with
  similarity t or more always share a pivot, so every document is replicated
  exactly to the regions at whose boundary a partner could lie. Documents as
  pivots do not work here: unrelated texts are all at distance 1 from each
  other, and the window of a document pivot would hold everything.
* **Voronoi step.** Each region has a centre document. The distance of every
  member to its centre is computed exactly, once per distinct pair. Members
  within the radius are linked to the centre and form one component. A second
  step takes the regions' largest components as centres.
* **Recursion on what is left.** Only members of different components are
  compared further, inside their region, and only those that the triangle
  inequality admits: counts of shingles in 256 hash cells are distances to
  fixed pivot sets in the symmetric-difference metric, and
  `sum |c_i(A) - c_i(B)| <= |A xor B| <= (1 - t) / (1 + t) (|A| + |B|)`
  must hold for a link. A pair that shares several regions is handled in the
  first of them only. Survivors are verified exactly.

Equal sets are collapsed to one class before anything is joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.bytewords import NOT_SPACE, chunks, mix
from docspark.llm.components import components
from docspark.session import small_batches, stored

#: Frequency table of shingle hashes: 2^20 counters in 16 parts. It only
#: orders shingles, so collisions cost speed and never a link.
SLOT_BITS, PARTS = 20, 16
CELLS = 256
#: Least pivots of a document that its rows carry in the last step.
CARRIED = 8
#: Members of a region compared in one task; larger regions are cut in blocks.
BLOCK = 1024
#: Bits of the filter that says which documents a verification needs.
NEEDED_BITS = 1 << 23


def shingle_sets(texts: pa.Array, n_words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for words in chunks(texts, NOT_SPACE):
        h = words.hashes(lower=True)
        s = np.zeros(max(0, len(h) - n_words + 1), dtype=np.uint64)
        for j in range(n_words):
            s = mix(s * np.uint64(0x2545F4914F6CDD1D) + h[j:j + len(s)] + np.uint64(j + 1))
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            if b - a >= n_words:
                yield np.unique(s[a:b - n_words + 1])
            elif b > a:
                one = np.zeros(1, dtype=np.uint64)
                for j in range(a, b):
                    one = mix(one * np.uint64(0xD6E8FEB86659FD93) + h[j:j + 1] + np.uint64(b - a))
                yield one
            else:
                yield s[:0]


def _signature(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    m = mix(s + np.uint64(0x51ED270B76A3B1A5))
    return (int(np.add.reduce(s).view(np.int64)),
            int(np.bitwise_xor.reduce(m).view(np.int64)))


def _classes_and_counts(n_words: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig1", pa.int64()),
        ("sig2", pa.int64()), ("part", pa.int32()), ("task", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            n, one, two = [], [], []
            held: list[np.ndarray] = []
            pending = 0
            for s in shingle_sets(batch.column(1), n_words):
                n.append(len(s))
                a, b = _signature(s)
                one.append(a)
                two.append(b)
                held.append(s)
                pending += len(s)
                if pending > 1_000_000:
                    _count(counts, held)
                    held, pending = [], 0
            _count(counts, held)
            empty = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                pa.array(two, pa.int64()), empty.cast(pa.int32()), empty.cast(pa.int64()),
                empty.cast(pa.binary())], schema=schema)
        blobs = [zlib.compress(part.astype("<i8").tobytes(), 1) for part in np.split(counts, PARTS)]
        none = pa.nulls(PARTS, pa.int64())
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            none, none, none, none, pa.array(range(PARTS), pa.int32()),
            pa.array([task] * PARTS, pa.int64()), pa.array(blobs, pa.binary())], schema=schema)

    return run


def _count(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        slots = (np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        counts += np.bincount(slots, minlength=len(counts))


def _add_counts(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(
        np.frombuffer(zlib.decompress(b.as_py()), dtype="<i8") for b in table.column("counts"))
    return pa.table({
        "part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()),
        "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _slot_counts(rows: DataFrame) -> np.ndarray:
    """Sum of all tasks' counters, added in a tree of fan-in 64. 8 MB at any size."""
    parts = rows.filter("counts IS NOT NULL").select("part", "task", "counts")
    for _ in range(3):
        parts = parts.withColumn("task", F.expr("task div 64")).groupBy("part", "task").applyInArrow(
            _add_counts, "part int, task long, counts binary")
    found = parts.collect()
    table = np.zeros((PARTS, (1 << SLOT_BITS) // PARTS), dtype=np.int64)
    for row in found:
        table[row.part] += np.frombuffer(zlib.decompress(row.counts), dtype="<i8")
    return table.ravel()


def _pivots(n_words: int, num: int, den: int, order):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()),
        ("n", pa.int32()), ("pivots", pa.list_(pa.int64())), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            ids, one, two, n, pivots, cells = [], [], [], [], [], []
            keys = batch.column(0)
            for i, s in enumerate(shingle_sets(batch.column(1), n_words)):
                if not len(s) or not keys[i].is_valid:
                    continue
                a, b = _signature(s)
                k = len(s) + (-num * len(s)) // den + 1
                first = rank[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                chosen = s[np.lexsort((s, first))[:k]]
                ids.append(keys[i].as_py())
                one.append(a)
                two.append(b)
                n.append(len(s))
                pivots.append(chosen.view(np.int64))
                cells.append(_cells(s))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                pa.array(n, pa.int32()), pa.array(pivots, pa.list_(pa.int64())),
                pa.array(cells, pa.binary())], schema=schema)

    return run


def _cells(s: np.ndarray) -> bytes:
    cells = np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _matrix(cells: pa.Array | pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(c.as_py() for c in cells)
    return np.frombuffer(joined, dtype=np.uint8).astype(np.int16).reshape(-1, CELLS)


def _sizes_fit(a, b, num: int, den: int):
    return (a * den >= b * num) & (b * den >= a * num)


def _cells_fit(l1, a, b, num: int, den: int):
    """|A xor B| <= (1 - t) / (1 + t) (|A| + |B|), with l1 <= |A xor B|."""
    return l1 * (den + num) <= (den - num) * (a + b)


def _near_pairs(num: int, den: int):
    """Pairs (a, b) with sizes and cells: keep those the cells admit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            l1 = np.abs(_matrix(batch.column("ca")) - _matrix(batch.column("cb"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(_cells_fit(l1, a, b, num, den)))

    return run


def _cross_pairs(num: int, den: int):
    """Rows sorted by (pivot, lo, hi): pairs of one group whose components
    differ and whose sizes and cells fit. Whole groups only; the last one of a
    batch is carried over, and a group has at most two blocks of members."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        ids, side, n, root = (
            t.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "side", "n", "root"))
        group = _group_numbers(t)
        cells, pivot = _matrix(t.column("cells")), t.column("pivot").to_numpy()
        least = _carried(t.column("least"))
        left, right = [ids[:0]], [ids[:0]]
        at, step = np.arange(len(ids)), 1
        while True:
            at = at[at + step < len(ids)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            to = at + step
            fit = (root[at] != root[to]) & ((side[at] < 0) | (side[at] != side[to]))
            fit &= _sizes_fit(n[at], n[to], num, den)
            i, j = at[fit], to[fit]
            l1 = np.abs(cells[i] - cells[j]).sum(axis=1)
            near = _cells_fit(l1, n[i], n[j], num, den)
            near[near] = ~_meets_before(least[i[near]], least[j[near]], pivot[i[near]])
            left.append(np.minimum(ids[i], ids[j])[near])
            right.append(np.maximum(ids[i], ids[j])[near])
            step += 1
        found = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carried, t]) if carried is not None else t
            group = _group_numbers(t)
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if cut:
                yield pairs(t.slice(0, cut))
            carried = t.slice(cut)
        if carried is not None and carried.num_rows:
            yield pairs(carried)

    return run


def _carried(lists: pa.ChunkedArray) -> np.ndarray:
    """The lists as rows of a matrix, filled up with the row's last value."""
    out = np.empty((len(lists), CARRIED), dtype=np.int64)
    for row, values in zip(out, lists.to_pylist()):
        row[:] = (values + values[-1:] * CARRIED)[:CARRIED]
    return out


def _meets_before(a: np.ndarray, b: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Whether two rows share a carried pivot below this region's."""
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return (common & (a < pivot[:, None])).any(axis=1)


def _group_numbers(t: pa.Table) -> np.ndarray:
    change = np.zeros(t.num_rows, dtype=np.int64)
    for c in ("pivot", "lo", "hi"):
        v = t.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def _needed_sets(n_words: int, needed):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(needed.value, dtype=np.uint8)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            keys = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(_in_filter(bits, keys), pa.bool_()))
            ids, sets, size = [], [], 0
            for key, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n_words)):
                ids.append(key)
                sets.append(s.tobytes())
                size += len(s)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
                    ids, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _bit(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(NEEDED_BITS)).astype(np.int64)


def _in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bit(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _filter_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(NEEDED_BITS, dtype=bool)
    for batch in batches:
        bits[_bit(batch.column(0).to_numpy())] = True
    packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
    yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["bits"])


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(docs: DataFrame, pairs: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold.

    Sets are computed for the documents of the pairs only. A filter of fixed
    size (1 MB) spares the others; it may let some through, never too few.
    """
    spark = docs.sparkSession
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    bits = np.zeros(NEEDED_BITS // 8, dtype=np.uint8)
    for row in ends.distinct().coalesce(32).mapInArrow(_filter_of_task, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
    needed = spark.sparkContext.broadcast(bits.tobytes())
    sets = stored(docs.mapInArrow(_needed_sets(n_words, needed), "doc_id long, shingles binary"), "sets")
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return stored(
        pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb")
        .mapInArrow(_verify(num, den), "a long, b long").distinct(), "verified")


def jaccard_components(
    docs: DataFrame, n_words: int = 3, num: int = 90, den: int = 100,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    Two documents link when `den * |A and B| >= num * |A or B|` over distinct
    `n_words`-word shingles, A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`.
    With fewer words the whole sequence is the one shingle. Null, empty and
    blank texts have no shingle and link with nothing. `component_id` is the
    least id reachable over links. Rows that share an id are one document
    with several texts; a null id links with nothing and has a null component.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return _components(docs, n_words, num, den)


def _components(docs: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    scanned = stored(docs.mapInArrow(
        _classes_and_counts(n_words),
        "doc_id long, n_shingles long, sig1 long, sig2 long, part int, task long, counts binary"), "classes")
    rows = scanned.filter("counts IS NULL").select("doc_id", "n_shingles", "sig1", "sig2")
    order = spark.sparkContext.broadcast(_slot_counts(scanned).astype(np.int32))

    classes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(
        "n_shingles", "sig1", "sig2").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes, "representatives")
    described = docs.mapInArrow(
        _pivots(n_words, num, den, order),
        "doc_id long, sig1 long, sig2 long, n int, pivots array<long>, cells binary")
    keep = classes.select(F.col("rep").alias("doc_id"), "sig1", "sig2")
    members = stored(described.join(keep, ["doc_id", "sig1", "sig2"]).dropDuplicates(
        ["doc_id", "sig1", "sig2"]), "members")
    info = members.select("doc_id", "n", "cells")

    placed = members.select("doc_id", "n", F.explode("pivots").alias("pivot"))
    centre = F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "n")).alias("centre")
    # Regions with the same members say the same; one of them is enough. Near
    # copies share nearly all their pivots, so this leaves few regions each.
    # Members are told by three sums of 31-bit hashes, which also see an id twice.
    members_of = [F.sum(F.xxhash64("doc_id", F.lit(s)).bitwiseAND(F.lit(0x7FFFFFFF))).alias(f"x{s}") for s in (3, 4, 5)]
    shared = placed.groupBy("pivot").agg(centre, F.count("*").alias("held"), *members_of).filter("held > 1")
    shared = shared.groupBy("held", "x3", "x4", "x5").agg(
        F.min("pivot").alias("pivot"), F.first("centre").alias("centre")).drop("x3", "x4", "x5")
    regions = stored(placed.join(shared, "pivot").select(
        "pivot", "doc_id", "n", "held", F.col("centre.doc_id").alias("centre"),
        F.col("centre.n").alias("n_centre")), "regions")

    def near(pairs: DataFrame) -> DataFrame:
        sides = [info.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("cells").alias(f"c{s}")) for s in "ab"]
        return pairs.join(sides[0], "a").join(sides[1], "b").select(
            "a", "b", "na", "nb", "ca", "cb").mapInArrow(_near_pairs(num, den), "a long, b long")

    fits = F.expr(f"n * {den} >= n_centre * {num} AND n_centre * {den} >= n * {num} AND doc_id <> centre")
    ordered = [F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")]
    links = _links(docs, near(regions.filter(fits).select(*ordered).distinct()), n_words, num, den)
    for last in (False, True):
        roots = components(links)
        known = roots.select(F.col("node").alias("doc_id"), "root")
        labelled = regions.select("pivot", "doc_id", "n", "held").join(known, "doc_id", "left").withColumn(
            "root", F.coalesce("root", "doc_id"))
        mixed = labelled.groupBy("pivot").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("pivot")
        open_regions = stored(labelled.join(mixed, "pivot"), "open")
        if last:
            break
        by_root = open_regions.groupBy("pivot", "root").agg(
            F.count("*").alias("k"), F.max(F.struct(F.xxhash64("doc_id", F.lit(1)), "doc_id", "n")).alias("one"))
        largest = by_root.groupBy("pivot").agg(F.max(F.struct("k", "root", "one")).alias("m")).select(
            "pivot", F.col("m.root").alias("main"), F.col("m.one.doc_id").alias("centre"),
            F.col("m.one.n").alias("n_centre"))
        again = open_regions.join(largest, "pivot").filter("root <> main").filter(fits)
        links = links.union(_links(docs, near(again.select(*ordered).distinct()), n_words, num, den))

    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("nb")).cast("int")
    # A large region becomes one task per pair of blocks. side tells the two
    # blocks apart; inside the diagonal block it is -1, so all pairs count.
    spread = open_regions.withColumn("nb", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "pivot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"),
        "doc_id", "n", "root")
    keys = ["pivot", "lo", "hi"]
    least = open_regions.groupBy("doc_id").agg(
        F.slice(F.sort_array(F.collect_list("pivot")), 1, CARRIED).alias("least"))
    carried = info.select("doc_id", "cells").join(least, "doc_id")
    crossed = spread.join(carried, "doc_id").repartition(*keys).sortWithinPartitions(
        *keys).mapInArrow(_cross_pairs(num, den), "a long, b long").distinct()
    rest = _links(docs, crossed, n_words, num, den)

    classed = rows.join(classes, ["n_shingles", "sig1", "sig2"], "left").select(
        "doc_id", "n_shingles", "rep")
    # Rows that share an id are one document: its classes hang together.
    several = classed.filter("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id").agg(
        F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("doc_id")
    shared_ids = classed.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(links.union(rest).union(shared_ids)).select(F.col("node").alias("rep"), "root")
    joined = classed.join(roots, "rep", "left")
    # An empty text beside others under one id follows the others.
    least = joined.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.coalesce("root", "rep", "doc_id")).alias("component_id"))
    return rows.select("doc_id", "n_shingles").join(least, "doc_id", "left")
