"""A trigram index for "contains" searches, verified on the text.

Documents lie in blocks of bounded size, in the order they were read; within
a block a document is a small number, its slot. For each trigram and block the
index holds the sorted slots, stored as differences. Needles become
conditions: every trigram of a literal part of three characters or more, and
for shorter parts the trigrams that begin with it. Texts are padded, so that
their last characters begin trigrams as well.

A block's postings are made where its texts lie, by sorting the trigrams of
one stretch of text after another, so the shuffle moves lists of slots and not
a row for every trigram of every document.

Postings are partitioned by the first character of the trigram and sorted
within: a search reads the partitions its conditions name, intersects the
rarest conditions per block, and then tests only the candidates' texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import scratch_path, small_batches, stored

BLOCK_DOCS = 4096
SHARDS = 64
#: Characters whose trigrams are sorted at once.
STRETCH = 1 << 16
#: Pairs of a trigram and a document held before their postings are written.
MOST_PAIRS = 1 << 22
#: Conditions that are intersected; the text decides about the others.
MOST_CONDITIONS = 4
#: Candidate blocks up to which the scan of texts is pruned by number.
NAMED_BLOCKS = 1000
SEPARATOR = "\u0001"
_PAD = "\u0002"
_LITTLE_FILES = {"parquet.writer.version": "v2", "compression": "zstd"}


def search_text(columns: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(SEPARATOR, *columns))


def _stretches(texts: Sequence[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Texts with their padding, one after another, of at most `STRETCH`
    characters together, and the text every character is of; -1 where no
    trigram begins. A longer text is cut so that it keeps its trigrams."""
    parts: list[str] = []
    sizes: list[tuple[int, int]] = []
    n = 0

    def out() -> tuple[str, np.ndarray]:
        owner = np.repeat(np.array([[i, -1] for i, _ in sizes]).ravel(), np.array([[size - 2, 2] for _, size in sizes]).ravel())
        return "".join(parts), owner

    for i, text in enumerate(texts):
        padded = text + _PAD * 2
        for at in range(0, len(text), STRETCH - 2):
            part = padded[at:at + STRETCH]
            if n + len(part) > STRETCH and parts:
                yield out()
                parts, sizes, n = [], [], 0
            parts.append(part)
            sizes.append((i, len(part)))
            n += len(part)
    if parts:
        yield out()


def _trigrams_of(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, text) of the distinct trigrams of each text, sorted, for one
    stretch after another; 21 bits of a code are a character."""
    for chars, owner in _stretches(texts):
        points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        held = np.zeros(0x110000, dtype=bool)
        held[points] = True
        alphabet = np.flatnonzero(held)
        rank = np.zeros(0x110000, dtype=np.int64)
        rank[alphabet] = np.arange(len(alphabet))
        at = np.flatnonzero(owner >= 0)
        ranks, n, first = rank[points], len(alphabet), owner[at[0]]
        # Below 2^63: at most 2^16 characters, and texts of one Arrow batch.
        wide = int(owner[at[-1]] - first) + 1
        keys = ((ranks[at] * n + ranks[at + 1]) * n + ranks[at + 2]) * wide + owner[at] - first
        keys.sort()
        keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
        found, text = np.divmod(keys, wide)
        found, last = np.divmod(found, n)
        before, middle = np.divmod(found, n)
        yield (alphabet[before] << 42) | (alphabet[middle] << 21) | alphabet[last], text + first


def _lists(block: int, codes: list[np.ndarray], slots: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (trigram, block, n, slots)."""
    code, slot = np.concatenate(codes), np.concatenate(slots).astype(np.int32)
    order = np.argsort(code, kind="stable")
    code, slot = code[order], slot[order]
    # A long text has a trigram in several stretches.
    new = np.append(True, (code[1:] != code[:-1]) | (slot[1:] != slot[:-1]))
    code, slot = code[new], slot[new]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    cuts = np.append(starts, len(code)).astype(np.int32)
    points = (code[starts][:, None] >> np.array([42, 21, 0])) & 0x1FFFFF
    chars = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return pa.RecordBatch.from_arrays([
        pa.array([chars[i:i + 3] for i in range(0, len(chars), 3)], pa.string()),
        pa.array(np.full(len(starts), block, dtype=np.int64)), pa.array(np.diff(cuts)),
        pa.ListArray.from_arrays(cuts, pa.array(slot))], names=["trigram", "block", "n", "slots"])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (block, slot, text) as they lie. A block may have
    several rows of a trigram."""
    block, codes, slots, pairs = -1, [], [], 0
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        places = batch.column("slot").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(blocks)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if codes and blocks[a] != block:
                yield _lists(block, codes, slots)
                codes, slots, pairs = [], [], 0
            block = int(blocks[a])
            for code, text in _trigrams_of(batch.column("text").slice(a, b - a).to_pylist()):
                codes.append(code)
                slots.append(places[a:b][text])
                pairs += len(code)
                if pairs >= MOST_PAIRS:
                    yield _lists(block, codes, slots)
                    codes, slots, pairs = [], [], 0
    if codes:
        yield _lists(block, codes, slots)


def _shard(first: Column) -> Column:
    return F.pmod(F.xxhash64(first), F.lit(SHARDS)).cast("int")


def conditions(needle: str) -> list[str]:
    """Trigrams, and shorter beginnings of trigrams, that a text with this
    needle has; `%` and `_` part the needle as in LIKE."""
    found: dict[str, None] = {}
    for part in re.split("[%_]", needle.lower()):
        if 0 < len(part) < 3:
            found[part] = None
        for i in range(len(part) - 2):
            found[part[i:i + 3]] = None
    # A beginning says nothing next to a trigram that has it.
    return [c for c in found if len(c) == 3 or not any(len(d) > len(c) and d.startswith(c) for d in found)]


class TrigramIndex:
    """`texts` (id, columns, block, slot) and `postings` (trigram, block, n, slots)."""

    def __init__(self, spark: SparkSession, folder: str, columns: Sequence[str]) -> None:
        self.spark, self.folder, self.columns = spark, folder, list(columns)
        self.texts = spark.read.parquet(f"{folder}/texts")
        self.postings = spark.read.schema(
            "trigram string, block long, n int, slots array<int>, shard int").parquet(f"{folder}/postings")

    @classmethod
    def build(
        cls, docs: DataFrame, columns: Sequence[str], folder: str | None = None, block_docs: int = BLOCK_DOCS,
    ) -> TrigramIndex:
        """Index the text of `columns` of every row; other columns are kept."""
        spark = docs.sparkSession
        folder = folder or scratch_path(spark, "trigram-index")
        # The place in the scan: written once, so it stays what it is.
        place = F.monotonically_increasing_id()
        inside = F.col("_m").bitwiseAND((1 << 33) - 1)
        texts = docs.withColumn("_m", place).withColumn(
            "block", F.shiftright("_m", 33) * (1 << 24) + F.floor(inside / block_docs)).withColumn(
            "slot", (inside % block_docs).cast("int")).drop("_m")
        texts.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{folder}/texts")
        held = spark.read.parquet(f"{folder}/texts")
        with small_batches(spark):
            lists = held.select("block", "slot", search_text(columns).alias("text")).mapInArrow(
                _post, "trigram string, block long, n int, slots array<int>").withColumn(
                "shard", _shard(F.substring("trigram", 1, 1)))
            lists.hint("rebalance", "shard").sortWithinPartitions("shard", "trigram", "block").write.options(
                **_LITTLE_FILES).partitionBy("shard").parquet(f"{folder}/postings")
        return cls(spark, folder, columns)

    def shards_of(self, wanted: Sequence[str]) -> list[int]:
        firsts = sorted({c[0] for c in wanted})
        row = self.spark.range(1).select(*[_shard(F.lit(c)).alias(f"s{i}") for i, c in enumerate(firsts)]).first()
        return sorted(set(row))

    def _named(self, wanted: Sequence[str]) -> DataFrame:
        """Postings of the conditions, tagged with the condition."""
        whole, short = [c for c in wanted if len(c) == 3], [c for c in wanted if len(c) < 3]
        test = F.col("trigram").isin(whole) if whole else F.lit(False)
        for c in short:
            test = test | F.col("trigram").startswith(c)
        met = [F.when(F.col("trigram").startswith(c), F.lit(c)) for c in wanted]
        return self.postings.filter(F.col("shard").isin(self.shards_of(wanted)) & test).withColumn(
            "condition", F.explode(F.array_compact(F.array(*met))))

    def _rarest(self, wanted: Sequence[str]) -> list[str] | None:
        """The conditions fewest documents meet; None if one is met by none."""
        held = {r["condition"]: r["n"] for r in self._named(wanted).groupBy("condition").agg(F.sum("n").alias("n")).collect()}
        if any(c not in held for c in wanted):
            return None
        return sorted(wanted, key=lambda c: (held[c], c))[:MOST_CONDITIONS]

    def places(self, needle: str) -> DataFrame | None:
        """(block, slot) of the documents that meet the rarest conditions;
        None where the needle has no condition and all texts are candidates."""
        wanted = conditions(needle)
        if not wanted:
            return None
        chosen = self._rarest(wanted)
        if chosen is None:
            return self.texts.select("block", "slot").limit(0)
        lists = self._named(chosen).groupBy("block", "condition").agg(
            F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
        whole = lists.groupBy("block").agg(F.collect_list("slots").alias("all")).filter(F.size("all") == len(chosen))
        both = F.reduce(F.slice("all", 2, MOST_CONDITIONS), F.get("all", F.lit(0)), F.array_intersect)
        return whole.select("block", F.explode(both).alias("slot"))

    def candidates(self, needles: Sequence[str]) -> DataFrame:
        """Rows that can contain one of the needles, case ignored. Whoever
        calls tests the needles themselves on these rows."""
        found: DataFrame | None = None
        for needle in needles:
            places = self.places(needle)
            if places is None:
                return self.texts.drop("block", "slot")
            found = places if found is None else found.union(places)
        if found is None:
            return self.texts.drop("block", "slot").limit(0)
        found = stored(found.distinct(), "places")
        texts = self.texts
        named = found.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()
        if len(named) <= NAMED_BLOCKS:
            texts = texts.filter(F.col("block").isin([r["block"] for r in named]))
        return texts.join(found, ["block", "slot"], "left_semi").drop("block", "slot")

    def containing(self, needle: str) -> DataFrame:
        """Rows whose text contains the needle, case ignored; `%` and `_` are
        wildcards, as in a plain search of the text."""
        low = needle.lower()
        rows = self.candidates([needle]).withColumn("_text", search_text(self.columns))
        test = F.col("_text").like(f"%{low}%") if re.search("[%_]", low) else F.contains("_text", F.lit(low))
        return rows.filter(test).drop("_text")
