"""Benchmark decontamination with a generalised suffix automaton.

The normalised items become one automaton over word hashes. Document words
stream through it; at every word the automaton knows the longest suffix of the
text read so far that occurs in an item. A window (ten item words in a row, or
a whole shorter item) ends at a word when that length reaches the window's.

Most words can be part of no window. A bitmap of the items' word pairs finds,
on whole batches at once, the runs in which every neighbouring pair occurs in
some item; only those runs are streamed. A run never cuts a window, because
every pair inside a window is an item's pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.bytewords import ALPHANUMERIC, Words, chunks, mix
from docspark.session import stored

PAIR_BITS = 22
#: Item words in one automaton (about 1 kB each while it is built). Larger
#: benchmarks are matched in several automata, one pass over the texts each;
#: results do not depend on how many there are.
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """Suffix automaton of several word sequences, by online extension."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[int]] = [set()]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q that holds only the strings reached through p."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, item: int, sequence: Iterable[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.ends[last].add(item)

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and length of the longest match after reading c."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, length + 1)

    def holder(self, state: int, size: int) -> int:
        """The state of the last `size` words read, given the current state."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


class Matcher:
    """Windows of a set of items: `window` words, or whole shorter items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int) -> None:
        self.window = window
        self.names = [name for name, _ in items]
        self.automaton = SuffixAutomaton()
        self.shorter: dict[int, dict[int, set[int]]] = {}
        self.least = window
        pairs, singles = [], []
        for at, (_, h) in enumerate(items):
            sequence = h.tolist()
            self.automaton.add(at, sequence)
            if len(h) > 1:
                pairs.append(_pairs(h))
            if 0 < len(h) < window:
                self.least = min(self.least, len(h))
                if len(h) == 1:
                    singles.append(h)
        automaton = self.automaton
        for at, (_, h) in enumerate(items):
            if 0 < len(h) < window:
                state = 0
                for c in h.tolist():
                    state = automaton.next[state][c]
                self.shorter.setdefault(state, {}).setdefault(len(h), set()).add(at)
        self.within: list[frozenset[int]] = [frozenset()] * len(automaton.link)
        held = [set(e) for e in automaton.ends]
        for state in sorted(range(1, len(held)), key=lambda s: -automaton.length[s]):
            self.within[state] = frozenset(held[state])
            up = automaton.link[state]
            if automaton.length[up] >= window:
                held[up] |= held[state]
        bits = np.zeros(1 << PAIR_BITS, dtype=bool)
        for p in pairs:
            bits[(p >> np.uint64(64 - PAIR_BITS)).astype(np.int64)] = True
        self.pair_bits = bits
        self.singles = np.unique(np.concatenate(singles)) if singles else np.zeros(0, np.uint64)

    def runs(self, h: np.ndarray, words: Words) -> Iterator[tuple[int, int]]:
        """Word ranges [a, b), inside one text each, that can hold a window."""
        if len(h) > 1:
            linked = self.pair_bits[(_pairs(h) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)]
            inner = words.bounds[(words.bounds > 0) & (words.bounds < len(h))]
            linked[inner - 1] = False
            edge = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            long = last - first >= max(2, self.least)
            yield from zip(first[long].tolist(), last[long].tolist())
        if len(self.singles):
            for at in np.flatnonzero(np.isin(h, self.singles)).tolist():
                yield at, at + 1

    def match(self, sequence: list[int]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in a window, and the items whose windows occur."""
        hit = np.zeros(len(sequence), dtype=bool)
        found: set[int] = set()
        automaton, state, length = self.automaton, 0, 0
        for i, c in enumerate(sequence):
            state, length = automaton.step(state, length, c)
            if length >= self.window:
                hit[i + 1 - self.window:i + 1] = True
                found |= self.within[automaton.holder(state, self.window)]
            if self.shorter and length >= self.least:
                up = state
                while up > 0:
                    for size, items in self.shorter.get(up, {}).items():
                        if size <= length:
                            hit[i + 1 - size:i + 1] = True
                            found |= items
                    up = automaton.link[up]
        return hit, found


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for words in chunks(pa.array(texts, pa.large_string()), ALPHANUMERIC):
        h = words.hashes(lower=True)
        out += [h[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:])]
    return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items in blocks of bounded size, read partition by partition."""
    block: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in items.toLocalIterator():
        h = _hashes([row.text])[0]
        if not len(h):
            continue
        if block and size + len(h) > block_words:
            yield block
            block, size = [], 0
        block.append((row.item, h))
        size += len(h)
    if block:
        yield block


SCANNED = "doc_id long, key string, n_words long, hits array<int>, items array<string>"


def _scan(shared):
    """(doc_id, key, n_words, hits, items) of each row (doc_id, text, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher: Matcher = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            hits: list[set[int]] = [set() for _ in range(batch.num_rows)]
            items: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for words in chunks(batch.column(1), ALPHANUMERIC):
                h = words.hashes(lower=True)
                n_words[words.first:words.first + words.n_texts] = np.diff(words.bounds)
                for a, b in matcher.runs(h, words):
                    hit, found = matcher.match(h[a:b].tolist())
                    if found:
                        at = int(np.searchsorted(words.bounds, a, side="right")) - 1
                        hits[words.first + at] |= set((np.flatnonzero(hit) + a - words.bounds[at]).tolist())
                        items[words.first + at] |= found
            names = [sorted({matcher.names[i] for i in s}) for s in items]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n_words),
                pa.array([sorted(s) for s in hits], pa.list_(pa.int32())),
                pa.array(names, pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "hits", "items"])

    return run


def _without(words: Words, hit: np.ndarray) -> str:
    """The text of a chunk of one text, without its hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    raw, kept, at = words.data.tobytes(), [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        kept.append(raw[at:words.starts[a]])
        at = int(words.ends[b - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8")


def _cut_hits(max_coverage: float):
    """Rows without the words in `_hits`; rows with too many of them go.
    `_hits` of what stays is left to tell the rows that were cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, hits = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("_hits")).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for row, places in enumerate(hits):
                if not places:
                    continue
                words = next(chunks(pa.array([texts[row]], pa.large_string()), ALPHANUMERIC))
                hit = np.zeros(len(words.starts), dtype=bool)
                hit[places] = True
                keep[row] = hit.sum() <= max_coverage * len(hit)
                texts[row] = _without(words, hit)
            batch = batch.set_column(at, "text", pa.array(texts, batch.column(at).type))
            yield batch.filter(pa.array(keep))

    return run


def _cut(shared, max_coverage: float):
    """Texts without their hit words; null where too much of a text is hit.

    Cutting can bring the two sides of a span together, so a text is matched
    again until nothing is hit.
    """

    def clean(matcher: Matcher, text: str) -> str | None:
        while True:
            words = next(chunks(pa.array([text], pa.large_string()), ALPHANUMERIC))
            h = words.hashes(lower=True)
            hit = np.zeros(len(h), dtype=bool)
            for a, b in matcher.runs(h, words):
                hit[a:b] |= matcher.match(h[a:b].tolist())[0]
            if not hit.any():
                return text
            if hit.sum() > max_coverage * len(hit):
                return None
            text = _without(words, hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher: Matcher = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at)
            changed: dict[int, str | None] = {}
            for words in chunks(texts, ALPHANUMERIC):
                h = words.hashes(lower=True)
                for a, b in matcher.runs(h, words):
                    row = words.first + int(np.searchsorted(words.bounds, a, side="right")) - 1
                    if row not in changed and matcher.match(h[a:b].tolist())[1]:
                        changed[row] = clean(matcher, texts[row].as_py())
            if changed:
                whole = texts.to_pylist()
                for row, text in changed.items():
                    whole[row] = text
                batch = batch.set_column(at, "text", pa.array(whole, texts.type))
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, text in changed.items() if text is None]] = False
                batch = batch.filter(pa.array(keep))
            yield batch

    return run


def _matchers(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Matcher]:
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text IS NOT NULL")
    some = False
    for block in _blocks(items, block_words):
        some = True
        yield Matcher(block, window)
    if not some:
        yield Matcher([], window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, hits, items) for every row of `docs`.

    `hits` are the positions of words inside a benchmark window, `items` the
    sorted ids of the items with a window in the text. Words are
    `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null and
    empty texts have no words. Items without words match nothing; items that
    share an id count as one, and a null id counts as the empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    matchers = list(_matchers_shared(spark, benchmark, window, block_words))
    if len(matchers) == 1:
        plain = rows.withColumn("key", F.lit(None).cast("string"))
        return plain.mapInArrow(_scan(matchers[0]), SCANNED).drop("key")
    # Rows meet again by id and digest of the text; equal rows have equal
    # results, so each row takes the group's.
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    passes, found = _all_hits(keyed, matchers)
    base = passes[0].select("doc_id", "key", "n_words")
    same = base["doc_id"].eqNullSafe(found["doc_id"]) & (base["key"] == found["key"])
    return base.join(found, same, "left").select(
        base["doc_id"], "n_words",
        F.coalesce("h", F.array().cast("array<int>")).alias("hits"),
        F.coalesce("i", F.array().cast("array<string>")).alias("items"))


def _all_hits(keyed: DataFrame, matchers: list) -> tuple[list[DataFrame], DataFrame]:
    """One stored pass per automaton over rows (doc_id, text, key), and
    (doc_id, key, h, i): the hits and items of all of them."""
    passes = [stored(keyed.mapInArrow(_scan(m), SCANNED), "contamination") for m in matchers]
    found = passes[0]
    for more in passes[1:]:
        found = found.union(more)
    found = found.filter(F.size("items") > 0).select("doc_id", "key", "hits", "items").distinct().groupBy("doc_id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("h"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    return passes, found


def _cut_by_all(docs: DataFrame, matchers: list, max_coverage: float) -> DataFrame:
    """`docs` cut by several automata as by one: the hits of all on the same
    text are joined, tested and cut, until no text is hit."""
    out, rest = None, docs
    while True:
        # Spreads equal texts where rows have an id.
        doc_id = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit(None).cast("string")
        keyed = rest.withColumn("_id", F.xxhash64(doc_id)).withColumn(
            "_key", F.sha2(F.coalesce("text", F.lit("")), 256))
        _, found = _all_hits(keyed.select(
            F.col("_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_key").alias("key")), matchers)
        found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("h").alias("_hits"))
        joined = keyed.join(found, ["_id", "_key"], "left").select(*docs.columns, "_hits")
        cut = stored(joined.mapInArrow(_cut_hits(max_coverage), joined.schema), "decontaminated")
        settled = cut.filter("_hits IS NULL").drop("_hits")
        out = settled if out is None else out.union(settled)
        rest = cut.filter("_hits IS NOT NULL").drop("_hits")
        if rest.isEmpty():
            return out


def _matchers_shared(spark, benchmark: DataFrame, window: int, block_words: int) -> Iterator:
    for matcher in _matchers(benchmark, window, block_words):
        yield spark.sparkContext.broadcast(matcher)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The contract's columns of `contamination`."""
    return contamination(docs, benchmark, window).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10,
    max_coverage: float = 0.5, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`docs` with every benchmark span cut out of `text`.

    A span is a run of words that lie in benchmark windows. A document with
    more than `max_coverage` of its words in spans is dropped. All columns
    stay; `n_chars`, where there is one, follows the text. Other texts, null
    and empty ones included, are unchanged.
    """
    spark = docs.sparkSession
    matchers = list(_matchers_shared(spark, benchmark, window, block_words))
    if len(matchers) == 1:
        out = docs.mapInArrow(_cut(matchers[0], max_coverage), docs.schema)
    else:
        out = _cut_by_all(docs, matchers, max_coverage)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(
            F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
