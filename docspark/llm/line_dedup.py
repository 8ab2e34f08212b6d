"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

State, as tables in the shared folder:

* `references`: (k1, k2, doc_id, n): how often a line key occurs in a document.
  This is the exact ledger; a key's owner is its least document.
* `filters`: (shard, cells): cuckoo filters per shard of the key space, holding
  every key of the ledger once. A shard keeps a bounded number of keys.

Every reference of a batch goes to the filter of its shard. A key the filter
has not seen is new, and as long as it stays so it is never looked up again;
only keys seen before, in this batch or an earlier one, reach the exact ledger,
which says who owns them. False positives of the filter end there. Deleting
documents takes their references off and removes keys without any reference
from the filters, so later results are as if the documents had never come.
Keys are 128-bit hashes of the stripped line in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.bytewords import mix
from docspark.session import stored

#: Keys of one shard on average; their filter takes about 3 MB.
SHARD_KEYS = 1 << 20
SLOTS = 4
_ENDS = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, worked on in whole arrays."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n_keys) / SLOTS / 0.85))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, dtype="<u2").reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.cells.astype("<u2").tobytes()

    def _print_and_bucket(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.view(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (h & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        jump = mix(prints.astype(np.uint64) + np.uint64(1)) & np.uint64(len(self.cells) - 1)
        return bucket ^ jump.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, bucket = self._print_and_bucket(keys)
        other = self._other(bucket, prints)
        return ((self.cells[bucket] == prints[:, None]) | (self.cells[other] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add distinct keys. False when the filter is too full; then build a larger one."""
        prints, bucket = self._print_and_bucket(keys)
        random = np.random.Generator(np.random.PCG64(7))
        for turn in range(500):
            # Per bucket, the first waiting prints take the free slots.
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
            rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
            free = self.cells[bucket] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
            self.cells[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket, rank = prints[~fits], bucket[~fits], rank[~fits]
            if not len(prints):
                return True
            if turn:
                # The first waiting print of each bucket drives one out.
                first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
                victim = random.integers(0, SLOTS, int(first.sum()))
                driven = self.cells[bucket[first], victim]
                self.cells[bucket[first], victim] = prints[first]
                prints[first] = driven
            bucket = self._other(bucket, prints)
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that are in the filter, one print each."""
        for fingerprint, bucket in zip(*self._print_and_bucket(keys)):
            other = self._other(np.array([bucket]), np.array([fingerprint]))[0]
            for b in (bucket, other):
                at = np.flatnonzero(self.cells[b] == fingerprint)
                if len(at):
                    self.cells[b, at[0]] = 0
                    break


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of the line stripped and with A-Z lower-cased; null if short."""
    bare = line.strip(_ENDS).lower()
    if len(bare) < 4 * min_chars and len(bare.decode("utf-8")) < min_chars:
        return None
    return blake2b(bare, digest_size=16).digest()


def _references(min_chars: int):
    """(k1, k2, doc_id, n) per key and text of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, counts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc is None or not text.is_valid:
                    continue
                own: dict[bytes, int] = {}
                for line in text.as_buffer().to_pybytes().split(b"\n"):
                    key = _key(line, min_chars)
                    if key is not None:
                        own[key] = own.get(key, 0) + 1
                keys += own
                counts += own.values()
                ids += [doc] * len(own)
            halves = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["k1", "k2", "doc_id", "n"])

    return run


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key and batch, saying whether several documents had it."""
    for batch in batches:
        keys, at, count = np.unique(
            batch.column("k1").to_numpy(), return_index=True, return_counts=True)
        shard = batch.column("shard").to_numpy()[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard), pa.array(keys), pa.array(count > 1)], names=["shard", "k1", "again"])


def _see(key: tuple, seen: pa.Table, filters: pa.Table) -> pa.Table:
    """Ask the shard's filters for each key, then insert the new ones.

    Returns the keys met before (known: in an earlier batch, if the filter is
    right), and the shard's filters as rows with cells.
    """
    chain = [CuckooFilter.of_bytes(b) for b in filters.column("cells").to_pylist()]
    rows = seen.column("k1").to_numpy()
    again = seen.column("again").to_numpy(zero_copy_only=False)
    keys, where, count = np.unique(rows, return_inverse=True, return_counts=True)
    met = count > 1
    met[where[again]] = True
    known = np.zeros(len(keys), dtype=bool)
    for held in chain:
        known |= held.contains(keys)
    _insert(chain, keys[~known])
    shard = key[0].as_py()
    out = keys[met | known]
    return pa.table({
        "shard": pa.array([shard] * (len(out) + len(chain)), pa.int32()),
        "k1": pa.concat_arrays([pa.array(out, pa.int64()), pa.nulls(len(chain), pa.int64())]),
        "known": pa.concat_arrays([pa.array(known[met | known]), pa.nulls(len(chain), pa.bool_())]),
        "cells": pa.array([None] * len(out) + [c.to_bytes() for c in chain], pa.binary())})


def _insert(chain: list[CuckooFilter], new: np.ndarray) -> None:
    """Add keys to the last filter, or to a further one when that is full."""
    if len(new):
        room = CuckooFilter.of_bytes(chain[-1].to_bytes()) if chain else CuckooFilter.sized(2 * len(new))
        if room.insert(new):
            chain[-1:] = [room]
        else:
            larger = CuckooFilter.sized(2 * len(new))
            while not larger.insert(new):
                larger = CuckooFilter.sized(4 * larger.cells.size)
            chain.append(larger)


def _mistaken(key: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Insert keys the filters wrongly took for known, so each key is held."""
    chain = [CuckooFilter.of_bytes(b) for b in filters.column("cells").to_pylist()]
    _insert(chain, keys.column("k1").to_numpy())
    return _chain_rows(key, chain)


def _forget(key: tuple, gone: pa.Table, filters: pa.Table) -> pa.Table:
    chain = [CuckooFilter.of_bytes(b) for b in filters.column("cells").to_pylist()]
    left = gone.column("k1").to_numpy()
    for held in chain:
        inside = held.contains(left)
        held.remove(left[inside])
        left = left[~inside]
    return _chain_rows(key, chain)


def _chain_rows(key: tuple, chain: list[CuckooFilter]) -> pa.Table:
    return pa.table({
        "shard": pa.array([key[0].as_py()] * len(chain), pa.int32()),
        "cells": pa.array([c.to_bytes() for c in chain], pa.binary())})


def _drop_lines(min_chars: int):
    """(n_lines, n_dropped, text) for rows whose `drops` are keys to leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, texts = [], [], []
            for text, drops in zip(batch.column("text"), batch.column("drops")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = raw.split(b"\n")
                n_lines.append(len(lines))
                if drops.is_valid:
                    pairs = np.array([[d["k1"], d["k2"]] for d in drops.as_py()], dtype="<i8")
                    gone = {p.tobytes() for p in pairs}
                    lines = [line for line in lines if _key(line, min_chars) not in gone]
                    raw = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(raw.decode("utf-8") if text.is_valid else None)
            arrays = {"text": pa.array(texts, batch.schema.field("text").type),
                      "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            names = [n for n in batch.schema.names if n not in ("drops", "text")] + list(arrays)
            yield pa.RecordBatch.from_arrays(
                [arrays.get(n, batch.column(n) if n not in arrays else None) for n in names], names=names)

    return run


_SEEN = "shard int, k1 long, known boolean, cells binary"


@dataclass(frozen=True)
class LineLedger:
    """All documents inserted and not deleted; every change gives a new ledger."""

    references: DataFrame
    filters: DataFrame
    #: Keys the filters have met more than once; a superset of the shared ones.
    repeated: DataFrame
    shards: int
    min_chars: int = 10

    @staticmethod
    def of(docs: DataFrame, min_chars: int = 10, shard_keys: int = SHARD_KEYS) -> LineLedger:
        """A ledger of a first batch, which also sets the number of shards."""
        spark = docs.sparkSession
        refs = _stored_references(docs, min_chars)
        shards = max(16, -(-refs.count() // shard_keys))
        empty = spark.createDataFrame([], _SEEN)
        start = LineLedger(refs.limit(0), empty.select("shard", "cells"), empty.select("k1"), shards, min_chars)
        return start._with(refs)

    def _with(self, refs: DataFrame) -> LineLedger:
        shard = F.pmod("k1", F.lit(self.shards)).cast("int")
        rows = refs.select(shard.alias("shard"), "k1").mapInArrow(_combine, "shard int, k1 long, again boolean")
        met = stored(rows.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_see, _SEEN), "seen")
        filters = met.filter("cells IS NOT NULL").select("shard", "cells")
        # Cuckoo filters can only forget what they hold: a key they took for
        # known by mistake is inserted after the exact check.
        wrong = met.filter("known").select("shard", "k1").join(self.references, "k1", "left_anti")
        if not wrong.isEmpty():
            filters = stored(wrong.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(
                _mistaken, "shard int, cells binary"), "filters")
        return LineLedger(
            self.references.union(refs), filters,
            self.repeated.union(met.filter("cells IS NULL").select("k1")).distinct(), self.shards, self.min_chars)

    def insert(self, docs: DataFrame) -> LineLedger:
        """Add documents with new ids."""
        return self._with(_stored_references(docs, self.min_chars))

    def delete(self, ids: DataFrame) -> LineLedger:
        """Take the documents with these `doc_id`s off again."""
        ids = ids.select("doc_id").distinct()
        left = stored(self.references.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id", "n"), "references")
        gone = self.references.join(ids, "doc_id", "left_semi").select("k1").distinct().join(
            left.select("k1"), "k1", "left_anti").withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int"))
        filters = stored(gone.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(
            _forget, "shard int, cells binary"), "filters")
        return LineLedger(left, filters, self.repeated, self.shards, self.min_chars)

    def drops(self) -> DataFrame:
        """(doc_id, drops): the keys each document loses, exact.

        Only references of repeated keys are grouped. The least document of
        a key is a plain minimum, so a line in very many documents is
        combined before the shuffle; the join back is split by adaptive
        execution.
        """
        asked = stored(self.references.join(self.repeated, "k1", "left_semi").select("k1", "k2", "doc_id"), "asked")
        owners = asked.groupBy("k1", "k2").agg(
            F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner <> last")
        return asked.join(owners, ["k1", "k2"]).filter("doc_id <> owner").groupBy("doc_id").agg(
            F.collect_list(F.struct("k1", "k2")).alias("drops"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """`docs` (documents of this ledger) without the lines another owns,
        with `n_lines` before and `n_dropped`."""
        kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "drops")]
        rows = docs.select(*kept, "text").join(self.drops(), "doc_id", "left").select(*kept, "text", "drops")
        fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
        return rows.mapInArrow(_drop_lines(self.min_chars), f"{fields}, text string, n_lines long, n_dropped long")


def _stored_references(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_references(min_chars), "k1 long, k2 long, doc_id long, n long"), "references")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """`docs` with the lines dropped that a document of smaller id also has.

    Keys of at least `min_chars` code points in two documents or more keep
    their lines in the least `doc_id` only; repeats inside one document stay.
    Null texts count as one empty line and stay null. Rows with a null id own
    nothing and lose nothing; rows that share an id are one document. Adds
    `n_lines` and `n_dropped`; a column of that name, or `drops`, gives way.
    """
    return LineLedger.of(docs, min_chars).deduplicated(docs)


def line_report(docs: DataFrame) -> DataFrame:
    """The contract's columns of `dedup_lines`."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ 	-
]+', ''), '[ 	-
]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
