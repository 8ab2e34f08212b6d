"""LM scoring: a self-attention model on subword ids, beside a unigram base.

Texts are cut into blocks of about 2 MB. A block holds its distinct words
once, with their subword ids and counts, and each document as positions in
that list; it is written once and everything after reads it.

* Counts of words, of subword ids and of symbol pairs cover every training
  document. Words meet by shards of their hash: a shard adds the counts of all
  blocks and answers each block, so a word costs one entry per block that has
  it, however often it occurs.
* The model predicts symbols: the most frequent ids have one each, the others
  share symbols by bands of equal mass and are told apart by their counts.
  Every training document belongs to one of the rounds, so each of its windows
  is trained on once. A round's windows form groups of about `GROUP_WINDOWS`,
  which train from the same parameters; Spark averages what they find.
* Scoring goes over overlapping windows, so every token is scored once.

What reaches the driver or is broadcast is bounded by the vocabulary of the
tokenizer and the size of the model, never by the corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.attention_model import MEMBERS, STRIDE, AttentionModel, windows
from docspark.llm.bytewords import NOT_SPACE, Words, chunks, mix
from docspark.session import fine_scans, scratch_path, small_batches, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that cuts a text before the merges of this kind of rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOLS, SHARED = 1024, 32
END = 0
#: Learning rate of each round.
RATES = (1e-2, 1e-2, 5e-3, 2e-3)
#: A round takes one training document in so many: each is in one round.
SHARE = len(RATES)
#: Windows of one step of the optimiser.
BATCH = 256
#: Distinct words of all blocks that one shard holds, on average.
SHARD_WORDS = 1_000_000
#: What each kind of symbol pair gives to those not seen.
DISCOUNT = 0.75
#: Windows that are trained on one after another, from a round's parameters.
GROUP_WINDOWS = 16_384
#: How windows are written, so that a file makes several tasks.
ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "4"}
#: Parameters travel as multiples of this, so that their sums are exact.
_UNIT = 2.0 ** -24
_SPACE, _LOWER = 0x20, np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# Subwords --------------------------------------------------------------------

class Subwords:
    """Subword ids of single words, each encoded with a space before it."""

    _loaded: dict[str, Subwords] = {}

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        self.size = max(ranks.values()) + 1
        self._bytes = np.zeros(self.size, dtype=np.int64)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)
        self._encoding = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Subwords:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place of each word's ids and the end, all ids) of words given
        as their bytes one after another, a space before each included.

        The pattern cuts before a space, so words can be encoded together and
        told apart by the bytes of their ids; where white space of other kinds
        joins two words, each is encoded alone.
        """
        ids = np.array(self._encoding.encode_ordinary(data.tobytes().decode()), dtype=np.int32)
        ends = np.cumsum(self._bytes[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        word_ends = np.cumsum(sizes)
        at = np.searchsorted(ends, word_ends)
        if len(at) and (at[-1] >= len(ends) or (ends[at] != word_ends).any()):
            starts = word_ends - sizes
            each = [self._encoding.encode_ordinary(data[a:b].tobytes().decode())
                    for a, b in zip(starts.tolist(), word_ends.tolist(), strict=True)]
            return np.cumsum([0, *map(len, each)]), np.array([i for e in each for i in e], dtype=np.int32)
        return np.append(0, at + 1), ids


# Blocks ----------------------------------------------------------------------

BLOCKS = ("block long, doc_id array<long>, held_out array<boolean>, sizes array<int>, sequence binary, "
          "hashes array<long>, counts array<int>, piece_sizes binary, pieces binary")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, two or four bytes each, compressed byte by byte:
    first the low bytes of all, then the next ones."""
    small = np.uint16 if len(numbers) == 0 or numbers.max() < 1 << 16 else np.uint32
    planes = np.ascontiguousarray(numbers.astype(small).view(np.uint8).reshape(-1, np.dtype(small).itemsize).T)
    return bytes([np.dtype(small).itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    held = memoryview(raw)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held[1:]), np.uint8).reshape(held[0], -1)
    return np.ascontiguousarray(planes.T).view(np.uint16 if held[0] == 2 else np.uint32).ravel().astype(np.intp)


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    """The words of a block, frequent ones first: their numbers in a document
    are small then, and pack well."""
    return np.argsort(-counts, kind="stable")


def _one_list(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.ListArray:
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _block(words: Words, ids: pa.Array, held: np.ndarray, subwords: Subwords, number: int) -> pa.RecordBatch:
    hashes = words.hashes(lower=True)
    distinct, first, position = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = np.diff(words.bounds)
    learned = np.repeat(~held, sizes)
    counts = np.bincount(position[learned], minlength=len(distinct))
    turn = np.empty(len(distinct), dtype=np.intp)
    turn[_by_frequency(counts)] = np.arange(len(distinct))
    # Every distinct word once, a space before each.
    starts, long = words.starts[first], words.ends[first] - words.starts[first] + 1
    begin = np.cumsum(long) - long
    spelled = np.full(int(long.sum()), _SPACE, dtype=np.uint8)
    inside = np.ones(len(spelled), dtype=bool)
    inside[begin] = False
    spelled[inside] = _LOWER[words.data[(np.arange(len(spelled)) + np.repeat(starts - begin - 1, long))[inside]]]
    ends, pieces = subwords.encode(spelled, long)
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), _one_list(ids, pa.int64()), _one_list(held, pa.bool_()),
        _one_list(sizes, pa.int32()), pa.array([_packed(turn[position])], pa.binary()),
        _one_list(distinct.view(np.int64), pa.int64()), _one_list(counts, pa.int32()),
        pa.array([_packed(np.diff(ends))], pa.binary()), pa.array([_packed(pieces)], pa.binary())],
        names=["block", "doc_id", "held_out", "sizes", "sequence", "hashes", "counts", "piece_sizes", "pieces"])


def _make_blocks(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, number = Subwords.of(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for words in chunks(batch.column("text"), NOT_SPACE):
                part = slice(words.first, words.first + words.n_texts)
                ids = batch.column("doc_id").slice(words.first, words.n_texts)
                yield _block(words, ids, held[part], subwords, number)
                number += 1

    return run


class Block:
    """One row of the table of blocks."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        self._batch, self._row = batch, row
        self.sizes = self.list("sizes")
        #: Places of the words in the block's list, by hash.
        self.sequence = _by_frequency(self.list("counts"))[self.binary("sequence")]

    def list(self, name: str) -> np.ndarray:
        return self._batch.column(name)[self._row].values.to_numpy(zero_copy_only=False)

    def binary(self, name: str) -> np.ndarray:
        return _unpacked(self._batch.column(name)[self._row].as_buffer())

    @property
    def number(self) -> int:
        return self._batch.column("block")[self._row].as_py()

    def symbols(self, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of all documents with their ends, their number per
        document, log probability per document of ids given their symbols)."""
        long_words, pieces = self.binary("piece_sizes"), self.binary("pieces")
        n_docs, last = len(self.sizes), len(long_words)
        # The end of a document is one more word, of one symbol.
        of_piece = np.append(symbols.of_id[pieces], END)
        inside = np.concatenate([[0.0], np.cumsum(np.append(symbols.log_share[pieces], 0.0))])
        lengths = np.append(long_words, 1)
        starts = np.cumsum(lengths) - lengths
        word_share = inside[starts + lengths] - inside[starts]
        sequence = np.insert(self.sequence, np.cumsum(self.sizes), last)
        doc = np.repeat(np.arange(n_docs), self.sizes + 1)
        long = lengths[sequence]
        total = np.cumsum(long)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(starts[sequence] - (total - long), long)
        return (of_piece[at], np.bincount(doc, long, n_docs).astype(np.intp),
                np.bincount(doc, word_share[sequence], n_docs))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)


def _of_training(sequence: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sequence[np.repeat(~held, sizes)], sizes[~held]


# Counts ----------------------------------------------------------------------

def _id_counts(size: int):
    """(id, n) over training documents; id -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(size, dtype=np.int64), 0
        for block in _rows(batches):
            weight = np.repeat(block.list("counts"), block.binary("piece_sizes"))
            total += np.bincount(block.binary("pieces"), weight, size).astype(np.int64)
            docs += int((~block.list("held_out")).sum())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(total[seen], docs))], names=["id", "n"])

    return run


@dataclass
class Symbols:
    """Symbol of every id, and its log probability given the symbol."""

    of_id: np.ndarray
    log_share: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, n: int = SYMBOLS, shared: int = SHARED) -> Symbols:
        """Symbol 0 ends a document; the last `shared` symbols hold many ids."""
        order = np.argsort(-counts, kind="stable")
        alone, rest = order[:n - shared - 1], order[n - shared - 1:]
        of_id, share = np.zeros(len(counts), dtype=np.intp), np.ones(len(counts))
        of_id[alone] = np.arange(1, len(alone) + 1)
        weight = counts[rest] + 0.05
        mass = np.cumsum(weight)
        band = np.minimum(shared - 1, (mass / mass[-1] * shared).astype(np.intp)) if len(rest) else rest
        of_id[rest] = n - shared + band
        share[rest] = weight / np.bincount(band, weight, shared)[band] if len(rest) else weight
        return cls(of_id, np.log(share))


def _pairs_and_rounds(shared, share: int, rounds: int):
    """Rows (cell, n) of symbol pairs, and rows (round, n, sizes, sequence):
    the documents of a block that a round trains on, and their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols: Symbols = shared.value
        pairs = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        names = ["cell", "n", "round", "sizes", "sequence"]
        for block in _rows(batches):
            sequence, sizes, _ = block.symbols(symbols)
            sequence, sizes = _of_training(sequence, sizes, block.list("held_out"))
            if not len(sizes):
                continue
            before = np.empty_like(sequence)
            before[1:] = sequence[:-1]
            before[np.cumsum(sizes) - sizes] = END
            pairs += np.bincount(before * SYMBOLS + sequence, minlength=len(pairs))
            number = (np.uint64(block.number) << np.uint64(20)) + np.arange(len(sizes), dtype=np.uint64)
            turn = mix(mix(number)) % np.uint64(share)
            for r in range(rounds):
                pick = turn == r
                if pick.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None], pa.int32()), pa.array([int((-(-sizes[pick] // STRIDE)).sum())]),
                        pa.array([r], pa.int32()), pa.array([_packed(sizes[pick])], pa.binary()),
                        pa.array([_packed(sequence[np.repeat(pick, sizes)])], pa.binary())], names=names)
        seen = np.flatnonzero(pairs)
        none = pa.nulls(len(seen))
        yield pa.RecordBatch.from_arrays([
            pa.array(seen.astype(np.int32)), pa.array(pairs[seen]), none.cast(pa.int32()),
            none.cast(pa.binary()), none.cast(pa.binary())], names=names)

    return run


def _prior(pairs: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after another, from counts: discounted, the
    rest going by how often and after how many symbols a symbol occurs."""
    often, widely = pairs.sum(axis=0) + 0.5, (pairs > 0).sum(axis=0) + 0.5
    plain = (often / often.sum() + widely / widely.sum()) / 2
    kept = np.maximum(pairs - DISCOUNT, 0)
    left = pairs.sum(axis=1, keepdims=True) - kept.sum(axis=1, keepdims=True) + 1
    return np.log((kept + left * plain) / (pairs.sum(axis=1, keepdims=True) + 1))


# Training --------------------------------------------------------------------

def _groups(rows: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (sequence, sizes) of documents, put together until they have
    `size` windows; what is left over at the end goes with the last group."""
    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))

    whole: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for row in rows:
        held.append(row)
        n += int((-(-row[1] // STRIDE)).sum())
        if n >= size:
            if whole:
                yield joined(whole)
            whole, held, n = held, [], 0
    if whole or held:
        yield joined(whole + held)


def _train(shared, turn: int, rate: float):
    """(i, weighted value, weight) of the parameters, summed over the groups
    of windows in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, vector = shared.value
        rows = (tuple(_unpacked(batch.column(name)[row].as_buffer()) for name in ("sequence", "sizes"))
                for batch in batches for row in range(batch.num_rows))
        total, seen = np.zeros(len(vector), dtype=np.int64), 0
        for sequence, sizes in _groups(rows, GROUP_WINDOWS):
            inputs, targets = windows(sequence, sizes, END, SYMBOLS)
            model = AttentionModel(prior)
            model.load(vector)
            model.train(inputs, targets, rate, BATCH, seed=turn)
            total += np.rint(model.vector() / _UNIT).astype(np.int64) * len(inputs)
            seen += len(inputs)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), seen))],
                names=["i", "value", "weight"])

    return run


def train_model(
    blocks: DataFrame, tokenizer: str, share: int = SHARE, rates: Sequence[float] = RATES,
) -> tuple[Symbols, AttentionModel]:
    """The model learned from the training documents of `blocks`.

    A rerun of the same blocks gives the same parameters: averages are sums of
    whole numbers, and a document's round is a hash of its place.
    """
    context = blocks.sparkSession.sparkContext
    size = Subwords.of(tokenizer).size
    counted = blocks.select("sizes", "sequence", "held_out", "counts", "piece_sizes", "pieces").mapInArrow(
        _id_counts(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, dtype=np.int64)
    for r in counted:
        if r["id"] >= 0:
            counts[r["id"]] = r["n"]
    symbols = Symbols.of(counts)
    # As many tables of pairs as tasks run at once, not as there are files.
    # Row groups of a few blocks, which tasks of training can share out.
    found = _stored_small(blocks.drop("doc_id", "hashes").coalesce(2 * context.defaultParallelism).mapInArrow(
        _pairs_and_rounds(context.broadcast(symbols), share, len(rates)),
        "cell int, n long, round int, sizes binary, sequence binary"), "rounds", **ROW_GROUPS)
    pairs = np.zeros(SYMBOLS * SYMBOLS)
    for r in found.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        pairs[r["cell"]] = r["n"]
    prior = _prior(pairs.reshape(SYMBOLS, SYMBOLS))
    model = AttentionModel(prior, MEMBERS)
    for turn, rate in enumerate(rates):
        shared = context.broadcast((prior, model.vector()))
        # Read where they lie: windows need no shuffle, and a task sends one sum.
        dealt = found.filter(F.col("round") == turn).select("sizes", "sequence")
        rows = dealt.mapInArrow(_train(shared, turn, rate), "i int, value long, weight long").groupBy("i").agg(
            F.sum("value").alias("value"), F.sum("weight").alias("weight")).collect()
        if rows:
            vector = np.zeros(len(rows))
            for r in rows:
                vector[r["i"]] = r["value"] / r["weight"] * _UNIT
            model.load(vector)
        shared.destroy()
    return symbols, model


# Scores ----------------------------------------------------------------------

SCORED = ("block long, doc_id array<long>, held_out array<boolean>, sizes array<int>, sequence binary, counts array<int>, "
          "score array<double>")


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, model = shared.value
        kept = ("block", "doc_id", "held_out", "sizes", "sequence", "counts")
        for batch in batches:
            for row in range(batch.num_rows):
                sequence, sizes, within = Block(batch, row).symbols(symbols)
                inputs, targets = windows(sequence, sizes, END, SYMBOLS)
                doc = np.repeat(np.arange(len(sizes)), -(-sizes // STRIDE))
                found = model.log_probabilities(inputs, targets).sum(axis=1)
                score = (np.bincount(doc, found, len(sizes)) + within) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(row, 1) for c in kept], _one_list(score, pa.float64())],
                    names=[*kept, "score"])

    return run


ENTRIES = "shard int, block long, start int, hashes array<long>, counts array<int>"
ANSWERS = "block long, start int, total array<long>"


def _deal(shards: int):
    """One row per block and shard, a range of hashes: the block's words there.
    A block's words are sorted by hash, so a row is a stretch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = batch.column("hashes")[row].values.to_numpy()
                counts = batch.column("counts")[row].values.to_numpy()
                shard = ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
                held, first = np.unique(shard, return_index=True)
                cuts = pa.array(np.append(first, len(hashes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(held), pa.array([batch.column("block")[row].as_py()] * len(held), pa.int64()),
                    pa.array(first.astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(hashes)),
                    pa.ListArray.from_arrays(cuts, pa.array(counts.astype(np.int32)))],
                    names=["shard", "block", "start", "hashes", "counts"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of one shard's words, for every block that has them. A row
    without a block holds the shard's distinct and all training words."""
    lists = table.column("hashes").combine_chunks()
    hashes, counts = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("hashes", "counts"))
    distinct, at = np.unique(hashes, return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)
    cuts = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    cuts = pa.array(np.append(cuts, cuts[-1] + 2).astype(np.int32))
    return pa.table({
        "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.array([None], pa.int64())]),
        "start": pa.concat_arrays([table.column("start").combine_chunks(), pa.array([0], pa.int32())]),
        "total": pa.ListArray.from_arrays(cuts, pa.array(np.append(total[at], [(total > 0).sum(), total.sum()]).astype(np.int64)))})


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def _with_base(train_tokens: int, distinct: int, ends: int):
    """Rows of documents, from blocks joined to the totals of their words."""
    whole = train_tokens + 0.1 * (distinct + 1)

    def logs(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                answers = batch.column("answers")[row].values
                total = np.zeros(int(block.sequence.max(initial=-1)) + 1, dtype=np.int64)
                if answers is not None:
                    for start, found in zip(answers.field("start").to_pylist(), answers.field("total"), strict=True):
                        total[start:start + len(found)] = found.values.to_numpy()
                n_docs = len(block.sizes)
                doc = np.repeat(np.arange(n_docs), block.sizes)
                base = np.bincount(doc, logs(total)[block.sequence], n_docs) + logs(np.array(ends))
                known = np.bincount(doc, (total > 0)[block.sequence], n_docs).astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[row].values, batch.column("held_out")[row].values,
                    pa.array(block.sizes.astype(np.int64) + 1), pa.array(known),
                    pa.array(np.full(n_docs, train_tokens, dtype=np.int64)), pa.array(base),
                    batch.column("score")[row].values],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def is_held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _stored_small(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """As `stored`, with stronger compression."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.options(compression="zstd", **options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_blocks(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The table of blocks of `docs` (doc_id, text), written once."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        is_held_out(F.col("doc_id")).alias("held_out"))
    with small_batches(docs.sparkSession):
        return _stored_small(rows.mapInArrow(_make_blocks(tokenizer), BLOCKS), "blocks")


def lm_scores(docs: DataFrame, tokenizer: str = TOKENIZER, share: int = SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    One row per row of `docs`. Null and empty texts are their end alone.
    Rows with a null id are never held out. Repeated rows count and score each.
    Without any training row both scores come from untrained shares. Words are
    told apart by 64-bit hashes. `score` is the log10 probability of the
    subword ids of the words and of the end. An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    # Rows of blocks are some MB each, and tasks over them long.
    with small_batches(spark, 4), fine_scans(spark):
        return _scores(docs, tokenizer, share)


def _scores(docs: DataFrame, tokenizer: str, share: int) -> DataFrame:
    spark = docs.sparkSession
    blocks = text_blocks(docs, tokenizer)
    sizes = blocks.agg(
        F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.size(F.filter("held_out", lambda h: ~h))), F.lit(0)).alias("docs")).first()
    symbols, model = train_model(blocks, tokenizer, share)
    shards = max(16, -(-sizes["words"] // SHARD_WORDS))
    answers = stored(blocks.select("block", "hashes", "counts").mapInArrow(_deal(shards), ENTRIES).groupBy("shard").applyInArrow(
        _add_up, ANSWERS), "answers")
    sums = answers.filter("block IS NULL").agg(
        F.coalesce(F.sum(F.get("total", F.lit(0))), F.lit(0)).alias("distinct"),
        F.coalesce(F.sum(F.get("total", F.lit(1))), F.lit(0)).alias("words")).first()
    ends = sizes["docs"]
    scored = blocks.drop("hashes").mapInArrow(
        _score(spark.sparkContext.broadcast((symbols, model))), SCORED)
    told = answers.filter("block IS NOT NULL").groupBy("block").agg(
        F.collect_list(F.struct("start", "total")).alias("answers"))
    joined = scored.join(told, "block", "left")
    return stored(joined.mapInArrow(
        _with_base(sums["words"] + ends, sums["distinct"] + (ends > 0), ends), RESULT), "scores")
