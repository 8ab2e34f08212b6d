"""Quality classifier: a factorisation machine over hashed words and structure.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise part has rank `RANK`; by the sum-of-squares identity
`sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)`
it costs as much as the linear part. Features are `HASHED` buckets of words
(share of the text's words, square root) and statistics of structure and size.

Training uses at most `TRAINING_ROWS` labelled rows, those with the least hash
of their id; that bound is a parameter, so the rows fit into one task, which
returns the weights. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.bytewords import NOT_SPACE, Words, chunks
from docspark.session import stored

HASHED = 1 << 12
RANK = 8
TRAINING_ROWS = 20_000
EPOCHS, BATCH, RATE = 12, 256, 0.05
#: Decay per step of linear and pairwise weights.
DECAY = 1e-4
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "log_chars_per_word", "symbols", "exclamations", "upper", "digits", "short_words",
    "long_words", "distinct_words", "stutters", "lines_per_word", "pipes", "punctuation", "non_ascii",
    "log_lines", "empty")
N_FEATURES = HASHED + len(STATISTICS)


def _byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL = _byte_table(b"#*$%&|<>@^~=+_\\{}[]")
_UPPER = _byte_table(bytes(range(65, 91)))
_DIGIT = _byte_table(bytes(range(48, 58)))
_PUNCTUATION = _byte_table(b".,;:?\"'()-")


def _sums(words: Words, flags: np.ndarray) -> np.ndarray:
    """Sum of a per-byte flag over each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[words.offsets[1:]] - total[words.offsets[:-1]]


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of one chunk: (bounds, columns, values)."""
    n = words.n_texts
    h = words.hashes(lower=True)
    n_words = np.diff(words.bounds)
    text = np.repeat(np.arange(n), n_words)
    bucket = (h >> np.uint64(52)).astype(np.int64)
    cell, count = np.unique(text * HASHED + bucket, return_counts=True)
    owner, column = cell // HASHED, cell % HASHED
    value = np.sqrt(count / n_words[owner])

    size = words.ends - words.starts
    data, some = words.data, np.maximum(1, n_words)
    chars = np.maximum(1, words.per_text(size))
    stutter = np.zeros(len(h), dtype=bool)
    stutter[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    distinct = np.zeros(n, dtype=np.int64)
    order = np.lexsort((h, text))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    np.add.at(distinct, text[order][fresh], 1)
    lines = _sums(words, data == 10) + 1
    statistics = np.stack([
        np.log1p(n_words) / 10, np.log1p(chars / some) / 3, _sums(words, _SYMBOL[data]) / chars * 5,
        np.minimum(2.0, _sums(words, data == 33) / some), _sums(words, _UPPER[data]) / chars * 2,
        _sums(words, _DIGIT[data]) / chars * 5, words.per_text(size <= 3) / some, words.per_text(size >= 12) / some,
        distinct / some, words.per_text(stutter) / some, np.minimum(2.0, lines / some),
        np.minimum(2.0, _sums(words, data == 124) / some), np.minimum(2.0, _sums(words, _PUNCTUATION[data]) / some),
        _sums(words, data >= 128) / chars, np.log1p(lines) / 10, (n_words == 0).astype(float)], axis=1)
    k = len(STATISTICS)
    owner = np.concatenate([owner, np.repeat(np.arange(n), k)])
    column = np.concatenate([column, HASHED + np.tile(np.arange(k), n)])
    value = np.concatenate([value, statistics.ravel()])
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(n + 1))
    return bounds, column[order].astype(np.int32), value[order].astype(np.float32)


class FactorisationMachine:
    """Weights `w` (bias last) and factors `v`, trained by AdaGrad on log loss."""

    def __init__(self, w: np.ndarray, v: np.ndarray) -> None:
        self.w, self.v = w, v

    @classmethod
    def fresh(cls, n: int = N_FEATURES, rank: int = RANK, seed: int = 1) -> FactorisationMachine:
        random = np.random.Generator(np.random.PCG64(seed))
        return cls(np.zeros(n + 1), random.normal(0, 0.01, (n, rank)))

    def _sums(self, bounds, column, value):
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        vx = self.v[column] * value[:, None]
        totals = np.zeros((len(bounds) - 1, self.v.shape[1]))
        squares = np.zeros(len(bounds) - 1)
        linear = np.zeros(len(bounds) - 1)
        if len(column):
            totals = np.add.reduceat(vx, bounds[:-1], axis=0)
            squares = np.add.reduceat((vx * vx).sum(axis=1), bounds[:-1])
            linear = np.add.reduceat(self.w[column] * value, bounds[:-1])
        return row, vx, totals, self.w[-1] + linear + 0.5 * ((totals * totals).sum(axis=1) - squares)

    def scores(self, bounds, column, value) -> np.ndarray:
        """Every row must have a feature; the statistics see to that."""
        return 1 / (1 + np.exp(-np.clip(self._sums(bounds, column, value)[3], -30, 30)))

    def train(self, bounds, column, value, label, epochs: int = EPOCHS, seed: int = 2) -> None:
        random = np.random.Generator(np.random.PCG64(seed))
        gw, gv = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        n = len(label)
        for _ in range(epochs):
            turn = random.permutation(n)
            for at in range(0, n, BATCH):
                rows = turn[at:at + BATCH]
                sizes = np.diff(bounds)[rows]
                b = np.concatenate([[0], np.cumsum(sizes)])
                pick = np.arange(b[-1]) + np.repeat(bounds[rows] - b[:-1], sizes)
                c, x = column[pick], value[pick]
                row, vx, totals, z = self._sums(b, c, x)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
                seen, slot = np.unique(c, return_inverse=True)
                dw = np.bincount(slot, error[row] * x, len(seen)) + DECAY * self.w[seen]
                each = (error[row] * x)[:, None] * (totals[row] - vx)
                dv = np.stack([np.bincount(slot, each[:, f], len(seen)) for f in range(each.shape[1])], axis=1)
                dv += DECAY * self.v[seen]
                gw[seen] += dw * dw
                gv[seen] += dv * dv
                self.w[seen] -= RATE * dw / np.sqrt(gw[seen])
                self.v[seen] -= RATE * dv / np.sqrt(gv[seen])
                gw[-1] += error.sum() ** 2
                self.w[-1] -= RATE * error.sum() / np.sqrt(gw[-1])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(columns, values, label) of rows (text, label)."""
    for batch in batches:
        at = 0
        for words in chunks(batch.column("text"), NOT_SPACE):
            bounds, column, value = features(words)
            cut = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(cut, pa.array(column)), pa.ListArray.from_arrays(cut, pa.array(value)),
                batch.column("label").slice(at, words.n_texts)], names=["columns", "values", "label"])
            at += words.n_texts


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All training rows, at most `TRAINING_ROWS`, in one task: the weights."""
    bounds, column, value, label = [np.zeros(1, np.int64)], [], [], []
    for batch in batches:
        lists = batch.column("columns")
        sizes = lists.value_lengths().to_numpy()
        bounds.append(bounds[-1][-1] + np.cumsum(sizes))
        column.append(lists.flatten().to_numpy())
        value.append(batch.column("values").flatten().to_numpy())
        label.append(batch.column("label").to_numpy())
    machine = FactorisationMachine.fresh()
    if label:
        labels = np.concatenate(label).astype(float)
        machine.train(np.concatenate(bounds), np.concatenate(column), np.concatenate(value), labels)
    yield pa.RecordBatch.from_arrays(
        [pa.array([machine.w.tobytes()]), pa.array([machine.v.tobytes()])], names=["w", "v"])


def train_classifier(
    labelled: DataFrame, max_rows: int = TRAINING_ROWS,
) -> FactorisationMachine:
    """A machine for rows (doc_id, text, label 0/1). Only the `max_rows` rows
    with the least hash of their id are used; ties go by id. Rows without a
    label are left out; without any row the scores are 0.5."""
    usable = labelled.filter("label IS NOT NULL").select(
        F.col("text"), F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("o"), F.col("doc_id").alias("i"))
    sparse = stored(usable.select("text", "label", "o", "i").mapInArrow(
        _sparse_with_order, "columns array<int>, values array<float>, label int, o long, i long"), "sparse")
    chosen = sparse.orderBy("o", "i", F.xxhash64("columns", "label")).limit(max_rows)
    row = chosen.select("columns", "values", "label").coalesce(1).mapInArrow(_fit, "w binary, v binary").first()
    return FactorisationMachine(
        np.frombuffer(row["w"]).copy(), np.frombuffer(row["v"]).reshape(N_FEATURES, RANK).copy())


def _sparse_with_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in _sparse(iter([batch.select(["text", "label"])])):
            rest = batch.slice(at, part.num_rows)
            at += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [*part.columns, rest.column("o"), rest.column("i")], names=["columns", "values", "label", "o", "i"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: FactorisationMachine = shared.value
        for batch in batches:
            found = [machine.scores(*features(w)) for w in chunks(batch.column("text"), NOT_SPACE)]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs`.

    `held_out` rows, those with crc32 of the id as text divisible by 5, never
    train. Null texts count as empty, and empty texts get the score that their
    statistics have. A null id is not held out and never labelled. Repeated
    rows score alike. Labels, lang, source and id are no features.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(fold != 0).select(
        "doc_id", F.col("quality").alias("label"))
    order = F.struct(F.xxhash64("doc_id"), "doc_id", "label")
    # The bound is applied to the labels first, so only the chosen rows'
    # texts are read further.
    chosen = known.orderBy(order).limit(max_rows)
    machine = train_classifier(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
