"""LM scoring: base against brute force, the model against its definition."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from docspark.llm import lm_scoring as lm
from docspark.llm.attention_model import STRIDE, AttentionModel, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("block", T.StringType())])


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    counts = Counter()
    for i, text, *_ in rows:
        if not held(i):
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text, *_ in rows:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + .1) / (n + .1 * (v + 1))) for t in ts)
        out.append((i, held(i), len(ts), sum(counts[t] > 0 for t in ts), n, base))
    return out


def check(rows, frame):
    got = sorted((tuple(r) for r in frame.collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] < 0
    return got


def hard_rows():
    words = "the quick brown fox Jumps over É 中文 naïve x9 don't a b ...".split(" ")
    random = np.random.Generator(np.random.PCG64(9))
    rows = [(i, " ".join(random.choice(words, random.integers(0, 60))), "s", "b") for i in range(120)]
    return rows + [(500, None, "", ""), (501, "", "", ""), (502, " \n\t", "", ""), (None, "the fox", "", ""),
                   (503, "z" * 3000, "", ""), (504, "long " * 30000, "", ""), rows[3], rows[3]]


def test_base_against_brute_force(spark):
    rows = hard_rows()
    frame = lm.lm_scores(spark.createDataFrame(rows, DOCS).repartition(4))
    assert frame.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = check(rows, frame)
    # Equal texts score alike, up to single precision.
    ends = {round(g[6], 5) for g in got if g[2] == 1}
    assert len(ends) == 1


def test_empty_and_untrained(spark):
    assert lm.lm_scores(spark.createDataFrame([], DOCS)).collect() == []
    only = next(i for i in range(100) if held(i))
    rows = [(only, "never trained on this", "", "")]
    got = check(rows, lm.lm_scores(spark.createDataFrame(rows, DOCS)))
    assert got[0][4] == 0 and got[0][3] == 0
    check([(500, None, "", "")], lm.lm_scores(spark.createDataFrame([(500, None, "", "")], DOCS)))


def test_training_beats_pair_counts_and_plain_counts(spark):
    """On held-out texts: trained model > its untrained prior, and > the base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = {}
    for share in (5, 10 ** 9):
        frame = lm.lm_scores(docs, share=share).filter("held_out")
        sums[share] = frame.selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    trained, untrained = sums[5], sums[10 ** 9]
    assert trained["n"] > 1000 and trained["s"] > untrained["s"] + .05 * trained["n"]
    assert trained["s"] > trained["b"]


def test_windows_score_each_target_once():
    random = np.random.Generator(np.random.PCG64(2))
    sizes = np.array([1, 16, 17, 40, 3])
    sequence = random.integers(0, 50, sizes.sum())
    inputs, targets = windows(sequence, sizes, 0, 99)
    assert targets[targets != 99].tolist() == sequence.tolist()
    at = 0
    for size in sizes:
        own = sequence[at:at + size]
        before = np.append(0, own[:-1])
        for w in range(-(-size // STRIDE)):
            row = inputs[int(sum(-(-s // STRIDE) for s in sizes[:list(sizes).index(size)])) + w]
            queries = before[w * STRIDE:(w + 1) * STRIDE]
            assert row[STRIDE:STRIDE + len(queries)].tolist() == queries.tolist()
            context = before[max(0, w - 1) * STRIDE:w * STRIDE]
            if w:
                assert row[:STRIDE].tolist() == context.tolist()
            else:
                assert set(row[:STRIDE].tolist()) == {99}
        at += size


def small_model(seed=1, n=12):
    random = np.random.Generator(np.random.PCG64(seed))
    prior = random.normal(size=(n, n))
    prior -= np.log(np.exp(prior).sum(axis=1, keepdims=True))
    model = AttentionModel(prior, members=4)
    for name in ("group", "member"):
        model.p[name] = random.normal(size=model.p[name].shape).astype(np.float32)
    model.p["distance"] = (random.normal(size=2 * STRIDE) * .3).astype(np.float32)
    return model


def plain(model, sequence):
    """One position after another, straight from the definition."""
    p, out, inputs = {k: v.astype(float) for k, v in model.p.items()}, [], [0, *sequence[:-1]]
    for i, target in enumerate(sequence):
        first = max(0, (i // STRIDE - 1) * STRIDE)
        e = p["embedding"][inputs[first:i + 1]]
        weight = np.exp((e[-1] @ p["query"]) @ (e @ p["key"]).T / math.sqrt(e.shape[1]) + p["distance"][i - np.arange(first, i + 1)])
        mixed = weight @ (e @ p["value"]) / weight.sum()
        x = e[-1] + mixed @ p["mix"]
        x = x + np.maximum(x @ p["up"] + p["up_bias"], 0) @ p["down"]
        prior = np.exp(_whole(model)[inputs[i]]).reshape(-1, model.members)
        groups = np.log(prior.sum(axis=1)) + p["group"] @ x
        members = np.log(prior / prior.sum(axis=1, keepdims=True)).ravel() + p["member"] @ x
        g = target // model.members
        own = members[g * model.members:(g + 1) * model.members]
        out.append(groups[g] - np.log(np.exp(groups).sum()) + members[target] - np.log(np.exp(own).sum()))
    return out


def _whole(model):
    groups, members = model.prior
    return (groups[:, :, None] + members).reshape(len(groups), -1)


def test_batched_attention_equals_one_position_at_a_time():
    model = small_model()
    random = np.random.Generator(np.random.PCG64(4))
    sequences = [random.integers(0, 12, s) for s in (1, 15, 16, 17, 53)]
    sizes = np.array([len(s) for s in sequences])
    inputs, targets = windows(np.concatenate(sequences), sizes, 0, 12)
    got = model.log_probabilities(inputs, targets, batch=3)
    want = np.concatenate([plain(model, s) for s in sequences])
    assert np.allclose(got[targets != 12], want, atol=1e-4)
    assert (got[targets == 12] == 0).all()


def test_probabilities_sum_to_one():
    model = small_model()
    for before in ([], [3, 5, 5], [1] * 40):
        rows = [np.array([*before, x]) for x in range(12)]
        inputs, targets = windows(np.concatenate(rows), np.full(12, len(before) + 1), 0, 12)
        found = model.log_probabilities(inputs, targets).reshape(12, -1)
        last = found[np.arange(12), len(before)]
        assert np.exp(last).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_against_differences():
    model = small_model()
    random = np.random.Generator(np.random.PCG64(6))
    inputs, targets = windows(random.integers(0, 12, 100), np.array([40, 3, 57]), 0, 12)
    _, gradients = model.gradients(inputs, targets)
    for name, values in model.p.items():
        for _ in range(4):
            at, step = tuple(random.integers(0, s) for s in values.shape), 1e-2
            held_value = values[at]
            losses = []
            for sign in (1, -1):
                values[at] = held_value + sign * step
                losses.append(-model.log_probabilities(inputs, targets).sum() / 100)
            values[at] = held_value
            slope = (losses[0] - losses[1]) / (2 * step)
            assert abs(slope - gradients[name][at]) < .03 * np.abs(gradients[name]).max() + 1e-4


def test_symbols_share_one_distribution():
    counts = np.random.Generator(np.random.PCG64(8)).integers(0, 50, 5000)
    symbols = lm.Symbols.of(counts)
    for s in np.unique(symbols.of_id):
        assert np.exp(symbols.log_share[symbols.of_id == s]).sum() == pytest.approx(1)
    assert symbols.of_id.min() == 1 and symbols.of_id.max() < lm.SYMBOLS
    few = lm.Symbols.of(np.array([3, 1, 0]))
    assert few.of_id.tolist() == [1, 2, 3]


@pytest.mark.parametrize("words", [
    ["the", "naïve", "don't", "x9--", "中文"], [" ", " ", "y"], ["a ", " b", "\u0085"], []])
def test_words_encode_alike_together_and_alone(words):
    subwords = lm.Subwords.of(lm.TOKENIZER)
    each = [(" " + w).encode() for w in words]
    data = np.frombuffer(b"".join(each), dtype=np.uint8)
    starts, ids = subwords.encode(data, np.array([len(e) for e in each], dtype=np.int64))
    alone = [subwords._encoding.encode_ordinary(e.decode()) for e in each]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == alone


def test_packed_numbers_round_trip():
    for numbers in (np.zeros(0, dtype=np.int64), np.arange(70_000), np.array([3, 65535])):
        import pyarrow as pa
        assert lm._unpacked(pa.py_buffer(lm._packed(numbers))).tolist() == numbers.tolist()


def test_every_training_window_belongs_to_one_round(spark):
    """Before, each round took one window in 64, and 15 in 16 were in none."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    blocks = lm.text_blocks(docs)
    symbols = lm.Symbols.of(np.ones(lm.Subwords.of(lm.TOKENIZER).size))
    shared = spark.sparkContext.broadcast(symbols)
    found = blocks.drop("doc_id", "hashes").mapInArrow(
        lm._pairs_and_rounds(shared, lm.SHARE, len(lm.RATES)),
        "cell int, n long, round int, sizes binary, sequence binary").collect()
    docs_of, symbols_of = Counter(), Counter()
    for r in found:
        if r["round"] is not None:
            sizes = lm._unpacked(memoryview(r["sizes"]))
            docs_of[r["round"]] += len(sizes)
            symbols_of[r["round"]] += int(sizes.sum())
            assert r["n"] == sum(-(-s // STRIDE) for s in sizes)
    assert sum(docs_of.values()) == docs.filter("crc32(CAST(doc_id AS STRING)) % 10 <> 0").count()
    assert sum(symbols_of.values()) == sum(r["n"] for r in found if r["cell"] is not None)
    assert set(docs_of) == set(range(len(lm.RATES)))


def test_a_task_trains_its_groups_apart_and_sends_their_sum(monkeypatch):
    """Before, windows were shuffled to tasks of one group each, and each sent all parameters."""
    import pyarrow as pa
    from types import SimpleNamespace
    monkeypatch.setattr(lm, "GROUP_WINDOWS", 8, raising=False)
    random = np.random.default_rng(3)
    rows = []
    for n in (10, 12):
        sizes = np.full(n, STRIDE)
        rows.append((lm._packed(random.integers(1, lm.SYMBOLS, int(sizes.sum()))), lm._packed(sizes)))
    model = AttentionModel(np.log(np.full((lm.SYMBOLS, lm.SYMBOLS), 1 / lm.SYMBOLS)), lm.MEMBERS)
    train = lm._train(SimpleNamespace(value=(np.log(np.full((lm.SYMBOLS, lm.SYMBOLS), 1 / lm.SYMBOLS)), model.vector())), 0, 1e-2)

    def run(held):
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.binary()) for i in (0, 1)], names=["sequence", "sizes"])
        out, = train(iter([batch]))
        return out.column("value").to_numpy(), out.column("weight").to_numpy()[0]

    one, two, both = run(rows[:1]), run(rows[1:]), run(rows)
    assert (one[1], two[1], both[1]) == (10, 12, 22)
    assert (both[0] == one[0] + two[0]).all()
    assert not list(train(iter([])))


def test_rows_are_summed_by_symbol():
    """Before, rows of each table were sorted and summed one after another."""
    model = small_model()
    random = np.random.Generator(np.random.PCG64(5))
    symbols = random.choice([0, 1, 1, 1, 1, 5, 12], 300)
    symbols[7] = 9
    rows = random.normal(size=(300, 6)).astype(np.float32)
    want = np.zeros((13, 6))
    np.add.at(want, symbols, rows)
    assert np.allclose(model._by_symbol(symbols, rows), want[:12], atol=1e-4)


def test_large_and_small_logits_keep_their_shares():
    """Rows are shifted only where their exponentials would not fit."""
    from docspark.llm.attention_model import _exponentials
    for shift in (0, 500, -500):
        logits = np.array([[1, 2, 3], [shift, shift + 1, shift + 2]], dtype=np.float32)
        shares, logs, total = _exponentials(logits)
        assert np.allclose(shares / total[:, None], [[.0900306, .2447285, .6652410]] * 2, atol=1e-5)
        assert np.allclose(logs, [3.4076059, shift + 2.4076059], atol=1e-3)


def test_scans_have_several_tasks_per_core(spark, tmp_path):
    """Before, files were put together to one task per core, and some cores got two."""
    from docspark.session import fine_scans
    cores = spark.sparkContext.defaultParallelism
    spark.range(4 * cores).repartition(4 * cores).write.parquet(str(tmp_path / "files"))
    n_files = len(list((tmp_path / "files").glob("*.parquet")))
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    with fine_scans(spark):
        assert spark.read.parquet(str(tmp_path / "files")).rdd.getNumPartitions() == n_files
    assert spark.conf.get(name, None) == before


def test_left_over_windows_go_with_the_last_group():
    """Before, they were a small group of their own, one in every task."""
    rows = [(np.full(STRIDE * n, n), np.full(n, STRIDE)) for n in (10, 12, 3)]
    for held, want in ((rows, [10, 15]), (rows[2:], [3]), (rows[:1], [10]), ([], [])):
        groups = list(lm._groups(iter(held), 8))
        assert [len(sizes) for _, sizes in groups] == want
        assert [len(sequence) for sequence, _ in groups] == [n * STRIDE for n in want]
