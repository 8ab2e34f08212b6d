"""Evaluation of classifiers and entity annotations.

Everything derives from one grouped count of (true, predicted) pairs; its
size is the square of the number of labels, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import labels
from docspark.functions.basics import ratio, rounded
from docspark.operators.scale import running_sums


def pair_counts(
    rows: DataFrame, truth: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    return rows.groupBy(
        F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(
        F.count("*").alias("n"))


def _safe(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where undefined."""
    pairs = pair_counts(rows)
    sides = pairs.select(F.explode(F.array(
        F.struct(
            F.col("y_true").alias("label"), F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
            .alias("hits")),
        F.struct(
            F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*[
        F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision = _safe(F.col("hits"), F.col("predicted"))
    recall = _safe(F.col("hits"), F.col("support"))
    return sums.select(
        "label", "support", "predicted", "hits", precision.alias("precision"),
        recall.alias("recall"),
        _safe(precision * recall * 2, precision + recall).alias("f1"))


def classification_report(rows: DataFrame, digits: int = 4) -> DataFrame:
    return class_metrics(rows).select(
        "label", "support",
        *[rounded(F.col(c), digits).alias(c) for c in ("precision", "recall", "f1")])


def classification_metrics(rows: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Accuracy, macro, weighted and micro scores and the unknown share."""
    per_class = class_metrics(rows)
    total = F.sum("support")
    accuracy = _safe(F.sum("hits"), total)

    def weighted(name: str) -> Column:
        return _safe(
            F.sum((F.col(name) * F.col("support")).cast("decimal(28,10)")).cast("double"),
            total)

    macro = F.avg(F.col("f1").cast("decimal(18,12)")).cast("double")
    # With one prediction per row micro precision, recall and F1 are equal.
    return per_class.agg(
        total.alias("documents"), rounded(accuracy, 4).alias("accuracy"),
        rounded(macro, 4).alias("f1_macro"),
        rounded(weighted("f1"), 4).alias("f1_weighted"),
        rounded(accuracy, 4).alias("f1_micro"),
        rounded(weighted("precision"), 4).alias("precision_weighted"),
        rounded(weighted("recall"), 4).alias("recall_weighted"),
        rounded(_safe(
            F.sum(F.when(F.col("label") == unknown, F.col("predicted")).otherwise(0)),
            total) * 100, 2).alias("unknown_pct"))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """Counts and row-normalised percentages in long form."""
    pairs = pair_counts(rows)
    totals = pairs.groupBy(F.col("y_true").alias("_of")).agg(F.sum("n").alias("t"))
    return pairs.join(totals, F.col("y_true").eqNullSafe(F.col("_of"))).select(
        "y_true", "y_pred", "n",
        rounded(ratio(F.col("n"), F.col("t")) * 100, 1).alias("row_pct"))


def accuracy_by_confidence_bin(rows: DataFrame) -> DataFrame:
    correct = F.count_if(F.col("y_true") == F.col("y_pred"))
    return rows.groupBy(labels.confidence_bin("ocr_confidence").alias("bin")).agg(
        F.count("*").alias("documents"),
        rounded(ratio(correct, F.count("*")) * 100, 2).alias("correct_pct"))


def top_confusions(rows: DataFrame, limit: int = 8) -> DataFrame:
    return pair_counts(rows).filter(F.col("y_true") != F.col("y_pred")).orderBy(
        F.desc("n"), "y_true", "y_pred").limit(limit)


def weak_classes(rows: DataFrame, below: float = 0.70) -> DataFrame:
    return class_metrics(rows).filter(F.col("f1") < below).select(
        "label", "support",
        *[rounded(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def span_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exact matches, false and missed spans per label."""
    keys = ["doc_id", "start", "end", "label"]
    joined = gold.select(*keys, F.lit(1).alias("g")).join(
        predicted.select(*keys, F.lit(1).alias("p")), keys, "full")
    both = F.col("g").isNotNull() & F.col("p").isNotNull()
    return joined.groupBy("label").agg(
        F.count_if(both).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"))


def span_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per label, plus the rows ``macro`` and ``micro``."""
    counts = span_counts(gold, predicted)

    def scores(frame: DataFrame) -> DataFrame:
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        p, r = _safe(tp, tp + fp), _safe(tp, tp + fn)
        return frame.select(
            "label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"),
            _safe(p * r * 2, p + r).alias("f1"))

    per_label = scores(counts)
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    micro = scores(counts.agg(*sums).select(F.lit("micro").alias("label"), "*"))
    macro = per_label.agg(*sums, *[
        F.avg(F.col(c).cast("decimal(18,12)")).cast("double").alias(c)
        for c in ("precision", "recall", "f1")]).select(
        F.lit("macro").alias("label"), "*")
    both = per_label.unionByName(macro).unionByName(micro)
    return both.select("label", "tp", "fp", "fn", *[
        rounded(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def stratified_split(
    rows: DataFrame, label: str, test_share: float = 0.2, seed: int = 42,
    min_rows: int = 5, row_id: str = "id",
) -> DataFrame:
    """Add ``is_test``: in each class the rows with the smallest hashes.

    Ranks are computed on ids and labels alone, as running counts over
    hash-prefix blocks, so a class with a third of all rows is spread over
    many tasks. Only one cut-off hash per class is joined back. A null label
    is a class of its own.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    narrow = rows.select(label, digest.alias("_h"))
    ranked = running_sums(
        narrow, ["_h"], F.substring("_h", 1, 3),
        {"_rank": F.lit(1).cast("bigint")}, [label])
    sizes = narrow.groupBy(label).agg(F.count("*").alias("_n")).filter(
        F.col("_n") >= min_rows)
    wanted = F.round(F.col("_n") * test_share)
    sizes = sizes.withColumnRenamed(label, "_of")
    same = F.col(label).eqNullSafe(F.col("_of"))
    cutoffs = ranked.join(sizes, same).groupBy("_of").agg(
        F.max(F.when(F.col("_rank") <= wanted, F.col("_h"))).alias("_cut"))
    return rows.join(cutoffs, same).withColumn(
        "is_test", F.coalesce(digest <= F.col("_cut"), F.lit(False))).drop("_cut", "_of")


def leaderboard_row(name: str, rows: DataFrame) -> DataFrame:
    """One leaderboard line for a model's predictions."""
    return classification_metrics(rows).select(
        F.lit(name).alias("model_name"), "documents", "accuracy", "f1_macro",
        "f1_weighted")


def compare_models(predictions: dict[str, DataFrame], baseline: str) -> DataFrame:
    """Leaderboard over several models on the same rows, with the gain in
    accuracy over the baseline."""
    frames = [leaderboard_row(n, rows) for n, rows in predictions.items()]
    board = frames[0]
    for more in frames[1:]:
        board = board.unionByName(more)
    base = leaderboard_row(baseline, predictions[baseline]).select("accuracy").scalar()
    return board.withColumn("gain", rounded(F.col("accuracy") - base, 4)).orderBy(
        F.desc_nulls_last("accuracy"), "model_name")
