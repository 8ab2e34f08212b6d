"""Merging and comparing text-recognition results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import exact_mean, exact_sum, ratio, rounded
from docspark.operators.scale import majority_value



def best_attempt_per_engine(attempts: DataFrame) -> DataFrame:
    """Per page and engine: the first attempt that is good enough, else the
    one with the highest confidence (earlier on a tie)."""
    good = F.col("confidence") >= fv.OCR_GOOD
    rank = F.struct(
        F.when(good, 0).otherwise(1).alias("c"),
        F.when(good, F.lit(0.0)).otherwise(-F.col("confidence")).alias("v"),
        F.col("attempt").alias("a"))
    return attempts.groupBy("document_id", "page_no", "engine").agg(
        F.min_by(F.struct("text", "confidence", "attempt"), rank).alias("b")).select(
        "document_id", "page_no", "engine", "b.text", "b.confidence", "b.attempt")


def fuse_engines(
    best: DataFrame, first: str = "tesseract", second: str = "opencv"
) -> DataFrame:
    """One text per page out of two engines."""
    def side(engine: str) -> Column:
        return F.max(F.when(
            F.col("engine") == engine, F.struct("text", "confidence"))).alias(engine)

    pages = best.groupBy("document_id", "page_no").agg(side(first), side(second))
    at, ac = F.col(f"{first}.text"), F.coalesce(f"{first}.confidence", F.lit(0.0))
    bt, bc = F.col(f"{second}.text"), F.coalesce(f"{second}.confidence", F.lit(0.0))

    def usable(text: Column, confidence: Column) -> Column:
        return F.coalesce(F.trim(text) != "", F.lit(False)) & (confidence > 0)

    def result(text: Column, confidence: Column, engine: str) -> Column:
        return F.struct(
            text.alias("text"), confidence.alias("confidence"),
            F.lit(engine).alias("engine"))

    a_ok, b_ok = usable(at, ac), usable(bt, bc)
    fused = (
        F.when(~a_ok & ~b_ok, result(F.lit(""), F.lit(0.0), "none"))
        .when(~b_ok, result(at, ac, first))
        .when(~a_ok, result(bt, bc, second))
        .when(ac >= fv.OCR_GOOD, result(at, ac, first))
        .when(bc > ac + 10, result(bt, bc, second))
        .when(F.abs(ac - bc) <= 10, result(
            F.concat(at, F.lit(" "), bt), F.greatest(ac, bc), "fusion"))
        .otherwise(result(at, ac, first)))
    return pages.select("document_id", "page_no", fused.alias("f")).select(
        "document_id", "page_no", "f.text", "f.confidence", "f.engine")


def document_ocr_rollup(pages: DataFrame) -> DataFrame:
    """Mean of the positive confidences, dominant engine, pages, review flag."""
    filled = F.trim("text") != ""
    stats = pages.groupBy("document_id").agg(
        F.count("*").alias("pages"),
        F.coalesce(exact_mean(F.when(F.col("confidence") > 0, F.col("confidence"))),
                   F.lit(0.0)).alias("_mean"),
        F.coalesce(F.bool_or(filled), F.lit(False)).alias("_filled"))
    engines = majority_value(pages, ["document_id"], "engine").drop("votes")
    return stats.join(engines, "document_id").select(
        "document_id", "pages", rounded(F.col("_mean"), 2).alias("confidence"), "engine",
        ((F.col("_mean") < fv.OCR_RUN_REVIEW_BELOW) | ~F.col("_filled")).alias(
            "needs_review"))


def document_text(
    pages: DataFrame, pages_per_part: int | None = None, separator: str = "\n\n"
) -> DataFrame:
    """Joined page text, one row per document.

    With ``pages_per_part`` a document comes in parts of so many page numbers
    instead, for bundles whose text is too long for one row.
    """
    if pages_per_part is None:
        part = F.lit(0)
    else:
        part = F.floor(F.col("page_no") / pages_per_part).cast("int")
    rows = pages.filter(F.trim("text") != "").groupBy(
        "document_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    kept = ["document_id"] if pages_per_part is None else ["document_id", "part"]
    return rows.select(*kept, F.array_join(
        F.transform("p", lambda x: x["text"]), separator).alias("text"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Page text and confidence where a recognised text replaces the native
    one: 97 for a native text, 0 for none."""
    recognised = F.coalesce(F.col("ocr_text") != "", F.lit(False))
    return pages.select(
        "document_id", "page_no",
        F.when(recognised, F.col("ocr_text")).otherwise(
            F.coalesce("native_text", F.lit(""))).alias("text"),
        F.when(recognised, F.col("ocr_confidence"))
        .when(F.coalesce(F.col("native_text") != "", F.lit(False)), 97.0)
        .otherwise(0.0).alias("confidence"),
        F.when(recognised, "tesseract").otherwise("pdfplumber").alias("engine"))


def reprocess_delta(runs: DataFrame) -> DataFrame:
    """What a new recognition run changes per document; a new confidence
    replaces the old one only when it is positive."""
    old = F.coalesce("old_confidence", F.lit(0.0))
    new = F.col("new_confidence")
    return runs.select(
        "id",
        F.when(new > old, "improved").when((new > 0) & (new < old), "degraded")
        .otherwise("unchanged").alias("change"),
        (~F.col("new_review") & F.col("old_review")).alias("newly_accepted"),
        F.when(new > 0, new).otherwise(old).alias("confidence"),
        (F.col("new_review") | ((new > 0) & (new < fv.LOW_OCR_ALERT_BELOW))).alias(
            "needs_review"))


def reprocess_summary(runs: DataFrame) -> DataFrame:
    return reprocess_delta(runs).groupBy("change").agg(
        F.count("*").alias("documents"),
        F.count_if("newly_accepted").alias("newly_accepted"))


def compare_engines(
    best: DataFrame, first: str = "tesseract", second: str = "opencv"
) -> DataFrame:
    """Mean confidences, improvement and share of pages where ``second`` is
    better, over the pages both engines read."""
    def of(engine: str) -> Column:
        return F.max(F.when(F.col("engine") == engine, F.col("confidence")))

    pairs = best.groupBy("document_id", "page_no").agg(
        of(first).alias("a"), of(second).alias("b")).dropna()
    mean_a, mean_b = exact_mean("a"), exact_mean("b")
    return pairs.agg(
        F.count("*").alias("pages"), rounded(mean_a, 1).alias(f"{first}_avg"),
        rounded(mean_b, 1).alias(f"{second}_avg"),
        rounded(mean_b - mean_a, 1).alias("improvement"),
        rounded(ratio(F.count_if(F.col("b") > F.col("a")), F.count("*")) * 100, 1)
        .alias("second_better_pct"))


def engine_times(pages: DataFrame) -> DataFrame:
    """Pages, attempts and mean seconds per engine; no text is read."""
    return pages.groupBy("engine").agg(
        F.countDistinct("document_id", "page_no").alias("pages"),
        F.count("*").alias("attempts"),
        rounded(exact_mean("seconds"), 3).alias("avg_seconds"))


__all__ = [n for n in (
    "assemble_pages", "best_attempt_per_engine", "compare_engines",
    "document_ocr_rollup", "document_text", "exact_sum", "fuse_engines",
    "reprocess_delta", "reprocess_summary")]
