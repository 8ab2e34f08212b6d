"""Order-dependent operators without whole-key sorts.

A window over a key that holds a third of all rows would sort them in one
task. Each operator here is either a mergeable aggregate or a prefix sum over
blocks of the order key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import cascade, extract, rounded
from docspark.functions.names import organised_destination
from docspark.operators.scale import in_ranges, join_to_groups, running_sums
from docspark.session import stored

PAGES_PER_BLOCK = 4096


def first_non_null_by_priority(
    rows: DataFrame, key: str, priority: str, value: str
) -> DataFrame:
    present = rows.filter(F.col(value).isNotNull())
    return present.groupBy(key).agg(F.min_by(value, priority).alias(value))


# --- segmentation of page bundles -------------------------------------------


def page_headers(pages: DataFrame) -> DataFrame:
    """What the top of each page says: start flag, type, reference, aircraft
    and confidence. The page text is dropped here and stays where it was."""
    lines = F.filter(
        F.transform(F.split("page_text", r"\r\n|\n|\r"), lambda x: F.trim(
            F.regexp_replace(x, r"^\s+|\s+$", ""))),
        lambda x: x != "")
    staged = pages.select("bundle_id", "page_no", lines.alias("_lines")).select(
        "bundle_id", "page_no",
        F.array_join(F.slice("_lines", 1, fv.HEADER_LINES), "\n").alias("_head"),
        F.array_join(F.slice("_lines", 1, fv.TOP_LINES), "\n").alias("_top"))
    doc_type = cascade("_head", lambda h: [
        F.when(h.rlike(p), label) for p, label in fv.BOUNDARY_PATTERNS])
    digits = extract("_head", fv.PAGE_ES)
    padded = F.concat(F.lit("ES"), F.lpad(
        digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))
    found = staged.select(
        "bundle_id", "page_no", doc_type.alias("doc_type"),
        padded.alias("es_reference"),
        F.upper(extract("_head", fv.PAGE_REGISTRATION)).alias("aircraft"),
        F.col("_top").rlike(fv.PAGE_ES).alias("_es_top"))
    by_type = F.col("doc_type").isNotNull()
    by_es = ~by_type & F.col("es_reference").isNotNull() & F.col("_es_top")
    score = (
        F.when(by_type, 3).otherwise(0)
        + F.when(F.col("es_reference").isNotNull(), 2).otherwise(0)
        + F.when(by_es, 1).otherwise(0)
        + F.when(F.col("aircraft").isNotNull(), 1).otherwise(0))
    return found.select(
        "bundle_id", "page_no", (by_type | by_es).alias("starts"), "doc_type",
        "es_reference", "aircraft",
        F.least(F.lit(1.0), score / F.lit(6.0)).alias("confidence"))


def segment_pages(pages: DataFrame) -> DataFrame:
    """Number the documents inside each bundle, from 1.

    A page starts a document when its header says so; the first page always
    does. The number is a running count of starts, computed over blocks of
    pages so that a huge bundle is spread over many tasks.
    """
    headers = stored(page_headers(pages), "headers")
    counted = running_sums(
        headers, ["page_no"], F.floor(F.col("page_no") / PAGES_PER_BLOCK),
        {"_starts_before": F.col("starts").cast("long")}, ["bundle_id"])
    first = headers.groupBy("bundle_id").agg(
        F.min_by("starts", "page_no").alias("_first_starts"),
        F.count("*").alias("_pages"))
    joined = join_to_groups(counted, first, ["bundle_id"], "_pages", "page_no")
    shift = F.when(F.col("_first_starts"), 0).otherwise(1)
    return joined.select(
        "bundle_id", "page_no", "starts", "doc_type", "es_reference", "aircraft",
        "confidence", (F.col("_starts_before") + shift).alias("segment"))


def segment_metadata(segments: DataFrame) -> DataFrame:
    """Type, reference and aircraft (first found), page range and name."""
    def first(name: str) -> Column:
        return F.min_by(
            name, F.when(F.col(name).isNotNull(), F.col("page_no"))).alias(name)

    merged = segments.groupBy("bundle_id", "segment").agg(
        first("doc_type"), first("es_reference"), first("aircraft"),
        F.min_by("confidence", "page_no").alias("confidence"),
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"),
        F.count("*").alias("pages"))
    name = F.concat(
        F.concat_ws(
            "_", "aircraft", "doc_type", "es_reference",
            F.format_string("p%d-%d", F.col("first_page") + 1, F.col("last_page") + 1),
            F.format_string("seg%03d", "segment")), F.lit(".pdf"))
    return merged.withColumns({
        "confidence": rounded(F.col("confidence"), 4),
        "filename": F.translate(name, '<>:"/\\|?*', "_________")})


# --- names and periods ------------------------------------------------------


def unique_destination(planned: DataFrame) -> DataFrame:
    """Destinations without collisions: the lowest id keeps the name, later
    ones carry their id."""
    groups = planned.groupBy("folder", "name").agg(
        F.min("id").alias("_first"), F.count("*").alias("_n"))
    joined = join_to_groups(
        planned.select("id", "folder", "name"), groups, ["folder", "name"], "_n", "id")
    stem = F.regexp_replace("name", r"\.pdf$", "")
    return joined.select(
        "id", "folder",
        F.when(F.col("id") == F.col("_first"), F.col("name")).otherwise(
            F.concat(stem, F.lit("_"), "id", F.lit(".pdf"))).alias("name"))


def organised_plan(docs: DataFrame) -> DataFrame:
    """Destination of every document in the organised tree."""
    names = [
        "es_reference", "sb_ad_reference", "work_order_number", "item_number",
        "ata_chapter"]
    dest = organised_destination(
        "id", "aircraft_registration", "category", "doc_type",
        {n: F.col(n) for n in names})
    return unique_destination(
        docs.select("id", dest.alias("d")).select("id", "d.folder", "d.name"))


def last_n_periods(counted: DataFrame, period: str, n: int) -> DataFrame:
    return counted.orderBy(F.desc_nulls_last(period)).limit(n)


def latest_per_key(files: DataFrame, key: str = "filename") -> DataFrame:
    """Newest file per key; equal times take the last path."""
    return files.groupBy(key).agg(
        F.max(F.struct("mtime", "path")).alias("_m")).select(
        key, F.col("_m.path").alias("path"), F.col("_m.mtime").alias("mtime"))


def running_statistics(log: DataFrame) -> DataFrame:
    """Processed, errors and mean duration after every row, in id order."""
    totals = running_sums(
        in_ranges(log.select("id", "status", "duration_s"), ["id"], "log-ranges"),
        ["id"], F.col("_range"),
        {"processed": F.lit(1).cast("long"),
         "errors": (F.col("status") == "error").cast("long"),
         "_seconds": F.col("duration_s").cast("decimal(18,6)")})
    return totals.select(
        "id", "processed", "errors",
        rounded(F.col("_seconds").cast("double") / F.col("processed"), 3)
        .alias("avg_duration_s"))


def context_budget(
    passages: DataFrame, order: Sequence[Column], length: Column, max_chars: int
) -> DataFrame:
    """Passages in ``order``, ranked from 1, while their total length fits.

    Lengths are summed per range of the order; only ranges that begin within
    the budget are sorted, however short or many their passages are.
    """
    rows = in_ranges(
        passages.withColumn("_len", F.coalesce(length, F.lit(0))), order, "passages")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy("_range").agg(
        F.sum("_len").alias("_l"), F.count("*").alias("_n")).select(
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_l").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    near = rows.join(
        begins.filter(F.col("_before") <= max_chars), F.col("_range") == F.col("_of"))
    inside = Window.partitionBy("_range").orderBy(*order)
    used = F.col("_before") + F.sum("_len").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return near.withColumn("_used", used).withColumn(
        "rank", F.col("_first") + F.row_number().over(inside)).filter(
        F.col("_used") <= max_chars).drop(
        "_len", "_range", "_of", "_before", "_first", "_used")
