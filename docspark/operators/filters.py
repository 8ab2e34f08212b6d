"""Filters, paging and set operations on the document catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from docspark.functions.basics import rounded


def _contains_ci(column: str, value: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the value are wildcards."""
    return F.col(column).ilike(f"%{value}%")


def list_documents(
    docs: DataFrame, *, aircraft: str | None = None, category: str | None = None,
    ata: str | None = None, es_reference: str | None = None,
    doc_type: str | None = None, status: str | None = None,
    critical: bool | None = None, needs_review: bool | None = None,
    sort: str | None = None, descending: bool = True,
) -> DataFrame:
    """Every given condition must hold; absent ones do not restrict. With
    ``sort`` the rows come in that column's order, ties by id, nulls last."""
    tests = []
    for column, value in (
        ("aircraft_registration", aircraft), ("category", category),
        ("ata_chapter", ata), ("es_reference", es_reference)):
        if value is not None:
            tests.append(_contains_ci(column, value))
    for column, value in (
        ("doc_type", doc_type), ("status", status), ("is_critical", critical),
        ("needs_review", needs_review)):
        if value is not None:
            tests.append(F.col(column) == value)
    for test in tests:
        docs = docs.filter(test)
    if sort is None:
        return docs
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return docs.orderBy(order, F.desc("id") if descending else F.asc("id"))


def documents_of_aircraft(
    docs: DataFrame, registration: str, category: str | None = None,
    doc_type: str | None = None, limit: int = 50,
) -> DataFrame:
    """Newest documents of one aircraft."""
    found = docs.filter(F.col("aircraft_registration").ilike(registration))
    if category is not None:
        found = found.filter(_contains_ci("category", category))
    if doc_type is not None:
        found = found.filter(F.col("doc_type") == doc_type)
    return found.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit)


def review_queue(docs: DataFrame, topic: str) -> DataFrame:
    """Rows to review whose warnings mention a topic."""
    return docs.filter(
        F.col("needs_review") & F.col("validation_warnings").contains(topic))


def search_within(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    needle = text.lower()
    test = F.lit(False)
    for column in columns:
        test = test | F.contains(
            F.lower(F.coalesce(column, F.lit(""))), F.lit(needle))
    return docs.filter(test)


def reprocess_candidates(
    docs: DataFrame, below: float | None = None, review_only: bool = False,
    limit: int | None = None,
) -> DataFrame:
    test = F.col("needs_review") if review_only else F.col("ocr_confidence") < below
    found = docs.filter(test)
    return found if limit is None else found.orderBy("id").limit(limit)


def recent(docs: DataFrame, period: str, as_of: Column) -> DataFrame:
    """Documents of the last day, week or month before ``as_of``."""
    days = {"today": 1, "week": 7, "month": 30}[period]
    moment = F.coalesce("created_at", "archived_at")
    return docs.filter(moment >= as_of - F.make_dt_interval(F.lit(days)))


def off_fleet(docs: DataFrame, fleet: list[str]) -> DataFrame:
    return docs.filter(~F.col("aircraft_registration").isin(fleet))


def confidence_between(docs: DataFrame, low: float, high: float) -> DataFrame:
    return docs.filter(F.col("ocr_confidence").between(low, high))


def confidence_slice(docs: DataFrame, kind: str) -> DataFrame:
    c = F.col("ocr_confidence")
    test = {
        "processed": c > 0, "low": c < 60, "good": c >= 80, "below_70": c < 70,
    }[kind]
    return docs.filter(test & (c > 0))


def training_rows(
    docs: DataFrame, label: str = "doc_type", text: str = "ocr_text",
    longer_than: int = 50,
) -> DataFrame:
    return docs.filter(
        F.col(label).isNotNull() & (F.upper(label) != "OTHER")
        & (F.length(text) > longer_than))


def documents_of_check(
    docs: DataFrame, aircraft: str, letter: str, es_reference: str | None
) -> DataFrame:
    """Documents of a check: aircraft and category; narrowed to the exact
    reference only when that leaves something."""
    found = docs.filter(
        _contains_ci("aircraft_registration", aircraft)
        & _contains_ci("category", f"Check {letter}"))
    import re

    if not es_reference or not re.match(r"^ES\d{4,}", es_reference, re.IGNORECASE):
        return found
    exact = F.coalesce(F.upper("es_reference") == es_reference.upper(), F.lit(False))
    stats = found.agg(F.count_if(exact).alias("n")).scalar()
    return found.filter(exact | (stats == 0))


def engine_files(docs: DataFrame) -> DataFrame:
    from docspark.fixed_values import ENGINE_FILE_LIKE

    return docs.filter(F.col("filename").like(ENGINE_FILE_LIKE))


def document_by_id(docs: DataFrame, row_id: int) -> DataFrame:
    return docs.filter(F.col("id") == row_id)


# --- paging -----------------------------------------------------------------


def paginate(docs: DataFrame, page: int, size: int) -> DataFrame:
    """One page, newest first, with the total and the number of pages."""
    total = docs.agg(F.count("*").alias("n")).scalar()
    rows = docs.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).offset(
        (page - 1) * size).limit(size)
    return rows.withColumns({
        "total": total, "pages": F.ceil(total / F.lit(size)).cast("bigint")})


def top_ata(docs: DataFrame, limit: int = 20) -> DataFrame:
    return docs.filter(F.col("ata_chapter").isNotNull()).groupBy("ata_chapter").agg(
        F.count("*").alias("count")).orderBy(
        F.desc("count"), "ata_chapter").limit(limit)


def recent_alerts(
    alerts: DataFrame, limit: int = 20, resolved: bool = False
) -> DataFrame:
    """The newest alerts first, and only then without the resolved ones."""
    newest = alerts.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit)
    return newest if resolved else newest.filter(~F.col("resolved"))


def model_leaderboard(models: DataFrame) -> DataFrame:
    return models.orderBy(F.desc_nulls_last("accuracy"), "model_name")


def document_register(docs: DataFrame) -> DataFrame:
    return docs.select(
        "id", "filename", "doc_type", "aircraft_registration", "category",
        rounded(F.col("ocr_confidence"), 1).alias("ocr_confidence"),
    ).orderBy(
        F.asc_nulls_last("aircraft_registration"), F.asc_nulls_last("doc_type"),
        "filename", "id")


# --- sets -------------------------------------------------------------------


def new_hashes(disk: DataFrame, known: DataFrame) -> DataFrame:
    return disk.select("sha256_hash").subtract(known.select("sha256_hash"))


def known_on_both(disk: DataFrame, known: DataFrame) -> DataFrame:
    return disk.select("sha256_hash").intersect(known.select("sha256_hash"))


