"""Dashboard aggregates over the document catalogue.

Facts are aggregated before they meet a dimension, so a join moves one row
per group instead of one per document, and several distinct counts share one
grouping instead of expanding every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions import labels
from docspark.functions.basics import exact_mean, exact_sum, ratio, rounded
from docspark.functions.entities import format_valid, normalise_es
from docspark.operators.scale import best_per_key, running_sums

_EXACT = "decimal(28,10)"


def _partial(name: str) -> list[Column]:
    """Mergeable sum and count of one measure."""
    return [
        F.sum(F.col(name).cast(_EXACT)).alias(f"{name}_s"),
        F.count(name).alias(f"{name}_n")]


def _merged_mean(name: str) -> Column:
    return F.try_divide(F.sum(f"{name}_s").cast("double"), F.sum(f"{name}_n"))


def _count_if(test: Column) -> Column:
    return F.count_if(test)


def kpi_cells(docs: DataFrame) -> DataFrame:
    """What the global indicators need of each (aircraft, reference)."""
    return docs.groupBy("aircraft_registration", "es_reference").agg(
        F.count("*").alias("n"),
        _count_if(F.col("status") == "ARCHIVED").alias("archived"),
        _count_if(F.col("status") == "ERROR").alias("errors"),
        _count_if(F.col("is_critical")).alias("critical"),
        _count_if(F.col("needs_review")).alias("review"),
        F.count("embedding").alias("embedded"),
        *_partial("ocr_confidence"), *_partial("classifier_confidence"),
        F.sum(F.col("file_size_kb").cast(_EXACT)).alias("kb"))


def kpis_of_cells(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"),
        F.coalesce(F.sum("archived"), F.lit(0)).alias("archived"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
        F.coalesce(F.sum("review"), F.lit(0)).alias("needs_review"),
        F.coalesce(F.sum("embedded"), F.lit(0)).alias("with_embedding"),
        rounded(_merged_mean("ocr_confidence"), 1).alias("avg_ocr"),
        rounded(_merged_mean("classifier_confidence"), 2).alias("avg_classifier"),
        rounded(F.sum("kb").cast("double") / 1024, 1).alias("total_mb"),
        F.countDistinct("aircraft_registration").alias("aircraft"),
        F.countDistinct("es_reference").alias("checks"))


def global_kpis(docs: DataFrame) -> DataFrame:
    return kpis_of_cells(kpi_cells(docs))


def dashboard_kpis(
    docs: DataFrame, alerts: DataFrame, aircraft: DataFrame
) -> DataFrame:
    active = alerts.filter(~F.col("resolved")).agg(F.count("*").alias("n"))
    fleet = aircraft.agg(F.count("*").alias("n"))
    positive = F.when(F.col("ocr_confidence") > 0, F.col("ocr_confidence"))
    return docs.agg(
        F.count("*").alias("total_documents"),
        _count_if(F.col("status") == "ARCHIVED").alias("archived"),
        F.coalesce(rounded(exact_mean(positive), 2), F.lit(0.0)).alias(
            "avg_ocr_confidence"),
        _count_if(F.col("needs_review")).alias("needs_review"),
        rounded(
            _count_if(F.col("status") == "ARCHIVED")
            / F.greatest(F.count("*"), F.lit(1)) * 100, 1).alias("archive_rate_pct"),
        _count_if(F.col("is_critical")).alias("critical_ads"),
    ).withColumns({
        "active_alerts": active.scalar(), "total_aircraft": fleet.scalar()})


def system_health(docs: DataFrame, alerts: DataFrame) -> DataFrame:
    active = alerts.filter(~F.col("resolved")).agg(F.count("*").alias("n"))
    totals = docs.agg(
        F.count("*").alias("total_documents"),
        _count_if(F.col("status") == "ARCHIVED").alias("archived"),
        _count_if(F.col("status") == "ERROR").alias("errors"),
        _count_if(F.col("is_duplicate")).alias("duplicates_detected"),
        F.coalesce(rounded(exact_mean("ocr_confidence"), 2), F.lit(0.0)).alias(
            "avg_ocr_confidence"))
    return totals.withColumns({
        "active_alerts": active.scalar(),
        "status": F.when(F.col("errors") < 10, "healthy").otherwise("degraded")})


def stage_coverage(docs: DataFrame) -> DataFrame:
    kept = docs.filter(F.col("status") == "ARCHIVED")
    whole = F.greatest(F.count("*"), F.lit(1))
    known = F.coalesce(F.col("aircraft_registration") != "", F.lit(False))
    return kept.agg(
        rounded(ratio(_count_if(known), whole), 3).alias("entities"),
        rounded(exact_mean("classifier_confidence"), 3).alias("classifier"),
        rounded(ratio(F.count("embedding"), whole), 3).alias("embedding"))


def by_type(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_type").agg(
        F.count("*").alias("documents"),
        rounded(exact_mean("ocr_confidence"), 1).alias("avg_ocr"),
        rounded(exact_mean("classifier_confidence"), 2).alias("avg_classifier"),
        rounded(exact_sum("file_size_kb") / 1024, 1).alias("size_mb"),
        _count_if(F.col("is_critical")).alias("critical"),
    ).orderBy(F.desc("documents"), "doc_type")


def stats_by_type(docs: DataFrame) -> DataFrame:
    """Count and mean confidence; a zero mean counts as missing."""
    return docs.groupBy("doc_type").agg(
        F.count("*").alias("count"),
        rounded(labels.blank_or_zero_to_null(exact_mean("ocr_confidence")), 1)
        .alias("avg_ocr_confidence"),
    ).orderBy(F.desc("count"), "doc_type")


def by_aircraft(docs: DataFrame, aircraft: DataFrame) -> DataFrame:
    cells = docs.filter(F.col("aircraft_registration").isNotNull()).groupBy(
        "aircraft_registration", "aircraft_id", "doc_type", "category").agg(
        F.count("*").alias("n"), *_partial("ocr_confidence"),
        _count_if(F.col("is_critical")).alias("c"),
        F.min("archived_at").alias("lo"), F.max("archived_at").alias("hi"))
    dimension = aircraft.select(F.col("id").alias("aircraft_id"), "msn", "model")
    return cells.join(dimension, "aircraft_id", "left").groupBy(
        "aircraft_registration", "msn", "model").agg(
        F.sum("n").alias("documents"),
        F.countDistinct("doc_type").alias("types"),
        F.countDistinct("category").alias("categories"),
        rounded(_merged_mean("ocr_confidence"), 1).alias("avg_ocr"),
        F.sum("c").alias("critical"),
        F.min("lo").cast("date").alias("first_document"),
        F.max("hi").cast("date").alias("last_document"))


def stats_by_aircraft(docs: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Every aircraft with its count, joined on the registration."""
    counts = docs.filter(F.col("aircraft_registration").isNotNull()).groupBy(
        F.col("aircraft_registration").alias("registration")).agg(
        F.count("*").alias("n"))
    return aircraft.select("registration").join(
        counts, "registration", "left").groupBy("registration").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"))


def by_category(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.count("*").alias("count"))


def by_ata(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("ata_chapter").isNotNull()).groupBy("ata_chapter").agg(
        F.count("*").alias("documents"),
        F.countDistinct("aircraft_registration").alias("aircraft"),
        rounded(exact_mean("ocr_confidence"), 1).alias("avg_ocr"),
        _count_if(F.col("is_critical")).alias("critical"))


def monthly_archive(docs: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "archived_at").cast("date")
    return docs.filter(F.col("archived_at").isNotNull()).groupBy(
        month.alias("month")).agg(
        F.count("*").alias("archived"),
        F.countDistinct("aircraft_registration").alias("active_aircraft"),
        rounded(exact_mean("ocr_confidence"), 1).alias("avg_ocr"),
        _count_if(F.col("is_critical")).alias("critical"),
    ).withColumn("label", F.date_format("month", "yyyy-MM")).orderBy("month")


def monthly_evolution(docs: DataFrame, periods: int = 6) -> DataFrame:
    """The last ``periods`` months with archived documents."""
    counted = docs.filter(F.col("status") == "ARCHIVED").groupBy(
        F.year("created_at").alias("year"), F.month("created_at").alias("month"),
    ).agg(F.count("*").alias("count"))
    return counted.orderBy(
        F.desc_nulls_last("year"), F.desc_nulls_last("month")).limit(periods).select(
        F.format_string("%d-%02d", "year", "month").alias("period"), "count")


def quality_bands(docs: DataFrame) -> DataFrame:
    return docs.groupBy(labels.quality_band("ocr_confidence").alias("band")).agg(
        F.count("*").alias("documents"),
        rounded(exact_mean("file_size_kb"), 1).alias("avg_kb"),
        F.countDistinct("aircraft_registration").alias("aircraft"))


def band_counts(docs: DataFrame, band: Column) -> DataFrame:
    return docs.groupBy(band.alias("band")).agg(F.count("*").alias("count"))


def anomalies(docs: DataFrame) -> DataFrame:
    kept = F.col("status") == "ARCHIVED"
    return docs.agg(
        _count_if(kept & F.col("aircraft_registration").isNull()).alias("no_aircraft"),
        _count_if(kept & F.col("ata_chapter").isNull()).alias("no_ata"),
        _count_if(kept & F.col("es_reference").isNull()).alias("no_reference"),
        _count_if(F.col("needs_review")).alias("needs_review"))


def coverage_cells(docs: DataFrame) -> DataFrame:
    """What coverage needs of each (aircraft, type)."""
    return docs.groupBy("aircraft_registration", "doc_type").agg(
        F.count("*").alias("n"), *_partial("ocr_confidence"),
        _count_if(F.col("manually_corrected")).alias("v"))


def coverage_by_aircraft(docs: DataFrame, aircraft: DataFrame) -> DataFrame:
    return coverage_of_cells(coverage_cells(docs), aircraft)


def coverage_of_cells(cells: DataFrame, aircraft: DataFrame) -> DataFrame:
    types = cells.agg(F.countDistinct("doc_type").alias("t"))
    mean = F.coalesce(rounded(_merged_mean("ocr_confidence"), 1), F.lit(0.0))
    per_aircraft = cells.filter(F.col("aircraft_registration").isNotNull()).groupBy(
        F.col("aircraft_registration").alias("registration")).agg(
        F.sum("n").alias("n"), F.countDistinct("doc_type").alias("nb_types"),
        mean.alias("avg_ocr"), F.sum("v").alias("v"))
    joined = aircraft.select("registration").join(per_aircraft, "registration", "left")
    nb_types = F.coalesce(F.col("nb_types"), F.lit(0))
    share = nb_types / F.greatest(types.scalar(), F.lit(1)) * 100
    return joined.select(
        F.col("registration").alias("aircraft"),
        F.coalesce("n", F.lit(0)).alias("total_docs"),
        nb_types.alias("nb_types"),
        F.coalesce("avg_ocr", F.lit(0.0)).alias("avg_ocr"),
        F.coalesce("v", F.lit(0)).alias("validated"),
        rounded(share, 0).alias("coverage_pct"),
    ).orderBy(F.desc("total_docs"), "aircraft")


def archive_quality_score(docs: DataFrame) -> DataFrame:
    kept = F.col("status") == "ARCHIVED"
    positive = F.when(F.col("ocr_confidence") > 0, F.col("ocr_confidence"))
    ocr = F.coalesce(exact_mean(positive), F.lit(0.0))
    classifier = F.coalesce(
        exact_mean(F.when(kept, F.col("classifier_confidence"))), F.lit(0.0))
    bad = _count_if(kept & F.col("aircraft_registration").isNull()) + _count_if(
        F.col("needs_review"))
    rate = bad / F.greatest(F.count("*"), F.lit(1))
    score = ocr * 0.4 + classifier * 100 * 0.3 + (1 - rate) * 100 * 0.3
    return docs.agg(rounded(score, 1).alias("quality_score"))


def validation_rate(docs: DataFrame) -> DataFrame:
    kept = F.col("status") == "ARCHIVED"
    corrected = _count_if(kept & F.col("manually_corrected"))
    return docs.agg(
        corrected.alias("manually_corrected"),
        rounded(
            corrected / F.greatest(_count_if(kept), F.lit(1)) * 100, 1
        ).alias("human_validation_pct"),
        _count_if(F.col("status") == "PENDING").alias("pending_count"))


def aircraft_stats(docs: DataFrame, aircraft: DataFrame) -> DataFrame:
    kinds = {
        "work_orders": "Work Order", "jobcards": "Jobcard", "ads": "AD", "sbs": "SB"}
    facts = docs.filter(F.col("aircraft_id").isNotNull()).groupBy("aircraft_id").agg(
        F.count("*").alias("total_docs"),
        *[_count_if(labels.normalise_doc_type("doc_type") == v).alias(k)
          for k, v in kinds.items()],
        rounded(exact_mean("ocr_confidence"), 4).alias("avg_ocr_confidence"),
        F.max("created_at").alias("last_archived"))
    joined = aircraft.select(
        F.col("id").alias("aircraft_id"), "registration", "model").join(
        facts, "aircraft_id", "left")
    return joined.select(
        "registration", "model",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_docs", *kinds)],
        "avg_ocr_confidence", "last_archived")


def check_stats(checks: DataFrame, aircraft: DataFrame, docs: DataFrame) -> DataFrame:
    kind = labels.normalise_doc_type("doc_type")
    facts = docs.filter(F.col("check_id").isNotNull()).groupBy("check_id").agg(
        F.count("*").alias("documents"),
        _count_if(kind == "Jobcard").alias("jobcards"),
        _count_if(kind == "Work Order").alias("work_orders"),
        _count_if(kind == "Defect Report").alias("defects"))
    fleet = aircraft.select(
        F.col("id").alias("aircraft_id"), "registration", "msn", "model")
    joined = checks.join(fleet, "aircraft_id", "left").join(
        facts, checks.id == facts.check_id, "left")
    return joined.select(
        "es_reference", "check_type", "registration", "msn", "model",
        "start_date", "end_date",
        F.datediff("end_date", "start_date").alias("duration_days"),
        *[F.coalesce(c, F.lit(0)).alias(c)
          for c in ("documents", "jobcards", "work_orders", "defects")])


def type_by_category(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category", "doc_type").agg(
        F.count("*").alias("count")).orderBy(
        F.asc_nulls_first("category"), F.desc("count"), "doc_type")


def quality_by_type(docs: DataFrame) -> DataFrame:
    stats = docs.groupBy("doc_type").agg(
        F.count("*").alias("count"),
        rounded(exact_mean("ocr_confidence"), 1).alias("avg_ocr"),
        rounded(exact_mean("classifier_confidence"), 2).alias("avg_classifier"))
    return stats.withColumns({
        "weak_ocr": F.col("avg_ocr") < fv.REVIEW_OCR_BELOW,
        "weak_classifier": F.col("avg_classifier") < fv.REVIEW_CLASSIFIER_BELOW})


def global_flags(docs: DataFrame) -> DataFrame:
    return docs.agg(*[
        _count_if(F.col(c)).alias(c)
        for c in ("needs_review", "is_critical", "manually_corrected")])


def ocr_summary(docs: DataFrame) -> DataFrame:
    """Mean, exact median, range and three quality classes.

    The median comes from running counts over the distinct values, so neither
    the rows nor the values are gathered in one place.
    """
    values = docs.filter(F.col("ocr_confidence") != 0).groupBy(
        F.col("ocr_confidence").alias("v")).agg(F.count("*").alias("n"))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).scalar()
    ranked = running_sums(
        values, ["v"], F.floor(F.col("v") * 100), {"seen": F.col("n")})
    low, high = F.floor((total + 1) / 2), F.floor(total / 2) + 1
    def share(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    v = F.col("v")
    weighted = F.sum((v.cast("decimal(18,10)") * F.col("n")).cast(_EXACT)).cast("double")
    middle = (
        F.min(F.when(F.col("seen") >= low, v))
        + F.min(F.when(F.col("seen") >= high, v))) / 2
    classes = {"good": v >= 80, "mid": (v >= 60) & (v < 80), "low": v < 60}
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        rounded(F.try_divide(weighted, F.sum("n")), 1).alias("mean"),
        rounded(middle, 2).alias("median"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        *[share(t).alias(k) for k, t in classes.items()],
        *[rounded(ratio(share(t), F.sum("n")) * 100, 0).alias(f"{k}_pct")
          for k, t in classes.items()])


def value_distribution(docs: DataFrame, column: str, missing: str) -> DataFrame:
    return docs.groupBy(
        F.coalesce(column, F.lit(missing)).alias("value")).agg(
        F.count("*").alias("count"))


def discovery_report(files: DataFrame) -> DataFrame:
    """Files and megabytes in total, per aircraft and per category."""
    cells = files.groupBy(
        F.coalesce("aircraft_registration", F.lit("?")).alias("a"),
        F.coalesce("category", F.lit("?")).alias("c")).agg(
        F.count("*").alias("n"), F.sum(F.col("file_size_kb").cast(_EXACT)).alias("kb"))
    def level(name: str, key: Column) -> DataFrame:
        return cells.groupBy(key.alias("key")).agg(
            F.sum("n").alias("files"),
            rounded(F.sum("kb").cast("double") / 1024, 1).alias("mb"),
        ).select(F.lit(name).alias("level"), "key", "files", "mb")

    return level("total", F.lit("all")).unionByName(
        level("aircraft", F.col("a"))).unionByName(level("category", F.col("c")))


def archive_tree(docs: DataFrame) -> DataFrame:
    """Counts at each level of aircraft, category and type.

    Upper levels are sums of the lowest one. The documents below a node stay
    rows of their own (``archive_tree_documents``): a nested list per node
    would gather an unbounded group in one task.
    """
    leaf = docs.filter(F.col("aircraft_registration").isNotNull()).groupBy(
        F.col("aircraft_registration").alias("aircraft"),
        F.coalesce("category", F.lit("Sans categorie")).alias("category"),
        F.coalesce("doc_type", F.lit("Autre")).alias("doc_type")).agg(
        F.count("*").alias("n"))
    def level(depth: int) -> DataFrame:
        keys = ["aircraft", "category", "doc_type"]
        kept = [
            F.col(k) if i < depth else F.lit(None).cast("string").alias(k)
            for i, k in enumerate(keys)]
        return leaf.groupBy(*keys[:depth]).agg(F.sum("n").alias("count")).select(
            F.lit(depth).alias("level"), *kept, "count")

    return level(1).unionByName(level(2)).unionByName(level(3))


def archive_tree_documents(docs: DataFrame) -> DataFrame:
    """The leaves of the tree, in tree order when written sorted."""
    return docs.filter(F.col("aircraft_registration").isNotNull()).select(
        F.col("aircraft_registration").alias("aircraft"),
        F.coalesce("category", F.lit("Sans categorie")).alias("category"),
        F.coalesce("doc_type", F.lit("Autre")).alias("doc_type"),
        "id", "filename", "es_reference",
        rounded(labels.blank_or_zero_to_null("ocr_confidence"), 1).alias(
            "ocr_confidence"),
        "needs_review", "is_critical")


def path_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Folder tree as edges: node, parent, depth and files below."""
    parts = F.split(F.translate(F.col(path), "\\", "/"), "/")
    depths = F.sequence(F.lit(1), F.size("parts"))
    nodes = paths.groupBy(parts.alias("parts")).agg(F.count("*").alias("n")).select(
        "parts", "n", F.explode(depths).alias("depth"))
    return nodes.groupBy(
        F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("node"),
        F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/").alias(
            "parent"),
        "depth",
        F.when(F.col("depth") < F.size("parts"), "folder").otherwise("file").alias(
            "kind")).agg(F.sum("n").alias("files"))


def distinct_checks(checks: DataFrame) -> DataFrame:
    """First check per reference, in arrival order (aircraft, id)."""
    key = F.regexp_replace(F.upper(F.coalesce("es_reference", F.lit(""))), "^ES", "")
    keyed = checks.withColumn("_key", key).filter(F.col("_key") != "")
    return best_per_key(
        keyed, ["_key"], [F.col("aircraft"), F.col("id")],
        ["id", "aircraft", "es_reference", "check_type"]).drop("_key")


def checks_by_letter(checks: DataFrame) -> DataFrame:
    letter = F.coalesce(labels.check_letter("check_type"), F.lit("?"))
    return distinct_checks(checks).groupBy(letter.alias("letter"), "aircraft").agg(
        F.count("*").alias("checks"))


def fleet_summary(aircraft_counts: DataFrame) -> DataFrame:
    return aircraft_counts.agg(
        _count_if(F.col("aircraft_type") == "NEO").alias("neo"),
        _count_if(F.col("aircraft_type") == "CEO").alias("ceo"),
        _count_if(F.col("doc_count") > 0).alias("with_documents"),
        F.sum("doc_count").alias("total_documents"))


def type_share(docs: DataFrame) -> DataFrame:
    counts = docs.groupBy("doc_type").agg(
        F.count("*").alias("count"), _count_if(F.col("is_critical")).alias("critical"))
    whole = counts.agg(F.greatest(F.sum("count"), F.lit(1)).alias("t")).scalar()
    return counts.select(
        "doc_type", "count",
        rounded(F.col("count") / whole * 100, 1).alias("share_pct"),
        rounded(F.col("critical") / F.col("count") * 100, 1).alias("critical_pct"))


def import_summary(log: DataFrame) -> DataFrame:
    """Status counts and throughput per run and aircraft."""
    def count(status: str) -> Column:
        return _count_if(F.col("status") == status)

    seconds = exact_sum("duration_s")
    return log.groupBy("run", "aircraft").agg(
        F.count("*").alias("found"), count("imported").alias("imported"),
        count("duplicate").alias("duplicates"), count("error").alias("errors"),
        rounded(seconds, 1).alias("elapsed_s"),
        F.coalesce(
            rounded(F.try_divide(count("imported").cast("double"), seconds), 2),
            F.lit(0.0)).alias("throughput"))


def label_counts(rows: DataFrame, label: str = "doc_type", at_least: int = 1) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("count")).filter(F.col("count") >= at_least)


def _stacked(frame: DataFrame, fields: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """One row per field out of one row of ``field_suffix`` totals."""
    return frame.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), *[
            F.col(f"{f}__{s}").alias(s) for s in suffixes])
        for f in fields])).alias("r")).select("r.*")


def entity_fill_report(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Filled and empty counts per field, in one pass over the rows."""
    filled = {f: F.coalesce(F.col(f).cast("string") != "", F.lit(False)) for f in fields}
    totals = docs.agg(
        *[_count_if(t).alias(f"{f}__filled") for f, t in filled.items()],
        *[_count_if(~t).alias(f"{f}__empty") for f, t in filled.items()])
    return _stacked(totals, fields, ["filled", "empty"])


def entity_fill_per_document(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    filled = F.lit(0)
    for f in fields:
        filled = filled + F.coalesce(
            F.col(f).cast("string") != "", F.lit(False)).cast("int")
    return docs.select("id", filled.alias("filled"), (len(fields) - filled).alias("empty"))


def validation_report(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Valid, suspect and empty values per field."""
    checks = {f: format_valid(f, f) for f in fields}
    totals = docs.agg(
        *[_count_if(F.coalesce(c, F.lit(False))).alias(f"{f}__valid")
          for f, c in checks.items()],
        *[_count_if(F.coalesce(~c, F.lit(False))).alias(f"{f}__suspect")
          for f, c in checks.items()],
        *[_count_if(c.isNull()).alias(f"{f}__empty") for f, c in checks.items()])
    return _stacked(totals, fields, ["valid", "suspect", "empty"])


def fleet_msn_report(aircraft: DataFrame, docs: DataFrame) -> DataFrame:
    counts = docs.filter(F.col("aircraft_registration").isNotNull()).groupBy(
        F.col("aircraft_registration").alias("registration")).agg(
        F.count("*").alias("n"))
    msn = F.coalesce(F.nullif(F.col("msn"), F.lit("")), F.lit("MANQUANT"))
    return aircraft.join(counts, "registration", "left").select(
        "registration", msn.alias("msn"),
        F.coalesce("n", F.lit(0)).alias("documents"))


def uploads_by_day(docs: DataFrame) -> DataFrame:
    day = F.coalesce("created_at", "archived_at").cast("date")
    return docs.groupBy(day.alias("day")).agg(F.count("*").alias("uploads"))


def relabel_impact(docs: DataFrame) -> DataFrame:
    """How many rows each planned relabelling rule would touch."""
    name = F.col("filename")
    ead, adsb, sb = name.ilike("%EAD%"), name.ilike("%ADSB%"), name.ilike("%SB%")
    specs = docs.filter(
        F.col("category").isin("Check A", "Check C", "Check D")
        & (labels.normalise_doc_type("doc_type") == "Specs"))
    return specs.agg(
        _count_if(ead).alias("ead_to_ad"), _count_if(adsb).alias("adsb_to_sb"),
        _count_if(sb & ~adsb & ~ead).alias("sb_to_sb"))


def low_confidence_counts(docs: DataFrame) -> DataFrame:
    """Documents per type and per aircraft, with the low ones."""
    low = F.coalesce("ocr_confidence", F.lit(0.0)) < fv.REVIEW_OCR_BELOW
    cells = docs.groupBy(
        F.col("doc_type").alias("t"),
        F.coalesce("aircraft_registration", F.lit("INCONNU")).alias("a")).agg(
        F.count("*").alias("n"), _count_if(low).alias("low"))
    def level(name: str, key: str) -> DataFrame:
        return cells.groupBy(F.col(key).alias("key")).agg(
            F.sum("n").alias("documents"), F.sum("low").alias("low"),
        ).select(F.lit(name).alias("level"), "key", "documents", "low")

    return level("type", "t").unionByName(level("aircraft", "a"))


def low_confidence_rows(docs: DataFrame, limit: int = 20) -> DataFrame:
    return docs.filter(
        F.coalesce("ocr_confidence", F.lit(0.0)) < fv.REVIEW_OCR_BELOW).orderBy(
        "id").limit(limit).select("id", "ocr_confidence", "doc_type", "filename")


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per named frame, as a consistency report."""
    counts = [
        f.agg(F.count("*").alias("rows")).select(F.lit(name).alias("view"), "rows")
        for name, f in frames.items()]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def normalised_reference_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(normalise_es("es_reference").alias("reference")).agg(
        F.count("*").alias("count"))
