"""Joins between documents, aircraft, checks, files and hits.

Dimensions carry no broadcast hint: Spark broadcasts a side when its measured
size is below the threshold and shuffles it otherwise. "Contains" matches are
equi joins on substrings of the distinct references.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions import labels
from docspark.functions.basics import extract
from docspark.functions.entities import linked_wp_refs, normalise_es, rct_anchor
from docspark.functions.paths import file_name, strip_long_path_prefix
from docspark.operators.scale import best_per_key, contains_aggregate, majority_value
from docspark.session import stored


def document_facts(
    docs: DataFrame, aircraft: DataFrame, checks: DataFrame
) -> DataFrame:
    """One row per document with date parts, aircraft and check."""
    fleet = aircraft.select(F.col("id").alias("aircraft_id"), "model", "msn")
    visits = checks.select(
        F.col("id").alias("check_id"), F.col("es_reference").alias("check_es"),
        "check_type")
    at = F.col("archived_at")
    return docs.join(fleet, "aircraft_id", "left").join(
        visits, "check_id", "left").select(
        "id", "filename", "doc_type", "category", "ata_chapter", "status",
        "aircraft_registration", "es_reference", "item_number", "part_number",
        "serial_number", "ocr_confidence", "ocr_engine", "classifier_confidence",
        "file_size_kb", "is_critical", "needs_review", *date_parts(at),
        "model", "msn", "check_es", "check_type")


def date_parts(at: Column) -> list[Column]:
    return [
        at.cast("date").alias("archive_date"),
        F.date_trunc("month", at).cast("date").alias("archive_month"),
        F.date_trunc("week", at).cast("date").alias("archive_week"),
        F.year(at).alias("year"), F.month(at).alias("month")]


def document_summary(
    docs: DataFrame, aircraft: DataFrame, checks: DataFrame
) -> DataFrame:
    fleet = aircraft.select(
        F.col("id").alias("aircraft_id"), F.col("model").alias("aircraft_model"),
        F.col("msn").alias("aircraft_msn"))
    visits = checks.select(F.col("id").alias("check_id"), "check_type")
    return docs.join(fleet, "aircraft_id", "left").join(
        visits, "check_id", "left").select(
        "id", "filename", "doc_type", "category", "aircraft_registration",
        "es_reference", "ata_chapter", "ocr_confidence", "classifier_confidence",
        "status", "is_critical", "created_at", "aircraft_model", "aircraft_msn",
        "check_type")


def aircraft_with_counts(aircraft: DataFrame, docs: DataFrame) -> DataFrame:
    """Every aircraft with its documents, matched on the registration
    without regard to case."""
    key = F.upper("aircraft_registration")
    counts = docs.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(
        F.count("*").alias("doc_count"))
    return aircraft.withColumn("_key", F.upper("registration")).join(
        counts, "_key", "left").select(
        "id", "registration", "model", "msn",
        F.coalesce("aircraft_type", F.lit("CEO")).alias("aircraft_type"), "lessor",
        F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def check_document_counts(
    checks: DataFrame, aircraft: DataFrame, docs: DataFrame
) -> DataFrame:
    """Documents of a check: same aircraft, and the check's number is part of
    the document reference. Checks without documents are dropped."""
    fleet = aircraft.select(
        F.col("id").alias("aircraft_id"),
        F.upper("registration").alias("registration"))
    visits = checks.join(fleet, "aircraft_id").withColumn(
        "number", F.regexp_replace(F.upper("es_reference"), "^ES", "")).filter(
        F.col("number") != "")
    references = docs.groupBy(
        F.upper("aircraft_registration").alias("registration"),
        F.upper("es_reference").alias("reference")).agg(F.count("*").alias("n")).filter(
        F.col("registration").isNotNull() & F.col("reference").isNotNull())
    totals = contains_aggregate(
        references, "reference", visits.select("registration", "number"), "number",
        [F.sum("n").alias("documents")], equal=["registration"])
    return visits.join(totals, ["registration", "number"]).select(
        "id", "registration", "es_reference", "check_type", "start_date", "documents")


def _number_from(reference: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(reference)), "^ES", "")


def resolve_aircraft(unknown: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Registration for documents without one: the most frequent one among
    catalogue documents whose reference contains the document's number, or,
    failing that, the number in its file name."""
    wanted = unknown.select(
        "id", _number_from(F.col("es_reference")).alias("own"),
        _number_from(extract(F.upper("filename"), r"(ES\d{4,8})")).alias("named"))
    asked = stored(wanted, "unknown-aircraft")
    numbers = asked.select(F.explode(F.array("own", "named")).alias("number")).filter(
        F.col("number") != "").distinct()
    known = catalogue.filter(F.col("aircraft_registration") != "").groupBy(
        F.upper("es_reference").alias("reference"), "aircraft_registration").agg(
        F.count("*").alias("n")).filter(F.col("reference").isNotNull())
    counted = contains_aggregate(
        known, "reference", numbers, "number", [F.sum("n").alias("n")], by=["aircraft_registration"])
    votes = stored(majority_value(
        counted, ["number"], "aircraft_registration", F.col("n")), "votes")

    def elected(place: str, tag: str) -> DataFrame:
        """Votes for the numbers in one column; rows without one stay out of
        the join, so they are no key of it."""
        return asked.filter(F.col(place) != "").join(
            votes.withColumnRenamed("number", place), place).select(
            F.col("id").alias(f"_{tag}"), F.col("aircraft_registration").alias(f"r_{tag}"),
            F.col("votes").alias(f"v_{tag}"))

    # Ids are unique: each join adds at most one row to a document.
    own, named = elected("own", "own"), elected("named", "named")
    return asked.select("id").join(own, F.col("id") == F.col("_own"), "left").join(
        named, F.col("id") == F.col("_named"), "left").select(
        "id", F.coalesce("r_own", "r_named").alias("aircraft_registration"),
        F.coalesce("v_own", "v_named").alias("votes"),
        F.when(F.col("r_own").isNotNull(), "reference")
        .when(F.col("r_named").isNotNull(), "filename").alias("method"))


def linked_references(docs: DataFrame, text: str = "ocr_text") -> DataFrame:
    """(id, pos, reference, number) per linked package named in the text."""
    refs = docs.select("id", F.posexplode(linked_wp_refs(text)).alias("pos", "reference"))
    return refs.withColumn("number", normalise_es("reference"))


def work_order_categories(catalogue: DataFrame) -> DataFrame:
    """Per reference of a Work Order with a check category: that category
    (lowest id decides)."""
    rows = catalogue.filter(
        (labels.normalise_doc_type("doc_type") == "Work Order")
        & F.col("category").isin(fv.CHECK_CATEGORIES)
        & F.col("es_reference").isNotNull())
    return rows.groupBy(F.upper("es_reference").alias("reference")).agg(
        F.min("id").alias("source_id"),
        F.min_by("category", "id").alias("linked_category"))


def linked_categories(numbers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(number, linked_category): of the Work Orders whose reference contains
    the number, the one with the lowest id decides."""
    orders = stored(work_order_categories(catalogue), "work-orders")
    least = contains_aggregate(
        orders, "reference", numbers, "number", [F.min("source_id").alias("source_id")])
    return least.join(orders.select("source_id", "linked_category"), "source_id").select(
        "number", "linked_category")


def resolve_linked_wp(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Category of the first linked package found in the catalogue."""
    refs = stored(linked_references(docs).filter(F.col("number") != "").select(
        "id", "pos", F.col("reference").alias("linked_ref"), "number"), "linked")
    hits = linked_categories(refs.select("number").distinct(), catalogue)
    return refs.join(hits, "number").groupBy("id").agg(
        F.min_by("linked_category", "pos").alias("linked_category"),
        F.min_by("linked_ref", "pos").alias("linked_ref"))


def rct_rows(docs: DataFrame) -> DataFrame:
    """Latest complete release record per work package."""
    found = docs.filter(labels.normalise_doc_type("doc_type") == "RCT").select(
        "id", "filename", "aircraft_registration",
        rct_anchor("ocr_text", "filename").alias("a"))
    rows = found.select(
        "id", "filename",
        F.upper("aircraft_registration").alias("registration"),
        F.col("a.linked_wp").alias("es_reference"),
        F.element_at(
            F.create_map(*[
                F.lit(x) for kv in fv.CHECK_TYPE_NAMES.items() for x in kv]),
            F.col("a.check_type")).alias("check_type")).dropna(
        subset=["registration", "es_reference", "check_type"])
    return best_per_key(
        rows, ["es_reference"], [-F.col("id")],
        ["id", "filename", "registration", "check_type"])


def rct_confirmed_checks(
    checks: DataFrame, aircraft: DataFrame, docs: DataFrame
) -> DataFrame:
    """Checks after release records confirmed or created them."""
    fleet = aircraft.select(
        F.col("id").alias("rct_aircraft_id"), F.upper("registration").alias("registration"))
    anchors = rct_rows(docs).join(fleet, "registration").select(
        "es_reference", F.col("id").alias("rct_document_id"),
        F.col("check_type").alias("rct_type"), "rct_aircraft_id")
    old = checks.select(
        F.upper("es_reference").alias("es_reference"), "id", "check_type", "aircraft_id")
    return old.join(anchors, "es_reference", "full").select(
        "es_reference", "id",
        F.coalesce("rct_type", "check_type").alias("check_type"),
        F.coalesce("rct_aircraft_id", "aircraft_id").alias("aircraft_id"),
        F.col("rct_document_id").isNotNull().alias("confirmed_by_rct"),
        "rct_document_id")


def rct_backfill(docs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Documents whose category changes because a release record confirmed
    their check; the record itself stays as it is."""
    anchors = confirmed.filter("confirmed_by_rct").select(
        "es_reference", "rct_document_id", F.col("check_type").alias("new_category"))
    rows = docs.select("id", "es_reference", F.col("category").alias("old_category"))
    changed = ~F.col("old_category").eqNullSafe(F.col("new_category"))
    return rows.join(anchors, "es_reference").filter(
        (F.col("id") != F.col("rct_document_id")) & changed).select(
        "id", "es_reference", "old_category", "new_category")


def incremental_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files known neither by path (with or without the long-path prefix) nor
    by content hash."""
    paths = known.select(
        strip_long_path_prefix("path").alias("_path")).dropna().distinct()
    hashes = known.select("sha256_hash").dropna().distinct()
    return files.withColumn("_path", strip_long_path_prefix("path")).join(
        paths, "_path", "left_anti").join(
        hashes, "sha256_hash", "left_anti").drop("_path")


def load_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    return docs.join(hits.select("id"), "id", "left_semi")


def repair_paths(missing: DataFrame, disk: DataFrame) -> DataFrame:
    """New path for documents whose file is gone: same name, else same
    reference; the most recent file wins."""
    def candidates(key: Column, prefix: str) -> DataFrame:
        return disk.select(key.alias("_k"), "path", "mtime").dropna(
            subset=["_k"]).groupBy("_k").agg(
            F.count("*").alias(f"{prefix}_n"),
            F.max(F.struct("mtime", "path")).getField("path").alias(f"{prefix}_path"))

    es = r"(ES\d{4,8})"
    name = file_name("path")
    by_name = candidates(F.lower(name), "name").withColumnRenamed("_k", "_name")
    by_es = candidates(extract(F.upper(name), es), "es").withColumnRenamed("_k", "_es")
    rows = missing.withColumns({
        "_name": F.lower("filename"), "_es": extract(F.upper("filename"), es)})
    matched = rows.join(by_name, "_name", "left").join(by_es, "_es", "left")
    return matched.select(
        "id", "filename", F.coalesce("name_path", "es_path").alias("new_path"),
        F.when(F.coalesce("name_n", "es_n") > 1, "multiple")
        .when(F.coalesce("name_n", "es_n") == 1, "updated")
        .otherwise("not_found").alias("result"))


def merge_scores(text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    return text_hits.select("id", "fts_score").join(
        vector_hits.select("id", "sem_score"), "id", "full").select(
        "id", F.coalesce("fts_score", F.lit(0.0)).alias("fts_score"),
        F.coalesce("sem_score", F.lit(0.0)).alias("sem_score"))


def aircraft_get_or_create(docs: DataFrame, aircraft: DataFrame) -> DataFrame:
    """The aircraft table plus default rows for unknown registrations."""
    known = aircraft.select(F.upper("registration").alias("registration"))
    new = docs.select(F.upper("aircraft_registration").alias("registration")).filter(
        F.col("registration") != "").distinct().join(known, "registration", "left_anti")
    rows = new.select("registration", F.lit(fv.DEFAULT_AIRCRAFT_MODEL).alias("model"))
    return aircraft.select("registration", "model", F.lit(False).alias("created")).unionByName(
        rows.withColumn("created", F.lit(True)))


def check_get_or_create(
    docs: DataFrame, checks: DataFrame, aircraft: DataFrame
) -> DataFrame:
    """Checks plus inferred ones for references of a known aircraft; the
    first document (lowest id) decides type and aircraft."""
    known = checks.select(F.upper("es_reference").alias("es_reference"))
    fleet = aircraft.select(
        F.upper("registration").alias("registration"), F.col("id").alias("aircraft_id"))
    rows = docs.select(
        "id", F.upper("es_reference").alias("es_reference"), "category",
        F.upper("aircraft_registration").alias("registration")).filter(
        F.col("es_reference") != "").join(fleet, "registration")
    first = best_per_key(
        rows.join(known, "es_reference", "left_anti"), ["es_reference"],
        [F.col("id")], ["category", "aircraft_id"])
    created = first.select(
        "es_reference", labels.inferred_check_type("category").alias("check_type"),
        "aircraft_id", F.lit(True).alias("inferred"))
    return checks.select(
        "es_reference", "check_type", "aircraft_id", F.lit(False).alias("inferred"),
    ).unionByName(created)


def delete_documents(
    docs: DataFrame, alerts: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Documents and alerts that remain after a cascading delete."""
    ids = doomed.select("id")
    return (
        docs.join(ids, "id", "left_anti"),
        alerts.join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti"))


def drop_orphan_aircraft(
    aircraft: DataFrame, docs: DataFrame, candidates: Sequence[str]
) -> DataFrame:
    """Remove candidate aircraft that no document refers to any more."""
    used = docs.select(F.col("aircraft_registration").alias("registration")).distinct()
    orphans = aircraft.filter(F.col("registration").isin(list(candidates))).join(
        used, "registration", "left_anti").select("registration")
    return aircraft.join(orphans, "registration", "left_anti")
