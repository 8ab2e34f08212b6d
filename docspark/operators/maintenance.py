"""Set-based corrections of the catalogue.

Each operator is a pure function of the old table. It returns the new rows or
a change report (id, field, old, new, rule); the report alone is a dry run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions import labels
from docspark.functions.basics import contains_any
from docspark.functions.registration import any_msn, registration_from_msn
from docspark.operators.joins import linked_categories, linked_references
from docspark.operators.scale import majority_value
from docspark.session import stored


def change_report(
    frame: DataFrame, field: str, old: Column, new: Column, rule: Column
) -> DataFrame:
    return frame.filter(~old.eqNullSafe(new)).select(
        "id", F.lit(field).alias("field"), old.cast("string").alias("old"),
        new.cast("string").alias("new"), rule.alias("rule"))


def _last(value: str, sequence: str | None) -> Column:
    """The value given last; without a sequence the greatest one."""
    if sequence is None:
        return F.max(value)
    given = F.struct(F.col(sequence).alias("s"), F.col(value).alias("v"))
    return F.max(F.when(F.col(value).isNotNull(), given))["v"]


def apply_patches(
    docs: DataFrame, patches: DataFrame, fields: Sequence[str],
    sequence: str | None = None,
) -> DataFrame:
    """Partial updates by id: only given (non-null) fields change, and a
    patched row counts as manually corrected. Of several patches of a field
    the last in ``sequence`` counts, without one the greatest value."""
    marked = patches.groupBy("id").agg(
        *[_last(f, sequence).alias(f"_p_{f}") for f in fields],
        F.lit(True).alias("_patched"))
    joined = docs.join(marked, "id", "left")
    changed = {f: F.coalesce(f"_p_{f}", f) for f in fields}
    changed["manually_corrected"] = F.coalesce("_patched", "manually_corrected")
    return joined.select(*[
        changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def resolve_alerts(alerts: DataFrame, resolved: DataFrame, at: Column) -> DataFrame:
    """Mark alerts as resolved; those already resolved keep their state."""
    marked = resolved.select("id", F.lit(True).alias("_r")).distinct()
    hit = F.col("_r").isNotNull()
    return alerts.join(marked, "id", "left").select(
        *[c for c in alerts.columns if c != "resolved"],
        (F.col("resolved") | hit).alias("resolved"),
        F.when(hit, at).alias("resolved_at"))


def relabel_check_specs(docs: DataFrame) -> DataFrame:
    """Specs in check folders: EAD files become AD, then ADSB and SB files
    become SB. An earlier rule takes a row out of reach of the later ones."""
    name = F.col("filename")
    specs = (labels.normalise_doc_type("doc_type") == "Specs") & F.col("category").isin(
        "Check A", "Check C", "Check D")
    new = (
        F.when(specs & name.ilike("%EAD%"), "AD")
        .when(specs & (name.ilike("%ADSB%") | name.ilike("SB%")), "SB"))
    return _relabelled(docs, new, F.lit(None).cast("string"))


def _relabelled(docs: DataFrame, new_type: Column, new_category: Column) -> DataFrame:
    touched = new_type.isNotNull()
    changed = {
        "doc_type": F.coalesce(new_type, "doc_type"),
        "category": F.when(touched, F.coalesce(new_category, "category")).otherwise(
            F.col("category")),
        "manually_corrected": touched | F.col("manually_corrected")}
    return docs.select(*[
        changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def relabel_false_ads(docs: DataFrame) -> DataFrame:
    """Doubtful directives by phrases in their name: certificate, then specs,
    else left for a person (``decision``)."""
    name = F.upper("filename")
    doubtful = (labels.normalise_doc_type("doc_type") == "AD") & (
        F.col("classifier_confidence") < fv.FALSE_AD_BELOW)
    certificate = contains_any(name, [p.upper() for p in fv.CERTIFICATE_PHRASES])
    specs = contains_any(name, [p.upper() for p in fv.SPECS_PHRASES])
    new = F.when(doubtful & certificate, "Certificate").when(doubtful & specs, "Specs")
    category = F.when(certificate, "Certificates").otherwise("Specs")
    decision = (
        F.when(~doubtful, "untouched").when(certificate, "certificate")
        .when(specs, "specs").otherwise("manual"))
    return _relabelled(docs.withColumn("decision", decision), new, category)


def fix_registrations(docs: DataFrame, fixes: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace a misread registration when the path confirms the right one."""
    new = F.lit(None).cast("string")
    for wrong, right in reversed(list(fixes)):
        new = F.when(
            (F.col("aircraft_registration") == wrong)
            & F.contains(F.upper("rel_path"), F.lit(right)), right).otherwise(new)
    return change_report(
        docs.withColumn("_new", F.coalesce(new, "aircraft_registration")),
        "aircraft_registration", F.col("aircraft_registration"), F.col("_new"),
        F.lit("path_confirms"))


def relabel_by_pattern(docs: DataFrame) -> DataFrame:
    """Engine files and dent-and-buckle charts by file name."""
    name = F.col("filename")
    chart = F.lit(False)
    for pattern in fv.DENT_CHART_ILIKE:
        chart = chart | name.ilike(pattern)
    engine = name.like(fv.ENGINE_FILE_LIKE)
    new = F.when(chart, "D&B Chart").when(engine, "Specs")
    return _relabelled(
        docs, new, F.when(chart, "Structural_Repair").otherwise("Engine File"))


def reassign_registration(
    docs: DataFrame, aircraft: DataFrame, wrong: str, right: str
) -> DataFrame:
    """Move all documents of one registration to another aircraft, provided
    that aircraft exists."""
    target = aircraft.filter(F.col("registration") == right).agg(
        F.min("id").alias("id")).scalar()
    hit = (F.col("aircraft_registration") == wrong) & target.isNotNull()
    changed = {
        "aircraft_registration": F.when(hit, right).otherwise(
            F.col("aircraft_registration")),
        "aircraft_id": F.when(hit, target).otherwise(F.col("aircraft_id"))}
    return docs.select(*[
        changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def autodetect_msn(
    aircraft: DataFrame, docs: DataFrame, known: dict[str, str]
) -> DataFrame:
    """Serial number for aircraft without one: the most frequent number in
    their documents, unless it contradicts a known one."""
    missing = aircraft.filter(
        F.col("msn").isNull() | (F.col("msn") == "")).select("registration")
    found = docs.select(
        F.col("aircraft_registration").alias("registration"),
        any_msn("extracted_entities", "ocr_text").alias("msn")).filter(
        F.col("msn").isNotNull())
    votes = majority_value(
        found.join(missing, "registration", "left_semi"), ["registration"], "msn")
    expected = F.lit(None).cast("string")
    for registration, number in known.items():
        expected = F.when(
            F.col("registration") == registration, number).otherwise(expected)
    return missing.join(votes, "registration", "left").select(
        "registration", F.col("msn").alias("detected_msn"), "votes",
        F.when(F.col("msn").isNull(), "none")
        .when(expected != F.col("msn"), "conflict").otherwise("updated").alias("result"))


def re_extract_registration(docs: DataFrame, topic: str = "immatriculation") -> DataFrame:
    """New registration for rows waiting on that topic; a found one clears
    the warnings and the review flag."""
    waiting = docs.filter(
        F.col("needs_review") & F.contains("validation_warnings", F.lit(topic)))
    text = F.concat(
        F.coalesce("ocr_text", F.lit("")), F.lit(" "), F.coalesce("rel_path", F.lit("")))
    found = waiting.withColumn("_t", text).withColumn(
        "_r", registration_from_msn("_t", "filename"))
    hit = F.col("_r.registration").isNotNull()
    return found.select(
        "id", F.coalesce("_r.registration", "aircraft_registration").alias(
            "aircraft_registration"),
        F.col("_r.method").alias("method"), (~hit).alias("needs_review"),
        F.when(hit, "[]").otherwise(F.col("validation_warnings")).alias(
            "validation_warnings"))


def linked_wp_repair(docs: DataFrame) -> DataFrame:
    """State of every archived Work Order that names a linked package: FIX
    (category changes), OK, or SKIP (nothing found)."""
    orders = docs.filter(
        (labels.normalise_doc_type("doc_type") == "Work Order")
        & (F.col("status") == "ARCHIVED") & F.col("ocr_text").ilike("%linked%wp%"))
    refs = stored(linked_references(orders).filter(F.col("number") != ""), "linked")
    hits = linked_categories(refs.select("number").distinct(), docs)
    chosen = refs.join(hits, "number").groupBy("id").agg(
        F.min_by("linked_category", "pos").alias("new_category"))
    state = (
        F.when(F.col("new_category").isNull(), "SKIP")
        .when(F.col("new_category") == F.col("category"), "OK").otherwise("FIX"))
    return orders.select("id", "category").join(chosen, "id", "left").select(
        "id", F.col("category").alias("old_category"), "new_category",
        state.alias("state"))


def generate_alerts(docs: DataFrame) -> DataFrame:
    """Low-confidence alerts, and warnings for documents without registration
    whose source file is missing."""
    low = docs.filter(
        (F.col("ocr_confidence") > 0)
        & (F.col("ocr_confidence") < fv.LOW_OCR_ALERT_BELOW)).select(
        F.col("id").alias("document_id"), "aircraft_registration",
        F.concat(F.lit("OCR faible confiance — "), "filename").alias("title"),
        F.concat(
            F.lit("Confiance OCR: "), F.format_string("%.1f", "ocr_confidence"),
            F.lit("%. Vérification manuelle recommandée.")).alias("message"),
        F.lit("warning").alias("severity"),
        F.lit("ocr_low_confidence").alias("alert_type"))
    lost = docs.filter(
        F.col("aircraft_registration").isNull() & ~F.col("file_present")).select(
        F.col("id").alias("document_id"), "aircraft_registration",
        F.concat(F.lit("Document sans immatriculation — "), "filename").alias("title"),
        F.concat(
            F.lit("'"), "filename",
            F.lit("' n'a pas d'immatriculation reconnue. Placé dans En_Attente/. "
                  "Vérification manuelle requise.")).alias("message"),
        F.lit("warning").alias("severity"),
        F.lit("ocr_low_confidence").alias("alert_type"))
    return low.unionByName(lost)


def purge_fleet(
    aircraft: DataFrame, keep: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """The fleet reduced to the kept aircraft, with their right data."""
    spark = aircraft.sparkSession
    wanted = spark.createDataFrame(list(keep), "registration string, model string, msn string")
    return aircraft.select("registration", F.lit(True).alias("_known")).join(
        wanted, "registration", "right").select(
        "registration", "model", "msn",
        F.col("_known").isNull().alias("inserted"))


def purge_report(
    before: dict[str, DataFrame], after: dict[str, DataFrame]
) -> DataFrame:
    report = None
    for phase, frames in (("before", before), ("after", after)):
        for name, frame in frames.items():
            row = frame.agg(F.count("*").alias("rows")).select(
                F.lit(phase).alias("phase"), F.lit(name).alias("table"), "rows")
            report = row if report is None else report.unionByName(row)
    return report


def patch_aircraft(
    aircraft: DataFrame, patches: DataFrame, sequence: str | None = None
) -> DataFrame:
    """Whitelisted fields only; '' clears a field, a bad date becomes null.

    ``patches`` has rows (id, field, value); of several for one field the
    last in ``sequence`` counts, without one the greatest value.
    """
    allowed = patches.filter(F.col("field").isin(fv.PATCHABLE_AIRCRAFT_FIELDS)).groupBy(
        "id", "field").agg(_last("value", sequence).alias("value"))
    per_row = allowed.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_p"))
    joined = aircraft.join(per_row, "id", "left")

    def value(column: str) -> Column:
        given = F.coalesce(F.map_contains_key("_p", F.lit(column)), F.lit(False))
        new = F.nullif(F.element_at("_p", column), F.lit(""))
        if column == "delivery_date":
            return F.when(given, F.try_to_date(new, "yyyy-MM-dd")).otherwise(F.col(column))
        return F.when(given, new).otherwise(F.col(column))

    return joined.select(*[
        value(c).alias(c) if c in fv.PATCHABLE_AIRCRAFT_FIELDS else F.col(c)
        for c in aircraft.columns])
