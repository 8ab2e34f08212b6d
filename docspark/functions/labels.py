"""Labels, flags and bands derived from catalogue columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import blank_to_null, col, extract, lookup, strip


def type_key(doc_type: str | Column) -> Column:
    """``Work Order`` / ``work-order`` / ``WORK_ORDER`` -> ``WORK_ORDER``."""
    return F.regexp_replace(F.upper(strip(doc_type)), r"[ \-]", "_")


def normalise_doc_type(doc_type: str | Column) -> Column:
    """Display value of a type name; unknown labels stay as they are."""
    return F.coalesce(
        lookup(type_key(doc_type), fv.TYPE_NAME_TO_VALUE), col(doc_type))


def check_letter(check_type: str | Column) -> Column:
    u = F.upper(strip(check_type))
    last = F.right(u, F.lit(1))
    return F.coalesce(
        extract(u, r"_([ACD])$"),
        blank_to_null(F.concat(
            F.regexp_extract(u, r"CHECK\s*([ACD])|([ACD])\s*CHECK", 1),
            F.regexp_extract(u, r"CHECK\s*([ACD])|([ACD])\s*CHECK", 2))),
        F.when(last.isin("A", "C", "D"), last),
    )


def inferred_check_type(category: str | Column) -> Column:
    """Check type named by a category; anything else counts as Check A."""
    letter = extract(F.upper(col(category)), r"CHECK[ _\-]?([ACD])$")
    return F.concat(F.lit("Check "), F.coalesce(letter, F.lit("A")))


def needs_review(ocr: str | Column, classifier: str | Column) -> Column:
    return (col(ocr) < fv.REVIEW_OCR_BELOW) | (
        col(classifier) < fv.REVIEW_CLASSIFIER_BELOW)


def is_critical(doc_type: str | Column, classifier: str | Column) -> Column:
    return (normalise_doc_type(doc_type) == "AD") & (
        col(classifier) > fv.CRITICAL_AD_ABOVE)


def reprocess_flag(new_confidence: str | Column) -> Column:
    c = col(new_confidence)
    return (c > 0) & (c < fv.LOW_OCR_ALERT_BELOW)


def run_review(confidence: str | Column, text: str | Column) -> Column:
    return (col(confidence) < fv.OCR_RUN_REVIEW_BELOW) | (
        F.length(strip(F.coalesce(col(text), F.lit("")))) == 0)


def quality_action(confidence: str | Column) -> Column:
    c = col(confidence)
    return (
        F.when(c.isNull() | (c == 0), "—")
        .when(c >= 85, "Archive fiable")
        .when(c >= 70, "Acceptable")
        .otherwise("Retraitement recommandé"))


def age_label(moment: str | Column, as_of: Column) -> Column:
    """Age in words; older than a week gives the date."""
    m = col(moment)
    seconds = F.timestamp_diff("SECOND", m, as_of).cast("double")
    return (
        F.when(m.isNull(), "—")
        .when(seconds < 60, "À l'instant")
        .when(seconds < 3600, F.format_string(
            "Il y a %d min", F.round(seconds / 60).cast("int")))
        .when(seconds < 86400, F.format_string(
            "Il y a %d h", F.round(seconds / 3600).cast("int")))
        .when(seconds < 604800, F.format_string(
            "Il y a %d j", F.round(seconds / 86400).cast("int")))
        .otherwise(F.date_format(m, "dd/MM/yyyy")))


def resolution_label(resolved: str | Column) -> Column:
    return F.when(col(resolved), "Résolu").otherwise("Actif")


def quality_band(confidence: str | Column) -> Column:
    """Five dashboard bands; missing and zero share the last one."""
    c = col(confidence)
    return (
        F.when(c >= 90, "90-100% — Excellent")
        .when(c >= 70, "70-90% — Bon")
        .when(c >= 50, "50-70% — Moyen")
        .when(c > 0, "0-50% — Faible")
        .otherwise("Non traité"))


def distribution_band(confidence: str | Column) -> Column:
    c = col(confidence)
    return (
        F.when(c >= 90, "90-100%").when(c >= 75, "75-89%")
        .when(c >= 50, "50-74%").when(c >= 25, "25-49%")
        .when(c > 0, "1-24%").otherwise("0%"))


def reprocess_band(confidence: str | Column) -> Column:
    c = F.coalesce(col(confidence), F.lit(0.0))
    return (
        F.when(c == 0, "0%").when(c < 25, "1-24%").when(c < 50, "25-49%")
        .when(c < 75, "50-74%").otherwise("75-99%"))


def confidence_bin(confidence: str | Column) -> Column:
    """Six right-closed bins, the lowest edge included; null counts as 0."""
    c = F.coalesce(col(confidence), F.lit(0.0))
    return (
        F.when((c >= 0) & (c <= 30), "0-30%").when((c > 30) & (c <= 50), "30-50%")
        .when((c > 50) & (c <= 70), "50-70%").when((c > 70) & (c <= 85), "70-85%")
        .when((c > 85) & (c <= 95), "85-95%").when((c > 95) & (c <= 100), "95-100%"))


def filename_type_conflict(filename: str | Column, doc_type: str | Column) -> Column:
    name = F.upper(col(filename))
    return col(doc_type).isin("AD", "SB") & (
        name.contains("ES0") | name.contains("ES1") | name.contains("ES2")
        | name.contains("WO-"))


def arbitration_reasons(
    filename: str | Column,
    doc_type: str | Column,
    confidence: str | Column,
    entity_type: str | Column,
) -> Column:
    """Reasons why a label needs a second opinion; empty when it does not."""
    reasons = F.array(
        F.when(col(confidence) < fv.ARBITRATION_BELOW, "low_confidence"),
        F.when(
            (F.length(col(entity_type)) > 0) & (col(entity_type) != col(doc_type)),
            "entity_conflict"),
        F.when(filename_type_conflict(filename, doc_type), "filename_conflict"),
    )
    return F.array_compact(reasons)


def blank_or_zero_to_null(value: str | Column) -> Column:
    return F.nullif(col(value), F.lit(0.0))
