"""Entity extraction by ordered pattern cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import (
    blank_to_null, cascade, col, extract, first_match, lookup, only_filled, strip)
from docspark.functions.registration import (
    extract_registration, normalise_registration)


def extract_field(upper: str | Column, field: str) -> Column:
    """One entity field from upper-cased text: first pattern that matches."""
    value = first_match(upper, fv.ENTITY_PATTERNS[field])
    return only_filled(strip(value)) if field == "effectivity" else value


def parse_document_date(value: str | Column) -> Column:
    """Date of a day-first or ISO spelling; null when it is not a date."""
    iso = F.translate(col(value), "/", "-")
    return F.coalesce(
        F.try_to_date(iso, "yyyy-M-d"),
        F.when(iso.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(iso, "d-M-yyyy")),
        F.when(iso.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), F.try_to_date(iso, "d-M-yy")),
    )


def ata_number(ata: str | Column) -> Column:
    """Two-digit chapter out of ``27-10``, ``ATA 27`` or ``27``."""
    return extract(ata, r"(\d{2})")


def ata_description(ata: str | Column) -> Column:
    return lookup(ata_number(ata), fv.ATA_DESCRIPTIONS)


def rct_anchor(
    text: str | Column, filename: str | Column, upper: Column | None = None
) -> Column:
    """Struct (registration, check_type, linked_wp) of a release record."""
    name = F.upper(col(filename))
    body = F.upper(col(text)) if upper is None else upper
    raw = extract(name, fv.RCT_FILENAME, 1)
    letter = F.coalesce(
        extract(name, fv.RCT_FILENAME, 2),
        first_match(body, fv.RCT_CHECK_PATTERNS))
    return F.struct(
        F.coalesce(normalise_registration(raw), raw).alias("registration"),
        F.concat(F.lit("CHECK_"), letter).alias("check_type"),
        F.coalesce(
            extract(name, fv.RCT_FILENAME, 3),
            first_match(body, fv.RCT_WP_PATTERNS)).alias("linked_wp"),
    )


ENTITY_FIELDS = [
    "aircraft_registration", *fv.ENTITY_PATTERNS, "ata_description",
    "linked_wp", "check_type",
]


def with_entities(
    frame: DataFrame, text: str = "ocr_text", filename: str = "filename",
    prefix: str = "",
) -> DataFrame:
    """Add every entity field, completed from the file name.

    The upper-cased text and the raw fields are columns of their own stages,
    so no row upper-cases its text twice and the generated code stays small.
    """
    upper = F.col("_upper")
    name = F.upper(F.col(filename))
    stage = frame.withColumn("_upper", F.upper(F.col(text)))
    stage = stage.withColumns({
        "_reg": extract_registration(text, filename, upper),
        "_rct": rct_anchor(text, filename, upper),
        **{f"_f_{f}": extract_field(upper, f) for f in fv.ENTITY_PATTERNS},
    })
    field = {f: F.col(f"_f_{f}") for f in fv.ENTITY_PATTERNS}
    field["es_reference"] = F.coalesce(
        field["es_reference"], extract(name, fv.FILENAME_ES))
    field["item_number"] = F.coalesce(
        field["item_number"], extract(name, fv.FILENAME_ITEM))
    field["sb_ad_reference"] = F.coalesce(
        field["sb_ad_reference"], extract(name, fv.FILENAME_SB))
    field["ata_chapter"] = F.coalesce(
        field["ata_chapter"],
        F.concat(F.lit("ATA "), extract(name, fv.FILENAME_ATA)))
    return stage.select(
        *frame.columns,
        F.coalesce("_reg", "_rct.registration").alias(
            prefix + "aircraft_registration"),
        *[expr.alias(prefix + f) for f, expr in field.items()],
        ata_description(field["ata_chapter"]).alias(prefix + "ata_description"),
        F.col("_rct.linked_wp").alias(prefix + "linked_wp"),
        F.col("_rct.check_type").alias(prefix + "check_type"))


def normalise_es(reference: str | Column) -> Column:
    """Number of a reference without prefix and leading zeros; '' stays ''."""
    digits = F.regexp_replace(F.trim(col(reference)), r"(?i)^ES\s*", "")
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(F.length(F.trim(col(reference))) == 0, F.lit("")).otherwise(
        F.coalesce(blank_to_null(bare), F.when(digits.isNotNull(), F.lit("0"))))


def linked_wp_refs(text: str | Column) -> Column:
    """Ordered distinct references named after a linked-package marker."""
    blocks = F.regexp_extract_all(col(text), F.lit(fv.LINKED_WP_BLOCK), F.lit(1))
    inside = F.flatten(F.transform(
        blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?i)(ES\s*\d{4,8})"))))
    loose = F.regexp_extract_all(
        col(text), F.lit(fv.LINKED_WP_FALLBACK), F.lit(1))
    refs = F.when(F.size(inside) > 0, inside).otherwise(loose)
    return F.array_distinct(
        F.transform(refs, lambda r: F.replace(r, F.lit(" "), F.lit(""))))


def profile_entities(text: str | Column, profile: str | Column) -> Column:
    """Map entity name -> all matches, limited to the profile's entities."""
    active = F.lit(None)
    for name, spec in fv.PROFILES.items():
        active = F.when(
            col(profile) == name, F.array(*map(F.lit, spec["entities"]))
        ).otherwise(active)
    active = F.coalesce(
        active, F.array(*map(F.lit, fv.GENERIC_PROFILE_ENTITIES)))
    entries = []
    for name, (pattern, group) in fv.PROFILE_PATTERNS.items():
        # The branch is evaluated per row, so inactive patterns never run.
        found = F.when(
            F.array_contains(active, name),
            F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group)))
        entries.append(F.struct(F.lit(name).alias("key"), found.alias("value")))
    hits = F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0)
    return F.map_from_entries(hits)


def _complete(field: str, value: Column) -> Column:
    if field == "aircraft_registration":
        up = F.upper(strip(value))
        return (
            F.when(up.rlike("^IN[A-Z]$"), F.concat(F.lit("TS-"), up))
            .when(up.rlike("^N[A-Z]$"), F.concat(F.lit("TS-I"), up))
            .otherwise(up))
    if field == "es_reference":
        return F.regexp_replace(F.upper(value), r"\s", "")
    return strip(value)


def _joined(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _value_of(match: Column, patterns: list[str]) -> Column:
    """The captured value of one match: only one alternative's group is set,
    so concatenating the groups yields it."""
    joined = _joined(patterns)
    return F.concat(*[
        F.regexp_extract(match, joined, g + 1) for g in range(len(patterns))])


def compact_entities_first(text: str | Column) -> Column:
    """First occurrence per field of the compact pattern set.

    The text is scanned once per field; the earliest position wins across the
    alternatives, and the groups are read from the short match.
    """
    return F.struct(*[
        cascade(
            F.regexp_extract(col(text), _joined(patterns), 0),
            lambda m, p=patterns, f=field: [_complete(f, only_filled(_value_of(m, p)))],
        ).alias(field)
        for field, patterns in fv.COMPACT_ENTITY_PATTERNS.items()])


def compact_entities_all(text: str | Column) -> Column:
    """Every distinct occurrence per field, in order of the text."""
    def values(patterns: list[str]) -> Column:
        matches = F.regexp_extract_all(
            col(text), F.lit(f"({_joined(patterns)})"), F.lit(0))
        return F.transform(matches, lambda m: strip(_value_of(m, patterns)))

    return F.struct(*[
        F.array_distinct(F.array_remove(values(patterns), "")).alias(field)
        for field, patterns in fv.COMPACT_ENTITY_PATTERNS.items()])


def entity_features(entities: dict[str, Column]) -> list[Column]:
    """Twelve 0/1 features from (possibly missing) entity columns."""
    def present(name: str) -> Column:
        value = entities.get(name, F.lit(None).cast("string"))
        return (F.length(F.coalesce(value, F.lit(""))) > 0).cast("int")

    registration = F.coalesce(
        entities.get("aircraft_registration", F.lit("")), F.lit(""))
    doc_ref = F.upper(F.coalesce(entities.get("doc_ref", F.lit("")), F.lit("")))
    return [
        present("aircraft_registration").alias("has_aircraft_reg"),
        present("es_reference").alias("has_es_ref"),
        present("ata_chapter").alias("has_ata_chapter"),
        present("part_number").alias("has_part_number"),
        present("serial_number").alias("has_serial_number"),
        present("doc_ref").alias("has_doc_ref"),
        present("document_date").alias("has_date"),
        present("airline").alias("has_airline"),
        registration.contains("TS-INP").cast("int").alias("is_ts_inp"),
        registration.contains("TS-INQ").cast("int").alias("is_ts_inq"),
        doc_ref.startswith("AD").cast("int").alias("doc_ref_is_ad"),
        doc_ref.startswith("SB").cast("int").alias("doc_ref_is_sb"),
    ]


def format_valid(value: str | Column, field: str) -> Column:
    """True or false for a filled field, null for an empty one."""
    text = strip(col(value).cast("string"))
    return F.when(
        F.length(col(value).cast("string")) > 0,
        text.rlike(f"^(?:{fv.FORMAT_RULES[field]})$"))


def content_hits(text: str | Column) -> Column:
    total = F.lit(0)
    for pattern in fv.QUICK_PATTERNS:
        total = total + F.coalesce(col(text).rlike(pattern).cast("int"), F.lit(0))
    return total


def content_score(text: str | Column) -> Column:
    return F.least(content_hits(text) * 2.0, F.lit(12.0))


def native_confidence(text: str | Column) -> Column:
    return F.least(F.lit(95.0) + content_score(text), F.lit(99.0))
