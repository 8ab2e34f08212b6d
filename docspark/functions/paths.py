"""Metadata inferred from archive paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import (
    blank_to_null, col, extract, file_stem, file_suffix, first_hit, lookup,
    path_parts, slashes)


def strip_long_path_prefix(path: str | Column) -> Column:
    return F.regexp_replace(F.trim(col(path)), r"^\\\\\?\\", "")


def path_metadata(path: str | Column, filename: str | Column) -> Column:
    """Struct of everything a relative path says about a file."""
    parts = path_parts(path)
    head = F.upper(F.get(parts, F.lit(0)))
    name = F.upper(col(filename))
    in_segment = F.filter(
        F.transform(parts, lambda p: extract(F.upper(p), r"ES(\d{6,8})")),
        lambda r: r.isNotNull())
    subcategory = F.filter(
        F.transform(parts, lambda p: lookup(F.upper(p), fv.SUBCATEGORY_EXACT)),
        lambda s: s.isNotNull())
    return F.struct(
        F.when(head.isin(fv.TREE_REGISTRATIONS), head).alias(
            "aircraft_registration"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("category"),
        F.coalesce(F.get(subcategory, F.lit(0)), F.lit("")).alias("subcategory"),
        F.concat(F.lit("ES"), F.get(in_segment, F.lit(0))).alias("es_reference"),
        extract(name, r"(A3\d{2}-\d{2}[A-Z]?\d{3,5}[A-Z]?)").alias(
            "sb_ad_reference"),
        F.concat(F.lit("ATA "), extract(F.upper(col(path)), r"ATA[\s\-]?(\d{2})"))
        .alias("ata_chapter"),
        extract(name, r"^(\d{3,4})\.PDF$").alias("item_number"),
        F.lower(file_suffix(filename)).alias("extension"),
    )


def discovery_metadata(path: str | Column) -> Column:
    """Struct (registration, category, reference) for an import listing."""
    parts = path_parts(path)
    fleet = F.filter(parts, lambda p: F.upper(p).isin(fv.FLEET_REGISTRATIONS))
    return F.struct(
        F.get(fleet, F.lit(0)).alias("aircraft_registration"),
        first_hit(F.lower(col(path)), fv.DISCOVERY_CATEGORIES).alias("category"),
        extract(F.upper(col(path)), r"(ES\d{5,7})").alias("es_reference"),
    )


def _last_segment_hit(path: str | Column, pairs: list[tuple[str, str]]) -> Column:
    labels = F.filter(
        F.transform(path_parts(path), lambda p: first_hit(F.upper(p), pairs)),
        lambda label: label.isNotNull())
    return F.coalesce(F.element_at(F.concat(F.array(F.lit("")), labels), -1))


def category_from_path(path: str | Column) -> Column:
    """Struct (category, subcategory): in each segment the first keyword
    counts, and a later segment overrides an earlier one."""
    return F.struct(
        _last_segment_hit(path, fv.SEGMENT_CATEGORIES).alias("category"),
        _last_segment_hit(path, fv.SEGMENT_SUBCATEGORIES).alias("subcategory"),
    )


def profile_from_path(path: str | Column) -> Column:
    """Struct (profile, confidence): share of keywords hit plus a bonus for
    the file name pattern; the first profile wins a tie."""
    lower = F.lower(slashes(path))
    name = F.element_at(F.split(lower, "/"), -1)
    scores = []
    for spec in fv.PROFILES.values():
        hits = F.lit(0)
        for keyword in spec["keywords"]:
            hits = hits + lower.contains(keyword).cast("int")
        score = hits / F.lit(float(len(spec["keywords"]))) * spec["confidence"]
        if spec["filename_regex"]:
            bonus = F.when(name.rlike(spec["filename_regex"]), spec["confidence"])
            score = score + F.coalesce(bonus, F.lit(0.0))
        scores.append(score)
    best = F.greatest(*scores)
    label = F.lit("unknown")
    for profile, score in reversed(list(zip(fv.PROFILES, scores))):
        label = F.when((score == best) & (best > 0), profile).otherwise(label)
    return F.struct(
        label.alias("profile"),
        F.round(F.least(best, F.lit(1.0)), 3).alias("confidence"))


def name_from_path(path: str | Column) -> Column:
    """Folders below ``Aircraft`` (else the last five parts) joined to the
    file name, without characters a file system refuses."""
    parts = F.filter(
        path_parts(strip_long_path_prefix(path)), lambda p: p != "")
    at = F.array_position(F.transform(parts, lambda p: F.lower(p)), "aircraft")
    size = F.size(parts)
    rel = F.when(at > 0, F.slice(parts, at.cast("int") + 1, size)).when(
        size >= 5, F.slice(parts, size - 4, F.lit(5))).otherwise(parts)
    name = F.element_at(F.concat(F.array(F.lit("")), rel), -1)
    folders = F.slice(rel, F.lit(1), F.greatest(F.size(rel) - 1, F.lit(0)))
    joined = F.concat(
        F.array_join(folders, "_"), F.lit("_"), file_stem(name), file_suffix(name))
    return (
        F.when(F.size(rel) == 0, F.lit(None).cast("string"))
        .when(F.size(folders) == 0, name)
        .otherwise(F.translate(joined, '<>:"/|?*', "________")))


def wanted_file(
    path: str | Column, extensions: Sequence[str] | None = None
) -> Column:
    """Inventory filter on a relative path: known suffix, no hidden, macOS or
    software folder, no temporary Office or resource-fork file."""
    parts = path_parts(path)
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(
        folders,
        lambda p: p.startswith(".") | (p == "__MACOSX")
        | F.lower(p).isin(fv.EXCLUDED_DIRECTORIES))
    suffix = F.regexp_replace(F.lower(file_suffix(name)), r"^\.", "")
    return (
        suffix.isin(list(extensions or fv.INVENTORY_EXTENSIONS)) & ~bad
        & ~name.startswith("~$") & ~name.startswith("._"))


def file_name(path: str | Column) -> Column:
    return F.element_at(path_parts(path), -1)


__all__ = [
    "blank_to_null", "category_from_path", "discovery_metadata", "file_name",
    "name_from_path", "path_metadata", "profile_from_path",
    "strip_long_path_prefix", "wanted_file",
]
