"""File names and destinations built from metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import (
    blank_to_null, col, file_stem, file_suffix, lookup, null_to_blank, strip)
from docspark.functions.labels import type_key


def clean_name(value: Column) -> Column:
    marked = F.regexp_replace(strip(value), r'[\s/\\:*?"<>|]', "_")
    return F.regexp_replace(F.regexp_replace(marked, "_+", "_"), "^_+|_+$", "")


def _first(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def _reference(kind: Column, e: dict[str, Column]) -> Column:
    es, item = e["es_reference"], e["item_number"]
    sb_ad = e["sb_ad_reference"]
    ata = F.replace(null_to_blank(e["ata_chapter"]), F.lit("ATA "), F.lit("ATA"))
    return (
        F.when(kind.isin("WORK_ORDER", "RCT"), _first(es, e["work_order_number"]))
        .when(kind == "JOBCARD", _first(item, es))
        .when(kind.isin("AD", "SB"),
              F.regexp_replace(_first(sb_ad, es), r"[/\\]", "-"))
        .when(kind == "DB_CHART", _first(sb_ad, item))
        .when(kind == "CERTIFICATE", _first(es, e["serial_number"]))
        .when(kind.isin("AMM", "CMM", "IPC", "SPECS"), _first(ata, es))
        .otherwise(_first(es, item)))


def suggested_filename(
    aircraft: str | Column,
    doc_type: str | Column,
    category: str | Column,
    entities: dict[str, Column],
    original: str | Column,
) -> Column:
    """Aircraft, category, type and reference; the type is left out when it
    repeats the category."""
    kind = type_key(F.coalesce(col(doc_type), F.lit("")))
    plane = F.coalesce(
        blank_to_null(clean_name(F.upper(null_to_blank(aircraft)))), F.lit("UNKNOWN"))
    cat = F.coalesce(
        lookup(null_to_blank(category), fv.NAME_CATEGORY_LABELS),
        clean_name(null_to_blank(category)))
    label = F.coalesce(
        lookup(kind, fv.NAME_TYPE_LABELS), clean_name(null_to_blank(doc_type)))
    parts = [
        plane, blank_to_null(cat),
        F.when(label != cat, blank_to_null(label)),
        blank_to_null(clean_name(_reference(kind, entities)))]
    name = F.concat_ws("_", *parts)
    fallback = F.coalesce(
        blank_to_null(clean_name(
            F.regexp_replace(null_to_blank(original), r"\.[^.]+$", ""))),
        F.lit("Document"))
    return F.concat(
        F.when(F.length(name) < 5, fallback).otherwise(name), F.lit(".pdf"))


def organised_destination(
    row_id: str | Column,
    aircraft: str | Column,
    category: str | Column,
    doc_type: str | Column,
    entities: dict[str, Column],
) -> Column:
    """Struct (folder, name) in the organised tree; documents without a
    registration wait in ``En_Attente``."""
    reg = F.upper(strip(null_to_blank(aircraft)))
    key = F.lower(strip(null_to_blank(category)))
    plain = F.replace(
        F.replace(key, F.lit(" "), F.lit("_")), F.lit("&"), F.lit("et"))
    folder = F.coalesce(
        lookup(key, fv.CATEGORY_FOLDERS), blank_to_null(plain), F.lit("Divers"))
    kind = type_key(null_to_blank(doc_type))
    path = F.concat_ws("/", reg, folder, lookup(kind, fv.TYPE_FOLDERS))
    short = F.coalesce(lookup(kind, fv.SHORT_TYPES), F.left(kind, F.lit(6)))
    ref = F.coalesce(
        *[blank_to_null(entities[n]) for n in (
            "es_reference", "sb_ad_reference", "work_order_number",
            "item_number")],
        col(row_id).cast("string"))
    ref = F.translate(strip(ref), " /\\", "_--")
    ata = F.concat(F.lit("_ATA"), blank_to_null(entities["ata_chapter"]))
    name = F.concat(
        F.coalesce(blank_to_null(reg), F.lit("UNKN")), F.lit("_"), short,
        F.lit("_"), ref, F.coalesce(ata, F.lit("")), F.lit(".pdf"))
    return F.struct(
        F.when(reg == "", "En_Attente").otherwise(path).alias("folder"),
        name.alias("name"))


def name_from_metadata(
    aircraft: str | Column,
    category: str | Column,
    es_reference: str | Column,
    doc_type: str | Column,
    ata_chapter: str | Column,
    filename: str | Column,
) -> Column:
    es = strip(blank_to_null(es_reference))
    es = F.when(F.upper(es).startswith("ES"), es).otherwise(
        F.concat(F.lit("ES"), es))
    parts = F.concat_ws(
        "_", strip(blank_to_null(aircraft)), strip(blank_to_null(category)), es,
        strip(blank_to_null(doc_type)),
        F.concat(F.lit("ATA"), strip(blank_to_null(ata_chapter))))
    name = F.concat(
        parts, F.lit("_"), file_stem(filename), file_suffix(filename))
    return F.when(parts == "", col(filename)).otherwise(
        F.translate(name, '<>:"/\\|?*', "_________"))


def rename_decision(current: str | Column, new: str | Column) -> Column:
    """``rename`` unless the name is unchanged, missing, or already carries
    the first 20 characters of the new stem."""
    cur, nxt = col(current), col(new)
    already = F.startswith(cur, F.left(file_stem(nxt), F.lit(20)))
    return (
        F.when(nxt.isNull() | (nxt == ""), "error")
        .when((nxt == cur) | already, "no_change")
        .otherwise("rename"))


def collapse_repeated_prefix(filename: str | Column) -> Column:
    """Drop one copy of the longest token prefix that is repeated at once."""
    tokens = F.split(file_stem(filename), "_")
    size = F.size(tokens)
    lengths = F.when(
        size >= 2, F.sequence(F.floor(size / 2).cast("int"), F.lit(1), F.lit(-1))
    ).otherwise(F.array().cast("array<int>"))
    repeated = F.filter(
        lengths,
        lambda n: F.slice(tokens, F.lit(1), n) == F.slice(tokens, n + 1, n))
    n = F.get(repeated, F.lit(0))
    kept = F.slice(tokens, n + 1, size)
    return F.when(n.isNull(), col(filename)).otherwise(
        F.concat(F.array_join(kept, "_"), file_suffix(filename)))


def repeated_prefix(filename: str | Column) -> Column:
    return col(filename).rlike(r"(TS-IN[A-Z].+)\1")
