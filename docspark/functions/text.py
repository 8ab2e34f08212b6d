"""Texts prepared for models and search, and small text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.basics import (
    blank_to_null, col, null_to_blank, path_parts, strip)


def head(value: Column, chars: int | None) -> Column:
    """Whole text by default; a window only where a model asks for one."""
    return value if chars is None else F.substring(value, 1, chars)


def embedding_text(
    text: str | Column,
    filename: str | Column,
    metadata: dict[str, Column],
    prefix: str | Column = "",
    body_chars: int | None = None,
    total_chars: int | None = None,
) -> Column:
    """Prefix, file name, metadata twice (to weigh more) and the body."""
    words = {
        "aircraft": "aircraft", "doc_type": "type", "category": "category",
        "es_reference": "reference", "ata_chapter": "ata",
        "sb_ad_reference": "service bulletin airworthiness directive"}
    meta = blank_to_null(F.concat_ws(" ", *[
        F.concat(F.lit(word + " "), blank_to_null(metadata[name]))
        for name, word in words.items() if name in metadata]))
    body = strip(F.replace(
        head(col(text), body_chars), F.lit("\n"), F.lit(" ")))
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    whole = F.concat_ws(
        " ", blank_to_null(strip(start)),
        F.concat(F.lit("filename "), blank_to_null(filename)),
        meta, meta, F.when(F.length(col(text)) > 0, body))
    return head(whole, total_chars)


def classifier_text(
    text: str | Column,
    filename: str | Column,
    path: str | Column,
    max_chars: int | None = None,
) -> Column:
    """Lower-cased body, file name words and path words."""
    name = F.lower(F.translate(col(filename), "-_.", "   "))
    folders = F.lower(F.array_join(path_parts(path), " "))
    return F.concat_ws(
        " ", blank_to_null(F.lower(head(col(text), max_chars))),
        F.when(F.length(col(filename)) > 0, F.concat(F.lit("FILENAME "), name)),
        F.when(F.length(col(path)) > 0, F.concat(F.lit("PATH "), folders)))


def short_classifier_text(
    text: str | Column,
    filename: str | Column,
    path: str | Column,
    max_chars: int | None = None,
    path_depth: int = 4,
) -> Column:
    """Body, ``FILE`` name and the last path parts, case kept."""
    parts = path_parts(path)
    size = F.size(parts)
    depth = F.least(size, F.lit(path_depth))
    last = F.slice(parts, size - depth + 1, F.greatest(depth, F.lit(1)))
    return F.concat_ws(
        " ", head(col(text), max_chars),
        F.when(F.length(col(filename)) > 0, F.concat(F.lit("FILE "), col(filename))),
        F.when(F.length(col(path)) > 0,
               F.concat(F.lit("PATH "), F.array_join(last, " "))))


def search_tokens(
    filename: str | Column,
    others: list[str | Column],
    text: str | Column,
) -> Column:
    """Distinct tokens of the name (separators split), other fields, text."""
    name = F.regexp_replace(F.lower(null_to_blank(filename)), r"[_\-.&]", " ")
    joined = F.concat_ws(
        " ", name, *[F.lower(null_to_blank(o)) for o in others],
        F.lower(null_to_blank(text)))
    return F.array_distinct(
        F.filter(F.split(joined, r"\s+"), lambda t: t != ""))


def alpha_quality(text: str | Column) -> Column:
    """min(100, words x share of letters x 5)."""
    t = null_to_blank(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    share = letters / F.greatest(F.length(t), F.lit(1))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.least(F.lit(100.0), words * share * 5)


def snippet(text: str | Column, query: str, window: int = 200) -> Column:
    """Surroundings of the first hit of the query, or of the query without
    its reference prefix; else the head of the text."""
    import re

    t = col(text)
    half = window // 2
    low = F.lower(t)
    bare = re.sub(r"^ES\s*0*", "", query, flags=re.IGNORECASE)
    hits = [
        F.nullif(F.instr(low, F.lit(q.lower())), F.lit(0)) for q in (query, bare)]
    at = F.coalesce(*hits) - 1
    start = F.greatest(at - half, F.lit(0))
    end = F.least(at + half, F.length(t))
    cut = strip(F.replace(
        F.substring(t, start + 1, end - start), F.lit("\n"), F.lit(" ")))
    around = F.concat(
        F.when(start > 0, "…").otherwise(""), cut,
        F.when(end < F.length(t), "…").otherwise(""))
    return (
        F.when((F.length(null_to_blank(t)) == 0) | F.lit(not query), "")
        .when(at.isNotNull(), around)
        .otherwise(F.concat(F.substring(t, 1, window), F.lit("..."))))
