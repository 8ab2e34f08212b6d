"""Span annotation in columns, with match offsets.

Spark's regular-expression functions return matches without positions. A text
split at the matches of a pattern gives what lies between them, and running
sums of lengths are the offsets. In every pattern the wanted group ends where
the match ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import col, let, prefix_scan, prefix_sums

SPAN_TYPE = "array<struct<start:int,end:int,label:string>>"


def _is_whole(pattern: str) -> bool:
    """Whether the first group is the whole match: nothing but it between
    word boundaries, so that one pass over the text gives both."""
    inner = re.fullmatch(r"\\b\((?!\?)(.*)\)\\b", pattern, re.S)
    if not inner:
        return False
    depth, literal = 0, re.sub(r"\\.|\[[^\]]*\]", "", inner[1])
    for c in literal:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return True


def _matches(text: Column, label: str, pattern: str) -> Column:
    """Of all matches, any case, Unicode classes: the characters from the end
    of the match before, those of the first group, and the label."""
    regex = f"(?iU){pattern}"
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    groups = whole if _is_whole(pattern) else F.regexp_extract_all(text, F.lit(regex), F.lit(1))
    none = F.array().cast("array<struct<step:int,size:int>>")
    pieces = F.arrays_zip(F.split(text, regex, -1), whole, groups)
    # The last piece is what follows the last match.
    found = F.filter(F.transform(pieces, lambda p: F.struct(
        (F.length(p["0"]) + F.length(p["1"])).alias("step"), F.length(p["2"]).alias("size"))),
        lambda p: p["step"].isNotNull())
    return F.struct(F.when(text.rlike(regex), found).otherwise(none).alias("found"), F.lit(label).alias("label"))


def _spans(matches: Column) -> Column:
    ends = prefix_sums(F.transform(matches["found"], lambda p: p["step"]))
    spans = let(ends, lambda e: F.transform(matches["found"], lambda p, i: F.struct(
        (F.get(e, i) - p["size"]).alias("start"), F.get(e, i).alias("end"), matches["label"].alias("label"))))
    return F.when(F.size(matches["found"]) > 0, spans).otherwise(F.array().cast(SPAN_TYPE))


def free_of(found: Column, taken: Column, end: str = "end") -> Column:
    """The spans of ``found`` that overlap none of ``taken``, by start. Both
    are arrays of one struct type with ``start`` and ``end``.

    In order of starts a span is free if no taken one that starts before
    reaches into it and the next taken one starts after it: two scans, however
    many spans there are.
    """
    def marked(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s.alias("span")))

    def free(all_: Column) -> Column:
        ends = F.transform(all_, lambda s: F.when(s["rank"] == 0, s["span"][end]))
        starts = F.reverse(F.transform(all_, lambda s: F.when(s["rank"] == 0, s["start"])))
        return let(prefix_scan(ends, F.greatest), lambda before: let(
            F.reverse(prefix_scan(starts, F.least)), lambda after: F.filter(
                all_, lambda s, i: (s["rank"] == 1)
                & (F.coalesce(F.get(before, i), s["start"]) <= s["start"])
                & (F.coalesce(F.get(after, i), s["span"][end]) >= s["span"][end]))))

    kept = let(F.array_sort(F.concat(marked(taken, 0), marked(found, 1))), free)
    return F.when((F.size(taken) == 0) | (F.size(found) == 0), found).otherwise(
        F.transform(kept, lambda s: s["span"]))


def annotate_spans(
    airlines: Sequence[str] = (), text_limit: int | None = None
) -> Callable[[str | Column], Column]:
    """Function text -> spans in order, without overlaps: an earlier label or
    pattern keeps its place.

    ``airlines`` adds operator names as a label of their own; ``text_limit``
    drops spans that end beyond a model's window.
    """
    patterns = [
        (label, p) for label, many in fv.SPAN_PATTERNS.items() for p in many]
    if airlines:
        names = "|".join(re.escape(a) for a in airlines)
        patterns.append(("AIRLINE", rf"\b({names})\b"))

    def place(taken: Column, matches: Column) -> Column:
        return let(_spans(matches), lambda found: F.concat(taken, free_of(found, taken)))

    def annotate(text: str | Column) -> Column:
        body = F.coalesce(col(text), F.lit(""))
        found = F.array(*[_matches(body, label, p) for label, p in patterns])
        spans = F.aggregate(found, F.array().cast(SPAN_TYPE), place)
        if text_limit is not None:
            spans = F.filter(spans, lambda s: s["end"] <= text_limit)
        return F.array_sort(spans)

    return annotate


def spans_of(text: Column, **options) -> Column:
    return annotate_spans(**options)(text)
