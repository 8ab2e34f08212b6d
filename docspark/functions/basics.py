"""Small building blocks shared by the column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: str | Column) -> Column:
    return F.nullif(col(value), F.lit(""))


def null_to_blank(value: str | Column) -> Column:
    return F.coalesce(col(value), F.lit(""))


def strip(value: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(value), r"^\s+|\s+$", "")


def only_filled(value: Column) -> Column:
    """Null for '' with one evaluation of ``value``.

    ``nullif`` may repeat its argument inside a lazy branch, which doubles
    the work of an expensive one and, nested, the size of the plan.
    """
    return F.get(F.array_remove(F.array(value), ""), F.lit(0))


def extract(value: str | Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, or null (``regexp_extract`` gives '')."""
    return only_filled(F.regexp_extract(col(value), pattern, group))


def cascade(value: str | Column, tries: Callable[[Column], list[Column]]) -> Column:
    """First non-null of ``tries(value)``, evaluated lazily.

    A long cascade of regular expressions would outgrow the size limit of one
    generated method. Inside a lambda it is evaluated expression by
    expression, which costs nothing next to the matching itself.
    """
    return F.get(
        F.transform(F.array(col(value)), lambda v: F.coalesce(*tries(v))), F.lit(0))


def leading_literal(pattern: str) -> str:
    """Letters every match of an upper-case pattern must begin with."""
    found = re.match(r"(?:\\b)?\(?([A-Z0-9]+)", pattern)
    if not found:
        return ""
    literal = found.group(1)
    return literal[:-1] if pattern[found.end():found.end() + 1] in "?*{|" else literal


def first_match(value: str | Column, patterns: Iterable[str]) -> Column:
    """First match of the first pattern that matches at all.

    A plain substring test decides first whether a pattern can match, which
    spares most texts the regular expression.
    """
    def tries(v: Column) -> list[Column]:
        out = []
        for pattern in patterns:
            literal = leading_literal(pattern)
            found = extract(v, pattern)
            out.append(
                F.when(v.contains(literal), found) if len(literal) > 1 else found)
        return out

    return cascade(value, tries)


def contains_any(value: Column, needles: Iterable[str]) -> Column:
    result = F.lit(False)
    for needle in needles:
        result = result | value.contains(needle)
    return result


def first_hit(value: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Label of the first needle (in order) contained in ``value``, or null."""
    case = None
    for needle, label in pairs:
        test = value.contains(needle)
        case = F.when(test, label) if case is None else case.when(test, label)
    return case


def lookup(value: str | Column, mapping: Mapping[str, str]) -> Column:
    """Literal map lookup; null when the key is absent."""
    entries = []
    for key, label in mapping.items():
        entries += [F.lit(key), F.lit(label)]
    return F.element_at(F.create_map(*entries), col(value))


def file_stem(name: str | Column) -> Column:
    return F.regexp_replace(col(name), r"(?<=.)\.[^.]*$", "")


def file_suffix(name: str | Column) -> Column:
    return F.regexp_extract(col(name), r".(\.[^.]+)$", 1)


def slashes(path: str | Column) -> Column:
    return F.translate(col(path), "\\", "/")


def path_parts(path: str | Column) -> Column:
    return F.split(slashes(path), "/")


def exact_sum(value: str | Column) -> Column:
    """Sum in exact decimal arithmetic.

    A double sum depends on the order in which shuffled partials arrive; the
    decimal sum does not, so reruns and lost executors give the same digits.
    """
    return F.sum(col(value).cast("decimal(28,10)")).cast("double")


def exact_mean(value: str | Column) -> Column:
    return F.try_divide(exact_sum(value), F.count(col(value)))


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding on the decimal value."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Places each step of a scan reaches over, and steps: arrays up to 16^7.
_REACH, _STEPS = 16, 7


def prefix_scan(values: Column, combine: Callable[..., Column]) -> Column:
    """Running totals of an array under an associative ``combine`` that skips
    nulls, such as ``F.greatest`` or a sum of ``coalesce``d terms.

    A fold that appends to an array copies it for every element. Here each
    step adds up the totals of sixteen times as many places, and a step longer
    than the array is skipped, so the work grows as n log n.
    """
    def step(at: int, x: Column) -> Column:
        if at == _STEPS:
            return x
        stride = _REACH ** at
        wider = F.transform(x, lambda v, i: combine(
            v, *[F.get(x, i - k * stride) for k in range(1, _REACH)]))
        return F.when(F.size(x) <= stride, x).otherwise(let(wider, lambda y: step(at + 1, y)))

    return let(values, lambda x: step(0, x))


def prefix_sums(values: Column) -> Column:
    def add(first: Column, *others: Column) -> Column:
        total = first
        for other in others:
            total = total + F.coalesce(other, F.lit(0))
        return total

    return prefix_scan(values, add)
