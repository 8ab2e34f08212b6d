"""Column expressions over whole texts, shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_chars(text: Column, chars: str) -> Column:
    """Code points of `text` in the regex class `chars`; null has none."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{chars}]+", "")
    return F.length(kept).cast("long")


def adjacent_repeats(words: Column) -> Column:
    """Words equal to the word before them."""
    return let(words, lambda w: F.size(F.filter(
        w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))).cast("long")


def repeated_window_words(words: Column, size: int = 8) -> Column:
    """Words that lie in a `size`-word window found twice or more in the text.

    Windows are 64-bit hashes of word hashes. Sorting (hash, position) puts
    equal windows side by side; the covered words are the sum of the steps
    between the positions so found, each at most `size`.
    """

    def windows(h: Column) -> Column:
        def window(i: Column) -> Column:
            return F.xxhash64(*[F.get(h, i + k) for k in range(size)])
        return F.when(F.size(h) >= size, F.transform(
            F.sequence(F.lit(0), F.size(h) - size), window)).otherwise(
            F.array().cast("array<bigint>"))

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(s, k - 1)["h"] == x["h"])
            return before | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(
            F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        pairs = F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.array_sort(pairs), lambda s: let(repeated(s), covered)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), count).cast("long")
