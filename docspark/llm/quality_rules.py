"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule. Policies are versioned masks over those bits, so
a new policy, or the effect of leaving one rule out, is bitwise work on the
ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.native_text import WORD, adjacent_repeats, count_chars, repeated_window_words, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`fails` is an SQL condition on the measurements, equal in any dialect."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "many_symbols", "100 * n_symbols > 5 * word_chars"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "exclamations", "100 * n_exclamations > 30 * n_words"),
    Rule(5, "upper_case", "100 * n_upper > 50 * word_chars"),
    Rule(6, "stuttering", "100 * n_stutters > 20 * n_words"),
    Rule(7, "word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
)
#: Versions never change once released; a change is a new version.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "v1": ("too_few_words", "repeated_windows"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[policy])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the measurements of each text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return docs.withColumns({"_words": words(text), "_lines": lines}).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count_chars(text, SYMBOLS),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("_words")),
        "n_exclamations": count_chars(text, "!"),
        "n_upper": count_chars(text, "A-Z"),
        "n_stutters": adjacent_repeats(F.col("_words")),
    }).drop("_words", "_lines")


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_exclamations", "n_upper", "n_stutters")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, fail_bits), one row per row of `docs`.

    Only id and text are used, so other columns may have any name. Null,
    empty and blank texts measure zero and fail `too_few_words`. Repeated
    rows and null ids are kept as they are.
    """
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", *MEASURES, fail_bits().alias("fail_bits"))


def fail_bits() -> Column:
    """All failed rules of a measured row."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def passing(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that a policy keeps, unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = measured(docs.select(row, F.col(text_col).alias("text")))
    return rows.withColumn("fail_bits", fail_bits()).filter(passes(policy)).select("_row.*")


def passes(policy: str = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policies: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule of it: documents dropped, dropped without the rule,
    and dropped by that rule alone.

    The ledger is first counted by failure pattern (at most 2^8 rows), so the
    policies and rules only multiply that small table.
    """
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"),
                 F.lit(mask(p)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for p in policies for r in RULES if r.name in POLICIES[p]]
    each = patterns.withColumn("case", F.explode(F.array(*cases))).select("fail_bits", "n", "case.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    others = failed.bitwiseAND(F.bitwise_not(F.col("bit")))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), count(failed != 0).alias("n_dropped"),
        count(others != 0).alias("n_dropped_without"),
        count((failed != 0) & (others == 0)).alias("n_dropped_alone"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns of the ledger under the current policy."""
    base = F.expr(" OR ".join(f"({r.fails})" for r in RULES[:2]))
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes().alias("kept"), "fail_bits")


SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM documents),
spots AS (
  SELECT rid, unnest(range(len(ws) - 7)) AS p,
    unnest(list_transform(range(len(ws) - 7), lambda p: md5(array_to_string(ws[p + 1:p + 8], ' ')))) AS win
  FROM w WHERE len(ws) >= 8),
twins AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM spots)
  WHERE c >= 2),
covered AS (
  SELECT rid, sum(least(8, coalesce(after - p, 8))) AS n FROM (
    SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS after FROM twins) GROUP BY rid),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS joined,
    length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper,
    len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutters
  FROM w LEFT JOIN covered ON covered.rid = w.rid),
f AS (SELECT * EXCLUDE joined, coalesce(joined, 0)::BIGINT AS word_chars FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({" OR ".join(f"({r.fails})" for r in RULES[:2])}) AS base_failed,
  NOT ({" OR ".join(f"({r.fails})" for r in RULES)}) AS kept,
  ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)})::BIGINT AS fail_bits
FROM f
"""
