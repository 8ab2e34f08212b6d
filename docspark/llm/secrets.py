"""Secret scan: fixed patterns, and a battery of randomness tests.

Beside the three patterns, every token that could be an encoded key is put to
three tests under the alphabet it seems to be written in:

* chi-squared: are the letters of the alphabet equally frequent?
* runs: does the token change between the lower and the upper half of the
  alphabet as often as chance would?
* serial correlation: do neighbouring letters say anything about each other?

A token passes when no test rejects randomness. Passing alone proves little
for short tokens, so each also gets a p-value for the opposite: how likely a
token of its length from natural text would spread over letters so evenly
(from the number of equal pairs of letters, whose mean and variance are known).
These p-values are controlled together: within each class of lengths the
Benjamini-Hochberg rule keeps the expected share of natural tokens among the
reported ones below `FALSE_SHARE`.

Positions come from splitting a text at the matches and adding up lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.basics import prefix_sums
from docspark.functions.spans import free_of
from docspark.llm.native_text import let
from docspark.session import stored

ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""")
VALUE = r"[A-Za-z0-9+/_.=-]+\z"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A token of the encodings' letters with a digit in it, 20 letters or more.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")


@dataclass(frozen=True)
class Encoding:
    name: str
    pattern: str
    alphabet: str


_DIGITS, _LOW = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UP = _LOW.upper()
#: The first whose pattern fits is the inferred encoding.
ENCODINGS = (
    Encoding("hex", r"\A(?=.*[a-f])(?=.*[0-9])[0-9a-f]+\z", _DIGITS + "abcdef"),
    Encoding("HEX", r"\A(?=.*[A-F])(?=.*[0-9])[0-9A-F]+\z", _DIGITS + "ABCDEF"),
    Encoding("base32", r"\A(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+=*\z", _UP + "234567"),
    Encoding("base36", r"\A(?=.*[a-z])(?=.*[0-9])[a-z0-9]+\z", _DIGITS + _LOW),
    Encoding("base64", r"\A(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/]+=*\z", _UP + _LOW + _DIGITS + "+/"),
    Encoding("base64url", r"\A(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_-]+=*\z", _UP + _LOW + _DIGITS + "-_"))

#: A test rejects randomness beyond this two-sided normal bound (p = 0.001).
BOUND = 3.29
#: Expected share of natural tokens among the reported ones.
FALSE_SHARE = 0.01
#: Chance that two, and three, random letters of natural text are equal.
EQUAL_2, EQUAL_3 = 0.0667, 0.0056
#: p-values are compared in bins of a tenth of a unit of -log10.
P_BINS = 300


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of all matches, in code points.

    Positions are running sums of the lengths of gaps and matches; no array
    grows match by match, so a text may hold any number of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(gaps: Column) -> Column:
        steps = F.transform(found, lambda v, i: (F.length(F.get(gaps, i)) + F.length(v)).cast("bigint"))
        return let(prefix_sums(steps), lambda ends: F.transform(found, lambda v, i: F.struct(
            (F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("stop"), v.alias("value"))))

    empty = F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")
    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), placed)).otherwise(empty)


def _count(token: Column, letter: Column) -> Column:
    return F.length(token) - F.length(F.replace(token, letter, F.lit("")))


def _battery(tokens: DataFrame) -> DataFrame:
    """Tokens (value) with encoding, z of the three tests, and p_natural."""
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    half = F.lit(None).cast("string")
    for e in reversed(ENCODINGS):
        fits = F.col("value").rlike(e.pattern)
        zeros_ones = "0" * (len(e.alphabet) // 2) + "1" * (len(e.alphabet) - len(e.alphabet) // 2)
        bare = F.regexp_replace("value", "=+\\z", "")
        encoding = F.when(fits, e.name).otherwise(encoding)
        alphabet = F.when(fits, e.alphabet).otherwise(alphabet)
        half = F.when(fits, F.translate(bare, e.alphabet, zeros_ones)).otherwise(half)
    rows = tokens.withColumns({
        "encoding": encoding, "alphabet": alphabet, "half": half,
        "bare": F.regexp_replace("value", "=+\\z", "")}).filter("encoding IS NOT NULL AND length(bare) >= 20")
    letters = F.split("bare", "")
    rows = rows.withColumns({
        "n": F.length("bare").cast("double"), "a": F.length("alphabet").cast("double"),
        "squares": F.aggregate(
            F.transform(F.array_distinct(letters), lambda c: _count(F.col("bare"), c).cast("double")),
            F.lit(0.0), lambda s, x: s + x * x),
        "ones": _count(F.col("half"), F.lit("1")).cast("double"),
        "runs": F.length(F.regexp_replace("half", "0+|1+", "x")).cast("double"),
        "places": F.transform(letters, lambda c: F.instr(F.col("alphabet"), c).cast("double"))})
    n, a = F.col("n"), F.col("a")
    chi = (a / n * F.col("squares") - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    both = 2 * F.col("ones") * (n - F.col("ones"))
    runs = (F.col("runs") - 1 - both / n) / F.sqrt(F.greatest(F.lit(0.01), both * (both - n) / (n * n * (n - 1))))

    def correlation(v: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
        mean = total(v) / F.size(v)
        return let(mean, lambda m: total(F.transform(
            F.slice(v, 2, F.size(v) - 1), lambda x, i: (x - m) * (F.get(v, i) - m))) / F.greatest(
            F.lit(1e-9), total(F.transform(v, lambda x: (x - m) * (x - m)))))

    serial = (correlation(F.col("places")) + 1 / n) * F.sqrt(n)
    # Equal pairs of letters in natural text of n letters: mean and variance.
    pairs = n * (n - 1) / 2
    equal = (F.col("squares") - n) / 2
    variance = pairs * (EQUAL_2 - EQUAL_2 ** 2 + 2 * (n - 2) * (EQUAL_3 - EQUAL_2 ** 2))
    z = (pairs * EQUAL_2 - equal) / F.sqrt(variance)
    return rows.withColumns({
        "z_chi": chi, "z_runs": runs, "z_serial": serial,
        # Upper bound of the normal tail, in units of -log10; 0 for z <= 0.
        "minus_log_p": F.when(z > 0, (z * z / 2) / 2.302585 + F.log10(
            F.lit(2.0))).otherwise(0.0)}).drop("half", "places", "alphabet")


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n) * 2).cast("int")


def _thresholds(tested: DataFrame) -> DataFrame:
    """(length_class, least): the least p bin that Benjamini-Hochberg accepts.

    Counts per class and bin are all it needs: at most `P_BINS` rows a class.
    """
    bins = tested.groupBy("length_class", "p_bin").agg(F.count("*").alias("held"))
    upto = Window.partitionBy("length_class").orderBy(F.desc("p_bin"))
    ranked = bins.withColumn("rank", F.sum("held").over(upto)).withColumn(
        "all", F.sum("held").over(Window.partitionBy("length_class")))
    bound = -F.log10(F.lit(FALSE_SHARE) * F.col("rank") / F.col("all"))
    return ranked.filter(F.col("p_bin") / 10 >= bound).groupBy("length_class").agg(F.min("p_bin").alias("least"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, random), arrays of (start, stop, value).

    Whole texts, with any number of matches; null counts as empty. `random`
    never overlaps the other three. Repeated rows are scanned as rows of their
    own; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(
        spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(
            F.regexp_replace(s["value"], r"""\A[A-Za-z_]+["']?\x20*[:=]\x20*["']?""", ""), VALUE, 0)) >= 8)
    scanned = stored(docs.select(
        "doc_id", assign.alias("assign"), spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"),
        spans(text, TOKEN).alias("token")).withColumn("row", F.expr("uuid()")), "secrets")
    base = F.concat("assign", "access", "hex")
    tokens = scanned.filter(F.size("token") > 0).select(
        "row", F.explode(free_of(F.col("token"), base, "stop")).alias("token")).select(
        "row", "token", F.col("token.value").alias("value"))
    tested = _battery(tokens).withColumns({
        "length_class": _length_class(F.col("n")),
        "p_bin": F.least(F.lit(P_BINS), F.floor(F.col("minus_log_p") * 10)).cast("int")})
    tested = stored(tested.select(
        "row", "token", "encoding", "length_class", "p_bin", "z_chi", "z_runs", "z_serial"), "tested")
    passed = " AND ".join(f"abs({z}) <= {BOUND}" for z in ("z_chi", "z_runs", "z_serial"))
    found = tested.join(_thresholds(tested), "length_class").filter("p_bin >= least").filter(passed).groupBy("row").agg(
        F.array_sort(F.collect_list("token")).alias("random"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")
    return scanned.join(found, "row", "left").select(
        "doc_id", "assign", "access", "hex", F.coalesce("random", none).alias("random"))


def _digest_text(kinds: tuple[str, ...]) -> Column:
    def labelled(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("kind"), s["stop"].alias("stop")))

    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(F.concat(*[labelled(i, k) for i, k in enumerate(kinds)])), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's columns of `secret_spans`."""
    size = lambda c: F.size(c).cast("long")
    return secret_spans(docs).select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(_digest_text(KINDS[:3]), 256).alias("base_sha256"), _digest_text(KINDS).alias("spans"),
        size("random").alias("n_random"))
