"""URL filter: rules first, then two character language models.

Rules accept or reject a host, its subdomains and a path. URLs that a rule
accepts and URLs that a rule rejects train one variable-order Markov model
each; every other URL is judged by the difference of its log-likelihoods under
the two models, per character, against a threshold calibrated on the same
labelled URLs.

The models are tables of all substrings of up to five characters; none is
dropped for being rare. The longest context seen in training counts, smoothed
towards the next shorter one. Substrings are combined before they are judged,
and URLs look theirs up by a shuffled join, so nothing that grows with the
input is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.session import stored

#: (verdict, rule). The host is what stands before the first slash.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 5
#: Substrings that hold more than 1/HOT of all places are looked up apart;
#: fewer than HOT can do so.
HOT = 1024
#: Weight of the shorter context, in observations.
SMOOTHING = 4.0
#: Bins of the score for calibration; scores lie well within +-8 per character.
BINS = 1600
_START, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, else null."""
    cases = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases


def _characters(urls: DataFrame) -> DataFrame:
    """One row per character of `url` and the end mark: `g`, the substring of
    five that ends there. URLs are padded in front, so all places have one."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), F.col("url"), F.lit(_END))
    return urls.withColumn("_p", padded).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("url") + 1))).withColumn(
        "g", F.expr(f"substring(_p, _i, {ORDER})")).drop("_p", "_i", "url")


def _steps(grams: DataFrame) -> DataFrame:
    """(g, step) for each substring of five: the log, in thousandths, of
    accepted over rejected probability of its last character after those
    before it, in the longest context that was seen in training.

    The probability of order k leans on that of order k - 1, which shares its
    last characters. Those of a substring that was not seen are null.
    """
    lower, base = None, {c: F.lit(1 / 256) for c in ("accepted", "rejected")}
    for k in range(1, ORDER + 1):
        gram = grams.groupBy(F.expr(f"right(g, {k})").alias("g")).agg(
            *[F.sum(c).alias(c) for c in base])
        before = gram.groupBy(F.expr("left(g, length(g) - 1)").alias("context")).agg(
            *[F.sum(c).alias(f"c_{c}") for c in base])
        gram = gram.withColumn("context", F.expr("left(g, length(g) - 1)")).withColumn(
            "shorter", F.expr("substring(g, 2)")).join(before, "context")
        ratio = F.lit(0.0)
        if lower is not None:
            gram = gram.join(lower, "shorter")
            base, ratio = {c: F.col(f"p_{c}") for c in base}, F.col("lower_ratio")
        shares = [F.when(F.col("accepted") + F.col("rejected") > 0, (F.col(c) + SMOOTHING * base[c]) / (
            F.col(f"c_{c}") + SMOOTHING)).alias(f"q_{c}") for c in base]
        table = stored(gram.select("g", ratio.alias("_ratio"), *shares).select("g", "q_accepted", "q_rejected", F.coalesce(
            F.log(F.col("q_accepted") / F.col("q_rejected")), F.col("_ratio")).alias("ratio")), f"url-model-{k}")
        lower = table.select(F.col("g").alias("shorter"), F.col("ratio").alias("lower_ratio"),
                             *[F.col(f"q_{c}").alias(f"p_{c}") for c in base])
    # Whole thousandths add up to the same sum in any order of the rows.
    return table.select("g", F.round(F.col("ratio") * 1000).cast("long").alias("step"))


def _scored(urls: DataFrame) -> DataFrame:
    """(id, score): mean log ratio over the characters of each row of
    (id, url, accepted, rejected)."""
    grams = stored(_characters(urls.select("url", "accepted", "rejected")).groupBy("g").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count("*").alias("places")), "url-grams")
    total = F.broadcast(grams.agg((F.sum("places") / HOT).alias("bar")))
    hot = grams.join(total, F.col("places") > F.col("bar"), "left_semi").select("g")
    steps = stored(_steps(grams).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "g", "left"), "url-steps")
    few = F.broadcast(steps.filter("hot").select("g", F.col("step").alias("hot_step")))
    places = _characters(urls.select("id", "url")).join(few, "g", "left")
    # Rows with a hot substring have their step; a null key meets nothing and
    # would pile up in one task, so they stay out of the shuffled join.
    parts = places.filter("hot_step IS NOT NULL").select("id", F.col("hot_step").alias("step")).union(
        places.filter("hot_step IS NULL").join(steps.filter("hot IS NULL"), "g").select("id", "step"))
    return parts.groupBy("id").agg((F.sum("step") / F.count("*") / 1000).alias("score"))


def _threshold(scores: DataFrame) -> float:
    """The score below which URLs are blocked: the bin edge with the highest
    sum of the two classes' shares of right answers, from a histogram of at
    most `BINS` rows. Ties go to the edge nearest zero; without labelled URLs
    of both kinds it is zero."""
    bin_of = F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2), F.floor(F.col("score") * 100))).cast("int")
    bins = scores.groupBy(bin_of.alias("bin")).agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).orderBy("bin").collect()
    accepted, rejected = (sum(b[c] for b in bins) for c in ("accepted", "rejected"))
    if not accepted or not rejected:
        return 0.0
    best, lost, caught = (1.0, 0.0, 0.0), 0, 0
    for b in bins:
        lost, caught = lost + b["accepted"], caught + b["rejected"]
        edge = (b["bin"] + 1) / 100
        best = max(best, (1 - lost / accepted + caught / rejected, -abs(edge), edge))
    return best[2]


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of `pages`.

    `score` is null where a rule decides. A null URL and one without `://`
    have an empty host and path; no rule fits and the model judges the empty
    or odd URL like any other (null as the empty one). Repeated URLs get the
    same verdict. Without training URLs of both kinds everything is allowed.
    """
    parsed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"),
                          host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    # Equal URLs are combined before anything is exploded, so a very common
    # one costs as much as a rare one.
    distinct = stored(ruled.groupBy("url").agg(
        F.sum(F.when(F.col("_rule.verdict") == "allow", 1).otherwise(0)).alias("accepted"),
        F.sum(F.when(F.col("_rule.verdict") == "block", 1).otherwise(0)).alias("rejected")).withColumn(
            "id", F.monotonically_increasing_id()), "urls")
    scores = stored(_scored(distinct).join(distinct, "id"), "url-scores")
    threshold = _threshold(scores)
    open_scores = scores.filter("accepted + rejected = 0").select("url", "score")
    return ruled.join(open_scores, "url", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("score") < threshold, "block").otherwise("allow")).alias("verdict"),
        "score")
