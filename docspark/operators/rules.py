"""Rule-based classification and processing profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import (
    cascade, col, contains_any, lookup, null_to_blank, slashes)


def profile_config(rows: DataFrame, profile: str = "profile") -> DataFrame:
    """Settings of each row's profile; unknown profiles get the generic one."""
    def setting(key: str, cast=str) -> Column:
        return lookup(profile, {n: cast(s[key]) for n, s in fv.PROFILES.items()})

    required = F.create_map(*[
        x for n, s in fv.PROFILES.items()
        for x in (F.lit(n), F.array(*map(F.lit, s["required"])))])
    generic = F.concat(F.lit("Document ("), F.col(profile), F.lit(")"))
    return rows.select(
        "*", F.coalesce(setting("display"), generic).alias("display"),
        F.coalesce(setting("prefix"), F.lit("")).alias("prefix"),
        setting("max_chars").cast("int").alias("max_chars"),
        F.coalesce(
            F.element_at(required, F.col(profile)),
            F.array().cast("array<string>")).alias("required"))


def profile_warnings(profile: str | Column, fields: dict[str, Column]) -> Column:
    """Missing required fields and failed format checks of the profile, for
    the fields that are given."""
    p = col(profile)
    checks = []
    for name, value in fields.items():
        users = [n for n, s in fv.PROFILES.items() if name in s["required"]]
        checks.append(F.when(
            p.isin(users) & (null_to_blank(value) == ""), f"missing {name}"))
    for name, value in fields.items():
        for pattern in sorted({
                s["formats"][name] for s in fv.PROFILES.values() if name in s["formats"]}):
            users = [
                n for n, s in fv.PROFILES.items() if s["formats"].get(name) == pattern]
            checks.append(F.when(
                p.isin(users) & (value != "") & ~value.rlike(pattern), f"format {name}"))
    return F.array_compact(F.array(*checks))


def argmax_label(scores: dict[str, Column], floor: float | None = None) -> Column:
    """Struct (label, score) of the best score; the first declared one wins a
    tie. With ``floor`` a best score not above it gives a null label."""
    best = F.greatest(*scores.values())
    label = F.lit(None).cast("string")
    for name, score in reversed(scores.items()):
        label = F.when(score == best, name).otherwise(label)
    if floor is not None:
        label = F.when(best > floor, label)
    return F.struct(label.alias("label"), best.alias("score"))


def classify_by_path(path: str | Column) -> Column:
    """Type from ordered folder rules; null in folders that say nothing."""
    lower = F.lower(slashes(null_to_blank(path)))
    typed = cascade(lower, lambda p: [
        F.when(p.rlike(rule), label) for rule, label in fv.PATH_TYPE_RULES])
    return F.when(
        (lower != "") & ~contains_any(lower, fv.NON_INFORMATIVE_FOLDERS), typed)


def classify_by_filename(filename: str | Column) -> Column:
    return F.when(col(filename).rlike(fv.WORK_ORDER_FILENAME), "Work Order")


def rule_scores(
    text: str | Column, filename: str | Column, path: str | Column
) -> dict[str, Column]:
    """Score per type; ``text`` must be lower case already."""
    body, name = col(text), col(filename)
    folder = F.lower(slashes(null_to_blank(path)))
    scores = {}
    for label, rule in fv.RULES.items():
        # Hits are counted as integers and weighted once, so equal evidence
        # always gives the same floating-point score.
        words = sum((body.contains(k).cast("int") for k in rule["keywords"]), F.lit(0))
        names = sum(
            (name.rlike("(?i)" + p).cast("int") for p in rule["filename"]), F.lit(0))
        paths = sum((folder.contains(p).cast("int") for p in rule["path"]), F.lit(0))
        score = (
            words * fv.RULE_KEYWORD_POINTS + names * fv.RULE_FILENAME_POINTS
            + paths * fv.RULE_PATH_POINTS) * rule["weight"]
        scores[label] = F.round(F.least(score, F.lit(1.0)), 6)
    return scores


def reference_boost(
    predicted: Column, score: Column, sb_ad: Column, filename: Column, path: Column
) -> Column:
    """Struct (label, score): a directive or bulletin reference relabels a
    non-structural type when path or name say AD or SB."""
    name, folder = F.upper(filename), F.upper(slashes(null_to_blank(path)))
    free = ~predicted.isin(fv.STRUCTURAL_TYPES) & (null_to_blank(sb_ad) != "")
    ad = free & (folder.contains("AD") | name.contains("AD"))
    sb = free & ~ad & folder.contains("SB")
    return F.struct(
        F.when(ad, "AD").when(sb, "SB").otherwise(predicted).alias("label"),
        F.when(ad, F.greatest(score, F.lit(0.85)))
        .when(sb, F.greatest(score, F.lit(0.80))).otherwise(score).alias("score"))


def infer_category(doc_type: str | Column, path: str | Column) -> Column:
    """Category from type and path. A structural type listens only to check
    folders; other types follow ordered path rules."""
    kind, folder = col(doc_type), F.lower(slashes(null_to_blank(path)))
    default = F.coalesce(lookup(kind, fv.TYPE_TO_CATEGORY), F.lit("Other"))
    check_a = contains_any(folder, ["check a", "check-a"])
    check_c = contains_any(folder, ["check c", "check-c"])
    structural = F.when(check_c, "Check C").when(check_a, "Check A").otherwise(default)
    other = default
    for needles, label in reversed(fv.CATEGORY_PATH_RULES):
        other = F.when(contains_any(folder, needles), label).otherwise(other)
    return F.when(kind.isin(fv.STRUCTURAL_TYPES), structural).otherwise(other)


def classify_by_rules(
    docs: DataFrame, text: str = "classifier_text", filename: str = "filename",
    path: str = "rel_path", sb_ad: str = "sb_ad_reference",
) -> DataFrame:
    """Add rule_type, rule_score, rule_category."""
    scored = docs.withColumn("_lower", F.lower(text)).withColumn(
        "_scores", F.struct(*[
            s.alias(f"s{i}") for i, s in enumerate(
                rule_scores("_lower", filename, path).values())]))
    scores = {n: F.col(f"_scores.s{i}") for i, n in enumerate(fv.RULES)}
    best = scored.withColumn("_best", argmax_label(scores))
    boosted = best.withColumn("_final", reference_boost(
        F.col("_best.label"), F.col("_best.score"), F.col(sb_ad), F.col(filename),
        F.col(path)))
    return boosted.select(
        *docs.columns, F.col("_final.label").alias("rule_type"),
        F.round("_final.score", 4).alias("rule_score"),
        infer_category("_final.label", path).alias("rule_category"))


def classify_cascade(
    docs: DataFrame, text: str = "classifier_text", filename: str = "filename",
    path: str = "rel_path", sb_ad: str = "sb_ad_reference",
    model_type: str | None = None, model_confidence: str | None = None,
) -> DataFrame:
    """Path rule, then file name, then model (when its columns are given),
    then scored rules; a type named by the path profile overrides."""
    from docspark.functions.paths import profile_from_path

    ruled = classify_by_rules(docs, text, filename, path, sb_ad)
    staged = ruled.withColumns({
        "_path": classify_by_path(path), "_name": classify_by_filename(filename),
        "_profile": lookup(profile_from_path(path)["profile"], fv.PROFILE_TO_TYPE)})

    def row(kind: Column, confidence: Column, method: str) -> Column:
        return F.struct(
            kind.alias("kind"), confidence.alias("confidence"),
            F.lit(method).alias("method"))

    case = F.when(
        F.col("_path").isNotNull(), row(F.col("_path"), F.lit(1.0), "path")
    ).when(F.col("_name").isNotNull(), row(F.col("_name"), F.lit(0.97), "filename"))
    if model_type is not None:
        case = case.when(
            F.col(model_type).isNotNull(),
            row(F.col(model_type), F.round(model_confidence, 4), "model"))
    decided = staged.withColumn("_c", case.otherwise(
        row(F.col("rule_type"), F.col("rule_score"), "rules")))
    override = F.col("_profile").isNotNull() & (F.col("_profile") != F.col("_c.kind"))
    return decided.select(
        *docs.columns,
        F.when(override, F.col("_profile")).otherwise(F.col("_c.kind")).alias(
            "predicted_type"),
        F.when(override, F.col("_profile")).otherwise(
            infer_category("_c.kind", path)).alias("predicted_category"),
        F.col("_c.confidence").alias("confidence"),
        F.when(override, F.concat("_c.method", F.lit("+profile"))).otherwise(
            F.col("_c.method")).alias("method"))


def keyword_classifier(text: str | Column, filename: str | Column) -> Column:
    """Label with the most keyword evidence, ``Unknown`` without any.

    ``text`` must be lower case.
    """
    body, name = col(text), F.lower(null_to_blank(filename))
    scores = {}
    for label, rule in fv.KEYWORD_RULES.items():
        score = F.lit(0.0)
        for word in rule["kw"]:
            score = score + body.contains(word).cast("double") + (
                name.contains(word).cast("double") * 0.5)
        for token in rule["fn"]:
            score = score + name.contains(token).cast("double") * 2.0
        scores[label] = score
    return scores


def with_keyword_class(
    docs: DataFrame, text: str = "ocr_text", filename: str = "filename"
) -> DataFrame:
    scored = docs.withColumn("_lower", F.lower(null_to_blank(text))).withColumn(
        "_scores", F.struct(*[
            s.alias(f"s{i}") for i, s in enumerate(
                keyword_classifier("_lower", filename).values())]))
    best = argmax_label(
        {n: F.col(f"_scores.s{i}") for i, n in enumerate(fv.KEYWORD_RULES)}, 0.0)
    return scored.select(
        *docs.columns, F.coalesce(best["label"], F.lit("Unknown")).alias("keyword_class"))


def filename_label(filename: str | Column) -> Column:
    """Label of the first token found in the file name, or null."""
    name = F.upper(col(filename))
    return F.coalesce(*[F.when(name.contains(t), lb) for t, lb in fv.FILENAME_LABEL_RULES])
