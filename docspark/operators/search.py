"""Hybrid search and retrieval.

A query is a parameter: its variants, entities and vector are literals that
Catalyst folds into the scan, so scoring needs no join at all. Ranking uses
``orderBy(...).limit(k)``, which keeps only k rows per task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import blank_to_null, null_to_blank, rounded, strip
from docspark.functions.entities import with_entities
from docspark.functions.text import search_tokens, snippet
from docspark.functions.vectors import cosine_literal
from docspark.operators.windows import context_budget
from docspark.session import stored

SEARCH_COLUMNS = [
    "filename", "ocr_text", "es_reference", "sb_ad_reference",
    "aircraft_registration", "work_order_number", "item_number", "part_number",
]


def ranked(frame: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank; only these reach a window."""
    top = frame.orderBy(*order).limit(limit)
    return top.withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def in_given_order(docs: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The named rows with their place in the caller's list."""
    wanted = F.array(*[F.lit(i).cast("bigint") for i in ids])
    rest = [c for c in docs.columns if c != "id"]
    return docs.filter(F.col("id").isin(list(ids))).select(
        "id", F.array_position(wanted, F.col("id")).alias("rank"), *rest).orderBy("rank")


def by_ranking(docs: DataFrame, ranking: DataFrame) -> DataFrame:
    """The ranked rows with their rank, for rankings too long for a list."""
    return docs.join(ranking.select("id", "rank"), "id").orderBy("rank", "id")


# --- the query --------------------------------------------------------------


def query_entities(queries: DataFrame, query: str = "query") -> DataFrame:
    """Aircraft, reference, chapter and work order named by each query."""
    found = with_entities(queries.withColumn("_none", F.lit("")), query, "_none", "q_")
    return found.select(
        *queries.columns, F.col("q_aircraft_registration").alias("aircraft"),
        F.col("q_es_reference").alias("es_reference"),
        F.col("q_ata_chapter").alias("ata"),
        F.col("q_work_order_number").alias("work_order"))


def query_variants_column(query: Column) -> Column:
    """Spellings of a reference: with and without prefix, blank and zeros."""
    q = strip(query)
    digits = F.regexp_extract(q, r"(?i)^ES\s*0*(\d+)$", 1)
    padded = F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(8)),
        lambda width: F.transform(
            F.array(F.lit("ES"), F.lit("ES ")),
            lambda prefix: F.concat(prefix, F.lpad(
                digits, F.greatest(width, F.length(digits)), F.lit("0"))))))
    return F.when(digits == "", F.array(q)).otherwise(
        F.array_distinct(F.concat(F.array(q, digits), padded)))


def query_variants(query: str) -> list[str]:
    q = query.strip()
    match = re.match(r"^ES\s*0*(\d+)$", q, re.IGNORECASE)
    if not match:
        return [q]
    number = match.group(1)
    padded = [
        prefix + number.zfill(width) for width in range(1, 9) for prefix in ("ES", "ES ")]
    return list(dict.fromkeys([q, number, *padded]))


# --- hits -------------------------------------------------------------------


_SEPARATOR = "\u0001"


def _matches(low: dict[str, Column], variants: Sequence[str]) -> Column:
    """Any variant in any of the lower-cased columns.

    A variant without wildcards is looked for once in all columns at a time;
    ``%`` and ``_`` typed by the user stay wildcards within one column.
    """
    test = F.lit(False)
    for variant in variants:
        v = variant.lower()
        if "%" in v or "_" in v:
            for name, column in low.items():
                if name != "*":
                    test = test | F.coalesce(column.like(f"%{v}%"), F.lit(False))
        else:
            test = test | F.contains(low["*"], F.lit(v))
    return test


def _minimal(variants: Sequence[str]) -> list[str]:
    """Variants that contain no other one: a row that matches any variant
    matches one of these."""
    low = [v.lower() for v in variants]
    return [
        v for v, x in zip(variants, low)
        if not any(y in x and y != x for y in low)]


def minimal_variants(query: str) -> list[str]:
    """The spellings of a query an index must be asked for."""
    return _minimal(query_variants(query))


def substring_search(
    docs: DataFrame, query: str, *, aircraft: str | None = None,
    doc_type: str | None = None, ata: str | None = None,
    category: str | None = None, es_reference: str | None = None,
    columns: Sequence[str] = SEARCH_COLUMNS,
) -> DataFrame:
    """Rows where a variant occurs; longer variants score higher.

    The test on the minimal variants runs first; the score is worked out from
    the best class downwards, only for rows that passed.
    """
    variants = query_variants(query)
    for column, part in (
        ("aircraft_registration", aircraft), ("ata_chapter", ata),
        ("category", category), ("es_reference", es_reference)):
        if part is not None:
            docs = docs.filter(F.col(column).ilike(f"%{part}%"))
    if doc_type is not None:
        docs = docs.filter(F.upper("doc_type") == doc_type.upper())

    def scored(low: dict[str, Column]) -> Column:
        score, upper = None, None
        for at_least, points in fv.VARIANT_SCORES:
            group = _minimal([
                v for v in variants
                if len(v) >= at_least and (upper is None or len(v) < upper)])
            upper = at_least
            if group:
                test = _matches(low, group)
                score = F.when(test, points) if score is None else score.when(test, points)
        return F.when(_matches(low, _minimal(variants)), score)

    lowered = F.struct(
        F.lower(F.concat_ws(_SEPARATOR, *columns)).alias("_all"),
        *[F.lower(c).alias(c) for c in columns if any(
            "%" in v or "_" in v for v in variants)])

    def of_row(row: Column) -> Column:
        names = [c for c in columns if any("%" in v or "_" in v for v in variants)]
        return scored({"*": row["_all"], **{c: row[c] for c in names}})

    # Inside the lambda the row is lower-cased once, not once per variant.
    score = F.get(F.transform(F.array(lowered), of_row), F.lit(0))
    return docs.select("id", score.alias("fts_score")).filter(
        F.col("fts_score").isNotNull())


def union_variant_hits(hits: DataFrame) -> DataFrame:
    """Best score per document over the hits of all variants."""
    return hits.groupBy("id").agg(F.max("score").alias("fts_score"))


def vector_search(
    docs: DataFrame, vector: Sequence[float], k: int,
    minimum: float = fv.MIN_SIMILARITY,
) -> DataFrame:
    """The k nearest rows above a minimum cosine similarity."""
    similar = docs.filter(F.col("embedding").isNotNull()).select(
        "id", cosine_literal("embedding", vector).alias("sem_score"))
    return similar.orderBy(F.desc("sem_score"), "id").limit(k).filter(
        F.col("sem_score") > minimum)


def hybrid_search(
    docs: DataFrame, query: str, vector: Sequence[float] | None, *,
    limit: int = 20, doc_type: str | None = None, aircraft: str | None = None,
    ata: str | None = None, category: str | None = None,
    es_reference: str | None = None,
) -> DataFrame:
    """All hits with their score, matched entities and snippet.

    The hits of both searches are merged before the documents are loaded, so
    only matching rows are joined and only they carry text.
    """
    text_hits = substring_search(
        docs, query, aircraft=aircraft, doc_type=doc_type, ata=ata,
        category=category, es_reference=es_reference)
    if vector is None:
        hits = text_hits.withColumn("sem_score", F.lit(0.0))
    else:
        near = vector_search(docs, vector, 3 * limit)
        hits = text_hits.join(near, "id", "full").select(
            "id", F.coalesce("fts_score", F.lit(0.0)).alias("fts_score"),
            F.coalesce("sem_score", F.lit(0.0)).alias("sem_score"))
    loaded = docs.drop("embedding").join(hits, "id")
    asked = query_entities(loaded.withColumn("query", F.lit(query)).select(
        "*", F.struct("es_reference").alias("_doc")).drop("es_reference"))
    doc_es = F.col("_doc.es_reference")
    weight = fv.HYBRID_WEIGHTS

    def number(reference: Column) -> Column:
        return F.regexp_replace(reference, r"(?i)^ES\s*0*", "")

    plane = F.upper("aircraft") == F.upper("aircraft_registration")
    reference = (number(F.col("es_reference")) == number(doc_es)) & (
        number(doc_es) != "")
    chapter = F.contains(F.col("ata_chapter"), F.col("ata"))

    def points(test: Column, name: str) -> Column:
        return F.when(test, weight[name]).otherwise(0.0)

    total = (
        F.col("fts_score") * weight["text"] + F.col("sem_score") * weight["vector"]
        + points(plane, "aircraft") + points(reference, "es") + points(chapter, "ata")
        + points(F.col("ocr_confidence") > 90, "ocr"))
    if doc_type is not None:
        total = total + points(
            F.contains(F.lower("doc_type"), F.lit(doc_type.lower())), "type")
    matched = F.array_compact(F.array(
        F.when(plane, F.concat(F.lit("Avion: "), "aircraft_registration")),
        F.when(reference, F.concat(F.lit("ES: "), doc_es)),
        F.when(chapter, F.concat(F.lit("ATA: "), "ata_chapter"))))
    return asked.select(
        "id", "filename", "doc_type", "aircraft_registration",
        doc_es.alias("es_reference"),
        rounded(F.least(total, F.lit(1.0)), 4).alias("score"),
        rounded(F.col("fts_score"), 4).alias("fts_score"),
        rounded(F.col("sem_score"), 4).alias("semantic_score"),
        matched.alias("matched_entities"),
        snippet("ocr_text", query).alias("snippet"))


def result_page(
    results: DataFrame, offset: int, limit: int, semantic: bool = True
) -> DataFrame:
    # The search runs once; the page and the total read its hits.
    results = stored(results, "hits")
    total = results.agg(F.count("*").alias("n")).scalar()
    return results.orderBy(F.desc("score"), "id").offset(offset).limit(limit).withColumns({
        "total": total, "mode": F.lit("hybrid" if semantic else "fts")})


# --- token search -----------------------------------------------------------


def with_tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tokens", search_tokens(
        "filename", ["aircraft_registration", "es_reference", "doc_type", "category"],
        "ocr_text"))


def token_search(docs: DataFrame, query: str, any_of: bool = False) -> DataFrame:
    """Rows whose tokens hold all (or any) of the query's words."""
    words = list(dict.fromkeys(query.lower().split()))
    if any_of:
        return docs.filter(F.arrays_overlap("tokens", F.array(*map(F.lit, words))))
    for word in words:
        docs = docs.filter(F.array_contains("tokens", word))
    return docs


def token_index(docs: DataFrame) -> DataFrame:
    """Inverted index rows (token, id), to be stored partitioned by token."""
    return docs.select(F.explode("tokens").alias("token"), "id")


def index_search(index: DataFrame, query: str) -> DataFrame:
    """Ids holding all words, from a stored index."""
    words = list(dict.fromkeys(query.lower().split()))
    return index.filter(F.col("token").isin(words)).groupBy("id").agg(
        F.countDistinct("token").alias("n")).filter(F.col("n") == len(words)).select("id")


# --- retrieval for answers --------------------------------------------------


def weighted_retrieval(
    docs: DataFrame, query: str, vector: Sequence[float] | None, k: int = 20
) -> DataFrame:
    """0.6 cosine + 0.4 share of query words found; words alone without a
    vector (then at least one word must occur)."""
    words = list(dict.fromkeys(query.lower().split()))
    hits = F.lit(0)
    for word in words:
        hits = hits + F.array_contains("tokens", word).cast("int")
    share = hits / F.lit(float(len(words)))
    if vector is None:
        scored = docs.select("*", share.alias("_s")).filter(F.col("_s") > 0)
    else:
        scored = docs.filter(
            F.col("embedding").isNotNull() & F.col("ocr_text").isNotNull()
        ).select("*", (
            cosine_literal("embedding", vector) * 0.6 + share * 0.4).alias("_s"))
    return scored.select("id", rounded(F.col("_s"), 6).alias("score")).orderBy(
        F.desc("score"), "id").limit(k)


def qa_sources(
    docs: DataFrame, vector: Sequence[float], k: int = 5, aircraft: str | None = None
) -> DataFrame:
    """Archived documents nearest to the question, in rank order."""
    if aircraft is not None:
        docs = docs.filter(F.col("aircraft_registration").ilike(f"%{aircraft}%"))
    kept = docs.filter(
        (F.col("status") == "ARCHIVED") & F.col("embedding").isNotNull()).withColumn(
        "similarity", rounded(cosine_literal("embedding", vector), 6)).drop("embedding")
    best = ranked(kept, [F.desc("similarity"), F.asc("id")], k)
    return best.filter(F.col("similarity") > fv.MIN_SIMILARITY)


def _title(doc_type: Column) -> Column:
    return F.coalesce(
        blank_to_null(F.initcap(F.replace(doc_type, F.lit("_"), F.lit(" ")))),
        F.lit("Inconnu"))


def qa_context(sources: DataFrame, top: int = 3, excerpt: int = 1000) -> DataFrame:
    """One text block from the best sources (a bounded number of rows)."""
    def or_na(name: str) -> Column:
        return F.coalesce(blank_to_null(name), F.lit("N/A"))

    preview = strip(F.replace(
        F.left(null_to_blank("ocr_text"), F.lit(excerpt)), F.lit("\n"), F.lit(" ")))
    block = F.concat(
        F.lit("[Doc "), "rank", F.lit("] "), "filename", F.lit("\nAvion: "),
        or_na("aircraft_registration"), F.lit(" | Type: "), _title(F.col("doc_type")),
        F.lit(" | Catégorie: "), or_na("category"), F.lit(" | Référence ES: "),
        or_na("es_reference"), F.lit("\nExtrait contenu: "),
        F.coalesce(blank_to_null(preview), F.lit("Texte non disponible")))
    parts = sources.filter(F.col("rank") <= top).select(
        F.struct("rank", block.alias("block")).alias("p"))
    return parts.agg(F.array_join(
        F.transform(F.sort_array(F.collect_list("p")), lambda p: p["block"]), "\n\n")
        .alias("context"))


def passage_context(
    passages: DataFrame, max_chars: int = 6000, excerpt: int = 600
) -> DataFrame:
    """Numbered passages in rank order while they fit into the budget."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    block = F.concat(
        F.lit("["), "rank", F.lit("] "), text("filename"), F.lit("\n    Type: "),
        text("doc_type"), F.lit(" | Avion: "), text("aircraft_registration"),
        F.lit(" | Catégorie: "), text("category"), F.lit(" | ATA: "),
        text("ata_chapter"), F.lit("\n    ES Ref: "), text("es_reference"),
        F.lit("\n    Extrait: "), F.left(null_to_blank("ocr_text"), F.lit(excerpt)),
        F.lit("\n"))
    kept = context_budget(
        passages.withColumn("block", block), [F.col("rank")], F.length("block"), max_chars)
    return kept.agg(
        F.count("*").alias("passages"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "block"))),
            lambda p: p["block"]), "\n").alias("context"))


def extractive_answer(sources: DataFrame, question: str) -> DataFrame:
    """Sentence built from the best source and the number of sources."""
    def or_na(column: Column) -> Column:
        return F.coalesce(blank_to_null(column), F.lit("N/A"))

    fields = [
        "rank", "filename", "aircraft_registration", "doc_type", "category",
        "es_reference", "similarity"]
    best = sources.agg(
        F.count("*").alias("n"), F.min(F.struct(*fields)).alias("s"))
    sentence = F.concat(
        "n", F.lit(f" document(s) pertinent(s) trouvé(s) pour '{question}'. "
                   "Document principal : "),
        "s.filename", F.lit(" — Avion "), or_na(F.col("s.aircraft_registration")),
        F.lit(", Type : "), _title(F.col("s.doc_type")), F.lit(", Catégorie : "),
        or_na(F.col("s.category")), F.lit(", Référence : "),
        or_na(F.col("s.es_reference")), F.lit("."))
    nothing = "Aucun document correspondant n'a été trouvé dans les archives."
    return best.select(
        F.when(F.col("n") == 0, nothing).otherwise(sentence).alias("answer"),
        F.col("n").alias("sources"),
        F.coalesce(rounded(F.col("s.similarity"), 2), F.lit(0.0)).alias("confidence"))
