"""Queries through stored indexes (R3, R4, R8, R10, L6, U1) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.basics import rounded
from docspark.indexes.tokens import TokenIndex
from docspark.indexes.trigrams import TrigramIndex
from docspark.indexes.vectors import VectorIndex
from docspark.operators import filters, search
from docspark.plans.functions import TOKENS_SQL
from docspark.plans.registry import plan
from docspark.plans.search import (
    _DOC_FIELDS, _NEAR_SQL, _R6, _SIM, QUERY, VECTOR, _any_match, _hits_sql, _tokens, question_vector)
from docspark import fixed_values as fv
from docspark.sources.bindings import Tables


def _vector_index(t: Tables, *payload: str) -> VectorIndex:
    return VectorIndex.build(t.documents("id", "embedding", *payload), payload=payload)


@plan("r04_index_search", """
WITH qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 5),
s AS (SELECT id, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS sim
  FROM cat_documents, qv WHERE embedding IS NOT NULL)
SELECT id, RND[sim;6] AS sem_score FROM (SELECT * FROM s ORDER BY sim DESC, id LIMIT 60) WHERE sim > 0.3""")
def r04_index(t: Tables) -> DataFrame:
    found = _vector_index(t).nearest(question_vector(t), 60, minimum=0.3)
    return found.select("id", rounded(F.col("similarity"), 6).alias("sem_score"))


@plan("l06_index_top_vectors", f"""
WITH s AS (SELECT id, {_SIM} AS sim FROM cat_documents WHERE embedding IS NOT NULL)
SELECT id, {_R6} AS sem_score FROM (SELECT * FROM s ORDER BY sim DESC, id LIMIT 25) WHERE sim > 0.1""")
def l06_index(t: Tables) -> DataFrame:
    found = _vector_index(t).nearest(VECTOR, 25, minimum=0.1)
    return found.select("id", rounded(F.col("similarity"), 6).alias("sem_score"))


# All rows whose id is divisible by 20 ask; all rows answer.
@plan("r04_index_batch", """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
s AS (SELECT q.id AS query_id, r.id, RND[list_dot_product(r.e, q.e) / (r.size * q.size);6] AS similarity
  FROM n q JOIN n r ON q.id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank, id, similarity
FROM s QUALIFY rank <= 10""")
def r04_batch(t: Tables) -> DataFrame:
    rows = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return VectorIndex.build(rows).nearest_of_each(queries, 10)


@plan("r10_index_sources", "WITH " + _NEAR_SQL.strip() + " SELECT id, rank, similarity FROM top")
def r10_index(t: Tables) -> DataFrame:
    index = _vector_index(t, "status")
    found = index.nearest(question_vector(t), 5, minimum=0.3, where=F.col("status") == "ARCHIVED")
    ranks = F.posexplode(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id"))))
    return found.withColumn("similarity", rounded(F.col("similarity"), 6)).agg(
        ranks.alias("p", "x")).select("x.id", (F.col("p") + 1).cast("int").alias("rank"), (-F.col("x.s")).alias("similarity"))


# Substrings --------------------------------------------------------------------


@plan("r03_index_search", "WITH " + _hits_sql() + " SELECT * FROM fts")
def r03_index(t: Tables) -> DataFrame:
    index = TrigramIndex.build(t.text(*_DOC_FIELDS), search.SEARCH_COLUMNS)
    return search.substring_search(index.candidates(search.minimal_variants(QUERY)), QUERY)


@plan("r03_index_contains", "SELECT id FROM cat_text WHERE contains(lower(ocr_text), 'linked wp es0010')")
def r03_contains(t: Tables) -> DataFrame:
    return TrigramIndex.build(t.text("id", "ocr_text"), ["ocr_text"]).containing("Linked WP ES0010").select("id")


# Two characters: the beginnings of trigrams.
@plan("r03_index_short_needle", "SELECT id FROM cat_text WHERE contains(lower(ocr_text), 'n9')")
def r03_short(t: Tables) -> DataFrame:
    return TrigramIndex.build(t.text("id", "ocr_text"), ["ocr_text"]).containing("N9").select("id")


@plan("u01_index_union", "WITH " + _hits_sql() + " SELECT * FROM fts")
def u01_index(t: Tables) -> DataFrame:
    index = TrigramIndex.build(t.text(*_DOC_FIELDS), search.SEARCH_COLUMNS)
    scores = F.array(*[
        F.struct(F.lit(v).alias("v"), F.lit(next(p for n, p in fv.VARIANT_SCORES if len(v) >= n)).alias("score"))
        for v in search.query_variants(QUERY)])
    hits = index.candidates(search.minimal_variants(QUERY)).withColumn("x", F.explode(scores)).filter(_any_match())
    return search.union_variant_hits(hits.select("id", "x.score"))


@plan("f04_index_search_within", """
SELECT id, filename, doc_type FROM cat_text WHERE contains(lower(filename), '0101')
  OR contains(lower(coalesce(aircraft_registration, '')), '0101') OR contains(lower(coalesce(es_reference, '')), '0101')
  OR contains(lower(doc_type), '0101')""")
def f04_index(t: Tables) -> DataFrame:
    columns = ["filename", "aircraft_registration", "es_reference", "doc_type"]
    index = TrigramIndex.build(t.documents("id", *columns), columns)
    return filters.search_within(index.candidates(["0101"]), "0101", columns).select("id", "filename", "doc_type")


# Tokens ------------------------------------------------------------------------


# Half of the documents, then the others, some taken off, some of these again.
@plan("r08_stored_index", f"""
SELECT id FROM cat_text WHERE list_contains({TOKENS_SQL}, 'linked') AND list_contains({TOKENS_SQL}, 'work')
  AND NOT (id % 10 = 6 AND id % 20 <> 16)""")
def r08_stored(t: Tables) -> DataFrame:
    docs = _tokens(t).select("id", "tokens")
    index = TokenIndex(t.spark)
    index.insert(docs.filter("id % 2 = 0"))
    index.insert(docs.filter("id % 2 = 1"))
    index.delete(t.documents("id").filter("id % 10 = 6"))
    index.insert(docs.filter("id % 20 = 16"))
    index.merge()
    return index.search("linked work").select("id")


@plan("r08_stored_index_any", f"""
SELECT id, CAST(list_contains({TOKENS_SQL}, 'rct') AS INT) + CAST(list_contains({TOKENS_SQL}, 'linked') AS INT) AS found
FROM cat_text WHERE list_contains({TOKENS_SQL}, 'rct') OR list_contains({TOKENS_SQL}, 'linked')""")
def r08_stored_any(t: Tables) -> DataFrame:
    index = TokenIndex(t.spark)
    index.insert(_tokens(t).select("id", "tokens"))
    return index.search("rct linked", any_of=True)
