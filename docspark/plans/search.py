"""Search and retrieval queries (R, J13, L6, U1) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.basics import rounded
from docspark.functions.vectors import cosine_literal
from docspark.operators import search
from docspark.plans.functions import TOKENS_SQL, _first, _q, REGISTRATION_SQL
from docspark.plans.registry import plan
from docspark.sources.bindings import Tables
from docspark import fixed_values as fv

QUERY = "ES001042"
# A fixed question vector; its width is that of the given vectors.
VECTOR = [((i * 37) % 17 - 8) / 16.0 for i in range(64)]
_VEC_SQL = "[" + ", ".join(repr(v) for v in VECTOR) + "]::DOUBLE[]"
_SIM = (
    f"list_dot_product(embedding::DOUBLE[], {_VEC_SQL}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"
    f" * sqrt(list_dot_product({_VEC_SQL}, {_VEC_SQL})))")
_R6 = "CAST(round(CAST(sim AS DECIMAL(28,10)), 6) AS DOUBLE)"
_DOC_FIELDS = [
    "id", "filename", "ocr_text", "es_reference", "sb_ad_reference",
    "aircraft_registration", "work_order_number", "item_number", "part_number",
    "doc_type", "category", "ata_chapter", "ocr_confidence"]


@plan("j13_score_against_query", f"""
WITH s AS (SELECT id, {_SIM} AS sim FROM cat_documents WHERE embedding IS NOT NULL)
SELECT id, {_R6} AS similarity FROM s""")
def j13(t: Tables) -> DataFrame:
    rows = t.documents("id", "embedding").filter("embedding IS NOT NULL")
    return rows.select(
        "id", rounded(cosine_literal("embedding", VECTOR), 6).alias("similarity"))


@plan("l06_top_vectors", f"""
WITH s AS (SELECT id, {_SIM} AS sim FROM cat_documents WHERE embedding IS NOT NULL)
SELECT id, {_R6} AS sem_score FROM (SELECT * FROM s ORDER BY sim DESC, id LIMIT 25) WHERE sim > 0.1""")
def l06(t: Tables) -> DataFrame:
    return search.vector_search(
        t.documents("id", "embedding"), VECTOR, 25, minimum=0.1).withColumn(
        "sem_score", rounded(F.col("sem_score"), 6))


@plan("r01_query_entities", f"""
WITH q AS (SELECT item_id, text AS ocr_text, '' AS filename FROM benchmark)
SELECT item_id, {REGISTRATION_SQL} AS aircraft, {_first('upper(ocr_text)', fv.ENTITY_PATTERNS['es_reference'])} AS es_reference,
  {_first('upper(ocr_text)', fv.ENTITY_PATTERNS['ata_chapter'])} AS ata,
  {_first('upper(ocr_text)', fv.ENTITY_PATTERNS['work_order_number'])} AS work_order FROM q""")
def r01(t: Tables) -> DataFrame:
    queries = t.raw("benchmark").select("item_id", F.col("text").alias("query"))
    return search.query_entities(queries).drop("query")


@plan("r02_query_variants", """
WITH q AS (SELECT id, coalesce(es_reference, doc_type) AS query FROM cat_documents),
n AS (SELECT id, query, regexp_extract(query, '(?i)^ES\\s*0*(\\d+)$', 1) AS num FROM q),
w AS (SELECT id, query, num, unnest(range(0, 18)) AS i FROM n),
v AS (SELECT id, i, CASE WHEN i = 0 THEN query WHEN num = '' THEN NULL WHEN i = 1 THEN num
  ELSE CASE WHEN i % 2 = 0 THEN 'ES' ELSE 'ES ' END || CASE WHEN length(num) >= i // 2 THEN num ELSE lpad(num, CAST(i // 2 AS INT), '0') END END AS v FROM w),
d AS (SELECT id, v, min(i) AS i FROM v WHERE v IS NOT NULL GROUP BY id, v)
SELECT id, string_agg(v, '|' ORDER BY i) AS variants FROM d GROUP BY id""")
def r02(t: Tables) -> DataFrame:
    query = F.coalesce("es_reference", "doc_type")
    return t.documents("id", "es_reference", "doc_type").select(
        "id", F.array_join(search.query_variants_column(query), "|").alias("variants"))


def _hits_sql(extra: str = "") -> str:
    rows = ", ".join(
        f"({_q(v)}, {0.9 if len(v) >= 8 else 0.7 if len(v) >= 5 else 0.5}::DOUBLE)"
        for v in search.query_variants(QUERY))
    test = " OR ".join(f"d.{c} ILIKE '%' || v.v || '%'" for c in search.SEARCH_COLUMNS)
    return (
        f"v(v, s) AS (VALUES {rows}), fts AS (SELECT d.id, max(v.s) AS fts_score FROM cat_text d, v "
        f"WHERE ({test}) {extra} GROUP BY d.id)")


@plan("r03_substring_search", "WITH " + _hits_sql() + " SELECT * FROM fts")
def r03(t: Tables) -> DataFrame:
    return search.substring_search(t.text(*_DOC_FIELDS), QUERY)


@plan("r03_substring_search_filtered", "WITH " + _hits_sql(
    "AND d.aircraft_registration ILIKE '%TS-IN%' AND upper(d.doc_type) = 'WORK ORDER' AND d.ata_chapter ILIKE '%2%'")
    + " SELECT * FROM fts")
def r03_filtered(t: Tables) -> DataFrame:
    return search.substring_search(
        t.text(*_DOC_FIELDS), QUERY, aircraft="TS-IN", doc_type="work order", ata="2")


@plan("r03_substring_search_by_reference", "WITH " + _hits_sql(
    "AND d.category ILIKE '%check%' AND d.es_reference ILIKE '%10%'") + " SELECT * FROM fts")
def r03_reference(t: Tables) -> DataFrame:
    return search.substring_search(
        t.text(*_DOC_FIELDS, "category"), QUERY, category="check", es_reference="10")


@plan("u01_union_variant_hits", "WITH " + _hits_sql() + " SELECT * FROM fts")
def u01(t: Tables) -> DataFrame:
    docs = t.text(*_DOC_FIELDS)
    scores = F.array(*[
        F.struct(F.lit(v).alias("v"), F.lit(
            next(p for n, p in fv.VARIANT_SCORES if len(v) >= n)).alias("score"))
        for v in search.query_variants(QUERY)])
    hits = docs.withColumn("x", F.explode(scores)).filter(F.lit(False) | _any_match())
    return search.union_variant_hits(hits.select("id", "x.score"))


def _any_match():
    test = F.lit(False)
    for column in search.SEARCH_COLUMNS:
        test = test | F.coalesce(
            F.contains(F.lower(column), F.lower("x.v")), F.lit(False))
    return test


@plan("r04_vector_search", f"""
WITH s AS (SELECT id, {_SIM} AS sim FROM cat_documents WHERE embedding IS NOT NULL)
SELECT id, {_R6} AS sem_score FROM (SELECT * FROM s ORDER BY sim DESC, id LIMIT 60) WHERE sim > 0.3""")
def r04(t: Tables) -> DataFrame:
    return search.vector_search(t.documents("id", "embedding"), VECTOR, 60).withColumn(
        "sem_score", rounded(F.col("sem_score"), 6))


_HYBRID_SQL = "WITH " + _hits_sql() + f""",
sem AS (SELECT id, sim FROM (SELECT id, {_SIM} AS sim FROM cat_documents WHERE embedding IS NOT NULL ORDER BY sim DESC, id LIMIT 60) WHERE sim > 0.3),
h AS (SELECT coalesce(f.id, s.id) AS id, coalesce(f.fts_score, 0) AS fts, coalesce(s.sim, 0) AS sem FROM fts f FULL JOIN sem s ON s.id = f.id),
b AS (SELECT d.*, h.fts, h.sem, regexp_replace(d.es_reference, '(?i)^ES\\s*0*', '') = '1042' AS es_hit FROM h JOIN cat_text d ON d.id = h.id),
p AS (SELECT *, coalesce(nullif(instr(lower(ocr_text), 'es001042'), 0), nullif(instr(lower(ocr_text), '1042'), 0)) - 1 AS pos FROM b),
x AS (SELECT *, least(1.0, 0.5 * fts + 0.5 * sem + CASE WHEN es_hit THEN 0.25 ELSE 0 END + CASE WHEN ocr_confidence > 90 THEN 0.05 ELSE 0 END)::DOUBLE AS raw FROM p),
res AS (SELECT id, filename, doc_type, aircraft_registration, es_reference, RND[raw;4] AS score, RND[fts;4] AS fts_score, RND[sem;4] AS semantic_score,
  CASE WHEN es_hit THEN 'ES: ' || es_reference ELSE '' END AS matched,
  CASE WHEN pos IS NULL THEN left(ocr_text, 200) || '...' ELSE
    CASE WHEN pos > 100 THEN '…' ELSE '' END
    || regexp_replace(replace(substr(ocr_text, greatest(pos - 100, 0) + 1, least(pos + 100, length(ocr_text)) - greatest(pos - 100, 0)), chr(10), ' '), '^\\s+|\\s+$', '', 'g')
    || CASE WHEN pos + 100 < length(ocr_text) THEN '…' ELSE '' END END AS snippet FROM x)"""


def _hybrid(t: Tables) -> DataFrame:
    docs = t.text(*_DOC_FIELDS, "embedding")
    return search.hybrid_search(docs, QUERY, VECTOR, limit=20)


@plan("r05_hybrid_search", _HYBRID_SQL + " SELECT id, filename, doc_type, aircraft_registration, es_reference, score, fts_score, semantic_score, matched FROM res")
def r05(t: Tables) -> DataFrame:
    return _hybrid(t).withColumn(
        "matched", F.array_join("matched_entities", "|")).drop(
        "matched_entities", "snippet")


def _bonus_sql(query: str, points: float, bonus: str, matched: str, extra: str = "") -> str:
    """Hybrid search for a query of one spelling, with its bonus."""
    test = " OR ".join(f"{c} ILIKE '%{query}%'" for c in search.SEARCH_COLUMNS)
    return f"""
WITH qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 5),
fts AS (SELECT id, {points}::DOUBLE AS fts FROM cat_text WHERE ({test}) {extra}),
sim0 AS (SELECT id, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS sim
  FROM cat_documents, qv WHERE embedding IS NOT NULL),
sem AS (SELECT id, sim FROM (SELECT * FROM sim0 ORDER BY sim DESC, id LIMIT 60) WHERE sim > 0.3),
h AS (SELECT coalesce(f.id, s.id) AS id, coalesce(f.fts, 0) AS fts, coalesce(s.sim, 0) AS sem FROM fts f FULL JOIN sem s ON s.id = f.id)
SELECT d.id, RND[least(1.0, 0.5 * h.fts + 0.5 * h.sem + {bonus} + CASE WHEN d.ocr_confidence > 90 THEN {fv.HYBRID_WEIGHTS['ocr']} ELSE 0 END)::DOUBLE;4] AS score,
  RND[h.fts;4] AS fts_score, RND[h.sem;4] AS semantic_score, {matched} AS matched FROM h JOIN cat_text d ON d.id = h.id"""


def _bonus(t: Tables, query: str, **options) -> DataFrame:
    found = search.hybrid_search(t.text(*_DOC_FIELDS, "embedding"), query, question_vector(t), limit=20, **options)
    return found.select(
        "id", "score", "fts_score", "semantic_score", F.array_join("matched_entities", "|").alias("matched"))


_PLANE = "upper(d.aircraft_registration) = 'TS-INC'"


@plan("r05_hybrid_search_aircraft", _bonus_sql(
    "TS-INC", 0.7,
    f"CASE WHEN {_PLANE} THEN {fv.HYBRID_WEIGHTS['aircraft']} ELSE 0 END + CASE WHEN contains(lower(d.doc_type), 'work order') THEN {fv.HYBRID_WEIGHTS['type']} ELSE 0 END",
    f"CASE WHEN {_PLANE} THEN 'Avion: ' || d.aircraft_registration ELSE '' END", "AND upper(doc_type) = 'WORK ORDER'"))
def r05_aircraft(t: Tables) -> DataFrame:
    return _bonus(t, "TS-INC", doc_type="work order")


_CHAPTER = "contains(d.ata_chapter, '27')"


@plan("r05_hybrid_search_chapter", _bonus_sql(
    "ATA 27", 0.7, f"CASE WHEN {_CHAPTER} THEN {fv.HYBRID_WEIGHTS['ata']} ELSE 0 END",
    f"CASE WHEN {_CHAPTER} THEN 'ATA: ' || d.ata_chapter ELSE '' END"))
def r05_chapter(t: Tables) -> DataFrame:
    return _bonus(t, "ATA 27")


@plan("r06_snippet", _HYBRID_SQL + " SELECT id, snippet FROM res")
def r06(t: Tables) -> DataFrame:
    return _hybrid(t).select("id", "snippet")


@plan("r07_result_page", _HYBRID_SQL + """
 SELECT id, score, (SELECT count(*) FROM res) AS total, 'hybrid' AS mode FROM res ORDER BY score DESC, id LIMIT 10 OFFSET 5""")
def r07(t: Tables) -> DataFrame:
    return search.result_page(_hybrid(t).select("id", "score"), 5, 10)


def _tokens(t: Tables, *more: str) -> DataFrame:
    return search.with_tokens(t.text(
        "id", "filename", "aircraft_registration", "es_reference", "doc_type",
        "category", "ocr_text", *more))


@plan("r08_token_search", f"""
SELECT id FROM cat_text WHERE list_contains({TOKENS_SQL}, 'check') AND list_contains({TOKENS_SQL}, 'rct')""")
def r08(t: Tables) -> DataFrame:
    return search.token_search(_tokens(t), "check rct").select("id")


@plan("r08_index_search", f"""
SELECT id FROM cat_text WHERE list_contains({TOKENS_SQL}, 'linked') AND list_contains({TOKENS_SQL}, 'work')""")
def r08_index(t: Tables) -> DataFrame:
    return search.index_search(search.token_index(_tokens(t)), "linked work")


@plan("r09_weighted_retrieval", f"""
WITH s AS (SELECT id, 0.6::DOUBLE * ({_SIM}) + 0.4::DOUBLE * ((CASE WHEN list_contains({TOKENS_SQL}, 'check') THEN 1 ELSE 0 END
  + CASE WHEN list_contains({TOKENS_SQL}, 'linked') THEN 1 ELSE 0 END) / 2.0::DOUBLE) AS sim
  FROM cat_text WHERE embedding IS NOT NULL)
SELECT id, {_R6} AS score FROM s ORDER BY score DESC, id LIMIT 20""")
def r09(t: Tables) -> DataFrame:
    return search.weighted_retrieval(_tokens(t, "embedding"), "check linked", VECTOR)


@plan("r09_text_retrieval", f"""
WITH s AS (SELECT id, ((CASE WHEN list_contains({TOKENS_SQL}, 'check') THEN 1 ELSE 0 END
  + CASE WHEN list_contains({TOKENS_SQL}, 'linked') THEN 1 ELSE 0 END) / 2.0::DOUBLE) AS sim FROM cat_text)
SELECT id, {_R6} AS score FROM s WHERE sim > 0 ORDER BY score DESC, id LIMIT 20""")
def r09_text(t: Tables) -> DataFrame:
    return search.weighted_retrieval(_tokens(t), "check linked", None)


# Question vector near the stored ones, so that sources exist.
_NEAR_SQL = """
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 5),
src0 AS (SELECT d.*, list_dot_product(d.embedding::DOUBLE[], q) / (sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS sim
  FROM cat_text d, qv WHERE d.embedding IS NOT NULL AND d.status = 'ARCHIVED'),
src AS (SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INT) AS rank FROM (SELECT *, RND[sim;6] AS similarity FROM src0)),
top AS (SELECT * FROM src WHERE rank <= 5 AND similarity > 0.3)"""


def question_vector(t: Tables) -> list[float]:
    """One stored vector, as an embedding model would deliver it."""
    row = t.raw("embeddings").filter("vec_id = 5").select("embedding").first()
    return [float(x) for x in row[0]]


def _sources(t: Tables, aircraft: str | None = None) -> DataFrame:
    docs = t.text(
        "id", "filename", "doc_type", "category", "aircraft_registration",
        "es_reference", "ata_chapter", "status", "ocr_text", "embedding")
    return search.qa_sources(docs, question_vector(t), aircraft=aircraft)


@plan("r10_qa_sources", "WITH " + _NEAR_SQL.strip() + " SELECT id, rank, similarity FROM top")
def r10(t: Tables) -> DataFrame:
    return _sources(t).select("id", "rank", "similarity")


@plan("r10_qa_sources_of_aircraft", "WITH " + _NEAR_SQL.strip().replace(
    "d.status = 'ARCHIVED'", "d.status = 'ARCHIVED' AND d.aircraft_registration ILIKE '%TS-INF%'")
    + " SELECT id, rank, similarity FROM top")
def r10_aircraft(t: Tables) -> DataFrame:
    return _sources(t, "ts-inf").select("id", "rank", "similarity")


@plan("r11_qa_context", "WITH " + _NEAR_SQL.strip() + """,
bl AS (SELECT rank, '[Doc ' || rank || '] ' || filename || chr(10) || 'Avion: ' || coalesce(aircraft_registration, 'N/A') || ' | Type: '
  || CASE doc_type WHEN 'AD' THEN 'Ad' WHEN 'SB' THEN 'Sb' WHEN 'RCT' THEN 'Rct' ELSE doc_type END || ' | Catégorie: ' || coalesce(category, 'N/A')
  || ' | Référence ES: ' || coalesce(es_reference, 'N/A') || chr(10) || 'Extrait contenu: '
  || coalesce(nullif(regexp_replace(replace(left(ocr_text, 1000), chr(10), ' '), '^\\s+|\\s+$', '', 'g'), ''), 'Texte non disponible') AS b FROM top WHERE rank <= 3)
SELECT coalesce(string_agg(b, chr(10) || chr(10) ORDER BY rank), '') AS context FROM bl""")
def r11(t: Tables) -> DataFrame:
    return search.qa_context(_sources(t))


@plan("r12_passage_context", """
WITH p AS (SELECT *, CAST(row_number() OVER (ORDER BY ocr_confidence DESC, id) AS INT) AS rank FROM cat_text),
bl AS (SELECT rank, '[' || rank || '] ' || filename || chr(10) || '    Type: ' || doc_type || ' | Avion: ' || coalesce(aircraft_registration, 'None')
  || ' | Catégorie: ' || coalesce(category, 'None') || ' | ATA: ' || coalesce(ata_chapter, 'None') || chr(10) || '    ES Ref: ' || coalesce(es_reference, 'None')
  || chr(10) || '    Extrait: ' || left(ocr_text, 600) || chr(10) AS b FROM p),
u AS (SELECT *, sum(length(b)) OVER (ORDER BY rank) AS used FROM bl)
SELECT count(*) AS passages, string_agg(b, chr(10) ORDER BY rank) AS context FROM u WHERE used <= 6000""")
def r12(t: Tables) -> DataFrame:
    rows = t.text(
        "id", "filename", "doc_type", "category", "aircraft_registration",
        "es_reference", "ata_chapter", "ocr_text", "ocr_confidence")
    passages = search.ranked(rows, [F.desc("ocr_confidence"), F.asc("id")], 20)
    return search.passage_context(passages)


@plan("r13_extractive_answer", "WITH " + _NEAR_SQL.strip() + """
SELECT CASE WHEN count(*) = 0 THEN 'Aucun document correspondant n''a été trouvé dans les archives.' ELSE count(*) || ' document(s) pertinent(s) trouvé(s) pour ''check C''. Document principal : ' || arg_min(filename, rank) || ' — Avion '
  || coalesce(arg_min(coalesce(aircraft_registration, 'N/A'), rank), 'N/A') || ', Type : '
  || arg_min(CASE doc_type WHEN 'AD' THEN 'Ad' WHEN 'SB' THEN 'Sb' WHEN 'RCT' THEN 'Rct' ELSE doc_type END, rank)
  || ', Catégorie : ' || arg_min(coalesce(category, 'N/A'), rank) || ', Référence : ' || arg_min(coalesce(es_reference, 'N/A'), rank) || '.' END AS answer,
  count(*) AS sources, coalesce(RND[max(similarity);2], 0) AS confidence FROM top""")
def r13(t: Tables) -> DataFrame:
    return search.extractive_answer(_sources(t), "check C")
