"""Classification, evaluation and recognition queries (M, W8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import rounded
from docspark.functions.spans import annotate_spans
from docspark.functions.text import classifier_text
from docspark.operators import evaluation as ev
from docspark.operators import ocr_fusion as fuse
from docspark.operators import rules, training
from docspark.operators.filters import training_rows
from docspark.plans.functions import PROFILE_SQL, _q, _values
from docspark.plans.registry import plan
from docspark.session import stored
from docspark.sources.bindings import Tables

_PATH_CASE = " ".join(
    f"WHEN regexp_matches(p, {_q(r)}) THEN {_q(k)}" for r, k in fv.PATH_TYPE_RULES)
_SKIP = " OR ".join(f"contains(p, {_q(f)})" for f in fv.NON_INFORMATIVE_FOLDERS)
PATH_TYPE_SQL = f"CASE WHEN {_SKIP} THEN NULL {_PATH_CASE} END"


@plan("m01_classify_by_path", f"""
WITH d AS (SELECT id, lower(rel_path) AS p FROM cat_text) SELECT id, {PATH_TYPE_SQL} AS doc_type FROM d""")
def m01(t: Tables) -> DataFrame:
    return t.text("id", "rel_path").select(
        "id", rules.classify_by_path("rel_path").alias("doc_type"))


@plan("m02_classify_by_filename", """
SELECT id, CASE WHEN regexp_matches(filename, '(?i)^ES\\d{4,8}(\\.pdf)?$') THEN 'Work Order' END AS doc_type FROM cat_text""")
def m02(t: Tables) -> DataFrame:
    return t.documents("id", "filename").select(
        "id", rules.classify_by_filename("filename").alias("doc_type"))


_RULE_TYPES = _values((i, n, r["weight"]) for i, (n, r) in enumerate(fv.RULES.items()))
_RULE_ROWS = _values(
    [(n, "k", w) for n, r in fv.RULES.items() for w in r["keywords"]]
    + [(n, "f", w) for n, r in fv.RULES.items() for w in r["filename"]]
    + [(n, "p", w) for n, r in fv.RULES.items() for w in r["path"]])
_STRUCTURAL = ", ".join(map(_q, fv.STRUCTURAL_TYPES))
_DEFAULTS = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in fv.TYPE_TO_CATEGORY.items())


def _category_sql(kind: str, path: str) -> str:
    tests = " ".join(
        f"WHEN {' OR '.join(f'contains({path}, {_q(n)})' for n in needles)} THEN {_q(label)}"
        for needles, label in fv.CATEGORY_PATH_RULES)
    return (
        f"CASE WHEN {kind} IN ({_STRUCTURAL}) THEN CASE WHEN contains({path}, 'check c') OR contains({path}, 'check-c') THEN 'Check C' "
        f"WHEN contains({path}, 'check a') OR contains({path}, 'check-a') THEN 'Check A' ELSE CASE {kind} {_DEFAULTS} ELSE 'Other' END END "
        f"ELSE CASE {tests} ELSE CASE {kind} {_DEFAULTS} ELSE 'Other' END END END")


RULES_SQL = f"""
ty(o, label, w) AS (VALUES {_RULE_TYPES}), ru(label, kind, pat) AS (VALUES {_RULE_ROWS}),
dx AS (SELECT id, filename, sb_ad_reference, lower(rel_path) AS p, lower(lower(ocr_text) || ' FILENAME ' || lower(translate(filename, '-_.', '   '))
  || ' PATH ' || lower(replace(rel_path, '/', ' '))) AS body FROM cat_text),
hit AS (SELECT dx.id, ru.label, count(*) FILTER (WHERE kind = 'k' AND contains(body, pat)) AS k,
  count(*) FILTER (WHERE kind = 'f' AND regexp_matches(filename, '(?i)' || pat)) AS f,
  count(*) FILTER (WHERE kind = 'p' AND contains(p, pat)) AS pa FROM dx CROSS JOIN ru GROUP BY 1, 2),
sc AS (SELECT hit.id, ty.o, ty.label, round(least((k * 0.15::DOUBLE + f * 0.35::DOUBLE + pa * 0.5::DOUBLE) * ty.w::DOUBLE, 1.0), 6) AS s
  FROM hit JOIN ty ON ty.label = hit.label),
mx AS (SELECT id, label, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS rn FROM sc) WHERE rn = 1),
bo AS (SELECT mx.id, dx.p, CASE WHEN mx.label IN ({_STRUCTURAL}) OR coalesce(dx.sb_ad_reference, '') = '' THEN mx.label
    WHEN contains(upper(dx.p), 'AD') OR contains(upper(dx.filename), 'AD') THEN 'AD' WHEN contains(upper(dx.p), 'SB') THEN 'SB' ELSE mx.label END AS label,
  CASE WHEN mx.label IN ({_STRUCTURAL}) OR coalesce(dx.sb_ad_reference, '') = '' THEN mx.s
    WHEN contains(upper(dx.p), 'AD') OR contains(upper(dx.filename), 'AD') THEN greatest(mx.s, 0.85) WHEN contains(upper(dx.p), 'SB') THEN greatest(mx.s, 0.80)
    ELSE mx.s END AS s FROM mx JOIN dx ON dx.id = mx.id)"""


def _classifier_rows(t: Tables) -> DataFrame:
    return t.text("id", "filename", "rel_path", "ocr_text", "sb_ad_reference").select(
        "id", "filename", "rel_path", "sb_ad_reference",
        classifier_text("ocr_text", "filename", "rel_path").alias("classifier_text"))


@plan("m03_classify_by_rules", "WITH " + RULES_SQL.strip() + " SELECT id, label, s AS score FROM mx")
def m03(t: Tables) -> DataFrame:
    docs = _classifier_rows(t)
    scored = docs.withColumn("low", F.lower("classifier_text")).select(
        "id", F.struct(*[s.alias(f"s{i}") for i, s in enumerate(
            rules.rule_scores("low", "filename", "rel_path").values())]).alias("s"))
    best = rules.argmax_label({n: F.col(f"s.s{i}") for i, n in enumerate(fv.RULES)})
    return scored.select("id", best.alias("b")).select("id", "b.label", "b.score")


@plan("m04_reference_boost", "WITH " + RULES_SQL.strip() + f" SELECT id, label AS rule_type, RND[s;4] AS rule_score, {_category_sql('label', 'p')} AS rule_category FROM bo")
def m04(t: Tables) -> DataFrame:
    return rules.classify_by_rules(_classifier_rows(t)).select(
        "id", "rule_type", rounded(F.col("rule_score"), 4).alias("rule_score"),
        "rule_category")


@plan("m05_infer_category", f"SELECT id, {_category_sql('doc_type', 'lower(rel_path)')} AS category FROM cat_text")
def m05(t: Tables) -> DataFrame:
    return t.text("id", "doc_type", "rel_path").select(
        "id", rules.infer_category("doc_type", "rel_path").alias("category"))


_PROFILE_CASE = " ".join(
    f"WHEN {_q(k)} THEN {_q(v)}" for k, v in fv.PROFILE_TO_TYPE.items())
CASCADE_CTES = RULES_SQL.strip() + ",\n" + PROFILE_SQL.strip() + f""",
cs AS (SELECT bo.id, bo.p, {PATH_TYPE_SQL.replace('(p,', '(bo.p,')} AS bypath,
  CASE WHEN regexp_matches(dx.filename, '(?i)^ES\\d{{4,8}}(\\.pdf)?$') THEN 'Work Order' END AS byname,
  bo.label, bo.s, CASE pf.profile {_PROFILE_CASE} END AS prof FROM bo JOIN dx ON dx.id = bo.id JOIN pf ON pf.id = bo.id),
dc AS (SELECT id, p, prof, coalesce(bypath, byname, label) AS kind, CASE WHEN bypath IS NOT NULL THEN 1.0::DOUBLE WHEN byname IS NOT NULL THEN 0.97::DOUBLE ELSE RND[s;4] END AS confidence,
  CASE WHEN bypath IS NOT NULL THEN 'path' WHEN byname IS NOT NULL THEN 'filename' ELSE 'rules' END AS method FROM cs)"""
CASCADE_SELECT = f"""
SELECT id, CASE WHEN prof <> kind THEN prof ELSE kind END AS predicted_type,
  CASE WHEN prof <> kind THEN prof ELSE {_category_sql('kind', 'p')} END AS predicted_category, confidence,
  CASE WHEN prof <> kind THEN method || '+profile' ELSE method END AS method FROM dc"""


@plan("m06_classify_cascade", "WITH " + CASCADE_CTES + CASCADE_SELECT)
def m06(t: Tables) -> DataFrame:
    return rules.classify_cascade(_classifier_rows(t)).select(
        "id", "predicted_type", "predicted_category",
        rounded(F.col("confidence"), 4).alias("confidence"), "method")


_MODEL_CTES = CASCADE_CTES.replace(
    "coalesce(bypath, byname, label)", "coalesce(bypath, byname, CASE WHEN id % 3 = 0 THEN 'Specs' END, label)").replace(
    "ELSE RND[s;4] END AS confidence", "WHEN id % 3 = 0 THEN 0.8123::DOUBLE ELSE RND[s;4] END AS confidence").replace(
    "ELSE 'rules' END AS method", "WHEN id % 3 = 0 THEN 'model' ELSE 'rules' END AS method")


# A third of the documents come with a model's answer.
@plan("m06_classify_cascade_with_model", "WITH " + _MODEL_CTES + CASCADE_SELECT)
def m06_model(t: Tables) -> DataFrame:
    rows = _classifier_rows(t).withColumns({
        "model_type": F.when(F.col("id") % 3 == 0, "Specs"), "model_confidence": F.lit(0.81234)})
    return rules.classify_cascade(rows, model_type="model_type", model_confidence="model_confidence").select(
        "id", "predicted_type", "predicted_category",
        rounded(F.col("confidence"), 4).alias("confidence"), "method")


_KW_TYPES = _values((i, n) for i, n in enumerate(fv.KEYWORD_RULES))
_KW_ROWS = _values(
    [(n, "k", w) for n, r in fv.KEYWORD_RULES.items() for w in r["kw"]]
    + [(n, "f", w) for n, r in fv.KEYWORD_RULES.items() for w in r["fn"]])
KEYWORD_SQL = f"""
kt(o, label) AS (VALUES {_KW_TYPES}), kr(label, kind, pat) AS (VALUES {_KW_ROWS}),
kx AS (SELECT id, doc_type, lower(ocr_text) AS body, lower(filename) AS fn FROM cat_text),
ks AS (SELECT kx.id, kt.o, kt.label, sum(CASE WHEN kr.kind = 'k' THEN CASE WHEN contains(body, pat) THEN 1.0 ELSE 0 END + CASE WHEN contains(fn, pat) THEN 0.5 ELSE 0 END
  ELSE CASE WHEN contains(fn, pat) THEN 2.0 ELSE 0 END END) AS s FROM kx CROSS JOIN kr JOIN kt ON kt.label = kr.label GROUP BY 1, 2, 3),
kc AS (SELECT id, CASE WHEN s > 0 THEN label ELSE 'Unknown' END AS keyword_class FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS rn FROM ks) WHERE rn = 1)"""


@plan("m07_keyword_classifier", "WITH " + KEYWORD_SQL.strip() + " SELECT * FROM kc")
def m07(t: Tables) -> DataFrame:
    return rules.with_keyword_class(t.text("id", "filename", "ocr_text")).select(
        "id", "keyword_class")


@plan("w08_argmax_label", """
SELECT id, CASE WHEN ocr_confidence / 100 >= classifier_confidence AND ocr_confidence / 100 >= needs THEN 'ocr'
  WHEN classifier_confidence >= needs THEN 'classifier' ELSE 'size' END AS label,
  greatest(ocr_confidence / 100, classifier_confidence, needs) AS score
FROM (SELECT id, ocr_confidence, classifier_confidence, least(file_size_kb / 64, 1.0)::DOUBLE AS needs FROM cat_documents)""")
def w08(t: Tables) -> DataFrame:
    rows = t.documents("id", "ocr_confidence", "classifier_confidence", "file_size_kb")
    best = rules.argmax_label({
        "ocr": F.col("ocr_confidence") / 100,
        "classifier": F.col("classifier_confidence"),
        "size": F.least(F.col("file_size_kb") / 64, F.lit(1.0))})
    return rows.select("id", best.alias("b")).select("id", "b.label", "b.score")


# --- training (rows only) ---------------------------------------------------


def _labelled(t: Tables) -> DataFrame:
    docs = t.text("id", "filename", "rel_path", "doc_type", "ocr_text")
    return ev.stratified_split(training_rows(docs), "doc_type")


#: The most frequent words and pairs of words, as many as the described model.
_TERMS = {"hashed": False, "vocabulary": 50_000}


def _evaluated(t: Tables, **options) -> DataFrame:
    rows = _labelled(t)
    if options.get("with_entities"):
        rows = training.with_entity_vector(rows)
    model = training.train_text_classifier(rows.filter(~F.col("is_test")), **_TERMS, **options)
    return training.predict(model, rows.filter("is_test"))


def _scored(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        F.col("doc_type").alias("y_true"), F.col("predicted").alias("y_pred"))


@plan("m08_train_text_classifier")
def m08(t: Tables) -> DataFrame:
    return ev.classification_metrics(_scored(_evaluated(t)))


@plan("m09_train_linear_svc")
def m09(t: Tables) -> DataFrame:
    return ev.classification_metrics(
        _scored(_evaluated(t, linear_svc=True)))


@plan("m10_train_entity_augmented")
def m10(t: Tables) -> DataFrame:
    found = _evaluated(t, with_entities=True)
    return training.override_by_filename(found).groupBy("method", "predicted").agg(
        F.count("*").alias("documents"))


@plan("m12_reclassify_other")
def m12(t: Tables) -> DataFrame:
    docs = t.text("id", "doc_type", "ocr_text")
    model = training.train_text_classifier(training_rows(docs), **_TERMS)
    return training.reclassify_other(model, docs, min_confidence=0.70)


@plan("m18_compare_models")
def m18(t: Tables) -> DataFrame:
    # Both sides of the comparison read the predictions.
    model = stored(_evaluated(t), "predictions")
    keywords = rules.with_keyword_class(model.drop("predicted", "probability"))
    return ev.compare_models({
        "keywords": keywords.select(
            F.col("doc_type").alias("y_true"), F.col("keyword_class").alias("y_pred")),
        "text_model": _scored(model)}, baseline="keywords")


# --- evaluation -------------------------------------------------------------


@plan("m11_stratified_split", """
WITH h AS (SELECT id, doc_type, md5('42:' || id) AS h, count(*) OVER (PARTITION BY doc_type) AS n FROM cat_documents)
SELECT id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY h, id) <= round(n * 0.2::DOUBLE) AS is_test FROM h WHERE n >= 5""")
def m11(t: Tables) -> DataFrame:
    return ev.stratified_split(t.documents("id", "doc_type"), "doc_type")


_CLASS_SQL = """
lb AS (SELECT y_true AS label FROM cat_predictions UNION SELECT y_pred FROM cat_predictions),
cm AS (SELECT lb.label, (SELECT count(*) FROM cat_predictions WHERE y_true = lb.label) AS support,
  (SELECT count(*) FROM cat_predictions WHERE y_pred = lb.label) AS predicted,
  (SELECT count(*) FROM cat_predictions WHERE y_pred = lb.label AND y_true = lb.label) AS hits FROM lb),
pr AS (SELECT *, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS p, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS r FROM cm),
f1 AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""


@plan("m13_classification_report", "WITH " + _CLASS_SQL.strip()
      + " SELECT label, support, RND[p;4] AS precision, RND[r;4] AS recall, RND[f;4] AS f1 FROM f1")
def m13(t: Tables) -> DataFrame:
    return ev.classification_report(t.predictions())


@plan("m13_classification_metrics", "WITH " + _CLASS_SQL.strip() + """
SELECT CAST(sum(support) AS BIGINT) AS documents, RND[sum(hits) / sum(support)::DOUBLE;4] AS accuracy, RND[avg(f);4] AS f1_macro,
  RND[sum(f * support) / sum(support);4] AS f1_weighted, RND[sum(hits) / sum(support)::DOUBLE;4] AS f1_micro,
  RND[sum(p * support) / sum(support);4] AS precision_weighted, RND[sum(r * support) / sum(support);4] AS recall_weighted,
  RND[sum(CASE WHEN label = 'Unknown' THEN predicted ELSE 0 END) / sum(support)::DOUBLE * 100;2] AS unknown_pct FROM f1""")
def m13_metrics(t: Tables) -> DataFrame:
    return ev.classification_metrics(t.predictions())


@plan("m14_confusion_matrix", """
SELECT y_true, y_pred, count(*) AS n, RND[count(*) / sum(count(*)) OVER (PARTITION BY y_true)::DOUBLE * 100;1] AS row_pct
FROM cat_predictions GROUP BY y_true, y_pred""")
def m14(t: Tables) -> DataFrame:
    return ev.confusion_matrix(t.predictions())


@plan("m15_accuracy_by_confidence_bin", """
SELECT CASE WHEN coalesce(ocr_confidence, 0) <= 30 THEN '0-30%' WHEN ocr_confidence <= 50 THEN '30-50%' WHEN ocr_confidence <= 70 THEN '50-70%'
  WHEN ocr_confidence <= 85 THEN '70-85%' WHEN ocr_confidence <= 95 THEN '85-95%' ELSE '95-100%' END AS bin, count(*) AS documents,
  RND[count(*) FILTER (WHERE y_true = y_pred) / count(*)::DOUBLE * 100;2] AS correct_pct FROM cat_predictions GROUP BY 1""")
def m15(t: Tables) -> DataFrame:
    return ev.accuracy_by_confidence_bin(t.predictions())


@plan("m16_top_confusions", """
SELECT y_true, y_pred, count(*) AS n FROM cat_predictions WHERE y_true <> y_pred
GROUP BY y_true, y_pred ORDER BY n DESC, y_true, y_pred LIMIT 8""")
def m16(t: Tables) -> DataFrame:
    return ev.top_confusions(t.predictions())


@plan("m16_weak_classes", "WITH " + _CLASS_SQL.strip()
      + " SELECT label, support, RND[p;4] AS precision, RND[r;4] AS recall, RND[f;4] AS f1 FROM f1 WHERE f < 0.7")
def m16_weak(t: Tables) -> DataFrame:
    return ev.weak_classes(t.predictions())


@plan("m17_span_metrics", """
WITH g AS (SELECT id AS doc_id, unnest([0, 100]) AS start, unnest([10, 110]) AS "end", unnest([doc_type, lang]) AS label FROM cat_documents),
p AS (SELECT id AS doc_id, unnest([0, 100]) AS start, unnest([10, 105 + id % 2 * 5]) AS "end", unnest([CASE WHEN needs_review THEN 'Other' ELSE doc_type END, lang]) AS label FROM cat_documents),
j AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS ig, p.doc_id IS NOT NULL AS ip FROM g FULL JOIN p
  ON p.doc_id = g.doc_id AND p.start = g.start AND p."end" = g."end" AND p.label = g.label),
c AS (SELECT label, count(*) FILTER (WHERE ig AND ip) AS tp, count(*) FILTER (WHERE NOT ig) AS fp, count(*) FILTER (WHERE NOT ip) AS fn FROM j GROUP BY label),
s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM (
  SELECT label, tp, fp, fn FROM c UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c)),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM s)
SELECT label, tp, fp, fn, RND[p;4] AS precision, RND[r;4] AS recall, RND[f;4] AS f1 FROM f
UNION ALL SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), RND[avg(p);4], RND[avg(r);4], RND[avg(f);4] FROM f WHERE label <> 'micro'""")
def m17(t: Tables) -> DataFrame:
    docs = t.documents("id", "doc_type", "lang", "needs_review")

    def spans(end: str, label: str) -> DataFrame:
        return docs.select(F.col("id").alias("doc_id"), F.expr(f"""inline(array(
            named_struct('start', 0, 'end', 10, 'label', {label}),
            named_struct('start', 100, 'end', CAST({end} AS INT), 'label', lang)))"""))

    return ev.span_metrics(
        spans("110", "doc_type"),
        spans("105 + id % 2 * 5", "CASE WHEN needs_review THEN 'Other' ELSE doc_type END"))


@plan("m17_annotator_agreement")
def m17_annotators(t: Tables) -> DataFrame:
    # The spans within a model's window are some of all spans: one annotation
    # of the texts, written once, gives both sides.
    spans = stored(t.text("id", "ocr_text").select(
        F.col("id").alias("doc_id"), F.explode(annotate_spans()("ocr_text")).alias("s"),
    ).select("doc_id", "s.start", "s.end", "s.label"), "spans")
    limited = spans.filter(F.col("end") <= fv.SPAN_TEXT_LIMIT)
    return ev.span_metrics(spans, limited)


# --- recognition results ----------------------------------------------------

_BEST_SQL = """
be AS (SELECT document_id, page_no, engine, text, confidence, attempt FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_no, engine
  ORDER BY CASE WHEN confidence >= 75 THEN 0 ELSE 1 END, CASE WHEN confidence >= 75 THEN 0 ELSE -confidence END, attempt) AS rn FROM cat_page_ocr) WHERE rn = 1)"""
_FUSE_SQL = _BEST_SQL + """,
pv AS (SELECT document_id, page_no, max(text) FILTER (WHERE engine = 'tesseract') AS ta, max(confidence) FILTER (WHERE engine = 'tesseract') AS ca,
  max(text) FILTER (WHERE engine = 'opencv') AS tb, max(confidence) FILTER (WHERE engine = 'opencv') AS cb FROM be GROUP BY 1, 2),
ok AS (SELECT *, trim(ta) <> '' AND ca > 0 AS a, trim(tb) <> '' AND cb > 0 AS b FROM pv),
en AS (SELECT *, CASE WHEN NOT a AND NOT b THEN 'none' WHEN NOT b THEN 'tesseract' WHEN NOT a THEN 'opencv' WHEN ca >= 75 THEN 'tesseract'
  WHEN cb > ca + 10 THEN 'opencv' WHEN abs(ca - cb) <= 10 THEN 'fusion' ELSE 'tesseract' END AS engine FROM ok),
fu AS (SELECT document_id, page_no, engine, CASE engine WHEN 'none' THEN '' WHEN 'tesseract' THEN ta WHEN 'opencv' THEN tb ELSE ta || ' ' || tb END AS text,
  CASE engine WHEN 'none' THEN 0 WHEN 'tesseract' THEN ca WHEN 'opencv' THEN cb ELSE greatest(ca, cb) END AS confidence FROM en)"""


@plan("m19_best_engine_per_page", "WITH " + _BEST_SQL.strip() + " SELECT * FROM be")
def m19(t: Tables) -> DataFrame:
    return fuse.best_attempt_per_engine(t.page_ocr())


def _fused(t: Tables) -> DataFrame:
    return fuse.fuse_engines(fuse.best_attempt_per_engine(t.page_ocr()))


@plan("m20_fuse_engines", "WITH " + _FUSE_SQL.strip() + " SELECT * FROM fu")
def m20(t: Tables) -> DataFrame:
    return _fused(t)


@plan("m21_document_ocr_rollup", "WITH " + _FUSE_SQL.strip() + """,
ec AS (SELECT document_id, engine, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, engine) AS rn FROM fu GROUP BY 1, 2),
st AS (SELECT document_id, count(*) AS pages, coalesce(MEAN[CASE WHEN confidence > 0 THEN confidence END], 0) AS m, bool_or(trim(text) <> '') AS filled FROM fu GROUP BY 1)
SELECT st.document_id, pages, RND[m;2] AS confidence, ec.engine, m < 55 OR NOT filled AS needs_review FROM st JOIN ec ON ec.document_id = st.document_id AND rn = 1""")
def m21(t: Tables) -> DataFrame:
    return fuse.document_ocr_rollup(_fused(t))


@plan("m21_document_text", "WITH " + _FUSE_SQL.strip() + """
SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text
FROM fu WHERE trim(text) <> '' GROUP BY 1""")
def m21_text(t: Tables) -> DataFrame:
    return fuse.document_text(_fused(t))


@plan("m22_ocr_reprocess_delta", """
SELECT id, CASE WHEN new_confidence > coalesce(old_confidence, 0) THEN 'improved' WHEN new_confidence > 0 AND new_confidence < coalesce(old_confidence, 0) THEN 'degraded'
  ELSE 'unchanged' END AS change, NOT new_review AND old_review AS newly_accepted,
  CASE WHEN new_confidence > 0 THEN new_confidence ELSE coalesce(old_confidence, 0) END AS confidence,
  new_review OR (new_confidence > 0 AND new_confidence < 50) AS needs_review FROM cat_ocr_runs""")
def m22(t: Tables) -> DataFrame:
    return fuse.reprocess_delta(t.ocr_runs())


@plan("m23_compare_ocr_engines", "WITH " + _BEST_SQL.strip() + """,
pr AS (SELECT max(confidence) FILTER (WHERE engine = 'tesseract') AS a, max(confidence) FILTER (WHERE engine = 'opencv') AS b FROM be GROUP BY document_id, page_no)
SELECT count(*) AS pages, RND[MEAN[a];1] AS tesseract_avg, RND[MEAN[b];1] AS opencv_avg, RND[MEAN[b] - MEAN[a];1] AS improvement,
  RND[count(*) FILTER (WHERE b > a) / count(*)::DOUBLE * 100;1] AS second_better_pct FROM pr""")
def m23(t: Tables) -> DataFrame:
    return fuse.compare_engines(fuse.best_attempt_per_engine(t.page_ocr()))


_PARTS = """conv_id AS document_id, turn AS page_no,
  CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS native_text,
  CASE conv_id % 2 WHEN 0 THEN text ELSE '' END AS ocr_text,
  CAST(conv_id * 31 % 1001 AS DOUBLE) / 10 AS ocr_confidence"""


@plan("m21_assemble_pages", f"""
WITH p AS (SELECT {_PARTS} FROM conversations)
SELECT document_id, page_no, CASE WHEN ocr_text <> '' THEN ocr_text ELSE coalesce(native_text, '') END AS text,
  CASE WHEN ocr_text <> '' THEN ocr_confidence WHEN native_text <> '' THEN 97.0 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN ocr_text <> '' THEN 'tesseract' ELSE 'pdfplumber' END AS engine FROM p""")
def m21_pages(t: Tables) -> DataFrame:
    t.raw("conversations").createOrReplaceTempView("docspark_page_parts")
    return fuse.assemble_pages(t.spark.sql(f"SELECT {_PARTS} FROM docspark_page_parts"))


@plan("m23_engine_times", """
SELECT engine, count(DISTINCT (document_id, page_no)) AS pages, count(*) AS attempts,
  RND[MEAN[CAST(confidence * 7 % 50 AS DOUBLE) / 10];3] AS avg_seconds FROM cat_page_ocr GROUP BY engine""")
def m23_times(t: Tables) -> DataFrame:
    return fuse.engine_times(t.page_ocr().withColumn(
        "seconds", F.expr("CAST(confidence * 7 % 50 AS DOUBLE) / 10")))
