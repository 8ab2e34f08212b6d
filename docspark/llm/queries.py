"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.llm.ball_tree_search import SQL as SEARCH_SQL
from docspark.llm.ball_tree_search import lexical_search
from docspark.llm.decontaminate import contamination_report
from docspark.llm.html_text import main_text
from docspark.llm.jaccard_join import jaccard_components
from docspark.llm.line_dedup import SQL as LINES_SQL
from docspark.llm.line_dedup import line_report
from docspark.llm.lm_scoring import lm_scores
from docspark.llm.quality_classifier import quality_scores
from docspark.llm.quality_rules import SQL as QUALITY_SQL
from docspark.llm.quality_rules import quality_verdicts
from docspark.llm.secrets import secret_report
from docspark.llm.source_mix import SQL as MIX_SQL
from docspark.llm.source_mix import mix_report
from docspark.llm.url_filter import url_verdicts
from docspark.llm.warc import SQL as WARC_SQL
from docspark.llm.warc import warc_round_trip
from docspark.llm.whitening import whitening_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"), n_words=3, num=90, den=100)


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(_table(spark, folder, "documents"))


ORACLE_SQL["op1_quality_rules"] = QUALITY_SQL


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contamination_report(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark"), window=10)


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(_table(spark, folder, "documents"))


ORACLE_SQL["op8_line_dedup"] = LINES_SQL


@query
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(_table(spark, folder, "documents"))


ORACLE_SQL["op6_source_mix"] = MIX_SQL


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(_table(spark, folder, "pages"))


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(_table(spark, folder, "documents"))


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc_round_trip(_table(spark, folder, "pages"))


ORACLE_SQL["op3_warc"] = WARC_SQL


@query
def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(_table(spark, folder, "pages"))


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening_report(_table(spark, folder, "embeddings"), components=4)


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=50)


ORACLE_SQL["op12_lexical_search"] = SEARCH_SQL


@query
def op13_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(_table(spark, folder, "documents"))
