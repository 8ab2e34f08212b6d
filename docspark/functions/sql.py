"""SQL-callable twins of four column functions.

They are SQL functions, so a query that calls them stays inside the JVM and
the optimiser sees through them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from docspark import fixed_values as fv


def _case(subject: str, pairs) -> str:
    tests = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {subject} {tests} END"


def register_sql_functions(spark: SparkSession) -> None:
    suffixes = _case(
        "right(upper(trim(v)), 2)", [(r[-2:], r) for r in fv.FLEET_REGISTRATIONS])
    types = _case(
        "regexp_replace(upper(trim(v)), '[ -]', '_')", fv.TYPE_NAME_TO_VALUE.items())
    bodies = {
        "normalise_registration": suffixes,
        "normalise_doc_type": f"coalesce({types}, v)",
        "normalise_es": """CASE WHEN trim(v) = '' THEN '' ELSE coalesce(nullif(regexp_replace(
            regexp_replace(trim(v), '^[Ee][Ss][ ]*', ''), '^0+', ''), ''),
            CASE WHEN v IS NOT NULL THEN '0' END) END""",
        "check_letter": """coalesce(
            nullif(regexp_extract(upper(trim(v)), '_([ACD])$', 1), ''),
            nullif(regexp_extract(upper(trim(v)), 'CHECK ?([ACD])', 1), ''),
            nullif(regexp_extract(upper(trim(v)), '([ACD]) ?CHECK', 1), ''),
            nullif(regexp_extract(upper(trim(v)), '([ACD])$', 1), ''))""",
    }
    for name, body in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING RETURN {body}")
