"""Registry of queries: name, Spark plan, optional SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docspark.plans.oracle_views import mean, rounded, total, with_views
from docspark.sources.bindings import Tables


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


PLANS: dict[str, Plan] = {}


def _expand(sql: str) -> str:
    """Shorthands of the SQL twins: MEAN[x], TOTAL[x] and RND[x;digits]."""
    sql = re.sub(r"\bMEAN\[([^\]]+)\]", lambda m: mean(m.group(1)), sql)
    sql = re.sub(r"\bTOTAL\[([^\]]+)\]", lambda m: total(m.group(1)), sql)
    return re.sub(
        r"\bRND\[([^\[\]]+);(\d+)\]",
        lambda m: rounded(m.group(1), m.group(2)), sql)


def plan(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` is its independent twin."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = Plan(name, build, with_views(_expand(sql)) if sql else None)
        return build

    return register
