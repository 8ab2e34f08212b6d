"""Registered queries with their SQL twins."""

import importlib

from docspark.plans.registry import PLANS, Plan, plan

for _group in (
    "aggregates", "filters", "joins", "windows", "functions", "search",
    "classification", "maintenance", "io", "streams", "indexes", "ingest", "changes",
):
    importlib.import_module(f"docspark.plans.{_group}")

__all__ = ["PLANS", "Plan", "plan"]
