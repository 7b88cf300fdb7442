"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["tracking", "shaping", "mapping", "analysis", "patrols", "geometry", "forms"]


def _modules() -> list:
    return [import_module(f"faunaflow.jobs.{m}") for m in MODULES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_daily_movement"](spark, sf_dir)


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
