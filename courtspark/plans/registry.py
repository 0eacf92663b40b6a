"""All registered queries of the tracking engine by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Tables, with_views

MODULES = ("maintenance", "tracking", "statistics", "reports", "models", "plays", "clusters")


def _plans() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    return {k: v for m in MODULES for k, v in import_module(f"courtspark.plans.{m}").PLANS.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for k, (f, _) in _plans().items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_views(s) for k, (_, s) in _plans().items() if s}
