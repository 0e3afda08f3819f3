"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import gaitworks.plans as _plans
from gaitworks.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__)):
    if _m.endswith("_queries"):
        importlib.import_module(f"gaitworks.plans.{_m}")

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["normalised_label_means"](spark, d)
