"""All queries of the engine's own operators, by name, with the SQL that each must equal."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from . import plans
from .plans.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    importlib.import_module(f"{plans.__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases fused from three observations each: overall confidence, conflicts and next action."""
    return QUERIES["fus05_07_cases"](spark, sf_dir)
