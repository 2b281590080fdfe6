"""Checks of the declared model as tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.operators.validation import orphans
from hirelens.schemas import FOREIGN_KEYS


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def violations(entities: dict[str, DataFrame]) -> DataFrame:
    """J8 over all declared foreign keys: (child, id, key, parent, missing)."""
    found = [orphans(entities[c], k, entities[p]).select(F.lit(c).alias("child"), "id", F.lit(k).alias("key"), F.lit(p).alias("parent"), F.col(k).alias("missing")) for c, keys in FOREIGN_KEYS.items() for k, p in keys if c in entities and p in entities]
    return union(found)
