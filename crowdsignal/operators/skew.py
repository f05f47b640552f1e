"""Joins of many rows to one row per key where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No more than this many keys are ever broadcast by join_per_key.
MOST_HOT_KEYS = 10_000


def hot_keys(rows: DataFrame, key: str, rows_per_task: int = 50_000) -> DataFrame:
    """(key): the keys that hold more than ``max(rows_per_task, rows / MOST_HOT_KEYS)`` rows, of which there are MOST_HOT_KEYS at most.

    Nulls are no key. The rows of any other key fit in one task.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    limit = F.greatest(F.lit(float(rows_per_task)), rows.agg(F.count(F.lit(1)) / MOST_HOT_KEYS).scalar())
    return sizes.where(F.col("_size") > limit).select(key)


def join_per_key(rows: DataFrame, per_key: DataFrame, on: list[str], size: str, rows_per_task: int = 50_000) -> DataFrame:
    """Inner join of ``rows`` to ``per_key``, which has one row per key and in ``size`` the key's number of rows.

    Keys of more than ``max(rows_per_task, sum(size) / MOST_HOT_KEYS)`` rows are hot: as sizes add up to the
    total, there are at most MOST_HOT_KEYS of them, whatever the data. They are broadcast, so that their rows stay
    where they are; the rows of all other keys are shuffled, and none of these keys can fill a task.

    Null keys match nothing. Rows of keys that ``per_key`` lacks are dropped. Empty tables give an empty result.
    """
    limit = F.greatest(F.lit(float(rows_per_task)), per_key.agg(F.sum(size) / MOST_HOT_KEYS).scalar())
    hot = per_key.where(F.col(size) > limit)
    cold = per_key.where(F.col(size) <= limit)
    kept = [*rows.columns, *(c for c in per_key.columns if c not in on and c != size)]
    few = rows.join(F.broadcast(hot), on).select(*kept)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on).select(*kept)
    return few.unionByName(rest)
