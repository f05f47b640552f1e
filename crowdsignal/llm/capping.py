"""Capping records per contributor by quality-weighted reservoir sampling without replacement (problem 3).

Every record draws an exponential key scaled by its score: with a uniform u, ``E = -log(u)`` and the weight ``w``, the
records of smallest ``E / w`` form a weighted sample without replacement. Keys are kept on a log scale, where the
largest ``log(w) - temperature * log(E)`` win. The temperature says how much chance there is: 1 is the weighted sample;
towards 0 the weights decide more and more. Its limit is the order by weight first and by ``-E`` among equal weights, which is what
temperature 0 takes. There u falls as ids grow, so that of equal scores the smaller id has the smaller E and is kept first.

Otherwise ``u`` comes from a hash of seed and id. In both cases a task that runs again draws the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crowdsignal.operators.skew import hot_keys
from crowdsignal.session import staged

_BITS = 52  # of a drawn number


def hashed_draw(id_: Column, seed: int) -> Column:
    """A uniform number in (0, 1) from the MD5 of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"))), 1, _BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def ordered_draw(id_: Column, kind: str) -> Column:
    """A number in (0, 1) that never grows with the id: one less its first six bytes as a fraction, or less a whole number's place in its range."""
    if kind == "string":
        digits = F.rpad(F.substring(F.hex(id_), 1, 12), 12, "0")
        return (float(1 << 48) - 0.5 - F.conv(digits, 16, 10).cast("double")) / float(1 << 48)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return 0.5 - id_.cast("double") / 2.0**64
    return F.lit(0.5)


def reservoir_keys(score: Column, id_: Column, kind: str, temperature: float, seed: int = 0) -> tuple[Column, Column]:
    """A record's key and what decides between equal keys; larger ones are kept first. The key is null for a missing score, which ranks last.

    The weight is ``score + 1``, and scores below 0 weigh as 0; at temperature 0 the score itself stands for the logarithm of its
    weight, as it has the same order without rounding.
    """
    exponential = -F.log(ordered_draw(id_, kind) if temperature == 0 else hashed_draw(id_, seed))
    if temperature == 0:
        return score, -exponential
    weighed = F.log1p(F.greatest(score, F.lit(0.0))) - F.lit(float(temperature)) * F.log(exponential)
    return F.when(score.isNotNull(), weighed), -exponential


def _marked(records: DataFrame, contributor: str, score: str, id_: str, cap: int, temperature: float, seed: int, rows_per_task: int) -> DataFrame:
    """The records of somebody, with ``__cap_over``: whether they are beyond their contributor's cap.

    The keyed records are written once. Most contributors' records fit in one task, where they are counted off in order. Those of
    contributors who hold too many stay where they are: at most ``cap`` records of each leave a task, by a rank filter that Spark
    applies before the shuffle, to find the last one to be kept, which is broadcast for at most MOST_HOT_KEYS contributors.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    key, luck = reservoir_keys(F.col(score), F.col(id_), dict(records.dtypes)[id_], temperature, seed)
    keyed = staged(records.where(F.col(contributor).isNotNull()).withColumns({"__cap_key": key, "__cap_luck": luck}), "keyed")
    hot = F.broadcast(hot_keys(keyed, contributor, rows_per_task))
    best = W.partitionBy(contributor).orderBy(F.col("__cap_key").desc_nulls_last(), F.col("__cap_luck").desc(), F.col(id_).asc())
    few = keyed.join(hot, contributor, "left_anti").withColumn("__cap_over", F.rank().over(best) > cap)
    many = keyed.join(hot, contributor, "left_semi")
    last = many.select(contributor, "__cap_key", "__cap_luck", id_).withColumn("__cap_place", F.row_number().over(best)).where(F.col("__cap_place") == cap)
    last = last.select(contributor, F.col("__cap_key").alias("__last_key"), F.col("__cap_luck").alias("__last_luck"), F.col(id_).alias("__last_id"))
    same = F.col("__cap_key").eqNullSafe(F.col("__last_key"))
    worse = (
        (F.col("__cap_key") < F.col("__last_key"))
        | (F.col("__cap_key").isNull() & F.col("__last_key").isNotNull())
        | (same & (F.col("__cap_luck") < F.col("__last_luck")))
        | (same & (F.col("__cap_luck") == F.col("__last_luck")) & (F.col(id_) > F.col("__last_id")))
    )
    many = many.join(F.broadcast(last), contributor, "left").withColumn("__cap_over", F.coalesce(worse, F.lit(False)))
    shown = [F.col(f"`{c}`") for c in records.columns]
    return few.select(*shown, "__cap_over").unionByName(many.select(*shown, "__cap_over"))


def over_cap(records: DataFrame, contributor: str, score: str, id_: str, cap: int = 25, temperature: float = 0.0, seed: int = 0, rows_per_task: int = 50_000) -> DataFrame:
    """The rows of ``records`` (one row per id) that are not kept when each contributor keeps ``cap`` of them.

    Kept are the largest reservoir keys, then missing scores; of equal keys the larger draw, then the smaller id. Rows without a
    contributor are always kept; rows repeated in full share their place. Ids aren't null. An empty table gives an empty one.
    """
    return _marked(records, contributor, score, id_, cap, temperature, seed, rows_per_task).where("__cap_over").select(*records.columns)


def capped(records: DataFrame, contributor: str, score: str, id_: str, cap: int = 25, temperature: float = 1.0, seed: int = 0, rows_per_task: int = 50_000) -> DataFrame:
    """The rows that are kept, those of nobody too; by default a weighted random sample of each contributor's records."""
    kept = _marked(records, contributor, score, id_, cap, temperature, seed, rows_per_task).where("NOT __cap_over").select(*records.columns)
    return records.where(F.col(contributor).isNull()).unionByName(kept)
