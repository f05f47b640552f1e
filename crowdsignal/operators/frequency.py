"""Per-key results by value-frequency compression (problem 2).

Rows are first grouped by key *and* value. Partial aggregation shrinks a key that holds most rows to one row per
distinct value before anything is shuffled, and these rows spread over all tasks, as they are hashed by both columns.
Every later step works on distinct values with their weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crowdsignal.functions.text import number
from crowdsignal.operators.skew import MOST_HOT_KEYS
from crowdsignal.session import staged

#: Keys of many distinct values have them cut into CUTS + 1 bins of about as many values each.
CUTS = 255
_STEP = 16


def value_frequencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the number of rows of each key and value; null keys and values are kept as such, NaN as null."""
    kind = dict(df.dtypes)[value]
    x = number(df[value]) if kind in ("double", "float") else df[value]
    return df.select(df[key].alias("key"), x.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def key_sizes(freq: DataFrame) -> DataFrame:
    """(key, n): rows of each key, null key included."""
    return freq.groupBy("key").agg(F.sum("n").alias("n"))


def frequent_keys(freq: DataFrame, percent: int = 3) -> DataFrame:
    """Non-null keys that hold at least ``percent`` of all rows, those of a null key counted in the total.

    The sizes, a row per key, are written, as the total needs them too and the table is read once.
    """
    sizes = staged(key_sizes(freq), "sizes")
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.where(F.col("key").isNotNull() & (F.col("n") * 100 >= F.lit(percent) * total))


def _binned(valued: DataFrame, values_per_bin: int) -> DataFrame:
    """(key, value, n, bin): bins follow the order of values; no bin of a key of more than ``values_per_bin`` values holds many of them.

    The cuts are approximate quantiles of such a key's distinct values, whatever their range, so a bin holds about 1/256 of them.
    As the limit is at least the 10,000th part of all values, there are at most MOST_HOT_KEYS such keys to broadcast. Other keys are one bin.
    """
    counts = valued.groupBy("key").agg(F.count(F.lit(1)).alias("_values"))
    limit = F.greatest(F.lit(float(values_per_bin)), valued.agg(F.count(F.lit(1)) / MOST_HOT_KEYS).scalar())
    large = counts.where(F.col("_values") > limit).select("key")
    places = ", ".join(f"{k / (CUTS + 1)}D" for k in range(1, CUTS + 1))
    cuts = valued.join(F.broadcast(large), "key").groupBy("key").agg(F.expr(f"percentile_approx(value, array({places}), 2000)").alias("_cuts"))
    below = lambda part: F.size(F.filter(part, lambda c: c < F.col("value")))
    # a cut in sixteen first, then the sixteen cuts between: 32 comparisons instead of 255
    coarse = below(F.array(*(F.col("_cuts")[k] for k in range(_STEP - 1, CUTS, _STEP))))
    placed = valued.join(F.broadcast(cuts), "key", "left").withColumn("_coarse", F.when(F.col("_cuts").isNotNull(), coarse))
    fine = F.col("_coarse") * _STEP + below(F.slice("_cuts", F.col("_coarse") * _STEP + 1, F.lit(_STEP)))
    return placed.select("key", "value", "n", F.coalesce(F.when(F.col("_cuts").isNotNull(), fine), F.lit(0)).alias("bin"))


def weighted_profile(freq: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.9), values_per_bin: int = 100_000) -> DataFrame:
    """One row per non-null key from (key, value, n): counts, mean, mode and exact percentiles.

    Columns: key, n_rows, n_values (rows with a value), n_distinct, mean, min_value, max_value, mode (the smallest of
    equally frequent values), and p<percent> for each of ``probs`` (linear interpolation, as ``percentile`` gives).
    A key without any value gets n_rows, zeros and nulls.

    Cumulative weights need the values of a key in order, which one task would get in a plain window over the key.
    Here the values of a key that has more than ``values_per_bin`` are first laid into bins between approximate quantiles, so that a
    window sees one bin of one key; the bins of a key, at most 256, are accumulated on their own. The frequencies, which several steps
    read, are written once.
    """
    freq = staged(freq.where(F.col("key").isNotNull()), "frequencies")
    valued = freq.where(F.col("value").isNotNull()).select("key", F.col("value").cast("double").alias("value"), "n")
    binned = _binned(valued, values_per_bin)
    bins = binned.groupBy("key", "bin").agg(F.sum("n").alias("bin_n"))
    ordered = W.partitionBy("key").orderBy("bin")
    bins = bins.select(
        "key", "bin",
        (F.sum("bin_n").over(ordered.rowsBetween(W.unboundedPreceding, 0)) - F.col("bin_n")).alias("before"),
        F.sum("bin_n").over(W.partitionBy("key")).alias("total"),
    )
    inside = W.partitionBy("key", "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    placed = binned.join(bins, ["key", "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))

    def at(index):  # the value that holds the 0-based position index of the key's ordered rows
        return F.min(F.when(F.col("upto") > index, F.col("value")))

    stats = [
        F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.max(F.struct(F.col("n"), -F.col("value"))).alias("top"),
    ]
    for k, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("total") - 1)
        stats += [at(F.floor(place)).alias(f"lo{k}"), at(F.ceil(place)).alias(f"hi{k}"), F.max(place - F.floor(place)).alias(f"part{k}")]
    per_key = placed.groupBy("key").agg(*stats)
    percentiles = [(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"part{k}")).alias(f"p{p * 100:g}".replace(".", "_")) for k, p in enumerate(probs)]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return key_sizes(freq).withColumnRenamed("n", "n_rows").join(per_key, "key", "left").select(
        "key", "n_rows", zero("n_values"), zero("n_distinct"), "mean", "min_value", "max_value", (-F.col("top.col2")).alias("mode"), *percentiles
    )
