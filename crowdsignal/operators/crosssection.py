"""Ranks within a date, and rank correlations between two signals on each date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def average_rank(value: str, by: Sequence[str]) -> Column:
    """The rank of a value among the non-null ones of its group, ties sharing their average; null for null.

    One window says both how many values are smaller and, as its frame takes equals in, how many aren't greater.
    """
    upto = W.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    return F.when(F.col(value).isNotNull(), (F.rank().over(upto) + F.count(value).over(upto)) / 2.0)


def percent_rank(value: str, by: Sequence[str]) -> Column:
    """Average rank over the number of non-null values."""
    return average_rank(value, by) / F.count(value).over(W.partitionBy(*by))


def daily_rank_ic(signal: DataFrame, outcome: DataFrame | None, dates: DataFrame, keys: Sequence[str] = ("variant",), min_pairs: int = 20) -> DataFrame:
    """(*keys, d, n_pairs, ic): rank correlation of signal and outcome on each date.

    ``signal`` has (*keys, d, ticker, value), ``outcome`` (d, ticker, ret), ``dates`` the sessions (d) of the outcome; without ``outcome``, the
    signal has the column ret beside it. Only tickers with both count, and are ranked among these. A date of the signal that is
    a session but has fewer than ``min_pairs`` pairs, or no variance, has a null ic. No signal gives no rows.

    Both ranks and the sums over a date take one shuffle. The mean of average ranks of n values is (n + 1) / 2.
    """
    by = [*keys, "d"]
    both = signal if outcome is None else signal.select(*by, "ticker", "value").join(outcome.where("ret IS NOT NULL"), ["d", "ticker"], "left")
    paired = both.join(F.broadcast(dates.select("d")), "d").select(*by, F.when(F.col("ret").isNotNull(), F.col("value")).alias("value"), F.when(F.col("value").isNotNull(), F.col("ret")).alias("ret"))
    ranked = paired.select(*by, average_rank("value", by).alias("a"), average_rank("ret", by).alias("b"))
    sums = ranked.groupBy(*by).agg(F.count("a").alias("n_pairs"), *(F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in ("ab", "aa", "bb")))
    squared_mean = F.col("n_pairs") * F.pow((F.col("n_pairs") + 1) / 2.0, F.lit(2.0))
    ic = (F.col("ab") - squared_mean) / F.nullif(F.sqrt((F.col("aa") - squared_mean) * (F.col("bb") - squared_mean)), F.lit(0.0))
    return sums.select(*by, "n_pairs", F.when(F.col("n_pairs") >= min_pairs, ic).alias("ic"))


def daily_spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """(d, rho): rank correlation of two signals (d, ticker, value), each ranked over its own tickers.

    Tickers that occur in both, on any date, are taken; dates that occur in both. The numerator runs over cells that both have, each
    side's variance over its own. A date without a common cell gives 0; one without variance null.
    """
    tickers = a.select("ticker").distinct().join(b.select("ticker").distinct(), "ticker")
    dates = a.select("d").distinct().join(b.select("d").distinct(), "d")

    def side(x: DataFrame, name: str) -> DataFrame:
        own = x.where("value IS NOT NULL").join(tickers, "ticker", "left_semi").join(dates, "d", "left_semi")
        ranked = own.select("d", "ticker", average_rank("value", ["d"]).alias("r"))
        return ranked.select("d", "ticker", (F.col("r") - F.avg("r").over(W.partitionBy("d"))).alias(name))

    both = side(a, "x").join(side(b, "y"), ["d", "ticker"], "full")
    sums = both.groupBy("d").agg(
        F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("xy"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("xx"), F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("yy")
    )
    return sums.select("d", (F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("rho"))
