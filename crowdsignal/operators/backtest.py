"""Backtests of quantile portfolios that are rebalanced at period ends, with costs on turnover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crowdsignal.operators.crosssection import percent_rank
from crowdsignal.session import staged

#: Periods by their alias: W ends on Sunday, as Spark's weeks do.
PERIODS = {"ME": "month", "QE": "quarter", "YE": "year", "W": "week", "D": "day"}


def rebalance_dates(signal: DataFrame, keys: Sequence[str] = ("variant",), rebalance: str = "ME") -> DataFrame:
    """(*keys, rebal): the last date with any signal in each period; periods without one give none."""
    if rebalance not in PERIODS:
        raise ValueError(f"rebalance must be one of {sorted(PERIODS)}")
    period = F.date_trunc(PERIODS[rebalance], F.col("d"))
    return signal.where("value IS NOT NULL").groupBy(*keys, period.alias("_p")).agg(F.max("d").alias("rebal")).select(*keys, "rebal")


def quantile_weights(signal: DataFrame, keys: Sequence[str] = ("variant",), quantiles: int = 5, long_only: bool = False) -> DataFrame:
    """(*keys, d, ticker, w) for every ticker with a signal: the top shares +1, the bottom -1 unless ``long_only``, the rest get 0.

    Top is a percent rank of 1 - 1/q or more, bottom one of 1/q or less, so sizes are uneven; a name in both is bottom.
    """
    by = [*keys, "d"]
    ranked = signal.where("value IS NOT NULL").select(*by, "ticker", percent_rank("value", by).alias("_pct"))
    top, bottom = F.col("_pct") >= 1 - 1 / quantiles, F.col("_pct") <= 1 / quantiles
    count = lambda c: F.sum(c.cast("int")).over(W.partitionBy(*by))
    long_w = F.when(top, 1.0 / count(top)).otherwise(F.lit(0.0))
    w: Column = long_w if long_only else F.when(bottom, -1.0 / count(bottom)).otherwise(long_w)
    return ranked.select(*by, "ticker", w.alias("w"))


def backtest_daily(
    signal: DataFrame, returns: DataFrame, calendar: DataFrame, priced: DataFrame, keys: Sequence[str] = ("variant",), cost_bps: float = 5.0, rebalance: str = "ME", quantiles: int = 5, long_only: bool = False
) -> DataFrame:
    """(*keys, d, gross, turnover, cost, net, cum, drawdown) of every session from the first rebalance to the last signal.

    ``signal`` has (*keys, d, ticker, value), ``returns`` (d, ticker, ret) one session ahead, ``calendar`` (d), ``priced`` (ticker) the
    tickers with a price series. Weights are made at rebalances and carried: a ticker that the latest rebalance lacks has weight 0.
    Ranks use all tickers with a signal; unpriced ones are dropped then, and what is left isn't scaled up. A missing return counts 0.
    Turnover is the sum of absolute changes of weight, over the names of both books, and 0 on the first day. No signal gives no rows.

    Weights change at rebalances only, so turnover is found by joining each book to the one before, not on a grid of sessions. The
    books, which hold one date in a period, are written once.
    """
    keys = list(keys)
    picks = staged(rebalance_dates(signal, keys, rebalance), "picks")
    on_dates = signal.join(picks.withColumnRenamed("rebal", "d"), [*keys, "d"], "left_semi")
    books = quantile_weights(on_dates, keys, quantiles, long_only).join(priced.select("ticker").distinct(), "ticker", "left_semi").withColumnRenamed("d", "rebal")
    books = staged(books, "books")
    # the book of each session, and the book before it where it is new
    spans = signal.where("value IS NOT NULL").groupBy(*keys).agg(F.max("d").alias("_last"))
    days = spans.withColumn("d", F.explode(calendar.agg(F.array_sort(F.collect_list("d"))).scalar()))  # some 250 dates a year
    days = days.where("d <= _last").select(*keys, "d", F.lit(None).cast("date").alias("rebal"))
    marks = days.unionByName(picks.select(*keys, F.col("rebal").alias("d"), "rebal"))
    held = marks.groupBy(*keys, "d").agg(F.max("rebal").alias("rebal"), F.max(F.col("rebal").isNull()).alias("_session"))
    held = held.withColumn("rebal", F.last("rebal", ignorenulls=True).over(W.partitionBy(*keys).orderBy("d").rowsBetween(W.unboundedPreceding, 0)))
    held = held.where("_session AND rebal IS NOT NULL").select(*keys, "d", "rebal")
    used = held.groupBy(*keys, "rebal").agg(F.min("d").alias("_first"))
    used = used.withColumn("_before", F.lag("rebal").over(W.partitionBy(*keys).orderBy("rebal")))
    now = books.join(used.where("_before IS NOT NULL"), [*keys, "rebal"]).select(*keys, "rebal", "ticker", "w")
    then = books.withColumnRenamed("rebal", "_before").withColumnRenamed("w", "_w").join(used.where("_before IS NOT NULL").select(*keys, "rebal", "_before"), [*keys, "_before"]).select(*keys, "rebal", "ticker", "_w")
    moved = now.join(then, [*keys, "rebal", "ticker"], "full").groupBy(*keys, "rebal").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_w", F.lit(0.0)))).alias("turnover"))
    turns = used.join(moved, [*keys, "rebal"]).select(*keys, F.col("_first").alias("d"), "turnover")
    gains = held.join(books.where("w <> 0"), [*keys, "rebal"]).join(returns.where("ret IS NOT NULL"), ["d", "ticker"]).groupBy(*keys, "d").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"))
    daily = held.select(*keys, "d").join(gains, [*keys, "d"], "left").join(turns, [*keys, "d"], "left").fillna(0.0, ["gross", "turnover"])
    daily = daily.withColumn("cost", F.col("turnover") * (cost_bps * 1e-4)).withColumn("net", F.col("gross") - F.col("cost"))
    so_far = W.partitionBy(*keys).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    daily = daily.withColumn("cum", F.product(1 + F.col("net")).over(so_far) - 1)
    return daily.withColumn("drawdown", F.col("cum") - F.max("cum").over(so_far))


def backtest_summary(daily: DataFrame, keys: Sequence[str] = ("variant",), periods: int = 252) -> DataFrame:
    """(*keys, ann_return, sharpe, max_drawdown, avg_turnover, n_days); a null sharpe where returns don't vary."""
    mean, sd = F.avg("net"), F.stddev_samp("net")
    return daily.groupBy(*keys).agg(
        (F.pow(1 + mean, F.lit(float(periods))) - 1).alias("ann_return"),
        (mean * periods / F.nullif(sd * F.sqrt(F.lit(float(periods))), F.lit(0.0))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("avg_turnover"), F.count(F.lit(1)).alias("n_days"),
    )
