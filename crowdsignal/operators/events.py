"""Event study around spikes of mentions, and the case study of one ticker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crowdsignal.operators.calendar import next_sessions, padded_returns
from crowdsignal.session import staged


def mention_spikes(cells: DataFrame, by: Sequence[str] = (), share: float = 0.99, floor: float = 3.0) -> DataFrame:
    """(*by, d, ticker, n, m, p99): cells whose mentions reach their own ticker's percentile, with a positive mean polarity.

    The percentile is over dates with mentions, interpolated, and must be ``floor`` or more. ``cells`` are of ``daily_cells``.
    """
    limits = cells.groupBy(*by, "ticker").agg(F.percentile("n", F.lit(share)).alias("p99")).where(F.col("p99") >= floor)
    return cells.join(limits, [*by, "ticker"]).where((F.col("n") >= F.col("p99")) & (F.col("m") > 0)).select(*by, "d", "ticker", "n", "m", "p99")


def market_returns(returns: DataFrame, symbol: str = "SPY") -> DataFrame:
    """(i, market): the returns of ``symbol`` if it is there, else the mean over tickers."""
    own = F.max(F.when(F.col("ticker") == symbol, F.col("ret")))
    there = returns.agg(F.coalesce(F.max(F.col("ticker") == symbol), F.lit(False))).scalar()
    return returns.groupBy("i").agg(F.when(there, own).otherwise(F.avg("ret")).alias("market"))


def event_windows(events: DataFrame, closed: DataFrame, calendar: DataFrame, window: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(*by, d, ticker, offset, ar, car) of events whose whole window has abnormal returns: the ticker's return less the market's.

    ``events`` has (*by, d, ticker), d any date, which counts as the first session from it on; d stays as it was. Events outside the
    calendar, windows that reach over either of its ends, and those with a missing return, are dropped. Each event becomes
    2 * window + 1 rows, joined by equality. The returns, which the market's are made of too, are written once.
    """
    returns = staged(padded_returns(closed, calendar), "returns")
    abnormal = returns.join(F.broadcast(market_returns(returns)), "i").select("ticker", "i", (F.col("ret") - F.col("market")).alias("ar")).where("ar IS NOT NULL")
    sessions = next_sessions(calendar).select(F.col("day").alias("d"), "i")
    placed = events.select(*by, "d", "ticker").join(F.broadcast(sessions), "d").withColumn("offset", F.explode(F.sequence(F.lit(-window), F.lit(window))))
    cells = placed.withColumn("i", F.col("i") + F.col("offset")).join(abnormal, ["ticker", "i"])
    event = W.partitionBy(*by, "ticker", "d")
    whole = cells.withColumn("_n", F.count(F.lit(1)).over(event)).where(F.col("_n") == 2 * window + 1)
    car = F.sum("ar").over(event.orderBy("offset").rowsBetween(W.unboundedPreceding, 0))
    return whole.select(*by, "d", "ticker", "offset", "ar", car.alias("car"))


def mean_car(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, offset, n_events, mean_car, se): mean over events, and the population deviation over the root of their number."""
    return windows.groupBy(*by, "offset").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("car").alias("mean_car"), (F.stddev_pop("car") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se")
    )


def mean_car_of_all(windows: DataFrame, groups: DataFrame, by: str = "subreddit", window: int = 10) -> DataFrame:
    """(by, offset, n_events, mean_car) for every group of ``groups``; one without events has zeros."""
    grid = groups.select(by).distinct().withColumn("offset", F.explode(F.sequence(F.lit(-window), F.lit(window))))
    out = grid.join(mean_car(windows, [by]).drop("se"), [by, "offset"], "left")
    return out.withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long"))).withColumn("mean_car", F.coalesce("mean_car", F.lit(0.0)))


def case_study(cells: DataFrame, closed: DataFrame, start: str, end: str, symbol: str = "GME") -> DataFrame:
    """(d, ticker, n, m, close) of one ticker from ``start`` to ``end``, both included: of ``symbol`` if it is priced and mentioned, else of the most
    mentioned priced ticker (the smaller name of equals). A session without mentions has n 0; one
    with neither mentions nor a close is absent."""
    totals = cells.join(closed.select("ticker").distinct(), "ticker", "left_semi").groupBy("ticker").agg(F.sum("n").alias("_n"))
    chosen = totals.orderBy((F.col("ticker") == symbol).desc(), F.col("_n").desc(), "ticker").limit(1).select("ticker")
    mine = lambda df: df.join(F.broadcast(chosen), "ticker", "left_semi").where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    both = mine(cells).select("d", "ticker", "n", "m").join(mine(closed).select("d", "ticker", "close"), ["d", "ticker"], "full")
    return both.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
