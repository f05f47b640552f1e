"""Trading sessions: the calendar, rolling of posts onto it, and shifts along it.

A shift by h goes h sessions along the calendar of all symbols, never h rows of one symbol: a symbol that lacks the session there
gives null. Calendars have one row per session, some 250 a year, and are joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crowdsignal.schemas import require


def session_calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """(d, i): the distinct dates in order, i counted from 0."""
    found = dates.select(F.to_date(date).alias("d")).where("d IS NOT NULL").distinct()
    return found.withColumn("i", F.row_number().over(W.orderBy("d")) - 1)


def next_sessions(calendar: DataFrame) -> DataFrame:
    """(day, d, i): every date of the calendar's span with the first session from it on; a join by equality then finds it."""
    span = calendar.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day")).join(calendar.select(F.col("d").alias("day"), F.struct("d", "i").alias("s")), "day", "left")
    ahead = F.first("s", ignorenulls=True).over(W.orderBy("day").rowsBetween(0, W.unboundedFollowing))
    return days.select("day", ahead.alias("s")).select("day", "s.d", "s.i")


def roll_to_session(posts: DataFrame, calendar: DataFrame, time: str = "created_utc", zone: str = "America/New_York", close_hour: int = 16, name: str = "trade_date") -> DataFrame:
    """``posts`` with the session on which they can first be traded.

    That is the first session from the local date on, or from the day after for posts at or after the closing hour. Posts before
    the first session go to it; those past the last, and those without a time, get null. An empty calendar is an error.
    """
    if calendar.isEmpty():
        raise ValueError("the calendar has no session")
    ahead = next_sessions(calendar).select(F.col("day").alias("_need"), F.col("d").alias(name))
    local = F.from_utc_timestamp(F.col(time).cast("timestamp"), zone)
    need = F.when(F.hour(local) < close_hour, F.to_date(local)).otherwise(F.date_add(F.to_date(local), 1))
    first = calendar.agg(F.min("d")).scalar()
    return posts.withColumn("_need", F.when(need < first, first).otherwise(need)).join(F.broadcast(ahead), "_need", "left").drop("_need")


def closes(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """(d, i, ticker, close) of the rows with a close."""
    require(prices, "date", "symbol", "close")
    named = prices.select(F.to_date("date").alias("d"), F.col("symbol").alias("ticker"), F.col("close").cast("double").alias("close"))
    return named.where("close IS NOT NULL AND NOT isnan(close)").join(F.broadcast(calendar), "d").select("d", "i", "ticker", "close")


def shifted(closed: DataFrame, by: int, name: str) -> DataFrame:
    """(ticker, i, name): the close ``by`` sessions before, as a table to join on (ticker, i); a negative ``by`` looks ahead."""
    return closed.select("ticker", (F.col("i") + by).alias("i"), F.col("close").alias(name))


def ratio(above: Column, below: Column) -> Column:
    """above / below - 1; null where that can't be."""
    return F.try_divide(above, F.nullif(below, F.lit(0.0))) - 1


def padded_returns(closed: DataFrame, calendar: DataFrame, pad: bool = True) -> DataFrame:
    """(d, i, ticker, ret): change of the close from the session before.

    With ``pad``, a missing close counts as the last one known, so a missing session returns 0; every symbol then has a row for every
    session, null until its second. Without, both sessions must be there.
    """
    if not pad:
        before = shifted(closed, 1, "before")
        return closed.join(before, ["ticker", "i"]).select("d", "i", "ticker", ratio(F.col("close"), F.col("before")).alias("ret"))
    # every symbol gets the whole calendar, as an array of some 250 sessions a year, never a join without a key
    days = calendar.agg(F.array_sort(F.collect_list(F.struct("i", "d")))).scalar()
    grid = closed.select("ticker").distinct().withColumn("s", F.explode(days)).select("ticker", "s.i", "s.d")
    filled = grid.join(closed.select("ticker", "i", "close"), ["ticker", "i"], "left")
    upto = W.partitionBy("ticker").orderBy("i")
    padded = filled.withColumn("close", F.last("close", ignorenulls=True).over(upto.rowsBetween(W.unboundedPreceding, 0)))
    return padded.select("d", "i", "ticker", ratio(F.col("close"), F.lag("close").over(upto)).alias("ret"))
