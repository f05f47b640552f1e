"""Sentiment factors per session and ticker, forward returns, and the classic price factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdsignal.operators.calendar import ratio, shifted
from crowdsignal.schemas import require

VARIANTS = ("sum_sent_x_attn", "mean_sent", "attn_log", "shrinkage_sent")
ALL_FORUMS = "ALL"


def polarity() -> Column:
    """Positive less negative score, as a double; null where either is missing."""
    pos, neg = F.col("score_pos").cast("double"), F.col("score_neg").cast("double")
    return F.nanvl(pos, F.lit(None).cast("double")) - F.nanvl(neg, F.lit(None).cast("double"))


def daily_cells(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, d, ticker, s, m, n) of scored rows with a trade_date: sum and mean of the polarities, and the number of rows.

    Rows without scores count in n only; a cell of nothing else has sum 0 and mean null. Rows without a session or ticker are dropped.
    """
    require(scored, "trade_date", "ticker", "score_pos", "score_neg", *by)
    rows = scored.select(*by, F.col("trade_date").alias("d"), "ticker", polarity().alias("p")).where("d IS NOT NULL AND ticker IS NOT NULL")
    return rows.groupBy(*by, "d", "ticker").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("s"), F.avg("p").alias("m"), F.count(F.lit(1)).alias("n"))


def factor_variants(cells: DataFrame, by: Sequence[str] = (), shrinkage_k: float = 10.0, keep: Sequence[str] = ()) -> DataFrame:
    """(*by, d, ticker, *keep, variant, value): the four factors of each cell, in one pass; ``keep`` are columns of the cell to repeat."""
    values = {"sum_sent_x_attn": F.col("s") * F.log1p("n"), "mean_sent": F.col("m"), "attn_log": F.log1p("n"), "shrinkage_sent": F.col("m") * F.col("n") / (F.col("n") + F.lit(float(shrinkage_k)))}
    wide = cells.select(*by, "d", "ticker", *keep, *(values[v].cast("double").alias(v) for v in VARIANTS))
    return wide.unpivot([*by, "d", "ticker", *keep], list(VARIANTS), "variant", "value")


def by_forum_and_pooled(scored: DataFrame) -> DataFrame:
    """Every row under its forum and once more under ALL; pooled factors are not means of the forums' ones."""
    return scored.withColumn("subreddit", F.explode(F.array(F.col("subreddit"), F.lit(ALL_FORUMS)))).where("subreddit IS NOT NULL")


def forward_returns(closed: DataFrame, horizon: int) -> DataFrame:
    """(d, ticker, ret): change of the close over the next ``horizon`` sessions; no row where the session there lacks a close."""
    ahead = shifted(closed, -horizon, "ahead")
    return closed.join(ahead, ["ticker", "i"]).select("d", "ticker", ratio(F.col("ahead"), F.col("close")).alias("ret"))


def momentum(closed: DataFrame, calendar: DataFrame, near: int = 21, far: int = 252) -> DataFrame:
    """(d, ticker, value): change from ``far`` to ``near`` sessions ago, on every session, whether or not it has a close itself."""
    past = shifted(closed, near, "near").join(shifted(closed, far, "far"), ["ticker", "i"])
    return past.join(F.broadcast(calendar), "i").select("d", "ticker", ratio(F.col("near"), F.col("far")).alias("value"))


def reversal(closed: DataFrame, lag: int = 5) -> DataFrame:
    """(d, ticker, value): the change over the last ``lag`` sessions with its sign turned."""
    return closed.join(shifted(closed, lag, "before"), ["ticker", "i"]).select("d", "ticker", (-ratio(F.col("close"), F.col("before"))).alias("value"))
