"""The two panels that the factor queries run on, and SQL for the same.

``forum``: scored_leukipp rolled onto the sessions of prices_daily. ``weekly``: lineitem read as a panel of weekly sessions, with
suppliers as tickers, average prices as closes, discount and tax as scores and the return flag as forum; it is long and wide
enough for regressions and for a momentum of 252 sessions, and its scores are exact in binary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdsignal.operators.calendar import closes, roll_to_session, session_calendar
from crowdsignal.session import staged
from crowdsignal.sources.tables import table


@dataclass(frozen=True)
class Panel:
    scored: DataFrame  # with trade_date
    calendar: DataFrame
    closed: DataFrame


def forum_panel(spark: SparkSession, sf: str) -> Panel:
    prices = table(spark, sf, "prices_daily")
    calendar = session_calendar(prices)
    return Panel(roll_to_session(table(spark, sf, "scored_leukipp"), calendar), calendar, closes(prices, calendar))


def weekly_panel(spark: SparkSession, sf: str) -> Panel:
    items = table(spark, sf, "lineitem")
    week, ticker = F.to_date(F.date_trunc("week", "l_shipdate")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double")
    prices = staged(items.groupBy(week.alias("date"), ticker.alias("symbol")).agg((100 + cents / F.count(F.lit(1)) / 100000.0).alias("close")), "prices")  # items are read once
    scored = items.select(
        week.alias("trade_date"), ticker.alias("ticker"), F.col("l_returnflag").alias("subreddit"),
        (F.round(F.col("l_discount") * 100) / 16.0).alias("score_pos"), (F.round(F.col("l_tax") * 100) / 16.0).alias("score_neg"),
    )
    calendar = session_calendar(prices)
    return Panel(scored, calendar, closes(prices, calendar))


PANELS = {"forum": forum_panel, "weekly": weekly_panel}

NEED = """CASE WHEN hour(timezone('America/New_York', timezone('UTC', created_utc))) < 16 THEN CAST(timezone('America/New_York', timezone('UTC', created_utc)) AS DATE)
  ELSE CAST(timezone('America/New_York', timezone('UTC', created_utc)) AS DATE) + 1 END"""

_COMMON = """
cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM days),
c AS (SELECT px.d, i, ticker, close FROM px JOIN cal ON px.d = cal.d),"""

#: Tables px (d, ticker, close), cal (d, i), c (d, i, ticker, close) and sc (trade_date, ticker, subreddit, p) of each panel.
SQL = {
    "forum": f"""
px AS (SELECT date AS d, symbol AS ticker, close FROM prices_daily WHERE close IS NOT NULL),
days AS (SELECT DISTINCT date AS d FROM prices_daily),{_COMMON}
sc AS (SELECT (SELECT min(d) FROM cal WHERE d >= need) AS trade_date, doc_id, ticker, subreddit, CAST(score_pos AS DOUBLE) - CAST(score_neg AS DOUBLE) AS p
  FROM (SELECT *, {NEED} AS need FROM scored_leukipp))""",
    "weekly": f"""
px AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS d, 'S' || l_suppkey AS ticker,
  100 + CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100000.0 AS close FROM lineitem GROUP BY 1, 2),
days AS (SELECT DISTINCT d FROM px),{_COMMON}
sc AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, 'S' || l_suppkey AS ticker, l_returnflag AS subreddit,
  CAST(round(l_discount * 100) AS DOUBLE) / 16 - CAST(round(l_tax * 100) AS DOUBLE) / 16 AS p FROM lineitem)""",
}


def cells_sql(by: str = "") -> str:
    """Tables cells (d, ticker, s, m, n) and fv (d, ticker, variant, value to 9 places), with the column ``by`` too."""
    b = f"{by}, " if by else ""
    values = {"sum_sent_x_attn": "s * ln(1 + n)", "mean_sent": "m", "attn_log": "ln(1 + n)", "shrinkage_sent": "m * n / (n + 10.0)"}
    rows = " UNION ALL ".join(f"SELECT {b}d, ticker, '{v}' AS variant, round(CAST({x} AS DOUBLE), 9) AS value FROM cells" for v, x in values.items())
    return f"""
cells AS (SELECT {b}trade_date AS d, ticker, coalesce(sum(p), 0) AS s, avg(p) AS m, count(*) AS n FROM sc WHERE trade_date IS NOT NULL AND ticker IS NOT NULL
  GROUP BY {b}trade_date, ticker),
fv AS ({rows})"""


def returns_sql(horizon: int) -> str:
    """Table r (d, ticker, ret)."""
    return f"r AS (SELECT a.d, a.ticker, b.close / nullif(a.close, 0) - 1 AS ret FROM c a JOIN c b ON a.ticker = b.ticker AND b.i = a.i + {horizon})"


MOMENTUM = "mom AS (SELECT cal.d, n.ticker, n.close / nullif(f.close, 0) - 1 AS value FROM c n JOIN c f ON n.ticker = f.ticker AND f.i = n.i - 231 JOIN cal ON cal.i = n.i + 21)"
REVERSAL = "rev AS (SELECT a.d, a.ticker, -(a.close / nullif(b.close, 0) - 1) AS value FROM c a JOIN c b ON a.ticker = b.ticker AND b.i = a.i - 5)"
PADDED = """
pad AS (SELECT t.ticker, cal.i, cal.d, last_value(c.close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY cal.i ROWS UNBOUNDED PRECEDING) AS close
  FROM (SELECT DISTINCT ticker FROM c) t CROSS JOIN cal LEFT JOIN c ON c.ticker = t.ticker AND c.i = cal.i),
ret AS (SELECT d, i, ticker, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY i), 0) - 1 AS ret FROM pad)"""
