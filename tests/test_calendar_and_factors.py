import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from crowdsignal.operators.calendar import closes, padded_returns, roll_to_session, session_calendar, shifted
from crowdsignal.operators.crosssection import average_rank, daily_rank_ic, daily_spearman, percent_rank
from crowdsignal.operators.factors import by_forum_and_pooled, daily_cells, factor_variants, forward_returns, momentum, reversal

D = dt.date


def calendar_of(spark, *dates):
    return session_calendar(spark.createDataFrame([(d,) for d in dates], "date date"))


def test_roll(spark):
    days = [D(2021, 1, 4), D(2021, 1, 5), D(2021, 1, 8), D(2021, 1, 11), D(2021, 7, 1), D(2021, 7, 2), D(2021, 7, 6)]
    cases = [
        ("2021-07-01 19:59:59", D(2021, 7, 1)), ("2021-07-01 20:00:00", D(2021, 7, 2)),  # summer
        ("2021-01-04 20:59:59", D(2021, 1, 4)), ("2021-01-04 21:00:00", D(2021, 1, 5)),  # winter
        ("2021-01-08 21:00:00", D(2021, 1, 11)), ("2021-01-06 12:00:00", D(2021, 1, 8)),  # weekend, holiday
        ("2020-06-01 12:00:00", D(2021, 1, 4)), ("2021-07-06 20:00:00", None), (None, None),
    ]
    posts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").withColumn("created_utc", F.col("t").cast("timestamp_ntz"))
    out = roll_to_session(posts, calendar_of(spark, *days))
    assert [r["trade_date"] for r in out.orderBy("k").collect()] == [d for _, d in cases]
    with pytest.raises(ValueError, match="no session"):
        roll_to_session(posts, calendar_of(spark, *days).limit(0))


def prices_of(spark, table):
    """{symbol: [close or None by session]} as prices."""
    rows = [(D(2021, 3, 1) + dt.timedelta(days=k), s, c) for s, cs in table.items() for k, c in enumerate(cs)]
    return spark.createDataFrame(rows, "date date, symbol string, close double")


def test_padded_returns(spark):
    prices = prices_of(spark, {"A": [1.0, 2.0, None, 4.0, None], "B": [None, None, 3.0, 0.0, 1.0]})
    calendar = session_calendar(prices)
    closed = closes(prices, calendar)
    out = {t: [r["ret"] for r in padded_returns(closed, calendar).where(F.col("ticker") == t).orderBy("i").collect()] for t in "AB"}
    assert out["A"] == [None, 1.0, 0.0, 1.0, 0.0]
    assert out["B"] == [None, None, None, -1.0, None]
    assert [(r["i"], r["ret"]) for r in padded_returns(closed, calendar, pad=False).where("ticker = 'A'").orderBy("i").collect()] == [(1, 1.0)]


def test_shifts_go_along_the_calendar(spark):
    prices = prices_of(spark, {"A": [1.0, None, 4.0, 8.0], "B": [1.0, 1.0, 1.0, 1.0]})
    calendar = session_calendar(prices)
    closed = closes(prices, calendar)
    fwd = {(r["d"].day, r["ticker"]): r["ret"] for r in forward_returns(closed, 1).collect()}
    assert fwd == {(3, "A"): 1.0, (1, "B"): 0.0, (2, "B"): 0.0, (3, "B"): 0.0}
    assert {r["i"] for r in shifted(closed, 2, "x").where("ticker = 'A'").collect()} == {2, 4, 5}
    mom = {(r["d"].day, r["ticker"]): r["value"] for r in momentum(closed, calendar, 1, 3).collect()}
    assert mom == {(4, "A"): 3.0, (4, "B"): 0.0}
    assert [(r["d"].day, r["value"]) for r in reversal(closed, 2).where("ticker = 'A'").collect()] == [(3, -3.0)]


def test_cells_and_variants(spark):
    rows = [(D(2021, 1, 4), "A", 0.5, 0.25), (D(2021, 1, 4), "A", None, None), (D(2021, 1, 4), "B", None, None), (None, "A", 1.0, 0.0), (D(2021, 1, 4), None, 1.0, 0.0), (D(2021, 1, 4), "A", float("nan"), 0.1)]
    cells = daily_cells(spark.createDataFrame(rows, "trade_date date, ticker string, score_pos double, score_neg double"))
    assert sorted(map(tuple, cells.drop("d").collect())) == [("A", 0.25, 0.25, 3), ("B", 0.0, None, 1)]
    values = {(r["ticker"], r["variant"]): r["value"] for r in factor_variants(cells).collect()}
    assert values["A", "sum_sent_x_attn"] == pytest.approx(0.25 * math.log(4))
    assert values["A", "shrinkage_sent"] == pytest.approx(0.25 * 3 / 13)
    assert values["B", "mean_sent"] is None and values["B", "attn_log"] == pytest.approx(math.log(2))


def test_pooled_is_its_own_group(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "subreddit string")
    assert sorted(r[0] for r in by_forum_and_pooled(df).collect()) == ["ALL", "ALL", "ALL", "x", "y"]


def test_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, None)], "g int, v double")
    out = df.select("v", average_rank("v", ["g"]).alias("r"), percent_rank("v", ["g"]).alias("p")).collect()
    assert sorted((r["v"], r["r"], r["p"]) for r in out if r["v"] is not None) == [(1.0, 1.5, 0.5), (1.0, 1.5, 0.5), (3.0, 3.0, 1.0)]
    assert [(r["r"], r["p"]) for r in out if r["v"] is None] == [(None, None)]


def _signal(spark, rows):
    return spark.createDataFrame([("v", D(2021, 1, d), t, x) for d, t, x in rows], "variant string, d date, ticker string, value double")


def test_rank_ic(spark):
    tickers = [f"T{k:02}" for k in range(25)]
    signal = _signal(spark, [(4, t, float(k * k)) for k, t in enumerate(tickers)] + [(5, t, float(k)) for k, t in enumerate(tickers[:20])] + [(6, t, float(k)) for k, t in enumerate(tickers[:19])] + [(7, t, 1.0) for t in tickers] + [(9, "T01", 1.0)])
    outcome = spark.createDataFrame([(D(2021, 1, d), t, float(k)) for d in (4, 5, 6, 7) for k, t in enumerate(tickers)] + [(D(2021, 1, 5), "T00", None)], "d date, ticker string, ret double")
    dates = spark.createDataFrame([(D(2021, 1, d),) for d in (4, 5, 6, 7, 8)], "d date")
    out = {r["d"].day: (r["n_pairs"], r["ic"]) for r in daily_rank_ic(signal, outcome, dates).collect()}
    assert out[4] == (25, pytest.approx(1.0)) and out[5] == (20, pytest.approx(1.0))
    assert out[6] == (19, None) and out[7] == (25, None) and set(out) == {4, 5, 6, 7}
    turned = {r["d"].day: r["ic"] for r in daily_rank_ic(signal.withColumn("value", -F.col("value")), outcome, dates).collect()}
    assert turned[4] == pytest.approx(-1.0)
    assert daily_rank_ic(signal.limit(0), outcome, dates).count() == 0


def test_spearman_without_mask(spark):
    a = spark.createDataFrame([(D(2021, 1, 4), t, v) for t, v in (("A", 1.0), ("B", 2.0), ("C", 3.0), ("X", 9.0))] + [(D(2021, 1, 5), "A", 1.0)], "d date, ticker string, value double")
    b = spark.createDataFrame([(D(2021, 1, 4), "A", 5.0), (D(2021, 1, 4), "B", 6.0), (D(2021, 1, 5), "C", 1.0)], "d date, ticker string, value double")
    out = {r["d"].day: r["rho"] for r in daily_spearman(a, b).collect()}
    # ranks of a: -1, 0, 1 around their mean, of b: -0.5, 0.5; common cells are A and B
    assert out[4] == pytest.approx(0.5 / math.sqrt(2 * 0.5)) and out[5] is None
