import datetime as dt

import pytest
from pyspark.sql import functions as F

from crowdsignal.operators.backtest import backtest_daily, backtest_summary, quantile_weights, rebalance_dates

D = dt.date


def signal(spark, rows):
    return spark.createDataFrame([("v", d, t, x) for d, t, x in rows], "variant string, d date, ticker string, value double")


@pytest.mark.parametrize(("n", "top", "bottom"), [(1, 1, 0), (4, 1, 0), (5, 2, 1), (7, 2, 1), (10, 3, 2), (20, 5, 4), (25, 6, 5), (100, 21, 20)])
def test_sizes(spark, n, top, bottom):
    s = signal(spark, [(D(2021, 1, 4), f"T{k:03}", float(k)) for k in range(n)])
    w = [r["w"] for r in quantile_weights(s).collect()]
    assert (sum(x > 0 for x in w), sum(x < 0 for x in w)) == (top, bottom)
    assert sum(x for x in w if x > 0) == pytest.approx(1)
    if bottom:
        assert sum(w) == pytest.approx(0)
    assert sum(r["w"] for r in quantile_weights(s, long_only=True).collect()) == pytest.approx(1)


def test_bottom_wins_where_both(spark):
    s = signal(spark, [(D(2021, 1, 4), "A", 1.0), (D(2021, 1, 4), "B", 1.0)])
    assert {r["w"] for r in quantile_weights(s, quantiles=1).collect()} == {-0.5}


def test_rebalance_dates(spark):
    s = signal(spark, [(D(2021, 1, 4), "A", 1.0), (D(2021, 1, 29), "A", 1.0), (D(2021, 1, 30), "A", None), (D(2021, 3, 2), "A", 1.0)])
    assert sorted(r["rebal"] for r in rebalance_dates(s).collect()) == [D(2021, 1, 29), D(2021, 3, 2)]
    assert len(rebalance_dates(s, rebalance="W").collect()) == 3
    with pytest.raises(ValueError, match="rebalance"):
        rebalance_dates(s, rebalance="fortnight")


def run(spark, s, returns, sessions, priced, **kw):
    r = spark.createDataFrame([(d, t, x) for d, t, x in returns], "d date, ticker string, ret double")
    c = spark.createDataFrame([(d,) for d in sessions], "d date")
    p = spark.createDataFrame([(t,) for t in priced], "ticker string")
    return backtest_daily(s, r, c, p, **kw)


def test_a_book_that_changes(spark):
    # daily rebalancing, long only, two quantiles: A and B, then B and C held half each; D has no price
    s = signal(spark, [(D(2021, 1, 4), t, x) for t, x in (("A", 4.0), ("B", 3.0), ("C", 2.0), ("E", 1.0))] + [(D(2021, 1, 6), t, x) for t, x in (("B", 4.0), ("C", 3.0), ("E", 2.0), ("X", 1.0))])
    days = [D(2021, 1, d) for d in (3, 4, 5, 6, 7)]
    returns = [(D(2021, 1, 4), "A", 0.1), (D(2021, 1, 4), "B", 0.2), (D(2021, 1, 5), "A", 0.3), (D(2021, 1, 6), "C", -0.1)]
    out = run(spark, s, returns, days, ["A", "B", "C", "E"], rebalance="D", quantiles=2, long_only=True, cost_bps=100.0).orderBy("d").collect()
    assert [r["d"].day for r in out] == [4, 5, 6]
    third = 1 / 3  # rank shares of 4 names: 1, .75, .5, .25; top holds those of .5 and more
    assert [r["gross"] for r in out] == pytest.approx([0.3 * third, 0.3 * third, -0.1 * third])
    assert [r["turnover"] for r in out] == pytest.approx([0, 0, 2 * third])
    net = [r["gross"] - 0.01 * r["turnover"] for r in out]
    assert [r["cum"] for r in out] == pytest.approx([net[0], (1 + net[0]) * (1 + net[1]) - 1, (1 + net[0]) * (1 + net[1]) * (1 + net[2]) - 1])
    assert out[0]["drawdown"] == 0 and out[2]["drawdown"] == pytest.approx(out[2]["cum"] - out[1]["cum"])


def test_unpriced_weight_is_not_scaled_up(spark):
    s = signal(spark, [(D(2021, 1, 4), t, x) for t, x in (("A", 4.0), ("X", 3.0), ("B", 2.0), ("C", 1.0))])
    out = run(spark, s, [(D(2021, 1, 4), "A", 0.3)], [D(2021, 1, 4)], ["A", "B", "C"], quantiles=2, long_only=True).collect()
    assert out[0]["gross"] == pytest.approx(0.1)


def test_summary_and_empty(spark):
    daily = spark.createDataFrame([("v", 0.01, 0.0, 0.0), ("v", 0.03, -0.02, 1.0)], "variant string, net double, drawdown double, turnover double")
    r = backtest_summary(daily).collect()[0]
    assert r["ann_return"] == pytest.approx(1.02**252 - 1)
    assert r["sharpe"] == pytest.approx(0.02 * 252 / (0.0002**0.5 * 252**0.5))
    assert (r["max_drawdown"], r["avg_turnover"], r["n_days"]) == (-0.02, 0.5, 2)
    assert backtest_summary(daily.withColumn("net", F.lit(0.0))).collect()[0]["sharpe"] is None
    assert run(spark, signal(spark, [(D(2021, 1, 4), "A", 1.0)]).limit(0), [(D(2021, 1, 4), "A", 1.0)], [D(2021, 1, 4)], ["A"]).count() == 0
