import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdsignal.operators.inference import describe, ic_summary, monthly_summary, newey_west, ols_hac, ols_robust, panel_order, stack_panel

D0 = dt.date(2021, 1, 1)


def series(spark, xs, key="v"):
    return spark.createDataFrame([(key, D0 + dt.timedelta(days=k), x) for k, x in enumerate(xs)], "variant string, d date, ic double")


def nw(xs, lags):
    x = np.array([v for v in xs if v is not None])
    e, n = x - x.mean(), len(x)
    var = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return x.mean(), x.mean() / np.sqrt(max(var, 0) / n)


def test_newey_west(spark):
    rng = np.random.default_rng(0)
    xs = [None if k % 7 == 3 else float(v) for k, v in enumerate(rng.standard_normal(60).cumsum() / 10 + 0.3)]
    r = newey_west(series(spark, xs), ["variant"], "ic").collect()[0]
    assert (r["mean"], r["nw_t"]) == pytest.approx(nw(xs, 5))
    r = newey_west(series(spark, xs), ["variant"], "ic", lags=0).collect()[0]
    x = np.array([v for v in xs if v is not None])
    assert r["nw_t"] == pytest.approx(x.mean() / (x.std(ddof=1) / len(x) ** 0.5) * (len(x) / (len(x) - 1)) ** 0.5)


def test_newey_west_needs_ten(spark):
    assert newey_west(series(spark, [1.0, 2.0] * 4 + [1.0]), ["variant"], "ic").collect()[0]["mean"] is None
    assert newey_west(series(spark, [1.0, 2.0] * 5), ["variant"], "ic").collect()[0]["mean"] == 1.5
    assert newey_west(series(spark, [1.0] * 12), ["variant"], "ic").collect()[0]["nw_t"] is None
    assert newey_west(series(spark, [1.0]).limit(0), ["variant"], "ic").count() == 0


def test_ic_summary(spark):
    r = ic_summary(series(spark, [0.1, None, 0.3, 0.2])).collect()[0]
    assert (r["mean_ic"], r["n_days"], r["nw_t"]) == (pytest.approx(0.2), 3, None)
    assert r["plain_t"] == pytest.approx(0.2 / (0.1 / 3**0.5))


def panel(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x = rng.standard_normal(3)
        rows.append((f"T{k % 7}", D0 + dt.timedelta(days=k // 7), *map(float, x), float(0.5 + x @ [1, -2, 0.3] + rng.standard_normal() * (1 + abs(x[0])))))
    df = spark.createDataFrame(rows, "ticker string, d date, a double, b double, c double, y double")
    return df, sorted(rows, key=lambda r: (r[0], r[1]))


def fitted(rows):
    x = np.array([[1, *r[2:5]] for r in rows])
    y = np.array([r[5] for r in rows])
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ y
    return x, y, inverse, b, y - x @ b


def test_hc1(spark):
    df, rows = panel(spark)
    out = {r["name"]: r for r in ols_robust(df.withColumn("g", F.lit(1)), ["g"], "y", ["a", "b", "c"]).collect()}
    x, y, inverse, b, e = fitted(rows)
    var = inverse @ (x.T * e**2 @ x) @ inverse * len(y) / (len(y) - 4)
    for k, name in enumerate(["const", "a", "b", "c"]):
        assert (out[name]["beta"], out[name]["se"]) == pytest.approx((b[k], var[k, k] ** 0.5))
    assert out["a"]["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())))


@pytest.mark.parametrize("block", [10, 37, 50_000])
def test_hac_across_tickers_and_blocks(spark, block):
    df, rows = panel(spark)
    out = {r["name"]: r for r in ols_hac(df.withColumn("g", F.lit(1)), ["g"], "y", ["a", "b", "c"], block=block).collect()}
    x, y, inverse, b, e = fitted(rows)
    u = x * e[:, None]
    meat = u.T @ u
    for k in range(1, 6):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / 6) * (g + g.T)
    var = inverse @ meat @ inverse
    for k, name in enumerate(["const", "a", "b", "c"]):
        assert (out[name]["beta"], out[name]["se"]) == pytest.approx((b[k], var[k, k] ** 0.5))
        assert out[name]["lower"] == pytest.approx(b[k] - 1.959963984540054 * var[k, k] ** 0.5)


def test_columns_far_from_zero_do_not_cancel(spark):
    df, rows = panel(spark)
    far = df.select("ticker", "d", (F.col("a") + 1e8).alias("a"), (F.col("b") * 1e-3 + 5e4).alias("b"), "c", (F.col("y") - 1e7).alias("y")).withColumn("g", F.lit(1))
    near = {r["name"]: r for r in ols_hac(df.withColumn("g", F.lit(1)), ["g"], "y", ["a", "b", "c"]).collect()}
    out = {r["name"]: r for r in ols_hac(far, ["g"], "y", ["a", "b", "c"]).collect()}
    for name, scale in (("a", 1), ("b", 1e3), ("c", 1)):
        assert (out[name]["beta"], out[name]["se"]) == pytest.approx((near[name]["beta"] * scale, near[name]["se"] * scale), rel=1e-5)
    assert out["a"]["r2"] == pytest.approx(near["a"]["r2"], rel=1e-6)


def test_many_groups_are_solved_together(spark):
    df, rows = panel(spark, 700)
    out = {(r["ticker"], r["name"]): r for r in ols_robust(df, ["ticker"], "y", ["a", "b", "c"]).collect()}
    assert len(out) == 28
    for ticker in ("T0", "T6"):
        x, y, inverse, b, e = fitted([r for r in rows if r[0] == ticker])
        var = inverse @ (x.T * e**2 @ x) @ inverse * len(y) / (len(y) - 4)
        for k, name in enumerate(["const", "a", "b", "c"]):
            assert (out[ticker, name]["beta"], out[ticker, name]["se"]) == pytest.approx((b[k], var[k, k] ** 0.5))


def test_small_and_singular_groups(spark):
    df, _ = panel(spark, 40)
    out = ols_hac(df.withColumn("g", F.lit("x")), ["g"], "y", ["a", "b", "c"], min_obs=100).collect()
    assert {r["n"] for r in out} == {40} and {r["beta"] for r in out} == {None}
    same = df.withColumn("b", F.col("a")).withColumn("g", F.lit("x"))
    assert len(ols_robust(same, ["g"], "y", ["a", "b", "c"]).collect()) == 4
    assert ols_robust(df.limit(0).withColumn("g", F.lit("x")), ["g"], "y", ["a"]).count() == 0


def test_panel_order(spark):
    df, rows = panel(spark, 50)
    own = panel_order(df, [], 10).where("_own").orderBy("_at").collect()
    assert [(r["ticker"], r["d"]) for r in own] == [(r[0], r[1]) for r in rows]


def test_stack_and_describe(spark):
    a = spark.createDataFrame([(D0, "A", 1.0), (D0, "B", None), (D0, "C", 2.0)], "d date, ticker string, value double")
    b = spark.createDataFrame([(D0, "A", 3.0), (D0, "B", 4.0)], "d date, ticker string, ret double")
    assert [tuple(r)[1:] for r in stack_panel(x=a, y=b).collect()] == [("A", 1.0, 3.0)]
    r = {r["name"]: r for r in describe(a, ["value"]).collect()}["value"]
    assert (r["n"], r["mean"], r["p50"], r["max"]) == (2, 1.5, 1.5, 2.0)
    m = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, -3.0), ("a", 3.0, 0.0)], "name string, beta double, z double")
    assert tuple(monthly_summary(m).collect()[0]) == ("a", 3, 2.0, 0.0, 1, 1)
