"""Queries of factors, returns, rank correlations, backtests, regressions and event studies on both panels, with SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdsignal.operators import backtest, events, inference
from crowdsignal.operators.calendar import padded_returns
from crowdsignal.operators.crosssection import daily_rank_ic, daily_spearman
from crowdsignal.operators.factors import by_forum_and_pooled, daily_cells, factor_variants, forward_returns, momentum, reversal
from crowdsignal.plans.panels import MOMENTUM, PADDED, PANELS, REVERSAL, SQL, cells_sql, returns_sql
from crowdsignal.session import staged

#: Least pairs of a day for a rank correlation: the panels are narrow in the small test tables; the operator's default is 20.
MIN_PAIRS = {"forum": 3, "weekly": 5}
HORIZON = 21


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _signal(scored: DataFrame, by: list[str] | None = None, outcome: DataFrame | None = None) -> DataFrame:
    """The factors with 9 places: products with logarithms that are equal by arithmetic must tie in every engine.

    With ``outcome``, its column ret is joined to the cells, before each becomes a row per factor.
    """
    by = by or []
    cells = daily_cells(scored, by)
    if outcome is not None:
        cells = cells.join(outcome.select("d", "ticker", "ret"), ["d", "ticker"], "left")
    return factor_variants(cells, by, keep=[] if outcome is None else ["ret"]).withColumn("value", F.round("value", 9))


def trade_date_roll(spark: SparkSession, sf: str) -> DataFrame:
    """The session of each scored row."""
    return PANELS["forum"](spark, sf).scored.select("doc_id", "ticker", "trade_date")


def _variants(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """F1, A1, P7, P8."""
    return _signal(PANELS[panel](spark, sf).scored)


def _variants_by_forum(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """F1, G1, P12."""
    return _signal(by_forum_and_pooled(PANELS[panel](spark, sf).scored), ["subreddit"])


def _returns(horizon: int, panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """R1, W3, P10."""
    return _rounded(forward_returns(PANELS[panel](spark, sf).closed, horizon), "ret")


def _momentum(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """K1."""
    x = PANELS[panel](spark, sf)
    return _rounded(momentum(x.closed, x.calendar), "value")


def _reversal(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """K2."""
    return _rounded(reversal(PANELS[panel](spark, sf).closed), "value")


def _padded(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """W4, T11."""
    x = PANELS[panel](spark, sf)
    return _rounded(padded_returns(x.closed, x.calendar), "ret")


def _ic(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    x = PANELS[panel](spark, sf)
    return staged(daily_rank_ic(_signal(x.scored, outcome=forward_returns(x.closed, HORIZON)), None, x.calendar, min_pairs=MIN_PAIRS[panel]), "ic")


def _ic_daily(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """I1, J2, W1, A12."""
    return _rounded(_ic(panel, spark, sf), "ic")


def _ic_summary(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """I2, N1, A13."""
    return _rounded(inference.ic_summary(_ic(panel, spark, sf)), "mean_ic", "plain_t", "nw_t")


def _newey_west(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """N1, W11."""
    return _rounded(inference.newey_west(_ic(panel, spark, sf), ["variant"], "ic"), "mean", "nw_se", "nw_t")


def _ic_by_forum(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """Per forum and pooled, in one job."""
    x = PANELS[panel](spark, sf)
    keys = ["subreddit", "variant"]
    signal = _signal(by_forum_and_pooled(x.scored), ["subreddit"], forward_returns(x.closed, HORIZON))
    ic = staged(daily_rank_ic(signal, None, x.calendar, keys, MIN_PAIRS[panel]), "ic")
    return _rounded(inference.ic_summary(ic, keys), "mean_ic", "plain_t", "nw_t")


def ic_forum_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Mean rank correlation of each variant, a column per forum."""
    return _ic_by_forum("weekly", spark, sf).groupBy("variant").pivot("subreddit", ["A", "N", "R", "ALL"]).agg(F.avg("mean_ic"))


def cumulative_ic(spark: SparkSession, sf: str) -> DataFrame:
    """Running sum of the daily correlations; a null day stays null and doesn't break the sum."""
    ic = _ic("weekly", spark, sf)
    upto = F.sum("ic").over(inference.W.partitionBy("variant").orderBy("d"))
    return _rounded(ic.select("variant", "d", F.when(F.col("ic").isNotNull(), upto).alias("cum_ic")), "cum_ic")


def _signals(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    x = PANELS["weekly"](spark, sf)
    sent = daily_cells(x.scored).select("d", "ticker", F.col("m").alias("value"))
    return {"sent": sent, "mom": momentum(x.closed, x.calendar), "rev": reversal(x.closed), "fwd": forward_returns(x.closed, HORIZON)}


def _spearman(spark: SparkSession, sf: str) -> DataFrame:
    s = {k: staged(v, k) for k, v in _signals(spark, sf).items() if k != "fwd"}  # each takes part in two pairs
    pairs = [daily_spearman(s[a], s[b]).select(F.lit(f"{a}_{b}").alias("pair"), "d", "rho") for a, b in (("sent", "mom"), ("sent", "rev"), ("mom", "rev"))]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2])


def xs_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Daily correlations of three pairs of signals, and their mean over 20 days."""
    last = inference.W.partitionBy("pair").orderBy("d").rowsBetween(-19, 0)
    rolling = F.when(F.count("rho").over(last) == 20, F.avg("rho").over(last))
    return _rounded(_spearman(spark, sf).withColumn("rolling_mean", rolling), "rho", "rolling_mean")


def xs_spearman_mean(spark: SparkSession, sf: str) -> DataFrame:
    """K4."""
    return _rounded(_spearman(spark, sf).groupBy("pair").agg(F.avg("rho").alias("mean_rho"), F.count("rho").alias("n_days")), "mean_rho")


def rebalance_dates(spark: SparkSession, sf: str) -> DataFrame:
    """B2, A15."""
    return backtest.rebalance_dates(_signal(PANELS["weekly"](spark, sf).scored))


def _weights(long_only: bool, spark: SparkSession, sf: str) -> DataFrame:
    """B1, B1b, W2, U5."""
    return _rounded(backtest.quantile_weights(_signal(PANELS["weekly"](spark, sf).scored), long_only=long_only), "w")


def _daily(long_only: bool, panel: str, spark: SparkSession, sf: str) -> DataFrame:
    x = PANELS[panel](spark, sf)
    return backtest.backtest_daily(staged(_signal(x.scored), "signal"), forward_returns(x.closed, 1), x.calendar, x.closed, long_only=long_only)


def _backtest_daily(long_only: bool, panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """B3-B6, J3, J4, W5, W6, W10."""
    out = _rounded(_daily(long_only, panel, spark, sf), "gross", "turnover", "cum", "drawdown")
    return out.withColumns({c: F.round(c, 9) for c in ("cost", "net")})


def _backtest_summary(long_only: bool, panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """B4-B6, A13."""
    return _rounded(backtest.backtest_summary(_daily(long_only, panel, spark, sf)), "ann_return", "sharpe", "max_drawdown", "avg_turnover")


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    """Written once, as regressions read it several times."""
    return staged(inference.stack_panel(**_signals(spark, sf)), "panel")


REGRESSORS = ["sent", "mom", "rev"]


def panel_stack(spark: SparkSession, sf: str) -> DataFrame:
    """O1, J5, P14, T10."""
    return _rounded(_panel(spark, sf), "sent", "mom", "rev", "fwd")


def panel_describe(spark: SparkSession, sf: str) -> DataFrame:
    """A11."""
    return _rounded(inference.describe(_panel(spark, sf), ["sent", "mom", "rev", "fwd"]), "mean", "sd", "min", "p25", "p50", "p75", "max")


_FIT = ("r2", "beta", "se", "z", "lower", "upper")
#: Groups of fewer rows get no coefficients.
LEAST_ROWS = {"month": 30, "pool": 0, "subreddit": 100}


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return inference.ols_robust(_panel(spark, sf).withColumn("month", F.date_format("d", "yyyy-MM")), ["month"], "fwd", REGRESSORS, LEAST_ROWS["month"])


def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    return inference.ols_hac(_panel(spark, sf).withColumn("pool", F.lit("ALL")), ["pool"], "fwd", REGRESSORS)


def ols_monthly_hc1(spark: SparkSession, sf: str) -> DataFrame:
    """O2, P20: a regression per month."""
    return _rounded(_monthly(spark, sf).drop("p"), *_FIT)


def ols_monthly_summary(spark: SparkSession, sf: str) -> DataFrame:
    """O5, A19."""
    out = inference.monthly_summary(_rounded(_monthly(spark, sf), "beta", "z"))
    return out.withColumns({c: F.round(c, 5) for c in ("mean_beta", "mean_t")})


def ols_pooled_hac(spark: SparkSession, sf: str) -> DataFrame:
    """O3: one regression over the panel."""
    return _rounded(_pooled(spark, sf).drop("p"), *_FIT)


def ols_pooled_table(spark: SparkSession, sf: str) -> DataFrame:
    """Its table of coefficients with p-values."""
    return _rounded(_pooled(spark, sf), *_FIT, "p")


def ols_pooled_by_forum(spark: SparkSession, sf: str) -> DataFrame:
    """A pooled regression per forum; fewer than 100 rows give no coefficients."""
    x = PANELS["weekly"](spark, sf)
    sent = daily_cells(x.scored, ["subreddit"]).select("subreddit", "d", "ticker", F.col("m").alias("sent")).where("subreddit IS NOT NULL AND sent IS NOT NULL")
    rest = inference.stack_panel(mom=momentum(x.closed, x.calendar), rev=reversal(x.closed), fwd=forward_returns(x.closed, HORIZON))
    return _rounded(inference.ols_hac(staged(sent.join(rest, ["d", "ticker"]), "panel"), ["subreddit"], "fwd", REGRESSORS, min_obs=LEAST_ROWS["subreddit"]).drop("p"), *_FIT)


def _spikes(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """E1, A2, A4, J6."""
    return _rounded(events.mention_spikes(daily_cells(PANELS[panel](spark, sf).scored)), "m", "p99")


def _forum_spikes(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    x = PANELS[panel](spark, sf)
    return events.mention_spikes(staged(daily_cells(x.scored.where("subreddit IS NOT NULL"), ["subreddit"]), "cells"), ["subreddit"], floor=2.0)


def _spikes_by_forum(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """E1b."""
    return _rounded(_forum_spikes(panel, spark, sf), "m", "p99")


def _event_car(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """E2-E4, J7, W8, A14."""
    x = PANELS[panel](spark, sf)
    windows = events.event_windows(events.mention_spikes(staged(daily_cells(x.scored), "cells")), x.closed, x.calendar)
    return _rounded(events.mean_car(windows), "mean_car", "se")


def _event_car_points(spark: SparkSession, sf: str) -> DataFrame:
    """E5: one, five and ten sessions on."""
    return _event_car("weekly", spark, sf).where("offset IN (1, 5, 10)")


def _event_car_by_forum(panel: str, spark: SparkSession, sf: str) -> DataFrame:
    """E6."""
    x = PANELS[panel](spark, sf)
    windows = events.event_windows(_forum_spikes(panel, spark, sf), x.closed, x.calendar, by=["subreddit"])
    return _rounded(events.mean_car_of_all(windows, x.scored.where("subreddit IS NOT NULL")), "mean_car")


CASE = ("2021-01-01", "2021-03-15")


def case_study_daily(spark: SparkSession, sf: str) -> DataFrame:
    """E7, A3, P15, T2."""
    x = PANELS["forum"](spark, sf)
    return _rounded(events.case_study(daily_cells(x.scored), x.closed, *CASE), "m")


QUERIES = {f.__name__: f for f in (trade_date_roll, ic_forum_matrix, cumulative_ic, xs_spearman, xs_spearman_mean, rebalance_dates, panel_stack, panel_describe, ols_monthly_hc1, ols_monthly_summary, ols_pooled_hac, ols_pooled_table, ols_pooled_by_forum, case_study_daily)}
QUERIES["event_car_points"] = _event_car_points
ORACLE: dict[str, str] = {}


def _name(query: str, panel: str) -> str:
    return query if panel == "forum" else f"{query}_weekly"


for _p in PANELS:
    QUERIES |= {
        _name("factor_variants", _p): partial(_variants, _p), _name("factor_variants_by_forum", _p): partial(_variants_by_forum, _p),
        _name("forward_returns_1", _p): partial(_returns, 1, _p), _name("forward_returns_21", _p): partial(_returns, 21, _p),
        _name("momentum_12_1", _p): partial(_momentum, _p), _name("reversal_1w", _p): partial(_reversal, _p), _name("padded_returns", _p): partial(_padded, _p),
        _name("rank_ic_daily", _p): partial(_ic_daily, _p), _name("rank_ic_summary", _p): partial(_ic_summary, _p), _name("rank_ic_by_forum", _p): partial(_ic_by_forum, _p),
        _name("newey_west_ic", _p): partial(_newey_west, _p),
        _name("ls_backtest_daily", _p): partial(_backtest_daily, False, _p), _name("ls_backtest_summary", _p): partial(_backtest_summary, False, _p),
        _name("lo_backtest_daily", _p): partial(_backtest_daily, True, _p), _name("lo_backtest_summary", _p): partial(_backtest_summary, True, _p),
        _name("mention_spikes", _p): partial(_spikes, _p), _name("mention_spikes_by_forum", _p): partial(_spikes_by_forum, _p),
        _name("event_car", _p): partial(_event_car, _p), _name("event_car_by_forum", _p): partial(_event_car_by_forum, _p),
    }
QUERIES |= {"quintile_weights": partial(_weights, False), "long_only_weights": partial(_weights, True)}

# SQL. Each query is tables of plans.panels followed by a select.

_BOTH = "sc0 AS (SELECT * FROM sc WHERE subreddit IS NOT NULL), scx AS (SELECT trade_date, ticker, p, subreddit FROM sc0 UNION ALL SELECT trade_date, ticker, p, 'ALL' FROM sc0)"


def _ic_sql(keys: str, least: int) -> str:
    """Table ic (keys, d, n_pairs, ic) of fv, r and cal."""
    return f"""
prs AS (SELECT {keys}, fv.d, fv.ticker, value, ret FROM fv JOIN r ON fv.d = r.d AND fv.ticker = r.ticker WHERE value IS NOT NULL AND ret IS NOT NULL),
rks AS (SELECT {keys}, d, rank() OVER (PARTITION BY {keys}, d ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, d, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY {keys}, d ORDER BY ret) + (count(*) OVER (PARTITION BY {keys}, d, ret) - 1) / 2.0 AS b FROM prs),
ctr AS (SELECT {keys}, d, a - avg(a) OVER (PARTITION BY {keys}, d) AS a, b - avg(b) OVER (PARTITION BY {keys}, d) AS b FROM rks),
day AS (SELECT {keys}, d, count(*) AS n, sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0) AS x FROM ctr GROUP BY {keys}, d),
ic AS (SELECT {keys}, d, coalesce(n, 0) AS n_pairs, CASE WHEN n >= {least} THEN x END AS ic
  FROM (SELECT DISTINCT {keys}, fv.d FROM fv JOIN cal ON fv.d = cal.d) LEFT JOIN day USING ({keys}, d))"""


def _nw_sql(keys: str) -> str:
    """Table nw (keys, n, mean, nw_se, nw_t) of ic."""
    lags = ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, 6))
    total = " + ".join(["sum(e * e)", *(f"2 * (1 - {k} / 6.0) * coalesce(sum(e * e{k}), 0)" for k in range(1, 6))])
    return f"""
dev AS (SELECT {keys}, d, ic, ic - avg(ic) OVER (PARTITION BY {keys}) AS e FROM ic WHERE ic IS NOT NULL),
lgd AS (SELECT {keys}, ic, e, {lags} FROM dev WINDOW w AS (PARTITION BY {keys} ORDER BY d)),
nw0 AS (SELECT {keys}, count(*) AS n, avg(ic) AS mean, sqrt(greatest(({total}) / count(*), 0) / count(*)) AS nw_se FROM lgd GROUP BY {keys}),
nw AS (SELECT {keys}, n, CASE WHEN n >= 10 THEN mean END AS mean, CASE WHEN n >= 10 THEN nw_se END AS nw_se, CASE WHEN n >= 10 THEN mean / nullif(nw_se, 0) END AS nw_t FROM nw0)"""


def _summary_sql(keys: str) -> str:
    return f"""SELECT {keys}, round(mean_ic, 6) AS mean_ic, n_days, round(mean_ic / nullif(sd / sqrt(n_days), 0), 6) AS plain_t, round(nw_t, 6) AS nw_t
      FROM (SELECT {keys}, avg(ic) AS mean_ic, count(ic) AS n_days, stddev_samp(ic) AS sd FROM ic GROUP BY {keys}) LEFT JOIN nw USING ({keys})"""


def _weights_sql(source: str, long_only: bool) -> str:
    """Table wts (variant, d, ticker, w) of the rows of ``source``."""
    top, bottom = "sum(CASE WHEN pct >= 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY variant, d)", "sum(CASE WHEN pct <= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY variant, d)"
    low = "" if long_only else f"WHEN pct <= 0.2 THEN -1.0 / CAST({bottom} AS DOUBLE)"
    return f"""
pct AS (SELECT variant, d, ticker, CAST(rank() OVER (PARTITION BY variant, d ORDER BY value) + (count(*) OVER (PARTITION BY variant, d, value) - 1) / 2.0 AS DOUBLE)
  / count(*) OVER (PARTITION BY variant, d) AS pct FROM {source} WHERE value IS NOT NULL),
wts AS (SELECT variant, d, ticker, CAST(CASE {low} WHEN pct >= 0.8 THEN 1.0 / CAST({top} AS DOUBLE) ELSE 0 END AS DOUBLE) AS w FROM pct)"""


_PICKS = "picks AS (SELECT variant, max(d) AS rebal FROM fv WHERE value IS NOT NULL GROUP BY variant, date_trunc('month', d))"


def _backtest_sql(panel: str, long_only: bool) -> str:
    """Table bt of the daily results: positions on the whole grid of sessions and tickers."""
    return f"""WITH {SQL[panel]}, {cells_sql()}, {returns_sql(1)}, {_PICKS},
onp AS (SELECT fv.* FROM fv JOIN picks ON fv.variant = picks.variant AND fv.d = picks.rebal), {_weights_sql("onp", long_only)},
held AS (SELECT l.variant, cal.d, max(rebal) AS rebal FROM (SELECT variant, max(d) AS last FROM fv WHERE value IS NOT NULL GROUP BY 1) l
  JOIN cal ON cal.d <= l.last JOIN picks ON picks.variant = l.variant AND rebal <= cal.d GROUP BY 1, 2),
hk AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY d) AS k FROM held),
pos AS (SELECT hk.variant, hk.d, k, ticker, w FROM hk JOIN wts ON hk.variant = wts.variant AND hk.rebal = wts.d WHERE ticker IN (SELECT ticker FROM px)),
turn AS (SELECT coalesce(a.variant, b.variant) AS variant, coalesce(a.k, b.k + 1) AS k, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS t
  FROM pos a FULL JOIN pos b ON a.variant = b.variant AND a.ticker = b.ticker AND a.k = b.k + 1 GROUP BY 1, 2),
gain AS (SELECT variant, pos.d, sum(w * coalesce(ret, 0)) AS g FROM pos LEFT JOIN r ON pos.d = r.d AND pos.ticker = r.ticker GROUP BY 1, 2),
net AS (SELECT hk.variant, hk.d, coalesce(g, 0) AS gross, CASE WHEN hk.k = 1 THEN 0.0 ELSE coalesce(t, 0) END AS turnover FROM hk
  LEFT JOIN gain ON hk.variant = gain.variant AND hk.d = gain.d LEFT JOIN turn ON hk.variant = turn.variant AND hk.k = turn.k),
net2 AS (SELECT *, turnover * 0.0005 AS cost, gross - turnover * 0.0005 AS net FROM net),
cum AS (SELECT *, product(1 + net) OVER (PARTITION BY variant ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS cum FROM net2),
bt AS (SELECT *, cum - max(cum) OVER (PARTITION BY variant ORDER BY d ROWS UNBOUNDED PRECEDING) AS drawdown FROM cum)"""


_ROUNDED = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_BT_DAILY = f"SELECT variant, d, {_ROUNDED('gross', 'turnover', 'cum', 'drawdown')}, round(cost, 9) AS cost, round(net, 9) AS net FROM bt"
_BT_SUMMARY = """SELECT variant, round(pow(1 + avg(net), 252) - 1, 6) AS ann_return, round(avg(net) * 252 / nullif(stddev_samp(net) * sqrt(252), 0), 6) AS sharpe,
  round(min(drawdown), 6) AS max_drawdown, round(avg(turnover), 6) AS avg_turnover, count(*) AS n_days FROM bt GROUP BY variant"""


def _spikes_sql(by: str, floor: int) -> str:
    """Table ev of cells."""
    b = f"{by}, " if by else ""
    on = f"cells.{by} = q.{by} AND " if by else ""
    return f"""
q AS (SELECT {b}ticker, quantile_cont(n, 0.99) AS p99 FROM cells GROUP BY {b}ticker HAVING quantile_cont(n, 0.99) >= {floor}),
ev AS (SELECT {", ".join(f"cells.{c}" for c in ([by] if by else []) + ["d", "ticker", "n", "m"])}, p99 FROM cells JOIN q ON {on}cells.ticker = q.ticker WHERE n >= p99 AND m > 0)"""


def _car_sql(by: str) -> str:
    """Table car (by, d, ticker, offset, ar, car) of ev."""
    b = f"{by}, " if by else ""
    return f"""{PADDED},
mk AS (SELECT i, avg(ret) AS market FROM ret GROUP BY i),
abn AS (SELECT ticker, ret.i, ret - market AS ar FROM ret JOIN mk ON ret.i = mk.i WHERE ret - market IS NOT NULL),
win AS (SELECT {", ".join(f"ev.{c}" for c in ([by] if by else []) + ["d", "ticker"])}, o AS "offset", ar FROM ev JOIN cal ON ev.d = cal.d JOIN generate_series(-10, 10) AS g(o) ON true
  JOIN abn ON abn.ticker = ev.ticker AND abn.i = cal.i + o),
car AS (SELECT *, sum(ar) OVER (PARTITION BY {b}ticker, d ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS car, count(*) OVER (PARTITION BY {b}ticker, d) AS k FROM win)"""


for _p in PANELS:
    _base, _fv, _fvf = f"WITH {SQL[_p]}", f"WITH {SQL[_p]}, {cells_sql()}", f"WITH {SQL[_p]}, {_BOTH}, {cells_sql('subreddit').replace('FROM sc ', 'FROM scx ')}"
    _one, _two = "variant", "subreddit, variant"
    _icd = f"{_fv}, {returns_sql(HORIZON)}, {_ic_sql(_one, MIN_PAIRS[_p])}"
    _forum = f"WITH {SQL[_p]}, {cells_sql('subreddit').replace('WHERE trade_date', 'WHERE subreddit IS NOT NULL AND trade_date')}"
    ORACLE |= {
        _name("factor_variants", _p): f"{_fv} SELECT d, ticker, variant, value FROM fv",
        _name("factor_variants_by_forum", _p): f"{_fvf} SELECT subreddit, d, ticker, variant, value FROM fv",
        _name("forward_returns_1", _p): f"{_base}, {returns_sql(1)} SELECT d, ticker, round(ret, 6) AS ret FROM r",
        _name("forward_returns_21", _p): f"{_base}, {returns_sql(21)} SELECT d, ticker, round(ret, 6) AS ret FROM r",
        _name("momentum_12_1", _p): f"{_base}, {MOMENTUM} SELECT d, ticker, round(value, 6) AS value FROM mom",
        _name("reversal_1w", _p): f"{_base}, {REVERSAL} SELECT d, ticker, round(value, 6) AS value FROM rev",
        _name("padded_returns", _p): f"{_base}, {PADDED} SELECT d, i, ticker, round(ret, 6) AS ret FROM ret",
        _name("rank_ic_daily", _p): f"{_icd} SELECT variant, d, n_pairs, round(ic, 6) AS ic FROM ic",
        _name("rank_ic_summary", _p): f"{_icd}, {_nw_sql(_one)} {_summary_sql(_one)}",
        _name("newey_west_ic", _p): f"{_icd}, {_nw_sql(_one)} SELECT variant, n, {_ROUNDED('mean', 'nw_se', 'nw_t')} FROM nw",
        _name("rank_ic_by_forum", _p): f"{_fvf}, {returns_sql(HORIZON)}, {_ic_sql(_two, MIN_PAIRS[_p])}, {_nw_sql(_two)} {_summary_sql(_two)}",
        _name("ls_backtest_daily", _p): f"{_backtest_sql(_p, False)} {_BT_DAILY}", _name("ls_backtest_summary", _p): f"{_backtest_sql(_p, False)} {_BT_SUMMARY}",
        _name("lo_backtest_daily", _p): f"{_backtest_sql(_p, True)} {_BT_DAILY}", _name("lo_backtest_summary", _p): f"{_backtest_sql(_p, True)} {_BT_SUMMARY}",
        _name("mention_spikes", _p): f"{_fv}, {_spikes_sql('', 3)} SELECT d, ticker, n, round(m, 6) AS m, round(p99, 6) AS p99 FROM ev",
        _name("mention_spikes_by_forum", _p): f"{_forum}, {_spikes_sql('subreddit', 2)} SELECT subreddit, d, ticker, n, round(m, 6) AS m, round(p99, 6) AS p99 FROM ev",
        _name("event_car", _p): f"""{_fv}, {_spikes_sql('', 3)}, {_car_sql('')} SELECT "offset", count(*) AS n_events, round(avg(car), 6) AS mean_car, round(stddev_pop(car) / sqrt(count(*)), 6) AS se
          FROM car WHERE k = 21 GROUP BY 1""",
        _name("event_car_by_forum", _p): f"""{_forum}, {_spikes_sql('subreddit', 2)}, {_car_sql('subreddit')} SELECT f.subreddit, f.o AS "offset", count(car.car) AS n_events, coalesce(round(avg(car.car), 6), 0) AS mean_car
          FROM (SELECT * FROM (SELECT DISTINCT subreddit FROM sc WHERE subreddit IS NOT NULL), generate_series(-10, 10) AS g(o)) f LEFT JOIN car ON car.subreddit = f.subreddit AND car."offset" = f.o AND k = 21 GROUP BY 1, 2""",
    }

_WEEKLY = f"WITH {SQL['weekly']}, {cells_sql()}"
_SIGNALS = f"{_WEEKLY}, sent AS (SELECT d, ticker, value FROM fv WHERE variant = 'mean_sent'), {MOMENTUM}, {REVERSAL}, {returns_sql(HORIZON)}"
_STACK = f"""{_SIGNALS}, stack AS (SELECT sent.d, sent.ticker, sent.value AS sent, mom.value AS mom, rev.value AS rev, ret AS fwd FROM sent JOIN mom ON sent.d = mom.d AND sent.ticker = mom.ticker
  JOIN rev ON sent.d = rev.d AND sent.ticker = rev.ticker JOIN r ON sent.d = r.d AND sent.ticker = r.ticker WHERE sent.value IS NOT NULL AND mom.value IS NOT NULL AND rev.value IS NOT NULL AND ret IS NOT NULL)"""


def _rho_sql(a: str, b: str) -> str:
    """Tables <a>_<b> (pair, d, rho)."""
    k = f"{a}_{b}"
    side = lambda x, y, n: f"""{k}{n} AS (SELECT d, ticker, v - avg(v) OVER (PARTITION BY d) AS v FROM (SELECT d, ticker, rank() OVER (PARTITION BY d ORDER BY value) + (count(*) OVER (PARTITION BY d, value) - 1) / 2.0 AS v
  FROM {x} WHERE value IS NOT NULL AND ticker IN (SELECT ticker FROM {y}) AND d IN (SELECT d FROM {y})))"""  # noqa: E731
    return f"""{side(a, b, 'x')}, {side(b, a, 'y')},
{k} AS (SELECT '{k}' AS pair, coalesce(x.d, y.d) AS d, coalesce(sum(x.v * y.v), 0) / nullif(sqrt(coalesce(sum(x.v * x.v), 0) * coalesce(sum(y.v * y.v), 0)), 0) AS rho
  FROM {k}x x FULL JOIN {k}y y ON x.d = y.d AND x.ticker = y.ticker GROUP BY 2)"""


def _ols_sql(source: str, g: str, hac: bool) -> str:
    """Table fit (g, n, r2, name, beta, se, z, lower, upper) of the table ``source``.

    Slopes by Cramer's rule on centred columns. A coefficient is a sum over rows of weight times outcome, so its robust variance is a
    sum of products of weight times residual, at lag 0 for HC1 and at lags 0 to 5 for HAC.
    """
    names = ["const", *REGRESSORS]
    part = f"PARTITION BY {g} ORDER BY ticker, d"
    lags = ", ".join(f"lag(f{j} * e, {k}) OVER ({part}) AS u{j}_{k}" for j in range(4) for k in range(1, 6)) if hac else "0 AS nolag"
    terms = lambda j: " + ".join([f"sum(f{j} * e * f{j} * e)", *(f"2 * (1 - {k} / 6.0) * coalesce(sum(f{j} * e * u{j}_{k}), 0)" for k in range(1, 6) if hac)])
    scale = "1.0" if hac else "CAST(count(*) AS DOUBLE) / nullif(count(*) - 4, 0)"
    rows = " UNION ALL ".join(f"SELECT {g}, n, r2, '{name}' AS name, b{j} AS beta, sqrt(v{j}) AS se FROM var" for j, name in enumerate(names))
    shown = lambda x, c: f"CASE WHEN n >= {LEAST_ROWS[g]} THEN round({x}, 6) END AS {c}"
    return f"""
mn AS (SELECT {g}, count(*) AS n, avg(sent) AS ma, avg(mom) AS mb, avg(rev) AS mc, avg(fwd) AS my FROM {source} GROUP BY {g}),
z AS (SELECT s.{g}, ticker, d, n, ma, mb, mc, my, sent - ma AS a, mom - mb AS b, rev - mc AS c, fwd - my AS y FROM {source} s JOIN mn ON s.{g} = mn.{g}),
mo AS (SELECT {g}, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS yb, sum(c * y) AS cy, sum(y * y) AS yy FROM z GROUP BY {g}),
de AS (SELECT *, nullif(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac), 0) AS det FROM mo),
iv AS (SELECT *, (bb * cc - bc * bc) / det AS i11, (ac * bc - ab * cc) / det AS i12, (ab * bc - ac * bb) / det AS i13, (aa * cc - ac * ac) / det AS i22, (ab * ac - aa * bc) / det AS i23, (aa * bb - ab * ab) / det AS i33 FROM de),
sl AS (SELECT *, i11 * ay + i12 * yb + i13 * cy AS b1, i12 * ay + i22 * yb + i23 * cy AS b2, i13 * ay + i23 * yb + i33 * cy AS b3 FROM iv),
fw AS (SELECT z.{g}, ticker, d, n, yy, b1, b2, b3, my - b1 * ma - b2 * mb - b3 * mc AS b0, y - b1 * a - b2 * b - b3 * c AS e, i11 * a + i12 * b + i13 * c AS f1, i12 * a + i22 * b + i23 * c AS f2,
  i13 * a + i23 * b + i33 * c AS f3, ma, mb, mc FROM z JOIN sl ON z.{g} = sl.{g}),
fz AS (SELECT *, 1.0 / n - ma * f1 - mb * f2 - mc * f3 AS f0 FROM fw),
lg AS (SELECT *, {lags} FROM fz),
var AS (SELECT {g}, count(*) AS n, 1 - sum(e * e) / max(yy) AS r2, max(b0) AS b0, max(b1) AS b1, max(b2) AS b2, max(b3) AS b3, {", ".join(f"greatest(({terms(j)}) * {scale}, 0) AS v{j}" for j in range(4))} FROM lg GROUP BY {g}),
long AS ({rows}),
fit AS (SELECT {g}, n, {shown("r2", "r2")}, name, {shown("beta", "beta")}, {shown("se", "se")}, {shown("beta / nullif(se, 0)", "z")}, {shown("beta - 1.959963984540054 * se", "lower")}, {shown("beta + 1.959963984540054 * se", "upper")} FROM long)"""


_FORUM_STACK = f"""WITH {SQL['weekly']}, {cells_sql('subreddit').replace('WHERE trade_date', 'WHERE subreddit IS NOT NULL AND trade_date')}, {MOMENTUM}, {REVERSAL}, {returns_sql(HORIZON)},
  fst AS (SELECT subreddit, fv.d, fv.ticker, fv.value AS sent, mom.value AS mom, rev.value AS rev, ret AS fwd FROM fv JOIN mom ON fv.d = mom.d AND fv.ticker = mom.ticker JOIN rev ON fv.d = rev.d AND fv.ticker = rev.ticker
  JOIN r ON fv.d = r.d AND fv.ticker = r.ticker WHERE variant = 'mean_sent' AND fv.value IS NOT NULL AND mom.value IS NOT NULL AND rev.value IS NOT NULL AND ret IS NOT NULL)"""
_RHO = f"{_SIGNALS}, {_rho_sql('sent', 'mom')}, {_rho_sql('sent', 'rev')}, {_rho_sql('mom', 'rev')}, rho AS (SELECT * FROM sent_mom UNION ALL SELECT * FROM sent_rev UNION ALL SELECT * FROM mom_rev)"
_WEEKLY_IC = f"{_WEEKLY}, {returns_sql(HORIZON)}, {_ic_sql('variant', MIN_PAIRS['weekly'])}"
_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
    f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM stack"
    for c in ("sent", "mom", "rev", "fwd")
)
ORACLE |= {
    "trade_date_roll": f"WITH {SQL['forum']} SELECT doc_id, ticker, trade_date FROM sc",
    "cumulative_ic": f"{_WEEKLY_IC} SELECT variant, d, CASE WHEN ic IS NOT NULL THEN round(sum(ic) OVER (PARTITION BY variant ORDER BY d ROWS UNBOUNDED PRECEDING), 6) END AS cum_ic FROM ic",
    "ic_forum_matrix": f"""{f"WITH {SQL['weekly']}, {_BOTH}, {cells_sql('subreddit').replace('FROM sc ', 'FROM scx ')}"}, {returns_sql(HORIZON)}, {_ic_sql('subreddit, variant', MIN_PAIRS['weekly'])},
      m AS (SELECT subreddit, variant, round(avg(ic), 6) AS x FROM ic GROUP BY 1, 2)
      SELECT variant, {", ".join(f"max(x) FILTER (WHERE subreddit = '{f}') AS {chr(34)}{f}{chr(34)}" for f in ("A", "N", "R", "ALL"))} FROM m GROUP BY variant""",
    "xs_spearman": f"{_RHO} SELECT pair, d, round(rho, 6) AS rho, CASE WHEN count(rho) OVER w = 20 THEN round(avg(rho) OVER w, 6) END AS rolling_mean FROM rho WINDOW w AS (PARTITION BY pair ORDER BY d ROWS 19 PRECEDING)",
    "xs_spearman_mean": f"{_RHO} SELECT pair, round(avg(rho), 6) AS mean_rho, count(rho) AS n_days FROM rho GROUP BY pair",
    "rebalance_dates": f"{_WEEKLY}, {_PICKS} SELECT variant, rebal FROM picks",
    "quintile_weights": f"{_WEEKLY}, {_weights_sql('fv', False)} SELECT variant, d, ticker, round(w, 6) AS w FROM wts",
    "long_only_weights": f"{_WEEKLY}, {_weights_sql('fv', True)} SELECT variant, d, ticker, round(w, 6) AS w FROM wts",
    "panel_stack": f"{_STACK} SELECT d, ticker, {_ROUNDED('sent', 'mom', 'rev', 'fwd')} FROM stack",
    "panel_describe": f"{_STACK} {_DESCRIBE}",
    "ols_monthly_hc1": f"{_STACK}, mst AS (SELECT *, strftime(d, '%Y-%m') AS month FROM stack), {_ols_sql('mst', 'month', False)} SELECT * FROM fit",
    "ols_monthly_summary": f"""{_STACK}, mst AS (SELECT *, strftime(d, '%Y-%m') AS month FROM stack), {_ols_sql('mst', 'month', False)}
      SELECT name, count(*) AS n_months, round(avg(beta), 5) AS mean_beta, round(avg(z), 5) AS mean_t, count(*) FILTER (WHERE z > 2) AS n_above, count(*) FILTER (WHERE z < -2) AS n_below FROM fit GROUP BY name""",
    "ols_pooled_hac": f"{_STACK}, pst AS (SELECT *, 'ALL' AS pool FROM stack), {_ols_sql('pst', 'pool', True)} SELECT * FROM fit",
    # p = 1 - erf(x) for x = |z| / sqrt(2), by the series 2 / sqrt(pi) exp(-x^2) sum 2^k x^(2k+1) / (2k+1)!!, which has no negative term
    "ols_pooled_table": f"""{_STACK}, pst AS (SELECT *, 'ALL' AS pool FROM stack), {_ols_sql('pst', 'pool', True)},
      pv AS (SELECT long.name, CASE WHEN abs(beta / se) > 8 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-pow(abs(beta / se), 2) / 2) * (SELECT sum(exp(2 * k * ln(2) + (2 * k + 1) * ln(abs(beta / se) / sqrt(2)) - lgamma(2 * k + 2) + lgamma(k + 1)))
        FROM generate_series(0, 400) AS g(k)) END AS p FROM long)
      SELECT fit.*, round(p, 6) AS p FROM fit JOIN pv USING (name)""",
    "ols_pooled_by_forum": f"{_FORUM_STACK}, {_ols_sql('fst', 'subreddit', True)} SELECT * FROM fit",
    "event_car_points": ORACLE["event_car_weekly"].replace("WHERE k = 21", """WHERE k = 21 AND "offset" IN (1, 5, 10)"""),
    "case_study_daily": f"""WITH {SQL['forum']}, {cells_sql()},
      t AS (SELECT ticker FROM cells WHERE ticker IN (SELECT ticker FROM px) GROUP BY ticker ORDER BY ticker = 'GME' DESC, sum(n) DESC, ticker LIMIT 1),
      a AS (SELECT * FROM cells JOIN t USING (ticker) WHERE d BETWEEN DATE '{CASE[0]}' AND DATE '{CASE[1]}'), b AS (SELECT * FROM c JOIN t USING (ticker) WHERE d BETWEEN DATE '{CASE[0]}' AND DATE '{CASE[1]}')
      SELECT coalesce(a.d, b.d) AS d, coalesce(a.ticker, b.ticker) AS ticker, coalesce(n, 0) AS n, round(m, 6) AS m, close FROM a FULL JOIN b ON a.d = b.d""",
}
