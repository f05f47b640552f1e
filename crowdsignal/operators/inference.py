"""Means of daily series with plain and autocorrelation-robust t-statistics, and least squares on panels.

Regressions are moments: Spark sums cross products of centred columns, in one row per group, and the small systems of all groups of a
batch are solved at once inside a task. Nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crowdsignal.operators.frequency import value_frequencies, weighted_profile
from crowdsignal.session import staged


def newey_west(series: DataFrame, keys: Sequence[str], value: str, order: str = "d", lags: int = 5, min_obs: int = 10) -> DataFrame:
    """(*keys, n, mean, nw_se, nw_t): mean of a series with its Newey-West error, Bartlett weights over ``lags``.

    Nulls are dropped first, so lags count rows that are left. Fewer than ``min_obs`` give a null mean and t; no error, a null t.
    """
    rows = series.where(F.col(value).isNotNull())
    own, ordered = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(order)
    centred = rows.withColumn("_e", F.col(value) - F.avg(value).over(own))
    lagged = centred.select(*keys, value, "_e", *(F.lag("_e", k).over(ordered).alias(f"_e{k}") for k in range(1, lags + 1)))
    n = F.count(F.lit(1))
    total = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0))
    se = F.sqrt(F.greatest(total / n, F.lit(0.0)) / n)
    enough = F.col("n") >= min_obs
    return lagged.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), se.alias("nw_se")).select(
        *keys, "n", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.col("nw_se")).alias("nw_se"), F.when(enough, F.col("mean") / F.nullif("nw_se", F.lit(0.0))).alias("nw_t")
    )


def ic_summary(ic: DataFrame, keys: Sequence[str] = ("variant",), lags: int = 5) -> DataFrame:
    """(*keys, mean_ic, n_days, plain_t, nw_t) of daily correlations; n_days counts those that aren't null."""
    keys = list(keys)
    plain = ic.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_days"), F.stddev_samp("ic").alias("_sd"))
    plain = plain.withColumn("plain_t", F.col("mean_ic") / F.nullif(F.col("_sd") / F.sqrt(F.col("n_days").cast("double")), F.lit(0.0))).drop("_sd")
    return plain.join(newey_west(ic, keys, "ic", lags=lags).select(*keys, "nw_t"), keys, "left")


def stack_panel(**signals: DataFrame) -> DataFrame:
    """(d, ticker, *names): signals of (d, ticker, value) side by side, for cells in which none is null."""
    out = None
    for name, signal in signals.items():
        value = "ret" if "ret" in signal.columns else "value"
        own = signal.select("d", "ticker", F.col(value).alias(name)).where(F.col(name).isNotNull())
        out = own if out is None else out.join(own, ["d", "ticker"])
    return out


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _filled(rows: pd.DataFrame, k: int, prefix: str) -> np.ndarray:
    """The symmetric k by k matrices of all rows, stacked."""
    out = np.zeros((len(rows), k, k))
    for i, j in _pairs(k):
        out[:, i, j] = out[:, j, i] = rows[f"{prefix}{i}_{j}"]
    return out


def _kept(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys]


def _solved(moments: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(*keys, _yy, means, _b0.., _i0_0..): slopes of centred columns by pseudo-inverse, as singular groups must not fail."""
    means = ["_my", *(f"_m{i}" for i in range(k))]
    names = ["_yy", *means, *(f"_b{i}" for i in range(k)), *(f"_i{i}_{j}" for i, j in _pairs(k))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inverse = np.linalg.pinv(_filled(batch, k, "_x"), hermitian=True)
            slopes = np.einsum("gij,gj->gi", inverse, batch[[f"_xy{i}" for i in range(k)]].to_numpy(float))
            out = {c: batch[c] for c in (*keys, "_yy", *means)} | {f"_b{i}": slopes[:, i] for i in range(k)} | {f"_i{i}_{j}": inverse[:, i, j] for i, j in _pairs(k)}
            yield pd.DataFrame(out)

    return moments.mapInPandas(work, ", ".join([*_kept(moments, keys), *(f"{c} double" for c in names)]))


def _residuals(panel: DataFrame, keys: Sequence[str], y: str, x: Sequence[str]) -> DataFrame:
    """The panel with centred regressors _z0.., residual _e and the fit of its group.

    Means come first and are taken off, so that cross products don't cancel for columns far from zero. Means and fits, a row per group,
    are written, so that Spark knows their size: it broadcasts them where they are small, as for months or forums, and no others.
    """
    k, keys = len(x), list(keys)
    means = panel.groupBy(*keys).agg(F.avg(y).alias("_my"), *(F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)))
    centre = [(F.col(y) - F.col("_my")).alias("_yc"), *((F.col(c) - F.col(f"_m{i}")).alias(f"_z{i}") for i, c in enumerate(x))]
    z = [F.col(f"_z{i}") for i in range(k)]
    sums = [F.sum(z[i] * z[j]).alias(f"_x{i}_{j}") for i, j in _pairs(k)] + [F.sum(z[i] * F.col("_yc")).alias(f"_xy{i}") for i in range(k)]
    first = [F.first(c).alias(c) for c in means.columns if c not in keys]
    means = staged(means, "means")
    centred = panel.join(means, keys).select("*", *centre)
    fits = _solved(centred.groupBy(*keys).agg(F.sum(F.col("_yc") * F.col("_yc")).alias("_yy"), *first, *sums), keys, k)
    rows = panel.join(staged(fits, "fits"), keys).select("*", *centre)
    return rows.withColumn("_e", F.col("_yc") - sum((F.col(f"_b{i}") * z[i] for i in range(k)), F.lit(0.0)))


def _design(k: int) -> list[Column]:
    return [F.lit(1.0), *(F.col(f"_z{i}") for i in range(k))]


def _fit_columns(k: int) -> list[str]:
    return ["_yy", "_my", *(f"_m{i}" for i in range(k)), *(f"_b{i}" for i in range(k)), *(f"_i{i}_{j}" for i, j in _pairs(k))]


def _with_errors(meat: DataFrame, keys: Sequence[str], x: Sequence[str], small_sample: bool, min_obs: int) -> DataFrame:
    """A row per group and coefficient. Errors are made for centred regressors and carried over to the intercept of the columns as given."""
    k, names, numbers = len(x), ["const", *x], ("r2", "beta", "se", "z", "p", "lower", "upper")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            n, size = g["n"].to_numpy(float), len(g)
            inverse = np.zeros((size, k + 1, k + 1))
            inverse[:, 0, 0] = 1 / n
            inverse[:, 1:, 1:] = _filled(g, k, "_i")
            shift = np.tile(np.eye(k + 1), (size, 1, 1))  # intercept = mean of y less slopes times means
            shift[:, 0, 1:] = -g[[f"_m{i}" for i in range(k)]].to_numpy(float)
            bread = shift @ inverse
            with np.errstate(divide="ignore", invalid="ignore"):
                scale = np.where(n > k + 1, n / (n - k - 1), np.nan) if small_sample else np.ones(size)
                variance = np.einsum("gii->gi", bread @ _filled(g, k + 1, "_v") @ bread.transpose(0, 2, 1)) * scale[:, None]
                beta = np.einsum("gij,gj->gi", shift, g[["_my", *(f"_b{i}" for i in range(k))]].to_numpy(float))
                se = np.where(variance > 0, np.sqrt(variance), np.nan)
                z = beta / se
                total = g["_yy"].to_numpy(float)
                r2 = np.where(total > 0, 1 - g["_rss"].to_numpy(float) / total, np.nan)
            p = np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(z)
            for i, name in enumerate(names):
                values = (r2, beta[:, i], se[:, i], z[:, i], p[:, i], beta[:, i] - 1.959963984540054 * se[:, i], beta[:, i] + 1.959963984540054 * se[:, i])
                shown = {c: pd.Series(np.where(n >= min_obs, v, np.nan)).astype("Float64") for c, v in zip(numbers, values, strict=True)}
                shown = {c: v.mask(v.isna() | np.isnan(v.to_numpy(float, na_value=np.nan))) for c, v in shown.items()}
                yield pd.DataFrame({c: g[c].reset_index(drop=True) for c in (*keys, "n")} | {"r2": shown["r2"], "name": name} | {c: shown[c] for c in numbers[1:]})

    schema = ", ".join([*_kept(meat, keys), "n bigint, r2 double, name string", *(f"{c} double" for c in numbers[1:])])
    return meat.mapInPandas(work, schema)


def ols_robust(panel: DataFrame, keys: Sequence[str], y: str, x: Sequence[str], min_obs: int = 0) -> DataFrame:
    """Least squares with an intercept per group, errors robust to heteroskedasticity (HC1): a row per group and coefficient.

    (*keys, n, r2, name, beta, se, z, p, lower, upper). There is at least one key. The panel is read three times: write it first if it is
    costly to make. Groups are few, as months are. Where regressors are collinear, the smallest slopes are taken.
    """
    k = len(x)
    design = _design(k)
    e2 = F.col("_e") * F.col("_e")
    meat = _residuals(panel, keys, y, x).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e2).alias("_rss"), *(F.sum(e2 * design[i] * design[j]).alias(f"_v{i}_{j}") for i, j in _pairs(k + 1)),
        *(F.first(c).alias(c) for c in _fit_columns(k)),
    )
    return _with_errors(meat, keys, x, True, min_obs)


def panel_order(panel: DataFrame, keys: Sequence[str], block: int = 50_000, lags: int = 5) -> DataFrame:
    """The rows in the order of ticker and date, numbered from 0 in ``_at`` per group, in blocks of so many rows.

    A row's number is its place within its ticker plus the rows of the tickers before, so only counts by ticker are ordered as a
    whole. The last ``lags`` rows of a block are given to the next one too, with ``_own`` false, so that lags reach across.
    """
    within = W.partitionBy(*keys, "ticker").orderBy("d")
    sizes = panel.groupBy(*keys, "ticker").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, "ticker", (F.sum("_n").over((W.partitionBy(*keys) if keys else W).orderBy("ticker")) - F.col("_n")).alias("_before"))
    numbered = panel.withColumn("_within", F.row_number().over(within) - 1).join(before, [*keys, "ticker"])
    placed = numbered.withColumn("_at", F.col("_before") + F.col("_within")).drop("_before", "_within")
    own = F.floor(F.col("_at") / block)
    blocks = F.when(F.pmod("_at", F.lit(block)) >= block - lags, F.array(own, own + 1)).otherwise(F.array(own))
    return placed.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)


def ols_hac(panel: DataFrame, keys: Sequence[str], y: str, x: Sequence[str], lags: int = 5, min_obs: int = 0, block: int = 50_000) -> DataFrame:
    """Least squares with an intercept per group, with Newey-West errors; columns as of ``ols_robust``.

    Rows are ordered by ticker, then date, and lags run over this order, from the end of one ticker into the next. A group of fewer
    than ``min_obs`` rows keeps its n and has null coefficients.
    """
    k, fit = len(x), _fit_columns(len(x))
    design = _design(k)
    rows = panel_order(_residuals(panel, keys, y, x).select(*keys, "ticker", "d", "_e", *fit, *(f"_z{i}" for i in range(k))), keys, block, lags)
    u = rows.select(*keys, "_block", "_at", "_own", "_e", *fit, *((F.col("_e") * design[i]).alias(f"_u{i}") for i in range(k + 1)))
    ordered = W.partitionBy(*keys, "_block").orderBy("_at")
    lagged = u.select("*", *(F.lag(f"_u{i}", l).over(ordered).alias(f"_u{i}_{l}") for i in range(k + 1) for l in range(1, lags + 1))).where("_own")

    def cell(i: int, j: int) -> Column:
        out = F.sum(F.col(f"_u{i}") * F.col(f"_u{j}"))
        for l in range(1, lags + 1):
            both = F.col(f"_u{i}") * F.col(f"_u{j}_{l}") + F.col(f"_u{j}") * F.col(f"_u{i}_{l}")
            out = out + (1 - l / (lags + 1)) * F.coalesce(F.sum(both), F.lit(0.0))
        return out.alias(f"_v{i}_{j}")

    meat = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("_rss"), *(cell(i, j) for i, j in _pairs(k + 1)), *(F.first(c).alias(c) for c in fit)
    )
    return _with_errors(meat, keys, x, False, min_obs)


def monthly_summary(monthly: DataFrame, cut: float = 2.0) -> DataFrame:
    """(name, n_months, mean_beta, mean_t, n_above, n_below) over the monthly coefficients; n_above counts t > cut, n_below t < -cut."""
    return monthly.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_months"), F.avg("beta").alias("mean_beta"), F.avg("z").alias("mean_t"),
        F.count_if(F.col("z") > cut).alias("n_above"), F.count_if(F.col("z") < -cut).alias("n_below"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, n, mean, sd, min, p25, p50, p75, max) of each column that has a value, with exact quartiles.

    Quartiles come from the frequencies of the values (see ``weighted_profile``), so no column is gathered in one task.
    """
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "name", "x").where("x IS NOT NULL AND NOT isnan(x)")
    spread = long.groupBy(F.col("name").alias("key")).agg(F.stddev_samp("x").alias("sd"))
    profile = weighted_profile(value_frequencies(long, "name", "x"), (0.25, 0.5, 0.75))
    return profile.join(spread, "key").select(
        F.col("key").alias("name"), F.col("n_values").alias("n"), "mean", "sd", F.col("min_value").alias("min"), "p25", "p50", "p75", F.col("max_value").alias("max")
    )
