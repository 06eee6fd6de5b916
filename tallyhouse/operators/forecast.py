"""One demand model per (category, region), fitted in parallel.

A group is the daily series of one pair: its size is bounded by the calendar, not
by the number of sales. Features come from Spark; the Python part only solves.

y = trend(t) * (1 + effects): a piecewise linear trend, and multiplicative weekly,
yearly, holiday and promotion effects, each a penalised least-squares fit given the
other. Penalties stand for the priors named below.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.operators.series import PAIR

MODEL_VERSION = "piecewise-v1"
INTERVAL = 0.90
CHANGEPOINTS, CHANGEPOINT_RANGE, CHANGEPOINT_PRIOR = 25, 0.90, 0.05
EFFECT_PRIOR = 10.0
COVERAGE_POWER = 8
# a cycle the history does not cover once says little about the days ahead
WEEKLY, YEARLY = (7.0, 3), (365.25, 10)
ROUNDS, DRAWS = 6, 400

FIT = (
    "category string, region string, ds date, yhat double, yhat_lower double, "
    "yhat_upper double, error string"
)


def fit_forecast(frame: DataFrame, interval: float = INTERVAL) -> DataFrame:
    """Future days of each pair; a pair that cannot be fitted yields one row that
    holds the reason."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = {c: pdf[c].iloc[0] for c in PAIR}
        try:
            out = _fit_pair(pdf.sort_values("ds"), interval, "|".join(pair.values()))
            out["error"] = None
        except Exception as e:  # one bad series must not end the job
            out = pd.DataFrame([{"ds": None, "error": f"{type(e).__name__}: {e}"}])
        return out.assign(**pair).reindex(columns=[c.split()[0] for c in FIT.split(", ")])

    numeric = frame.withColumns({c: F.col(c).cast("double") for c in ("y", "promo_active")})
    # little data but much work per pair: a fixed number of partitions keeps adaptive
    # execution from packing many pairs into one task by their size
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numeric = numeric.repartition(tasks, *PAIR)
    return numeric.groupBy(*PAIR).applyInPandas(fit, FIT)


def _waves(days: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2 * np.pi * np.outer(days / period, np.arange(1, order + 1))
    return np.hstack([np.sin(angle), np.cos(angle)])


def _ridge(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ y)


def _effects(pdf: pd.DataFrame, days: np.ndarray, train: np.ndarray) -> tuple:
    """Effect columns of all days and the prior width of each column."""
    span = days[train][-1] - days[train][0] + 1
    cols, widths = [], []
    for period, order in (WEEKLY, YEARLY):
        cols.append(_waves(days, period, order))
        # the less of a cycle the history covers, the closer its effect stays to zero
        widths += [EFFECT_PRIOR * min(1.0, span / period) ** COVERAGE_POWER] * 2 * order
    labels = sorted({h for hs in pdf["holidays"][train] for h in hs})
    cols += [np.array([label in hs for hs in pdf["holidays"]], float)[:, None] for label in labels]
    promo = pdf["promo_active"].to_numpy(float)
    if promo[train].sum() > 0:
        cols.append(promo[:, None])
    x = np.hstack(cols)
    return x, np.array(widths + [EFFECT_PRIOR] * (x.shape[1] - len(widths)))


def _fit_pair(pdf: pd.DataFrame, interval: float, name: str) -> pd.DataFrame:
    y = pdf["y"].to_numpy(float)
    train = ~np.isnan(y)
    if train.sum() < 2:
        raise ValueError("fewer than 2 observed days")
    days = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]").astype(float)
    first, last = days[train][0], days[train][-1]
    t = (days - first) / max(last - first, 1.0)
    scale = np.abs(y[train]).max() or 1.0
    y = y / scale

    history = t[train][: max(int(train.sum() * CHANGEPOINT_RANGE), 1)]
    picks = np.linspace(0, len(history) - 1, min(CHANGEPOINTS, len(history) - 1) + 1)
    knots = history[picks.round().astype(int)][1:]
    trend = np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - knots, 0)])
    x, widths = _effects(pdf, days, train)

    a_all, a, xt, yt = trend, trend[train], x[train], y[train]
    season, bends = np.zeros(len(yt)), np.full(len(knots), CHANGEPOINT_PRIOR)
    noise = yt.var() or 1e-6
    for _ in range(ROUNDS):
        # absolute-value prior on slope changes, as reweighted squares
        bend = noise / (CHANGEPOINT_PRIOR * np.maximum(np.abs(bends), 1e-4))
        lift = (1 + season)[:, None]
        slope = _ridge(a * lift, yt, np.concatenate([[1e-8, 1e-8], bend]))
        level, bends = a @ slope, slope[2:]
        effect = _ridge(xt * level[:, None], yt - level, noise / widths**2 + 1e-9)
        season = xt @ effect
        noise = max(np.var(yt - level * (1 + season)), 1e-10)

    ahead = days > last
    level, lift, steps = (a_all @ slope)[ahead], 1 + x[ahead] @ effect, t[ahead] - 1.0
    yhat = level * lift
    # spread: the noise plus slope changes as frequent and as large as those seen
    rng = np.random.default_rng(zlib.crc32(name.encode()))
    step = np.diff(steps, prepend=0.0)
    hits = rng.random((DRAWS, len(step))) < np.clip(len(knots) * step, 0, 1)
    size = np.abs(bends).mean() if len(bends) else 0.0
    drift = (np.cumsum(hits * rng.laplace(0, size + 1e-12, hits.shape), axis=1) * step).cumsum(axis=1)
    paths = yhat + drift * lift + rng.normal(0, np.sqrt(noise), hits.shape)
    edge = (1 - interval) / 2
    low, high = np.quantile(paths, [edge, 1 - edge], axis=0)
    values = np.clip(np.stack([yhat, np.minimum(low, yhat), np.maximum(high, yhat)]) * scale, 0, None)
    if not np.isfinite(values).all():
        raise ValueError("the fit did not converge")
    out = pd.DataFrame(values.T, columns=["yhat", "yhat_lower", "yhat_upper"])
    out.insert(0, "ds", pdf["ds"].to_numpy()[ahead])
    return out


def forecast_rows(
    fit: DataFrame, run_date: Column, model_version: str = MODEL_VERSION
) -> DataFrame:
    """Fitted days as rows of the forecast table."""
    good = fit.filter("error is null")
    value = {"predicted_revenue": "yhat", "yhat_lower": "yhat_lower", "yhat_upper": "yhat_upper"}
    return good.select(
        run_date.alias("run_date"),
        *PAIR,
        F.col("ds").alias("target_date"),
        *[F.col(s).cast("decimal(14,4)").alias(n) for n, s in value.items()],
        F.lit(model_version).alias("model_version"),
    )


def forecast_filter(
    forecasts: DataFrame, category: str | None = None, region: str | None = None
) -> DataFrame:
    if category:
        forecasts = forecasts.filter(F.col("category") == category)
    if region:
        forecasts = forecasts.filter(F.col("region") == region)
    return forecasts


def latest_run(
    forecasts: DataFrame, category: str | None = None, region: str | None = None
) -> DataFrame:
    """Rows of the newest run under the filter. The run date is a scalar subquery,
    so a table partitioned by it reads one partition."""
    scope = forecast_filter(forecasts, category, region)
    return scope.filter(F.col("run_date") == scope.agg(F.max("run_date")).scalar())


def forecast_points(
    forecasts: DataFrame,
    category: str | None = None,
    region: str | None = None,
    horizon: int = 90,
) -> DataFrame:
    """First ``horizon`` rows of the newest run by day; without a filter the limit
    runs across all pairs."""
    rows = latest_run(forecasts, category, region)
    return rows.orderBy("target_date", *PAIR).limit(horizon)


def forecast_points_per_pair(forecasts: DataFrame, horizon: int = 90) -> DataFrame:
    """First ``horizon`` days of each pair in the newest run."""
    rows = latest_run(forecasts)
    starts = rows.groupBy(*PAIR).agg(F.sort_array(F.collect_set("target_date")).alias("days"))
    last = F.coalesce(F.get("days", F.lit(horizon - 1)), F.element_at("days", -1))
    ends = starts.select(*PAIR, last.alias("until"))
    return rows.join(ends, PAIR).filter("target_date <= until").drop("until")


def forecast_inventory(forecasts: DataFrame) -> DataFrame:
    return forecasts.agg(
        F.count("*").alias("forecast_rows"), F.max("target_date").alias("latest_target")
    )
