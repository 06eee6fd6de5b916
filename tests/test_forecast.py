"""Properties of the fitted forecast."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import calendars as cal, forecast as fc, series as sr

FRAME = "category string, region string, ds date, y decimal(18,2)"
PROMOS = "promo_id string, category string, region string, start_date date, end_date date, discount_pct decimal(8,4)"


def series(spark, n, category="Snacks", noise=5.0, bump=None):
    rng, start, rows = np.random.default_rng(1), date(2024, 1, 1), []
    for t in range(n):
        y = 100 + 0.5 * t + 20 * math.sin(2 * math.pi * t / 7) + rng.normal(0, noise)
        if bump and t in bump:
            y *= 1.5
        rows.append((category, "West", start + timedelta(days=t), round(max(y, 0), 2)))
    df = spark.createDataFrame(rows, "category string, region string, ds date, y double")
    return df.withColumn("y", F.col("y").cast("decimal(18,2)"))


def frame(spark, df, horizon, promos=(), min_days=60):
    span = df.agg(F.min("ds").alias("first_day"), F.date_add(F.max("ds"), horizon).alias("last_day"))
    holidays = cal.holiday_calendar(cal.calendar_dimension(span))
    return sr.training_frame(df, spark.createDataFrame(list(promos), PROMOS), holidays, horizon, min_days)


@pytest.mark.parametrize("n, horizon", [(65, 7), (70, 30), (400, 14)])
def test_rows_are_future_finite_and_ordered(spark, n, horizon):
    out = fc.fit_forecast(frame(spark, series(spark, n), horizon)).orderBy("ds").collect()
    last = date(2024, 1, 1) + timedelta(days=n - 1)
    assert [r["ds"] for r in out] == [last + timedelta(days=i + 1) for i in range(horizon)]
    for r in out:
        assert r["error"] is None
        assert 0 <= r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] < math.inf


def test_two_runs_agree(spark):
    f = frame(spark, series(spark, 90), 10)
    assert fc.fit_forecast(f).orderBy("ds").collect() == fc.fit_forecast(f).orderBy("ds").collect()


def test_beats_the_seasonal_naive_guess(spark):
    full = series(spark, 200)
    cut = date(2024, 1, 1) + timedelta(days=170)
    fit = {r["ds"]: r["yhat"] for r in fc.fit_forecast(frame(spark, full.filter(F.col("ds") < cut), 30)).collect()}
    truth = {r["ds"]: float(r["y"]) for r in full.collect()}
    ours = sum(abs(fit[d] - truth[d]) for d in fit)
    naive = sum(abs(truth[cut - timedelta(days=7 - (d - cut).days % 7)] - truth[d]) for d in fit)
    assert ours < naive


def test_promotion_lifts_the_forecast(spark):
    bump = set(range(40, 60)) | set(range(120, 140))
    day = lambda t: date(2024, 1, 1) + timedelta(days=t)
    promos = [("P1", "Snacks", "West", day(40), day(59), 20), ("P2", "Snacks", "West", day(120), day(139), 20),
              ("P3", " snacks", "WEST", day(205), day(209), 20)]
    from decimal import Decimal
    promos = [(*p[:5], Decimal(p[5])) for p in promos]
    df = series(spark, 200, noise=1.0, bump=bump)
    out = {r["ds"]: r["yhat"] for r in fc.fit_forecast(frame(spark, df, 14, promos)).collect()}
    assert out[day(205)] > 1.2 * out[day(212)]


def test_short_series_stay_out_and_bad_ones_report(spark):
    df = series(spark, 80).unionByName(series(spark, 30, "Short"))
    assert {r[0] for r in fc.fit_forecast(frame(spark, df, 5)).select("category").collect()} == {"Snacks"}
    one = spark.createDataFrame([("Bad", "West", date(2024, 1, 1), None, 0.0, [])],
                                "category string, region string, ds date, y double, promo_active double, holidays array<string>")
    row = fc.fit_forecast(one).first()
    assert row["category"] == "Bad" and "observed" in row["error"] and row["ds"] is None


def test_rows_of_the_table(spark):
    fit = fc.fit_forecast(frame(spark, series(spark, 65), 7))
    rows = fc.forecast_rows(fit, F.lit(date(2024, 7, 1)))
    assert rows.count() == 7 and rows.schema["predicted_revenue"].dataType.simpleString() == "decimal(14,4)"


def test_constant_and_zero_series(spark):
    rows = [("Z", "West", date(2024, 1, 1) + timedelta(days=t), 0) for t in range(70)]
    rows += [("C", "West", date(2024, 1, 1) + timedelta(days=t), 50) for t in range(70)]
    df = spark.createDataFrame(rows, "category string, region string, ds date, y int").withColumn("y", F.col("y").cast("decimal(18,2)"))
    got = fc.fit_forecast(frame(spark, df, 5)).collect()
    assert all(r["error"] is None for r in got)
    assert all(abs(r["yhat"]) < 1e-3 for r in got if r["category"] == "Z")
    assert all(abs(r["yhat"] - 50) < 1 for r in got if r["category"] == "C")
