"""Reports over forecast points. A pair has at most ``horizon`` points (365), so
its group is small by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions.columns import MONEY_OUT, ratio
from tallyhouse.operators.series import PAIR

VALUE = "predicted_revenue"


def forecast_kpis(points: DataFrame, by=PAIR) -> DataFrame:
    """Total, daily mean and the first day with the highest value."""
    peak = F.max_by(
        F.struct("target_date", VALUE), F.struct(VALUE, -F.unix_date("target_date"))
    )
    return points.groupBy(*by).agg(
        F.sum(VALUE).cast(MONEY_OUT).alias("total_revenue"),
        ratio(F.sum(VALUE), F.count("*")).alias("avg_daily"),
        peak.alias("p"),
    ).select(
        *by,
        "total_revenue",
        "avg_daily",
        F.col("p.target_date").alias("peak_day"),
        F.col("p.predicted_revenue").alias("peak_value"),
    )


def _label(value: Column, *steps: tuple[Column, str], other: str) -> Column:
    label = F.lit(other)
    for test, text in reversed(steps):
        label = F.when(test, text).otherwise(label)
    return F.when(value.isNotNull(), label)


def forecast_growth(points: DataFrame, by=PAIR, days: int = 7) -> DataFrame:
    """Mean of the first against the mean of the last days, in percent."""
    group = Window.partitionBy(*by)
    ranked = points.withColumns(
        {
            "up": F.row_number().over(group.orderBy("target_date")),
            "down": F.row_number().over(group.orderBy(F.desc("target_date"))),
        }
    )
    means = ranked.groupBy(*by).agg(
        *[
            ratio(F.sum(F.when(F.col(c) <= days, F.col(VALUE))), F.count_if(F.col(c) <= days)).alias(n)
            for c, n in (("up", "avg_start"), ("down", "avg_end"))
        ]
    )
    g = F.col("growth_pct")
    growth = F.coalesce(
        F.try_divide(F.col("avg_end") - F.col("avg_start"), F.col("avg_start")) * 100, F.lit(0.0)
    )
    trend = _label(g, (g > 5, "upward"), (g < -5, "decline"), other="stable")
    return means.withColumn("growth_pct", growth).withColumn("trend", trend)


def forecast_band_pct(points: DataFrame, by=PAIR) -> DataFrame:
    """Mean width of the interval as a percentage of the daily mean."""
    b = F.col("band_pct")
    width, mean = F.sum(F.col("yhat_upper") - F.col("yhat_lower")), F.sum(VALUE)
    band = F.coalesce(ratio(width, mean) * 100, F.lit(0.0)).alias("band_pct")
    label = _label(b, (b < 20, "high"), (b < 40, "moderate"), other="wide")
    return points.groupBy(*by).agg(band).withColumn("confidence", label)


def forecast_weekly(points: DataFrame, by=PAIR) -> DataFrame:
    """Sum, mean and maximum per week from Monday to Sunday."""
    monday = F.date_trunc("week", "target_date").cast("date")
    weeks = points.groupBy(*by, monday.alias("monday")).agg(
        F.sum(VALUE).cast(MONEY_OUT).alias("total"),
        ratio(F.sum(VALUE), F.count("*")).alias("avg"),
        F.max(VALUE).alias("peak"),
    )
    label = F.concat_ws("/", "monday", F.date_add("monday", 6))
    return weeks.withColumn("week", label).drop("monday")
