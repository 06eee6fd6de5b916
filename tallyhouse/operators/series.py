"""Daily series per (category, region). A series has one row per day, so a group
is bounded by the calendar whatever the number of sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.columns import MONEY_OUT
from tallyhouse.operators.calendars import (
    date_spine,
    holiday_effects,
    promo_calendar,
    regressor_lookup,
)
from tallyhouse.operators.keys import first_per_key
from tallyhouse.operators.sales import derive_revenue
from tallyhouse.session import materialize
from tallyhouse.specs import ROW

PAIR = ["category", "region"]
MIN_HISTORY_DAYS = 60


def series_join(sales: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Sales that fall into a pair; the first row of each dimension key counts.

    The two reduced dimensions are stored first: their true size then decides between
    broadcast and merge, and a merge of plain tables lets adaptive execution split a
    hot product or store.
    """
    facts = derive_revenue(sales.filter("transaction_ts is not null")).select(
        F.to_date("transaction_ts").alias("ds"), "sku", "store_id", "revenue"
    )
    sku = _first_stored(products, "sku", "category")
    store = _first_stored(stores, "store_id", "region")
    placed = facts.filter("revenue is not null").join(sku, "sku").join(store, "store_id")
    return placed.filter("category is not null and region is not null")


def _first_stored(dim: DataFrame, key: str, value: str) -> DataFrame:
    first = first_per_key(dim.select(key, value, ROW), [key], ROW)
    return materialize(dim.sparkSession, first.drop(ROW), f"dim-{key}")


def daily_series(sales: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    placed = series_join(sales, products, stores)
    return placed.groupBy("ds", *PAIR).agg(F.sum("revenue").cast(MONEY_OUT).alias("y"))


def series_profile(series: DataFrame) -> DataFrame:
    return series.groupBy(*PAIR).agg(
        F.countDistinct("ds").alias("n_days"),
        F.min("ds").alias("first_date"),
        F.max("ds").alias("last_date"),
    )


def history_gate(series: DataFrame, min_days: int = MIN_HISTORY_DAYS) -> DataFrame:
    """All pairs, with those too short marked as not eligible."""
    return series_profile(series).withColumn("eligible", F.col("n_days") >= min_days)


def training_frame(
    series: DataFrame,
    promos: DataFrame,
    holidays: DataFrame,
    horizon: int = 90,
    min_days: int = MIN_HISTORY_DAYS,
) -> DataFrame:
    """Observed days plus the horizon of every eligible pair, with features.

    ``y`` is NULL on future days; days without sales inside the history are gaps
    and stay out. ``series`` is used several times, so pass a stored table.
    """
    profile = history_gate(series, min_days).filter("eligible")
    spine = date_spine(profile, horizon)
    ends = profile.select(*PAIR, "last_date")
    days = (
        spine.join(series, [*PAIR, "ds"], "left")
        .join(ends, PAIR)
        .filter("y is not null or ds > last_date")
        .drop("last_date")
    )
    promo = promo_calendar(spine, promos)
    featured = regressor_lookup(days, promo, "promo_active", "promo_active")
    none = F.array().cast("array<string>")
    return featured.join(holiday_effects(holidays), "ds", "left").select(
        *PAIR, "ds", "y", "promo_active", F.coalesce("holidays", none).alias("holidays")
    )
