"""Day-grained calendars: holidays, promotions, campaigns, date spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.columns import is_true, ratio, strip

# ---- fixed values: season of each month, January first
SEASONS = ["WINTER"] * 2 + ["SPRING"] * 3 + ["SUMMER"] * 3 + ["FALL"] * 3 + ["WINTER"]

# ---- fixed values: holidays as (name, month, first day, last day, weekday);
# weekday counts Sunday as 1, None means the date itself
HOLIDAYS = [
    ("New Year's Day", 1, 1, 1, None),
    ("MLK Day", 1, 15, 21, 2),
    ("Presidents' Day", 2, 15, 21, 2),
    ("Memorial Day", 5, 25, 31, 2),
    ("Independence Day", 7, 4, 4, None),
    ("Labor Day", 9, 1, 7, 2),
    ("Columbus Day", 10, 8, 14, 2),
    ("Veterans Day", 11, 11, 11, None),
    ("Thanksgiving", 11, 22, 28, 5),
    ("Christmas", 12, 25, 25, None),
]
UNNAMED_HOLIDAY = "US_Holiday"


def days_between(df: DataFrame, start: Column, end: Column, name: str = "ds") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(start, end)))


def holiday_name(day: Column) -> Column:
    """An nth weekday is the one weekday that falls into a fixed week of days."""
    name = F.lit(None).cast("string")
    for label, month, first, last, weekday in HOLIDAYS:
        hit = (F.month(day) == month) & F.dayofmonth(day).between(first, last)
        if weekday:
            hit = hit & (F.dayofweek(day) == weekday)
        name = F.when(hit, label).otherwise(name)
    return name


def calendar_dimension(span: DataFrame) -> DataFrame:
    """One row per day from ``first_day`` to ``last_day`` of a one-row span."""
    days = days_between(span, F.col("first_day"), F.col("last_day"), "calendar_date")
    season = F.element_at(F.array(*map(F.lit, SEASONS)), F.month("calendar_date"))
    holiday = holiday_name(F.col("calendar_date"))
    return days.select(
        "calendar_date",
        season.alias("season"),
        F.initcap(holiday.isNotNull().cast("string")).alias("is_holiday"),
        holiday.alias("holiday_name"),
    )


def holiday_calendar(calendar: DataFrame, upper_window: int = 1) -> DataFrame:
    """Holidays only, with the window of days each one acts on."""
    return calendar.filter(is_true(F.col("is_holiday"))).select(
        strip(F.coalesce("holiday_name", F.lit(UNNAMED_HOLIDAY))).alias("holiday"),
        F.to_date("calendar_date").alias("ds"),
        F.lit(0).alias("lower_window"),
        F.lit(upper_window).alias("upper_window"),
    )


def holiday_effects(holidays: DataFrame) -> DataFrame:
    """Per day the sorted labels of the effects that act on it."""
    shift = F.explode(F.sequence("lower_window", "upper_window")).alias("shift")
    acts = holidays.select("holiday", "ds", shift)
    label = F.when(F.col("shift") == 0, F.col("holiday")).otherwise(
        F.concat("holiday", F.format_string("%+d", "shift"))
    )
    day = F.date_add("ds", F.col("shift"))
    return acts.groupBy(day.alias("ds")).agg(F.sort_array(F.collect_set(label)).alias("holidays"))


def date_spine(profile: DataFrame, horizon: int = 90) -> DataFrame:
    """Per pair every day from its first to its last plus the horizon."""
    return days_between(
        profile.select("category", "region", "first_date", "last_date"),
        F.col("first_date"),
        F.date_add("last_date", horizon),
    ).select("category", "region", "ds")


def _pair_key(c: str) -> Column:
    return F.lower(strip(F.col(c)))


def promo_days(windows: DataFrame, bounds: DataFrame, value: Column) -> DataFrame:
    """Windows to (category, region, day, value), the highest value on overlap.

    Equal windows collapse first, windows are clipped to the days in question, and
    the explode feeds a map-side maximum. Work grows with windows times their days;
    no window ever meets every day of its pair.
    """
    span = bounds.agg(F.struct(F.min("ds").alias("lo"), F.max("ds").alias("hi"))).scalar()
    usable = windows.filter("start_date is not null and end_date is not null").groupBy(
        _pair_key("category").alias("category_key"),
        _pair_key("region").alias("region_key"),
        F.greatest("start_date", span["lo"]).alias("start_date"),
        F.least("end_date", span["hi"]).alias("end_date"),
    )
    merged = usable.agg(F.max(value).alias("value")).filter("start_date <= end_date")
    days = days_between(merged, F.col("start_date"), F.col("end_date"))
    return days.groupBy("category_key", "region_key", "ds").agg(F.max("value").alias("value"))


def promo_intensity() -> Column:
    """Discount as a fraction; a missing discount counts as none."""
    return (F.coalesce("discount_pct", F.lit(0)) / 100).cast("decimal(10,6)")


def promo_interval_join(spine: DataFrame, windows: DataFrame) -> DataFrame:
    """Days of the spine inside a window, with the highest intensity."""
    days = promo_days(windows, spine, promo_intensity()).withColumnRenamed("value", "intensity")
    keyed = spine.withColumns(
        {"category_key": F.lower("category"), "region_key": F.lower("region")}
    )
    return keyed.join(days, ["category_key", "region_key", "ds"]).drop("category_key", "region_key")


def promo_overlap_max(spine: DataFrame, windows: DataFrame) -> DataFrame:
    """Intensity per day in a window, never below zero."""
    hits = promo_interval_join(spine, windows)
    return hits.withColumn("intensity", F.greatest("intensity", F.lit(0).cast("decimal(10,6)")))


def promo_calendar(spine: DataFrame, windows: DataFrame) -> DataFrame:
    """Every day of the spine with its intensity, 0 without a promotion."""
    return regressor_lookup(spine, promo_overlap_max(spine, windows), "intensity", "promo_active")


def regressor_lookup(days: DataFrame, feature: DataFrame, col: str, name: str) -> DataFrame:
    at = ["category", "region", "ds"]
    found = days.join(feature.select(*at, F.col(col).alias(name)), at, "left")
    return found.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("decimal(10,6)")))


def promo_day_set(windows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Distinct (day, category, region) with a promotion."""
    days = promo_days(windows, bounds, F.lit(1))
    return days.select(
        "ds", F.col("category_key").alias("category"), F.col("region_key").alias("region")
    )


def campaign_calendar(spine: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Total exposure of the campaigns that run on each day, 0 without one."""
    span = spine.agg(F.struct(F.min("ds").alias("lo"), F.max("ds").alias("hi"))).scalar()
    runs = campaigns.filter("start_date <= end_date and exposure is not null").groupBy(
        _pair_key("category").alias("category_key"),
        _pair_key("region").alias("region_key"),
        F.greatest("start_date", span["lo"]).alias("start_date"),
        F.least("end_date", span["hi"]).alias("end_date"),
    )
    merged = runs.agg(F.sum("exposure").alias("exposure")).filter("start_date <= end_date")
    days = days_between(merged, F.col("start_date"), F.col("end_date"))
    per_day = days.groupBy("category_key", "region_key", "ds").agg(
        F.sum("exposure").alias("exposure")
    )
    keyed = spine.withColumns(
        {"category_key": F.lower("category"), "region_key": F.lower("region")}
    )
    found = keyed.join(per_day, ["category_key", "region_key", "ds"], "left")
    return found.select(
        "category", "region", "ds", F.coalesce("exposure", F.lit(0)).alias("exposure")
    )


def competitor_gap(products: DataFrame, competitor_prices: DataFrame) -> DataFrame:
    """Own mean list price against the mean competitor price of each month."""

    def mean(c):
        return ratio(F.sum(c), F.count(c))

    own = products.groupBy("category").agg(mean("list_price").alias("own_price"))
    theirs = competitor_prices.groupBy(
        F.trunc("obs_date", "month").alias("month"), "category", "region"
    ).agg(mean("competitor_price").alias("competitor_price"))
    gap = (F.col("own_price") - F.col("competitor_price")).alias("gap")
    return theirs.join(own, "category").select(
        "month", "category", "region", "own_price", "competitor_price", gap
    )
