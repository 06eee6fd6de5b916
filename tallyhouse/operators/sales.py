"""Revenue questions over the star schema.

Facts are reduced on the map side before anything is shuffled. Dimensions carry no
broadcast hint: Catalyst broadcasts one while its size stays below the threshold and
sort-merge joins it beyond, where adaptive execution splits a hot key.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions.columns import MONEY, MONEY_OUT, month_of, ratio
from tallyhouse.operators.keys import first_per_key, top


def revenue_sum() -> Column:
    return F.sum("revenue").cast(MONEY_OUT).alias("revenue")


def derive_revenue(df: DataFrame) -> DataFrame:
    """Feeds without an amount get price times quantity."""
    value = F.coalesce("revenue", F.col("unit_price") * F.col("quantity"))
    return df.withColumn("revenue", value.cast(MONEY))


def usable_sales_filter(df: DataFrame) -> DataFrame:
    priced = F.col("unit_price").isNotNull() & F.col("quantity").isNotNull()
    return df.filter(
        F.col("transaction_ts").isNotNull() & (F.col("revenue").isNotNull() | priced)
    )


def date_range_filter(
    df: DataFrame, start: date | None = None, end: date | None = None, ts: str = "transaction_ts"
) -> DataFrame:
    """Whole days, both ends included; on the raw timestamp, so the scan sees it."""
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col(ts) < F.lit(end + timedelta(days=1)).cast("timestamp_ntz"))
    return df


def usable_sales(
    sales: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    usable = derive_revenue(usable_sales_filter(date_range_filter(sales, start, end)))
    return usable.withColumn("ds", F.to_date("transaction_ts"))


def sales_enriched(
    sales: DataFrame,
    products: DataFrame | None = None,
    stores: DataFrame | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Usable sales with category, brand and region; a dimension that the question
    does not need may stay out."""
    out = usable_sales(sales, start, end).select(
        "transaction_ts", "ds", "store_id", "sku", "quantity", "unit_price", "revenue"
    )
    if products is not None:
        out = out.join(products.select("sku", "category", "brand"), "sku", "left")
    if stores is not None:
        out = out.join(stores.select("store_id", "region"), "store_id", "left")
    return out


def sku_attr_join(by_sku: DataFrame, products: DataFrame) -> DataFrame:
    return by_sku.join(products.select("sku", "brand", "category"), "sku", "left")


def revenue_cube(enriched: DataFrame) -> DataFrame:
    """Revenue and rows per day, category and region. The operators below that read
    ``ds``, ``category``, ``region`` and ``revenue`` take it in place of the sales,
    so many questions cost one pass over the facts."""
    return enriched.groupBy("ds", "category", "region").agg(
        F.sum("revenue").cast(MONEY).alias("revenue"), F.count("*").alias("n")
    )


def _rows(df: DataFrame) -> Column:
    return F.sum("n") if "n" in df.columns else F.count("*")


def _cells(enriched: DataFrame) -> DataFrame:
    """Revenue and rows per (category, region): all breakdowns derive from it."""
    return enriched.groupBy("category", "region").agg(
        F.sum("revenue").alias("revenue"), _rows(enriched).alias("n")
    )


def revenue_kpis(enriched: DataFrame) -> DataFrame:
    """Total, both breakdowns and the leaders, as (section, name, revenue, n).

    The total counts rows that have no category or region, the breakdowns do not.
    """
    sets = _cells(enriched).groupingSets([[], ["category"], ["region"]], "category", "region")
    rows = sets.agg(
        F.sum("revenue").cast(MONEY_OUT).alias("revenue"),
        F.sum("n").alias("n"),
        F.grouping_id().alias("level"),
    ).select(
        F.when(F.col("level") == 3, "total")
        .when(F.col("level") == 1, "category")
        .otherwise("region")
        .alias("section"),
        F.when(F.col("level") == 3, "ALL")
        .otherwise(F.coalesce("category", "region"))
        .alias("name"),
        "revenue",
        "n",
    )
    return rows.filter(F.col("name").isNotNull())


def kpi_headline(enriched: DataFrame) -> DataFrame:
    """One row: total, transactions, leading category and region (N/A if none)."""
    is_total = F.col("section") == "total"

    def leader(dim):
        mine = F.col("section") == dim
        order = F.when(mine, F.struct(-F.col("revenue"), F.col("name")))
        return F.coalesce(F.min_by("name", order), F.lit("N/A")).alias(f"top_{dim}")

    return revenue_kpis(enriched).agg(
        F.coalesce(F.max(F.when(is_total, F.col("revenue"))), F.lit(0))
        .cast(MONEY_OUT)
        .alias("total_revenue"),
        F.coalesce(F.max(F.when(is_total, F.col("n"))), F.lit(0)).alias("transaction_count"),
        leader("category"),
        leader("region"),
    )


def revenue_by(enriched: DataFrame, dim: str) -> DataFrame:
    return (
        enriched.filter(F.col(dim).isNotNull())
        .groupBy(dim)
        .agg(revenue_sum())
        .orderBy(F.desc("revenue"), F.asc(dim))
    )


def top_member(enriched: DataFrame, dim: str) -> DataFrame:
    return top(revenue_by(enriched, dim), [F.desc("revenue"), F.asc(dim)], 1)


def insights_aggregates(enriched: DataFrame) -> DataFrame:
    return revenue_kpis(enriched).drop("n")


def revenue_share(enriched: DataFrame, dim: str) -> DataFrame:
    """Share of all revenue, unplaced rows included. The total is a window over the
    few aggregated members, so the facts are read once."""
    sums = enriched.groupBy(dim).agg(F.sum("revenue").alias("s"))
    total = F.sum("s").over(Window.partitionBy()).cast(MONEY_OUT)
    part = F.col("s").cast(MONEY_OUT)
    shares = sums.select(dim, part.alias("revenue"), ratio(part, total).alias("share"))
    return shares.filter(F.col(dim).isNotNull())


def monthly_revenue(enriched: DataFrame, months: int = 12) -> DataFrame:
    """The last months that have sales."""
    by_month = enriched.groupBy(month_of(F.col("ds")).alias("month")).agg(
        revenue_sum()
    )
    return top(by_month, [F.desc("month")], months).orderBy("month")


def category_month_revenue(enriched: DataFrame) -> DataFrame:
    return (
        enriched.filter(F.col("category").isNotNull())
        .groupBy(month_of(F.col("ds")).alias("month"), "category")
        .agg(revenue_sum())
    )


def month_pairs(monthly: DataFrame) -> DataFrame:
    """Categories present in both of the last two months, side by side.

    The rank runs over the aggregate (months times categories), not over sales.
    """
    age = F.dense_rank().over(Window.orderBy(F.desc("month")))
    recent = monthly.withColumn("age", age).filter("age <= 2")
    pairs = recent.groupBy("category").agg(
        F.max(F.when(F.col("age") == 1, F.col("revenue"))).alias("revenue_cur"),
        F.max(F.when(F.col("age") == 2, F.col("revenue"))).alias("revenue_prev"),
    )
    return pairs.na.drop()


def category_mom_growth(enriched: DataFrame) -> DataFrame:
    pairs = month_pairs(category_month_revenue(enriched))
    growth = ratio(F.col("revenue_cur") - F.col("revenue_prev"), F.col("revenue_prev"))
    return pairs.withColumn("growth", growth).filter("growth is not null").orderBy("growth")


def data_span(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.min("ds").alias("first_day"),
        F.max("ds").alias("last_day"),
        _rows(enriched).alias("transactions"),
        revenue_sum().alias("total_revenue"),
    )


def product_performance(
    usable: DataFrame, products: DataFrame, limit: int = 20, order: str = "_row_idx"
) -> DataFrame:
    """Best products; only the chosen ones meet the dimension."""
    best = top(
        usable.groupBy("sku").agg(
            revenue_sum(), F.count("revenue").alias("transactions")
        ),
        [F.desc("revenue"), F.asc("sku")],
        limit,
    )
    dim = first_per_key(products.select("sku", "brand", "category", order), ["sku"], order)
    return sku_attr_join(best, dim).orderBy(F.desc("revenue"), F.asc("sku"))


def repair_price(df: DataFrame) -> DataFrame:
    """A missing price follows from amount and quantity."""
    derived = F.try_divide(F.col("revenue").cast("double"), F.col("quantity").cast("double"))
    broken = F.col("unit_price").isNull() & derived.isNotNull()
    return df.withColumns(
        {
            "unit_price": F.coalesce("unit_price", derived.cast("decimal(12,4)")),
            "price_action": F.when(broken, "REPAIRED"),
        }
    )


def repair_amount(df: DataFrame) -> DataFrame:
    """A missing amount follows from price and quantity."""
    derived = (F.col("unit_price") * F.col("quantity")).cast("decimal(14,4)")
    broken = F.col("revenue").isNull() & derived.isNotNull()
    return df.withColumns(
        {
            "revenue": F.coalesce("revenue", derived),
            "amount_action": F.when(broken, "REPAIRED"),
        }
    )


def unknown_key_flag(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose key the dimension lacks: kept, and flagged. The dimension joins as
    it is stored, so that adaptive execution can split a hot unknown key."""
    return df.join(dim.select(key), key, "left_anti").withColumn("action", F.lit("FLAGGED"))


def currency_normalize(df: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """Amounts in the base currency. One without a known rate is no amount there: NULL,
    and the row is flagged."""
    rated = df.join(rates.select("currency", "rate"), "currency", "left")
    rate = F.when(F.col("currency") == base, F.lit(1)).otherwise(F.col("rate"))
    return rated.withColumns(
        {
            "revenue_usd": (F.col("revenue") * rate).cast(MONEY),
            "currency_action": F.when(rate.isNull(), "FLAGGED"),
        }
    ).drop("rate")


def unify_channels(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def late_arriving_flag(df: DataFrame, bound: Column, ts: str = "transaction_ts") -> DataFrame:
    """Rows stamped before the lateness bound of their batch."""
    return df.withColumn("is_late_arriving", F.coalesce(F.col(ts) < bound, F.lit(False)))
