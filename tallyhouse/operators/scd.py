"""Product history as a slowly changing dimension of type 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyhouse.operators.keys import bucket_column, touched, with_bucket
from tallyhouse.operators.layers import save_rows
from tallyhouse.session import materialize
from tallyhouse.specs import ROW

TRACKED = ("category", "brand", "package_size", "list_price")


KEY = ["sku", "valid_from"]


def _from_dim(dim: DataFrame, tracked) -> DataFrame:
    """The values that a product starts with, as changes of its first day."""
    return dim.select("sku", F.col("launch_date").alias("valid_from"), *[
        F.col(c).cast("string").alias(c) for c in tracked
    ])


def _changes(updates: DataFrame, tracked, order: str) -> DataFrame:
    """One row per product and day: the last update of each attribute, NULL where none is."""

    def latest(c):
        mine = F.col("attribute") == c
        return F.max_by(F.when(mine, F.col("new_value")), F.when(mine, F.col(order))).alias(c)

    return updates.groupBy("sku", F.col("effective_date").alias("valid_from")).agg(
        *[latest(c) for c in tracked]
    )


def _over(older: DataFrame, newer: DataFrame, tracked) -> DataFrame:
    """Changes of two origins by product and day; the newer one wins where it has a value."""
    both = older.withColumn("_rank", F.lit(0)).unionByName(newer.withColumn("_rank", F.lit(1)))
    return both.groupBy(*KEY).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in tracked]
    )


def _versions(changes: DataFrame, tracked) -> list[Column]:
    """Columns of versions out of changes: values run on until they change."""
    history = Window.partitionBy("sku").orderBy("valid_from")
    so_far = history.rowsBetween(Window.unboundedPreceding, 0)
    following = F.lead("valid_from").over(history)
    return [
        *[F.col(k) for k in KEY],
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in tracked],
        F.date_sub(following, 1).alias("valid_to"),
        following.isNull().alias("is_current"),
    ]


def scd2_apply(dim: DataFrame, updates: DataFrame, tracked=TRACKED, order: str = ROW) -> DataFrame:
    """Versions of every product: one per day on which something changed.

    Updates collapse to one row per product and day on the map side, the last one
    of each attribute wins. The window then goes over the changed days of one
    product, which the calendar bounds.
    """
    merged = _over(_from_dim(dim, tracked), _changes(updates, tracked, order), tracked)
    return merged.select(*_versions(merged, tracked))


def _own(c: str) -> str:
    """The column of a stored history with what changed on the version's first day."""
    return f"_set_{c}"


def _stored(changes: DataFrame, tracked) -> DataFrame:
    return changes.select(*_versions(changes, tracked), *[F.col(c).alias(_own(c)) for c in tracked])


def scd2_create(dim: DataFrame, path: str, tracked=TRACKED) -> None:
    """A stored history with the first version of every product, laid out by buckets of sku.
    Beside its values a version keeps which of them changed on its day, so that a change
    that arrives late still runs on to the next one."""
    rows = with_bucket(_stored(_from_dim(dim, tracked), tracked), ["sku"], bucket_column())
    save_rows(rows, path, "overwrite", [bucket_column()], whole=True)


def scd2_merge(spark: SparkSession, path: str, updates: DataFrame, tracked=TRACKED, order: str = ROW) -> None:
    """Close, open and split versions of a stored history for a batch of updates.

    The batch is stored once; only the buckets of its products are read and replaced, files
    of all others stay as they are. An update of a day and attribute that a former batch
    set wins over it, so that a batch may be replayed. What is written is stored before,
    since it replaces what it is read from.
    """
    history = spark.read.parquet(path)
    name = bucket_column(history)
    batch = materialize(spark, with_bucket(_changes(updates, tracked, order), ["sku"], name), "changes")
    mine = history.where(F.col(name).isin(touched(batch, name)))
    older = mine.select(*KEY, *[F.col(_own(c)).alias(c) for c in tracked])
    merged = _stored(_over(older, batch.drop(name), tracked), tracked)
    merged = materialize(spark, with_bucket(merged, ["sku"], name), "versions")
    save_rows(merged, path, "overwrite", [name])


def scd2_read(spark: SparkSession, path: str, tracked=TRACKED) -> DataFrame:
    """The versions of a stored history."""
    return spark.read.parquet(path).select(*KEY, *tracked, "valid_to", "is_current")


def scd2_asof_lookup(sales: DataFrame, versions: DataFrame, cols=("brand",)) -> DataFrame:
    """Each sale with the version valid on its day; NULLs where none is.

    Versions are listed per product and month they touch. A sale then meets the
    versions of one month (31 at most), and the sales of a hot product spread over
    the months.
    """
    span = sales.agg(F.max("transaction_ts").cast("date")).scalar()
    until = F.least(F.coalesce("valid_to", span), span)
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(until, "month"), F.expr("interval 1 month"))
    by_month = (
        versions.filter(F.col("valid_from") <= until)
        .withColumn("month", F.explode(months))
        .select("sku", "month", "valid_from", "valid_to", *cols)
    )
    day = F.to_date("transaction_ts")
    keyed = sales.withColumn("month", F.trunc(day, "month"))
    s, v = keyed.alias("s"), by_month.alias("v")
    valid = (
        (F.col("s.sku") == F.col("v.sku"))
        & (F.col("s.month") == F.col("v.month"))
        & (F.to_date("s.transaction_ts") >= F.col("v.valid_from"))
        & (F.col("v.valid_to").isNull() | (F.to_date("s.transaction_ts") <= F.col("v.valid_to")))
    )
    return s.join(v, valid, "left").select(
        *[F.col(f"s.`{c}`") for c in sales.columns],
        F.col("v.valid_from"),
        *[F.col(f"v.{c}") for c in cols],
    )
