"""Raw, error and curated layers as parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyhouse.functions.columns import file_name
from tallyhouse.operators.cleaning import align_to_schema, business_columns
from tallyhouse.operators.keys import (
    antijoin,
    bucket,
    bucket_column,
    first_rows,
    rows_at,
    rows_at_in_parts,
    rows_per_bucket,
    unknown_firsts,
    with_bucket,
)
from tallyhouse.operators.quality import DQ
from tallyhouse.session import materialize
from tallyhouse.specs import FILE, LINEAGE, ROW, SHEET

BATCH_ID, INGESTED_AT = "_load_batch_id", "_ingested_at"
FEED, PATH, _ORDER = "feed", "_source_path", "_order"


#: Layers are read less often than they are kept.
STORED_AS, CSV_AS = "zstd", "gzip"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _audit(batch_id: int | None) -> dict[str, Column]:
    return {
        BATCH_ID: F.lit(batch_id).cast("int"),
        INGESTED_AT: F.current_timestamp(),
    }


def save_rows(
    df: DataFrame,
    path: str,
    mode: str,
    by: Sequence[str] = (),
    cluster: Sequence[str] = (),
    whole: bool = False,
    one: bool = False,
) -> None:
    """Files of even size. Adaptive rebalancing also splits a partition value that
    holds most of the rows; ``cluster`` instead sorts the table by ranges, so that
    file statistics prune by those columns. With ``one`` all rows have one value of
    ``by``, or lie by its values already: every task writes the rows it has, and nothing is shuffled.
    An overwrite replaces the partitions of ``by`` that it brings, or with ``whole``
    everything below ``path``."""
    if one:
        even = df
    elif cluster:
        order = [F.col(c) for c in [*by, *cluster]]
        even = df.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        even = df.hint("rebalance", *[F.col(c) for c in by])
    writer = even.write.mode(mode).option("compression", STORED_AS)
    if by:
        writer = writer.partitionBy(*by)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "static" if whole else "dynamic")
    writer.parquet(path)


def raw_rows(df: DataFrame, columns: Sequence[str], batch_id: int | None) -> DataFrame:
    """Every business column as text, aligned to the raw table, plus lineage."""
    texts = [
        (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns
    ]
    lineage = [F.col(c) for c in LINEAGE if c in df.columns and c != FILE]
    if FILE in df.columns:
        lineage = [file_name(F.col(FILE)).alias(FILE), F.col(FILE).alias(PATH), *lineage]
    meta = [c.alias(n) for n, c in _audit(batch_id).items()]
    return df.select(*texts, *lineage, *meta)


def _mode(batch_id: int | None) -> str:
    """A batch replaces what a former attempt at it has left; rows without one add up."""
    return "append" if batch_id is None else "overwrite"


def sink_raw(df: DataFrame, path: str, columns: Sequence[str], batch_id: int | None = None) -> None:
    """One folder per batch."""
    save_rows(raw_rows(df, columns, batch_id), path, _mode(batch_id), [BATCH_ID], one=True)


def error_rows(rejected: DataFrame, batch_id: int | None = None) -> DataFrame:
    """One generic layout: the verdict and the whole row as JSON text."""
    body = [c for c in rejected.columns if c not in DQ and c not in LINEAGE]
    row = F.to_json(
        F.struct(*[F.col(c).cast("string").alias(c) for c in body]), {"ignoreNullFields": "false"}
    )
    return rejected.select(
        F.col("_dq_source_file").alias(FILE),
        F.col("_dq_sheet").alias(SHEET),
        *[c.alias(n) for n, c in _audit(batch_id).items()],
        F.col("_dq_issue").alias("dq_issue"),
        F.col("_dq_detail").alias("dq_detail"),
        F.col("_dq_action").alias("dq_action"),
        row.alias("row_data"),
    )


def sink_error(rejected: DataFrame, path: str, batch_id: int | None = None, feed: str | None = None) -> None:
    """One folder per batch and feed."""
    rows = error_rows(rejected, batch_id).withColumn(FEED, F.lit(feed).cast("string"))
    save_rows(rows, path, _mode(batch_id), [BATCH_ID, FEED], one=True)


def curated_rows(df: DataFrame, schema: T.StructType, batch_id: int | None) -> DataFrame:
    return align_to_schema(df, schema).withColumns(_audit(batch_id))


def sink_curated_overwrite(
    df: DataFrame,
    path: str,
    schema: T.StructType,
    batch_id: int | None = None,
    by: Sequence[str] = (),
    cluster: Sequence[str] = (),
    key: Sequence[str] = (),
) -> None:
    """Replace the table, or with ``by`` only the partitions present in ``df``.

    With ``key`` the table is laid out by key buckets below ``by``, as insert-ignore reads
    it. A value of ``by`` is then replaced folder by folder, since buckets that it no longer
    has must go too: ``by`` is one column of few values, such as the channel.
    """
    rows = curated_rows(df, schema, batch_id)
    if not key:
        save_rows(rows, path, "overwrite", by, cluster)
        return
    spark = df.sparkSession
    name = bucket_column(read_or_empty(spark, path, schema)) if by else bucket_column()
    rows = materialize(spark, with_bucket(rows, list(key), name), "curated")
    if not by:
        save_rows(rows, path, "overwrite", [name], cluster, whole=True)
        return
    (part,) = by
    for (value,) in rows.select(part).distinct().collect():
        own = rows.where(F.col(part).eqNullSafe(F.lit(value))).drop(part)
        save_rows(own, f"{path}/{part}={_folder(value)}", "overwrite", [name], cluster, whole=True)


def _folder(value) -> str:
    """A partition value as Spark writes it into a path."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    unsafe = "\"#%'*/:=?\\{[]^"  # fixed values
    return "".join(f"%{ord(c):02X}" if c in unsafe or ord(c) < 32 or ord(c) == 127 else c for c in str(value))


#: Keys that may be few enough to be broadcast.
FEW = 500_000
#: Rows that a task should write into a bucket, at most.
PART = 500_000


def _fresh_keys(df: DataFrame, target: DataFrame, keys: list[str], order: str, sizes: dict[int, int]) -> DataFrame:
    """Key and number of the first row of each key that the target lacks, stored where the batch
    is long. ``sizes`` are the rows of each bucket in the batch."""
    spark, few, new = df.sparkSession, sum(sizes.values()) <= FEW, target.isEmpty()
    if few and not new:
        once = materialize(spark, first_rows(df, [], keys, order), "batch-keys", STORED_AS)
        return antijoin(once, target, keys, sorted(sizes))
    # a new target has nothing to look up
    found = first_rows(df, [], keys, order) if new else unknown_firsts(df, target, keys, order, sorted(sizes))
    return found if few else materialize(spark, found, "fresh-keys", STORED_AS)


def insert_ignore_rows(
    df: DataFrame, target: DataFrame, key: Sequence[str], order: str = ROW
) -> DataFrame:
    """First row per key of the batch, less the keys the target already has. Keys and numbers
    are compared alone; the rows are read after that and meet only those to insert. The batch
    is read several times, so it is a table or what follows from one without an exchange."""
    if not key:
        return df
    keys = list(key)
    sizes = rows_per_bucket(df, keys, bucket_column(target))
    return rows_at(df, _fresh_keys(df, target, keys, order, sizes), [*keys, order])


def sink_curated_insert_ignore(
    df: DataFrame,
    path: str,
    schema: T.StructType,
    key: Sequence[str],
    batch_id: int | None = None,
    order: str = ROW,
    by: Sequence[str] = (),
    cluster: Sequence[str] = (),
) -> None:
    """Append; a key that exists wins. Replaying a batch changes nothing.

    The table is laid out by key buckets, below ``by`` if given: a batch reads the keys of
    the buckets that it has itself, and nothing else of the target. Its rows are sent once at
    most, and those of known keys only if many others are fresh.
    """
    spark = df.sparkSession
    target = read_or_empty(spark, path, schema)
    if not key:
        save_rows(curated_rows(df, schema, batch_id), path, "append", by, cluster)
        return
    fields = [*schema.fields, T.StructField(_ORDER, df.schema[order].dataType)]
    typed = align_to_schema(df.withColumn(_ORDER, F.col(order)), T.StructType(fields))
    keys, name = list(key), bucket_column(target)
    sizes = rows_per_bucket(typed, keys, name)
    found, on = _fresh_keys(typed, target, keys, _ORDER, sizes), [*keys, _ORDER]
    many = sum(sizes.values()) > FEW and found.count()
    if not many or many <= FEW:
        fresh = rows_at(typed, found, on)
        save_rows(with_bucket(curated_rows(fresh, schema, batch_id), keys, name), path, "append", [*by, name], cluster)
        return
    parts = 1 + max(sizes.values()) // PART
    part = bucket(keys, name) * parts + F.pmod(F.xxhash64(*on), F.lit(parts)).cast("int")
    if many == sum(sizes.values()):
        near = typed.withColumn("_part", part).repartition("_part").drop("_part")  # every row is fresh
    else:
        near = rows_at_in_parts(typed, found, on, part)
    rows = with_bucket(curated_rows(near, schema, batch_id), keys, name)
    layout = [*by, name, *cluster]
    save_rows(rows.sortWithinPartitions(*layout) if cluster else rows, path, "append", [*by, name], one=True)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; an append takes the columns of the existing files and
    fills what the batch lacks with empty text."""
    if mode == "append":
        try:
            have = df.sparkSession.read.csv(path, header=True).columns
            df = df.select(
                *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in have]
            )
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    df.write.mode(mode).csv(path, header=True, emptyValue="")


def sink_csv_batch(df: DataFrame, path: str, feed: str, batch_id: int, replace: bool) -> None:
    """The CSV of a feed, one folder per batch. ``replace`` leaves this batch's alone; other
    feeds of the table keep theirs."""
    rows = df.withColumn(BATCH_ID, F.lit(batch_id).cast("int")).write.mode("overwrite").partitionBy(BATCH_ID)
    rows = rows.option("partitionOverwriteMode", "static" if replace else "dynamic")
    rows.csv(f"{path}/{FEED}={_folder(feed)}", header=True, emptyValue="", compression=CSV_AS)


def dq_report_sink(rejected: DataFrame, path: str, stamp: str) -> None:
    """Rejected rows by run, file and sheet; a run written again replaces its own."""
    report = rejected.select(
        *business_columns(rejected.drop(*DQ)), *DQ[:3], F.lit(stamp).alias("_report_ts"), *DQ[3:]
    )
    even = report.hint("rebalance", F.col("_dq_source_file"), F.col("_dq_sheet"))
    writer = even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("_report_ts", "_dq_source_file", "_dq_sheet").csv(path, header=True, compression=CSV_AS)


def replace_forecasts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows of the (run, category, region) groups that ``new`` does not bring,
    plus ``new``. Both keys are bounded by runs times pairs."""
    group = ["run_date", "category", "region"]
    kept = old.join(new.select(*group).distinct(), group, "left_anti")
    point = [*group, "target_date"]
    values = [c for c in new.columns if c not in point]
    last = new.groupBy(*point).agg(F.max(F.struct(*values)).alias("v")).select(*point, "v.*")
    return kept.unionByName(last)


def sink_forecast_replace(new: DataFrame, path: str) -> None:
    """Rewrite only the run dates that ``new`` touches."""
    spark = new.sparkSession
    old = read_or_empty(spark, path, new.schema)
    runs = new.select("run_date").distinct()
    touched = old.join(runs, "run_date", "left_semi")
    save_rows(replace_forecasts(touched, new), path, "overwrite", ["run_date"])
