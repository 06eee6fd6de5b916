"""Structured Streaming over a drop folder of feed files."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyhouse.functions.columns import MONEY_OUT
from tallyhouse.operators.layers import error_rows, sink_curated_insert_ignore
from tallyhouse.operators.quality import clean_rows, rejected_rows
from tallyhouse.plans.ingest import ARRIVAL, curate, gate_feed
from tallyhouse.session import materialize
from tallyhouse.specs import FILE, ROW, SHEET, FeedSpec


SPREAD = 16


def read_drops(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """A folder of parquet drops as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def drain(writer) -> None:
    """Process everything that has arrived, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    drain(stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint))


def stream_incremental_ingest(
    spark: SparkSession,
    src: str,
    schema: T.StructType,
    spec: FeedSpec,
    out: str,
    checkpoint: str,
    files_per_trigger: int = 1000,
) -> None:
    """Drops through cleaning, gate and insert-ignore, one micro-batch at a time.

    A replayed batch finds its keys in the target and adds nothing.
    """
    lines = read_drops(spark, src, schema, files_per_trigger).select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.lit(spec.sheet).alias(SHEET),
        F.col("_metadata.row_index").alias(ROW),
    )

    # batch numbers restart with each checkpoint, so a checkpoint's errors have a folder of their own
    run = f"{zlib.crc32(checkpoint.rstrip('/').encode()):08x}"

    def load(batch: DataFrame, batch_id: int) -> None:
        tagged = materialize(batch.sparkSession, gate_feed(batch, spec), f"gate-{spec.name}")
        errors = f"{out}/error/dq_rejected_rows/run={run}/batch={batch_id}"
        error_rows(rejected_rows(tagged), batch_id).write.mode("overwrite").parquet(errors)
        sink_curated_insert_ignore(
            curate(clean_rows(tagged), spec),
            f"{out}/curated/{spec.table}",
            spec.schema,
            spec.target_key,
            batch_id,
            order=ARRIVAL,
        )

    each_batch(lines, checkpoint, load)


def stream_dedup(
    stream: DataFrame, key: Sequence[str], ts: str, delay: str, spread: str | None = None
) -> DataFrame:
    """One arrival of each key; keys are kept for ``delay`` of event time.

    A streaming dedup has no map-side step, so all rows of a hot key meet in one task.
    With ``spread``, a fixed row number, the key is first deduplicated in SPREAD
    shares, and only one row of each share goes on.
    """
    marked = stream.withWatermark(ts, delay)
    if spread:
        marked = marked.withColumn("_share", F.pmod(F.col(spread), F.lit(SPREAD)))
        marked = marked.dropDuplicatesWithinWatermark([*key, "_share"]).drop("_share")
    return marked.dropDuplicatesWithinWatermark(list(key))


def stream_late_flag(stream: DataFrame, ts: str, lateness: timedelta, out: str) -> None:
    """Rows older than the newest one of all batches before theirs by more than ``lateness``
    are flagged; flagged rows land in ``out/rows``, a folder per batch.

    The newest event time is one number that each batch takes from the batch before and
    leaves to the next in ``out/newest``, so that it outlives a restart; a batch run again
    reads the same number and replaces its own folders. The first batch flags nothing, a NULL
    time is not late, and a time ahead of the clock does not move the bound. The checkpoint
    is in ``out`` too: batch numbers and folders belong together.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    def flag(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = spark.read.parquet(f"{out}/newest/batch={batch_id - 1}").first()[0] if batch_id else None
        late = F.lit(False) if newest is None else micros < F.lit(newest - lateness // timedelta(microseconds=1))
        landed = f"{out}/rows/batch={batch_id}"
        batch.withColumn("is_late_arriving", F.coalesce(late, F.lit(False))).write.mode("overwrite").parquet(landed)
        past = F.when(micros <= F.unix_micros(F.current_timestamp()), micros)
        # greatest() passes over a missing side: no bound yet, or no time in the batch
        top = spark.read.parquet(landed).agg(F.greatest(F.max(past), F.lit(newest).cast("long")).alias("newest"))
        top.write.mode("overwrite").parquet(f"{out}/newest/batch={batch_id}")

    each_batch(stream, f"{out}/checkpoint", flag)


def stream_daily_revenue(stream: DataFrame, ts: str, value: str, by: Sequence[str], delay: str) -> DataFrame:
    """Daily totals per group; a day stays open for ``delay`` of event time."""
    day = F.window(ts, "1 day")
    sums = stream.withWatermark(ts, delay).groupBy(day, *by).agg(
        F.sum(value).cast(MONEY_OUT).alias("revenue"), F.count("*").alias("n")
    )
    return sums.select(F.to_date("window.start").alias("ds"), *by, "revenue", "n")


def keep_changes(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each batch of updated totals under its batch number; a replayed batch
    replaces its own folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save)
    drain(writer.option("checkpointLocation", checkpoint))


def latest_changes(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest value of each key out of the kept changes."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return newest.select(*keys, "v.*")
