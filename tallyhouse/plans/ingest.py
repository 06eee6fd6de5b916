"""Config-driven ingest: files -> raw -> clean -> gate -> error and curated layers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from datetime import timedelta
from itertools import groupby

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyhouse.operators.audit import load_batch_audit, unknown_keys
from tallyhouse.operators.cleaning import (
    align_to_schema,
    clean_text,
    coerce_numeric_vote,
    dedup_on_column,
    inject_columns,
    map_columns,
    measure_columns,
    parse_dates_coalesce,
    parse_dates_vote,
    string_columns,
    tidy_numbers,
)
from tallyhouse.operators.layers import (
    BATCH_ID,
    STORED_AS,
    dq_report_sink,
    read_or_empty,
    sink_csv_batch,
    sink_curated_insert_ignore,
    sink_curated_overwrite,
    sink_error,
    sink_raw,
)
from tallyhouse.operators.quality import clean_rows, dq_gate, rejected_rows
from tallyhouse.session import materialize, shuffles_dropped, stored
from tallyhouse.sources.files import discover_files, select_feeds
from tallyhouse.sources.grids import drop_ghost_sheets, grid_to_table, route_sheet
from tallyhouse.sources.workbooks import scan_workbooks
from tallyhouse.specs import LINEAGE, SHEET, FeedSpec


# order of arrival: file, sheet, row
ARRIVAL = "_arrival"
#: One row per committed batch and feed.
COMMITS = "audit/load_batch"
BATCHES = T.StructType(
    [T.StructField("load_batch_id", T.IntegerType()), T.StructField("load_type", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("rows_in", "attempted", "inserted", "deduped", "rejected", "repaired", "flagged", "late_arriving")]
    + [T.StructField("feed", T.StringType())]
)
HOUSE_CURRENCY = "USD"
LATE = timedelta(days=7)


def target_types(spec: FeedSpec) -> dict[str, T.DataType]:
    """Source column -> type of the column it lands in."""
    types = {f.name: f.dataType for f in spec.schema}
    names = spec.mapping or {n: n for n in spec.schema.names}
    return {s.lower(): types[t] for s, t in names.items()}


def type_columns(df: DataFrame, spec: FeedSpec, typing: str = "declared") -> DataFrame:
    """Dates and numbers out of clean text.

    ``declared`` parses each value for the type its target column has; a text that
    is no number stays for the gate to report. ``vote`` lets each column decide by
    majority, and the minority becomes NULL.
    """
    if typing == "vote":
        dated = parse_dates_vote(df)
        free = [c for c in measure_columns(string_columns(dated)) if c not in spec.text]
        return coerce_numeric_vote(dated, free)
    types = {c: t for c, t in target_types(spec).items() if c in df.columns}
    times = [c for c, t in types.items() if isinstance(t, (T.DateType, T.TimestampNTZType))]
    numbers = [c for c, t in types.items() if isinstance(t, T.NumericType)]
    return tidy_numbers(parse_dates_coalesce(df, times), numbers)


def gate_feed(landed: DataFrame, spec: FeedSpec, typing: str = "declared") -> DataFrame:
    """Landed text rows -> typed rows with their verdict."""
    return dq_gate(type_columns(clean_text(landed), spec, typing), spec.key, spec.rules)


@contextmanager
def stored_verdicts(landed: DataFrame, spec: FeedSpec, typing: str = "declared") -> Iterator[DataFrame]:
    """As ``gate_feed``, stored while the block runs. The gate reads its rows twice, for the checks
    and for the rows: they are cleaned and typed once, into a table that goes when it is read."""
    spark = landed.sparkSession
    with ExitStack() as kept:
        typed = type_columns(clean_text(landed), spec, typing)
        with stored(spark, typed, f"typed-{spec.name}", STORED_AS) as rows:
            tagged = kept.enter_context(stored(spark, dq_gate(rows, spec.key, spec.rules), f"gate-{spec.name}", STORED_AS))
        yield tagged


def curate(clean: DataFrame, spec: FeedSpec) -> DataFrame:
    """Gate survivors in the columns of the target, lineage kept."""
    rows = map_columns(clean, spec.mapping, LINEAGE) if spec.mapping else clean
    rows = inject_columns(rows, spec.literals).withColumn(ARRIVAL, F.struct(*LINEAGE))
    return dedup_on_column(rows, spec.dedup, ARRIVAL) if spec.dedup else rows


def write_curated(rows: DataFrame, spec: FeedSpec, path: str, batch_id: int | None) -> None:
    """A fact is laid out by channel and time: an overwrite replaces its own channel."""
    fact = "transaction_ts" in spec.schema.names
    layout = {"by": ["source_system"], "cluster": ["transaction_ts", *spec.target_key]} if fact else {}
    if spec.mode == "append":
        sink_curated_insert_ignore(
            rows, path, spec.schema, spec.target_key, batch_id, order=ARRIVAL, **layout
        )
    else:
        sink_curated_overwrite(rows, path, spec.schema, batch_id, key=spec.target_key, **layout)


def committed(spark: SparkSession, out: str) -> DataFrame:
    """Feeds of batches whose load has come to its end, with their counters: a row is written
    when all layers are, so it is what makes a load count."""
    return read_or_empty(spark, f"{out}/{COMMITS}", BATCHES)


def visible(rows: DataFrame, out: str, feed: str | None = None) -> DataFrame:
    """Rows of a layer that committed loads have brought (``feed``: the layer of one feed).
    What a broken load has left stays hidden until its batch is run again."""
    done = committed(rows.sparkSession, out)
    done = done.where(F.col("feed") == feed) if feed else done
    if "feed" in rows.columns:
        done = done.select(F.col("load_batch_id").alias("_b"), F.col("feed").alias("_f"))
        return rows.join(done, (F.col(BATCH_ID) == F.col("_b")) & (F.col("feed") == F.col("_f")), "left_semi")
    done = done.select(F.col("load_batch_id").alias("_b")).distinct()
    return rows.join(done, F.col(BATCH_ID) == F.col("_b"), "left_semi")


def _lookups(spark: SparkSession, source: dict[str, str], out: str) -> dict[str, tuple]:
    """The curated dimensions that a feed's keys are looked up in; none while one is not loaded."""
    found = {}
    for key, table in (("sku", "dim_product"), ("store_id", "dim_store")):
        if key in source:
            known = read_or_empty(spark, f"{out}/curated/{table}", T.StructType([T.StructField(key, T.StringType())]))
            if not known.isEmpty():
                found[f"_no_{key}"] = (source[key], known, key)
    return found


def audit_feed(tagged: DataFrame, spec: FeedSpec, out: str, batch_id: int) -> DataFrame:
    """The counters of one feed: repaired where price or amount follows from the other, flagged
    where a currency is not the house's or a key is in no dimension, late where a sale is
    older than the newest of the batch by ``LATE``; inserted rows are counted in the target."""
    source = {target: s for s, target in spec.mapping.items() if s in tagged.columns}
    price, amount, time = (source.get(n) for n in ("unit_price", "revenue", "transaction_ts"))
    false, spark = F.lit(False), tagged.sparkSession
    marks = {"repaired": false, "flagged": false, "late_arriving": false}
    if price and amount:
        marks["repaired"] = F.col(price).isNull() != F.col(amount).isNull()
    if "currency" in source:
        marks["flagged"] = F.coalesce(F.col(source["currency"]) != HOUSE_CURRENCY, false)
    lookups = _lookups(spark, source, out)
    if lookups:
        tagged = unknown_keys(tagged, lookups)
    for flag in lookups:
        marks["flagged"] = marks["flagged"] | F.col(flag)
    if time and isinstance(tagged.schema[time].dataType, T.TimestampNTZType):
        newest = tagged.agg(F.max(time)).first()[0]
        if newest is not None:
            marks["late_arriving"] = F.coalesce(F.col(time) < F.lit(newest - LATE), false)
    counted = load_batch_audit(tagged, F.lit(batch_id).cast("int"), spec.folder.upper(), F.lit(True), marks)
    try:
        own = spark.read.parquet(f"{out}/curated/{spec.table}").where(F.col(BATCH_ID) == batch_id)
        for name, value in spec.literals.items():
            own = own.where(F.col(name) == value) if value is not None and name in own.columns else own
        inserted = own.count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        inserted = 0
    return counted.withColumns({"inserted": F.lit(inserted).cast("long"), "feed": F.lit(spec.name)})


def ingest_feed(landed: DataFrame, spec: FeedSpec, out: str, batch_id: int, stamp: str, typing: str) -> None:
    """One feed through all layers and its commit. The verdicts are stored once, as
    long as later steps read that table. Every layer is keyed by the batch, so that a load that
    broke off and is run again replaces what it left."""
    sink_raw(landed, f"{out}/raw/{spec.name}", spec.columns(), batch_id)
    with stored_verdicts(landed, spec, typing) as tagged:
        rejected = rejected_rows(tagged)
        if not rejected.isEmpty():
            sink_error(rejected, f"{out}/error/dq_rejected_rows", batch_id, spec.name)
            dq_report_sink(rejected, f"{out}/reports", stamp)
        rows = curate(clean_rows(tagged), spec)
        if not rows.isEmpty():
            write_curated(rows, spec, f"{out}/curated/{spec.table}", batch_id)
            sink_csv_batch(align_to_schema(rows, spec.schema), f"{out}/csv/{spec.table}", spec.name, batch_id, spec.mode != "append")
        audit = align_to_schema(audit_feed(tagged, spec, out, batch_id), BATCHES)
        audit.coalesce(1).write.mode("append").parquet(f"{out}/{COMMITS}")


def ingest_landed(
    spark: SparkSession,
    landed: Iterable[tuple[FeedSpec, DataFrame]],
    out: str,
    batch_id: int | None = None,
    stamp: str | None = None,
    typing: str = "declared",
) -> DataFrame:
    """Landed rows of feeds, one after another, as one batch; returns the batch's audit rows.

    Feeds that the batch has committed are passed over: running it again changes nothing.
    Without a number the batch takes the next one.
    """
    if batch_id is None:
        batch_id = (committed(spark, out).agg(F.max("load_batch_id")).first()[0] or 0) + 1
    done = {r.feed for r in committed(spark, out).where(F.col("load_batch_id") == batch_id).select("feed").collect()}
    for spec, rows in landed:
        if spec.name not in done and not rows.isEmpty():
            with shuffles_dropped(spark):
                ingest_feed(rows, spec, out, batch_id, stamp or f"{batch_id:08d}_000000", typing)
    return committed(spark, out).where(F.col("load_batch_id") == batch_id)


def run_ingest(
    spark: SparkSession,
    root: str,
    out: str,
    specs: Sequence[FeedSpec],
    mode: str = "all",
    batch_id: int | None = None,
    stamp: str | None = None,
    typing: str = "declared",
) -> DataFrame:
    """All feeds of the mode, in declared order; returns one audit row per feed.

    Workbooks shared by several feeds are decoded once, into a stored table.
    """
    chosen = select_feeds(specs, mode)
    found = {r["feed"] for r in discover_files(spark, root, chosen).select("feed").distinct().collect()}

    def landed() -> Iterator[tuple[FeedSpec, DataFrame]]:
        for (folder, pattern), group in groupby(chosen, key=lambda s: (s.folder, s.pattern)):
            feeds = [s for s in group if s.name in found]
            if not feeds:
                continue
            grid = scan_workbooks(spark, f"{root}/{folder}", pattern)
            grid = drop_ghost_sheets(materialize(spark, grid, "grid"))
            routed = grid.withColumn("feed", route_sheet(F.col(SHEET), feeds))
            for spec in feeds:
                sheet = routed.filter(F.col("feed") == spec.name).drop("feed")
                yield spec, materialize(spark, grid_to_table(sheet, spec.columns()), f"landed-{spec.name}")

    return ingest_landed(spark, landed(), out, batch_id, stamp, typing)
