"""Every operator as a query over the driver's tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyhouse import testbed as t
from tallyhouse.functions.columns import to_timestamp_any
from tallyhouse.functions.rules import violates
from tallyhouse.operators import (
    audit,
    calendars as cal,
    cleaning as cl,
    forecast as fc,
    inventory as inv,
    layers as ly,
    quality as dq,
    reports as rp,
    sales as sl,
    scd,
    series as sr,
)
from tallyhouse.operators import keys
from tallyhouse.plans import context, ingest
from tallyhouse.session import compiled, materialize, scratch
from tallyhouse.sources import files, grids, tables, workbooks as wb
from tallyhouse.specs import (
    FEEDS,
    FILE,
    FORECASTS,
    PRODUCTS,
    ROW,
    SALES,
    SHEET,
    STORES,
    FeedSpec,
)
from tallyhouse.streaming import incremental as st

START, END = date(1996, 3, 1), date(1998, 11, 30)
RUN_STAMP = "20240708_060000"
HORIZON = 90
POS_SPEC = next(s for s in FEEDS if s.name == "pos_batch")
ONLINE_SPEC = next(s for s in FEEDS if s.name == "online_batch")
#: What the quality log and the batch audit read of the gate's rows: the rest is not sent to the verdicts.
LOGGED = ["transaction_id", "ts", "store_id", "sku", "unit_price", "amount", "currency", "_dq_issue", "_dq_source_file"]
QUERIES: dict = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        compiled(spark)
        return f(spark, d)

    QUERIES[f.__name__] = run
    return f


# ---- inputs several queries share


def _enriched(spark, d, **span) -> DataFrame:
    sales = t.sales(spark, d, lineage=False)
    return sl.sales_enriched(sales, t.products(spark, d), t.stores(spark, d), **span)


def _by_product(spark, d) -> DataFrame:
    sales = t.sales(spark, d, lineage=False)
    return sl.sales_enriched(sales, products=t.products(spark, d))


def _by_store(spark, d) -> DataFrame:
    return sl.sales_enriched(t.sales(spark, d, lineage=False), stores=t.stores(spark, d))


def _usable(spark, d) -> DataFrame:
    return sl.usable_sales(t.sales(spark, d, lineage=False))


def _landed(spark, d) -> DataFrame:
    """The point-of-sale feed as the raw layer holds it."""
    return materialize(spark, t.pos_feed(spark, d), "landed", ly.STORED_AS)


def _grid(spark, d) -> DataFrame:
    """Sheet rows as the scan stores them."""
    return materialize(spark, t.grid(spark, d), "grid")


def _clean_feed(spark, d) -> DataFrame:
    return cl.clean_text(_landed(spark, d))


def _tidy_feed(spark, d) -> DataFrame:
    return cl.tidy_numbers(_clean_feed(spark, d), list(POS_SPEC.rules))


def _tagged(spark, d) -> DataFrame:
    return dq.dq_gate(_tidy_feed(spark, d), POS_SPEC.key, POS_SPEC.rules)


def _rejected(spark, d) -> DataFrame:
    """Rejected rows as three reports, of the runs of three days."""
    rejected = dq.rejected_rows(_tagged(spark, d))
    day = F.concat(F.lit("2024070"), (F.col(ROW) % 3 + 1).cast("string"), F.lit("_060000"))
    return rejected.withColumn("report", dq.dq_report_name(day))


def _series(spark, d) -> DataFrame:
    return sr.daily_series(t.sales(spark, d, lineage=False), t.products(spark, d), t.stores(spark, d))


def _stored_series(spark, d) -> DataFrame:
    return materialize(spark, _series(spark, d), "series")


def _spine(series: DataFrame) -> DataFrame:
    return cal.date_spine(sr.series_profile(series), HORIZON)


def _calendar(spark, d) -> DataFrame:
    days = F.col("l_shipdate").cast("date")
    span = t.table(spark, d, "lineitem").agg(
        F.min(days).alias("first_day"), F.max(days).alias("last_day")
    )
    return cal.calendar_dimension(span)


def _points(spark, d) -> DataFrame:
    return fc.forecast_points_per_pair(t.forecasts(spark, d), HORIZON)


def _stored_tagged(spark, d) -> DataFrame:
    return materialize(spark, _tagged(spark, d).select(*LOGGED), "tagged", ly.STORED_AS)


def _looked_up(spark, d) -> DataFrame:
    """The gate's rows, as far as log and audit read them, with flags on keys that the dimensions lack."""
    lookups = {
        "no_store": ("store_id", t.stores(spark, d), "store_id"),
        "no_sku": ("sku", t.products(spark, d), "sku"),
    }
    return audit.unknown_keys(_stored_tagged(spark, d), lookups)


def _quality_log(tagged: DataFrame) -> DataFrame:
    repairs = {
        "NULL_UNIT_PRICE": (F.col("unit_price").isNull() & F.col("amount").isNotNull(), "unit_price"),
        "NULL_AMOUNT": (F.col("amount").isNull() & F.col("unit_price").isNotNull(), "amount"),
    }
    flags = {
        "UNKNOWN_STORE_ID": (F.col("no_store"), "store_id"),
        "UNKNOWN_SKU": (F.col("no_sku"), "sku"),
        "EUR_CURRENCY": (F.col("currency") == "EUR", "currency"),
    }
    batch = (F.length("store_id") + 100).cast("int")
    return audit.quality_log_build(tagged, "transaction_id", batch, repairs, flags)


def _batches(spark, d, verdicts: DataFrame) -> DataFrame:
    """Audit rows of the point-of-sale feed, one load batch per length of store id."""
    known = t.target_keys(spark, d).withColumn("known", F.lit(True))
    marks = {
        "repaired": F.col("unit_price").isNull() != F.col("amount").isNull(),
        "flagged": F.col("no_store") | F.col("no_sku"),
        "late_arriving": to_timestamp_any(F.col("ts")) < F.lit("1996-01-01").cast("timestamp_ntz"),
    }
    batch = (F.length("store_id") + 100).cast("int")
    # the join sends the marks, not the texts that they are made of
    marked = verdicts.select("transaction_id", "_dq_issue", batch.alias("batch"), *[c.alias(n) for n, c in marks.items()])
    tagged = marked.join(known, "transaction_id", "left")
    return audit.load_batch_audit(tagged, F.col("batch"), "INCREMENTAL", F.col("known").isNull(), {n: F.col(n) for n in marks})


# ---- scans, sources, sinks


@query
def scan_workbooks(spark: SparkSession, d: str) -> DataFrame:
    grid = wb.decode_workbooks(t.workbooks(spark, d))
    cols = ["order_id", "customer", "status", "priority", "ts"]
    return grids.grid_to_table(grids.drop_ghost_sheets(materialize(spark, grid, "grid")), cols).select(*cols)


@query
def discover_files(spark, d):
    def spec(name, pattern):
        return FeedSpec(name, "", pattern, name, SALES)

    specs = [spec("facts", "line*.parquet"), spec("facts", "order*.parquet"), spec("dims", "[ps]*r*.parquet")]
    found = files.discover_files(spark, d, specs)
    names = ["lineitem", "orders", "part", "supplier"]
    counts = None
    for n in names:
        one = t.numbered(spark, d, n).groupBy(F.col(FILE).alias("file_name")).agg(F.count("*").alias("n_rows"))
        counts = one if counts is None else counts.unionByName(one)
    return found.join(counts, "file_name").select("feed", "file_name", "n_rows")


@query
def drop_ghost_sheets(spark, d):
    kept = grids.drop_ghost_sheets(_grid(spark, d))
    return kept.groupBy(F.col(FILE).alias("file"), F.col(SHEET).alias("sheet")).agg(
        F.count("*").alias("n_rows")
    )


@query
def detect_header(spark, d):
    return grids.detect_header(_grid(spark, d)).select(
        F.col(FILE).alias("file"), F.col(SHEET).alias("sheet"), "header_row", "n_cells"
    )


@query
def grid_to_table(spark, d):
    table = grids.grid_to_table(grids.drop_ghost_sheets(_grid(spark, d)))
    return table.select(
        F.col(FILE).alias("file"),
        F.col(SHEET).alias("sheet"),
        F.col(ROW).alias("row_idx"),
        F.col("Order_ID").alias("order_id"),
        F.col("Customer").alias("customer"),
        F.col("_col2").alias("col2"),
        F.col("Status").alias("status"),
        F.col("Order Date").alias("order_date"),
    )


@query
def source_system_tag(spark, d):
    tag = grids.source_system_tag(F.col(FILE), F.col(SHEET))
    return t.sheets(spark, d).select(
        F.col(FILE).alias("file"), F.col(SHEET).alias("sheet"), "n_rows", tag.alias("source_system")
    )


@query
def route_sheet(spark, d):
    specs = [s for s in FEEDS if s.folder == "incremental"]
    return t.sheets(spark, d).select(
        F.col(FILE).alias("file"),
        F.col(SHEET).alias("sheet"),
        grids.route_sheet(F.col(SHEET), specs).alias("feed"),
    )


@query
def scan_curated(spark, d):
    found = tables.scan_curated(
        {"sales": t.sales(spark, d, lineage=False), "products": t.products(spark, d), "stores": t.stores(spark, d)},
        {
            "sales": ["transaction_id", "sku", "store_id", "quantity", "unit_price", "revenue"],
            "products": ["sku", "category", "brand"],
            "stores": ["store_id", "region"],
        },
    )
    # one frame: the columns that a table lacks are NULL
    named = [df.withColumn("table_name", F.lit(n)) for n, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


@query
def sink_raw(spark, d):
    path = scratch(spark, "raw")
    ly.sink_raw(cl.normalize_headers(t.online_feed(spark, d)), path, ["order_id", "units", "note"], 7)
    return spark.read.parquet(path).select(
        F.col(FILE).alias("source_file"), F.col(SHEET).alias("sheet_name"), F.col(ROW).alias("row_idx"),
        "order_id", "units", F.col("note").cast("string").alias("note"),
        F.col(ly.BATCH_ID).alias("load_batch_id"),
    )


@query
def sink_error(spark, d):
    path = scratch(spark, "error")
    ly.sink_error(dq.rejected_rows(_tagged(spark, d)), path, 7)
    return spark.read.parquet(path).select(
        F.col(FILE).alias("source_file"), F.col(SHEET).alias("sheet_name"),
        F.col(ly.BATCH_ID).alias("load_batch_id"), "dq_issue", "dq_detail", "dq_action", "row_data",
    )


def _sales_back(spark, path) -> DataFrame:
    return spark.read.schema(SALES).parquet(path).select(SALES.names)


@query
def sink_curated_overwrite(spark, d):
    """All channels once, then the point-of-sale channel again with other prices."""
    path, sales = scratch(spark, "curated"), t.sales(spark, d)
    layout = {"by": ["source_system"], "cluster": ["transaction_ts", "transaction_id"]}
    ly.sink_curated_overwrite(sales, path, SALES, 1, **layout)
    again = sales.filter("source_system = 'POS'").withColumn("unit_price", F.lit(1))
    ly.sink_curated_overwrite(again, path, SALES, 2, **layout)
    return _sales_back(spark, path)


@query
def sink_curated_insert_ignore(spark, d):
    """The point-of-sale channel, then all channels, then all channels again."""
    path, sales = scratch(spark, "curated"), t.sales(spark, d)
    key = ["transaction_id"]
    ly.sink_curated_insert_ignore(sales.filter("source_system = 'POS'"), path, SALES, key, 1)
    for batch in (2, 3):
        ly.sink_curated_insert_ignore(sales, path, SALES, key, batch)
    return _sales_back(spark, path)


@query
def sink_csv(spark, d):
    path, products = scratch(spark, "csv"), t.products(spark, d)
    ly.sink_csv(products.select("sku", "brand", "category"), path)
    ly.sink_csv(products.select("brand", "sku", "list_price"), path, "append")
    back = spark.read.csv(path, header=True)
    return back.withColumn("category", F.coalesce("category", F.lit("")))


@query
def sink_forecast_replace(spark, d):
    path, old = scratch(spark, "forecasts"), t.forecasts(spark, d)
    ly.sink_forecast_replace(old, path)
    newest = fc.latest_run(old).filter(F.col("category") != "PROMO")
    ly.sink_forecast_replace(newest.withColumn("model_version", F.lit("v2")), path)
    return spark.read.schema(FORECASTS).parquet(path)


@query
def dq_report_sink(spark, d):
    path = scratch(spark, "reports")
    ly.dq_report_sink(dq.rejected_rows(_tagged(spark, d)), path, RUN_STAMP)
    back = spark.read.csv(path, header=True)
    return back.select(
        "transaction_id", "ts", "qty",
        F.col("_dq_issue").alias("issue"),
        F.col("_report_ts").cast("string").alias("report_ts"),
        F.col("_dq_source_file").alias("source_file"),
        F.col("_dq_sheet").alias("sheet"),
    )


def _ingested(spark, d) -> str:
    """Point-of-sale rows as batch 1, batch 1 run again, and the same rows as batch 2."""
    out = scratch(spark, "lake")
    ly.sink_curated_overwrite(t.products(spark, d), f"{out}/curated/dim_product", PRODUCTS)
    ly.sink_curated_overwrite(t.stores(spark, d), f"{out}/curated/dim_store", STORES)
    landed = materialize(spark, t.pos_feed(spark, d), "landed", ly.STORED_AS)
    for batch in (1, 1, 2):
        ingest.ingest_landed(spark, [(POS_SPEC, landed)], out, batch)
    return out


@query
def ingest_curated(spark, d):
    """The fact after the three runs: every key once, of the batch that brought it."""
    out = _ingested(spark, d)
    rows = ingest.visible(spark.read.parquet(f"{out}/curated/sales_transactions"), out)
    return rows.select(
        "transaction_id", "transaction_ts", "store_id", "sku", "quantity", "unit_price", "revenue", "currency",
        "source_system", "source_file", F.col(ly.BATCH_ID).cast("int").alias("load_batch_id"),
    )


@query
def ingest_layers(spark, d):
    """Rows by layer and batch after the three runs."""
    out = _ingested(spark, d)
    raw = spark.read.parquet(f"{out}/raw/{POS_SPEC.name}").withColumn("layer", F.lit("raw"))
    error = spark.read.parquet(f"{out}/error/dq_rejected_rows").withColumn("layer", F.concat(F.lit("error "), "dq_issue"))
    csv = spark.read.csv(f"{out}/csv/sales_transactions", header=True).withColumn("layer", F.lit("csv"))
    parts = [ingest.visible(raw, out, POS_SPEC.name), ingest.visible(error, out), ingest.visible(csv, out)]
    counts = [p.groupBy("layer", F.col(ly.BATCH_ID).cast("int").alias("load_batch_id")).agg(F.count("*").alias("n")) for p in parts]
    return reduce(DataFrame.unionByName, counts)


@query
def ingest_audit(spark, d):
    """The audit rows of the two batches."""
    return ingest.committed(spark, _ingested(spark, d))


# ---- projections, cleaning, predicates


@query
def normalize_headers(spark, d):
    return cl.normalize_headers(t.online_feed(spark, d)).drop(FILE, SHEET, ROW)


@query
def null_markers(spark, d):
    feed = cl.null_markers(_landed(spark, d))
    return feed.select(F.col(ROW).alias("row_idx"), "transaction_id", "ts", "qty", "unit_price", "amount")


@query
def drop_all_null_rows(spark, d):
    feed = cl.null_markers(_landed(spark, d))
    kept = cl.drop_all_null_rows(feed, ["unit_price", "amount"])
    return kept.select(F.col(ROW).alias("row_idx"), "unit_price", "amount")


@query
def trim_strings(spark, d):
    feed = cl.trim_strings(_landed(spark, d))
    return feed.select(F.col(ROW).alias("row_idx"), "sku", "qty")


@query
def parse_dates_vote(spark, d):
    feed = cl.parse_dates_vote(_clean_feed(spark, d), ["ts"])
    return feed.select(F.col(ROW).alias("row_idx"), "ts")


@query
def parse_dates_coalesce(spark, d):
    feed = cl.parse_dates_coalesce(_clean_feed(spark, d), ["ts"])
    return feed.select(F.col(ROW).alias("row_idx"), "ts")


@query
def coerce_numeric_vote(spark, d):
    cols = ["qty", "unit_price", "amount", "currency"]
    return cl.coerce_numeric_vote(_clean_feed(spark, d), cols).select(F.col(ROW).alias("row_idx"), *cols)


@query
def map_columns(spark, d):
    return cl.map_columns(cl.normalize_headers(t.online_feed(spark, d)), ONLINE_SPEC.mapping)


@query
def inject_columns(spark, d):
    mapped = cl.map_columns(cl.normalize_headers(t.online_feed(spark, d)), ONLINE_SPEC.mapping, [FILE])
    return cl.inject_columns(mapped, ONLINE_SPEC.literals).select(
        "transaction_id", "sku", "source_system", "source_file"
    )


@query
def dedup_on_column(spark, d):
    return cl.dedup_on_column(t.sales(spark, d), "transaction_id").select(*SALES.names)


@query
def align_to_schema(spark, d):
    mapped = cl.map_columns(cl.normalize_headers(t.online_feed(spark, d)), ONLINE_SPEC.mapping)
    return cl.align_to_schema(mapped, SALES)


@query
def derive_revenue(spark, d):
    return sl.derive_revenue(t.sales(spark, d)).select(
        F.col(ROW).alias("row_idx"), "quantity", "unit_price", "revenue"
    )


@query
def usable_sales_filter(spark, d):
    return sl.usable_sales_filter(t.sales(spark, d)).select(
        F.col(ROW).alias("row_idx"), "transaction_id", "transaction_ts", "unit_price", "revenue"
    )


@query
def date_range_filter(spark, d):
    return sl.date_range_filter(t.sales(spark, d), START, END).select(
        F.col(ROW).alias("row_idx"), "transaction_id", "transaction_ts"
    )


@query
def forecast_filter(spark, d):
    return fc.forecast_filter(t.forecasts(spark, d), "ECONOMY", "ASIA")


@query
def issue_filter(spark, d):
    kept = dq.issue_filter(dq.rejected_rows(_tagged(spark, d)), ["PK_DUPLICATE", "DATATYPE_VIOLATION"])
    return kept.select(F.col(ROW).alias("row_idx"), F.col("_dq_issue").alias("issue"))


@query
def page_rows(spark, d):
    rows = t.sales(spark, d).select("transaction_id", F.col(ROW).alias("row_idx"), "sku", "store_id")
    return inv.page_rows(rows, [F.asc("transaction_id"), F.asc("row_idx")], 100, 250)


# ---- data-quality gate


def _verdicts(df):
    return df.select(
        F.col(ROW).alias("row_idx"),
        "transaction_id",
        F.col("_dq_issue").alias("issue"),
        F.col("_dq_detail").alias("detail"),
        F.col("_dq_action").alias("action"),
        F.col("_dq_source_file").alias("source_file"),
        F.col("_dq_sheet").alias("sheet"),
    )


@query
def dq_duplicate_rows(spark, d):
    return _verdicts(dq.dq_duplicate_rows(_tidy_feed(spark, d)))


@query
def dq_pk_duplicates(spark, d):
    return _verdicts(dq.dq_pk_duplicates(_tidy_feed(spark, d), ["transaction_id"]))


def _rule(spark, d, col, rule):
    feed = _tidy_feed(spark, d)
    return feed.select(F.col(ROW).alias("row_idx"), col, violates(rule, F.col(col)).alias("bad"))


@query
def dq_rule_numeric(spark, d):
    return _rule(spark, d, "unit_price", "numeric")


@query
def dq_rule_positive_numeric(spark, d):
    return _rule(spark, d, "qty", "positive_numeric")


@query
def dq_rule_datetime(spark, d):
    return _rule(spark, d, "ts", "datetime")


@query
def dq_datatype_gate(spark, d):
    return _verdicts(dq.dq_datatype_gate(_tidy_feed(spark, d), POS_SPEC.rules))


@query
def dq_gate(spark, d):
    return _verdicts(_tagged(spark, d))


@query
def dq_counts(spark, d):
    return dq.dq_counts(_tagged(spark, d)).withColumnRenamed("_dq_issue", "issue")


@query
def dq_report_index(spark, d):
    return dq.dq_report_index(_rejected(spark, d))


@query
def dq_report_detail(spark, d):
    rows = dq.dq_report_detail(_rejected(spark, d), "20240702_060000_lineitem_Sales_dq_report.csv")
    return _verdicts(rows)


@query
def dq_issue_rollup(spark, d):
    return dq.dq_issue_rollup(_rejected(spark, d))


@query
def dq_newest_first(spark, d):
    names = dq.dq_report_index(_rejected(spark, d)).select("report", "total_rejected")
    return names.orderBy(F.desc("report"))


@query
def union_rejected(spark, d):
    # cleaned once for five scans; with its scope filled in as the gate does, checks share exchanges
    feed = materialize(spark, _tidy_feed(spark, d), "tidy", ly.STORED_AS)
    feed = feed.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in dq.SCOPE})
    parts = [
        dq.dq_duplicate_rows(feed, key=["transaction_id"]),
        dq.dq_pk_duplicates(feed, ["transaction_id"]),
        dq.rejected_rows(dq.dq_gate(feed, POS_SPEC.key, POS_SPEC.rules)).filter("_dq_issue = 'DATATYPE_VIOLATION'"),
    ]
    return _verdicts(dq.union_rejected(*[p.select(*feed.columns, *dq.DQ) for p in parts]))


# ---- joins


@query
def sales_enriched(spark, d):
    return _enriched(spark, d)


@query
def series_join(spark, d):
    return sr.series_join(t.sales(spark, d, lineage=False), t.products(spark, d), t.stores(spark, d))


@query
def sku_attr_join(spark, d):
    by_sku = _usable(spark, d).groupBy("sku").agg(sl.revenue_sum())
    return sl.sku_attr_join(by_sku, t.products(spark, d))


@query
def promo_interval_join(spark, d):
    return cal.promo_interval_join(_spine(_stored_series(spark, d)), t.promos(spark, d))


@query
def insert_ignore_antijoin(spark, d):
    rows = t.sales(spark, d).select("transaction_id", F.col(ROW).alias("row_idx"))
    once = materialize(spark, keys.first_per_key(rows, ["transaction_id"], "row_idx"), "batch")
    path, name = scratch(spark, "target"), keys.bucket_column()
    keys.with_bucket(t.target_keys(spark, d), ["transaction_id"], name).repartition(name).write.partitionBy(name).parquet(path)
    return keys.antijoin(once, spark.read.parquet(path), ["transaction_id"])


LAYERS = {
    "raw": ["lineitem", "orders", "events"],
    "curated": ["customer", "nation", "part", "region", "supplier"],
    "public": ["benchmark", "conversations", "documents", "embeddings", "labels", "pages"],
}


def _catalog(spark, d):
    listed = [(s, n) for s, names in LAYERS.items() for n in names]
    counts = inv.table_counts({(s, n): t.table(spark, d, n) for s, n in listed})
    return spark.createDataFrame(listed, "schema_name string, table_name string"), counts


@query
def catalog_join(spark, d):
    return inv.catalog_join(*_catalog(spark, d))


@query
def table_inventory(spark, d):
    return inv.table_inventory(*_catalog(spark, d))


@query
def regressor_lookup(spark, d):
    series = _stored_series(spark, d)
    feature = cal.promo_overlap_max(_spine(series), t.promos(spark, d))
    return cal.regressor_lookup(series, feature, "intensity", "promo_active")


@query
def month_pair_join(spark, d):
    return sl.month_pairs(sl.category_month_revenue(_by_product(spark, d)))


# ---- aggregations


@query
def revenue_kpis(spark, d):
    return sl.revenue_kpis(_enriched(spark, d, start=START, end=END))


@query
def kpi_headline(spark, d):
    return sl.kpi_headline(_enriched(spark, d))


@query
def revenue_by_category(spark, d):
    return sl.revenue_by(_by_product(spark, d), "category")


@query
def revenue_by_region(spark, d):
    return sl.revenue_by(_by_store(spark, d), "region")


@query
def insights_aggregates(spark, d):
    return sl.insights_aggregates(_enriched(spark, d))


@query
def revenue_share(spark, d):
    parts = [
        sl.revenue_share(placed(spark, d), dim).select(
            F.lit(dim).alias("dim"), F.col(dim).alias("name"), "revenue", "share"
        )
        for dim, placed in (("category", _by_product), ("region", _by_store))
    ]
    return parts[0].unionByName(parts[1])


@query
def monthly_revenue_12(spark, d):
    return sl.monthly_revenue(_usable(spark, d), 12)


@query
def category_month_revenue(spark, d):
    return sl.category_month_revenue(_by_product(spark, d))


@query
def category_mom_growth(spark, d):
    return sl.category_mom_growth(_by_product(spark, d))


@query
def data_span(spark, d):
    return sl.data_span(_usable(spark, d))


@query
def product_performance(spark, d):
    usable = sl.usable_sales(t.sales(spark, d, lineage=False), START, END)
    return sl.product_performance(usable, t.products(spark, d), 100)


@query
def daily_series(spark, d):
    return _series(spark, d)


@query
def series_profile(spark, d):
    return sr.series_profile(_series(spark, d))


@query
def quality_by_issue(spark, d):
    return audit.quality_by_issue(_quality_log(_looked_up(spark, d)))


@query
def quality_by_action(spark, d):
    return audit.quality_by_action(_quality_log(_looked_up(spark, d)))


@query
def quality_summary(spark, d):
    tagged = _looked_up(spark, d)
    return audit.quality_summary(_quality_log(tagged), _batches(spark, d, tagged))


@query
def forecast_inventory(spark, d):
    return fc.forecast_inventory(t.forecasts(spark, d))


@query
def forecast_kpis(spark, d):
    return rp.forecast_kpis(_points(spark, d))


@query
def forecast_band_pct(spark, d):
    return rp.forecast_band_pct(_points(spark, d))


@query
def forecast_weekly(spark, d):
    return rp.forecast_weekly(_points(spark, d))


# ---- windows, sorts, top-k


@query
def first_per_key(spark, d):
    return keys.first_per_key(t.sales(spark, d), ["sku", "store_id"], ROW).select(*SALES.names)


@query
def latest_run(spark, d):
    return fc.latest_run(t.forecasts(spark, d), region="EUROPE")


@query
def latest_batch(spark, d):
    return audit.latest_batch(_batches(spark, d, _looked_up(spark, d)))


@query
def forecast_growth(spark, d):
    return rp.forecast_growth(_points(spark, d))


@query
def promo_overlap_max(spark, d):
    return cal.promo_overlap_max(_spine(_stored_series(spark, d)), t.promos(spark, d))


@query
def top_category(spark, d):
    return sl.top_member(_by_product(spark, d), "category")


@query
def top_region(spark, d):
    return sl.top_member(_by_store(spark, d), "region")


@query
def top_products(spark, d):
    return sl.product_performance(_usable(spark, d), t.products(spark, d), 20)


@query
def forecast_points(spark, d):
    return fc.forecast_points(t.forecasts(spark, d), horizon=HORIZON)


@query
def forecast_points_per_pair(spark, d):
    return _points(spark, d)


@query
def unify_channels(spark, d):
    online = cl.map_columns(cl.normalize_headers(t.online_feed(spark, d)), ONLINE_SPEC.mapping)
    pos = t.sales(spark, d).filter("source_system = 'POS'").select(
        "transaction_id", F.col("quantity").cast("int").cast("string").alias("quantity"),
        F.col("revenue").cast("string").alias("revenue"), "sku",
    )
    both = sl.unify_channels(pos, online.select("transaction_id", "quantity", "sku", "currency"))
    return both.select("transaction_id", "quantity", "revenue", "sku", "currency")


# ---- text products


@query
def bounded_context(spark, d):
    cube = materialize(spark, sl.revenue_cube(_enriched(spark, d)), "cube")
    tagged = _looked_up(spark, d)
    batches = _batches(spark, d, tagged)
    return context.bounded_context(cube, _quality_log(tagged), batches, t.forecasts(spark, d))


@query
def insights_summary(spark, d):
    cube = materialize(spark, sl.revenue_cube(_enriched(spark, d)), "cube")
    return context.insights_summary(cube)


# ---- time series and forecasting


@query
def date_spine(spark, d):
    return _spine(_series(spark, d))


@query
def promo_calendar(spark, d):
    return cal.promo_calendar(_spine(_stored_series(spark, d)), t.promos(spark, d))


@query
def holiday_calendar(spark, d):
    return cal.holiday_calendar(_calendar(spark, d))


@query
def holiday_effects(spark, d):
    effects = cal.holiday_effects(cal.holiday_calendar(_calendar(spark, d)))
    return effects.select("ds", F.array_join("holidays", "|").alias("holidays"))


@query
def history_gate(spark, d):
    return sr.history_gate(_series(spark, d), 1200)


def _training(spark, d):
    holidays = cal.holiday_calendar(_calendar(spark, d))
    return sr.training_frame(_stored_series(spark, d), t.promos(spark, d), holidays, HORIZON)


@query
def training_frame(spark, d):
    return _training(spark, d).withColumn("holidays", F.array_join("holidays", "|"))


@query
def fit_forecast(spark, d):
    return fc.fit_forecast(_training(spark, d))


@query
def forecast_rows(spark, d):
    """The projection into the forecast table, over daily revenue in place of a fit."""
    y = F.col("y").cast("double")
    fit = _series(spark, d).select(
        "category", "region", "ds", y.alias("yhat"), (y / 2).alias("yhat_lower"),
        (y * 2).alias("yhat_upper"), F.when(F.col("y") < 50000, "too small").alias("error"),
    )
    return fc.forecast_rows(fit, F.lit(END))


@query
def calendar_dimension(spark, d):
    return _calendar(spark, d)


@query
def promo_day_set(spark, d):
    return cal.promo_day_set(t.promos(spark, d), _stored_series(spark, d))


@query
def competitor_gap(spark, d):
    return cal.competitor_gap(t.products(spark, d), t.competitor_prices(spark, d))


@query
def campaign_calendar(spark, d):
    return cal.campaign_calendar(_spine(_stored_series(spark, d)), t.campaigns(spark, d))


# ---- history, repair, audit


@query
def scd2_apply(spark, d):
    return scd.scd2_apply(t.products(spark, d), t.product_updates(spark, d))


@query
def scd2_merge(spark, d):
    """A stored history of the dimension, brought up to date by two batches of updates."""
    path, updates = scratch(spark, "history"), t.product_updates(spark, d)
    scd.scd2_create(t.products(spark, d), path)
    half = updates.agg(F.max(ROW)).first()[0] // 2
    for batch in (updates.filter(F.col(ROW) <= half), updates.filter(F.col(ROW) > half)):
        scd.scd2_merge(spark, path, batch)
    return scd.scd2_read(spark, path)


@query
def scd2_asof_lookup(spark, d):
    versions = materialize(spark, scd2_apply(spark, d), "versions")
    sales = t.sales(spark, d).select("transaction_id", "transaction_ts", "sku", F.col(ROW).alias("row_idx"))
    return scd.scd2_asof_lookup(sales, versions, ("brand", "list_price"))


@query
def late_arriving_flag(spark, d):
    """Every fifth line arrives nine days after its stamp; the bound is the Monday of
    its arrival."""
    shift = F.when(F.substring_index("transaction_id", "-", -1).cast("int") == 5, 9).otherwise(0)
    arrived = F.date_add(F.to_date("transaction_ts"), shift)
    bound = F.date_trunc("week", arrived).cast("timestamp_ntz")
    rows = sl.late_arriving_flag(t.sales(spark, d), bound)
    return rows.select(F.col(ROW).alias("row_idx"), "transaction_id", "is_late_arriving")


@query
def repair_price(spark, d):
    return sl.repair_price(t.sales(spark, d)).select(
        F.col(ROW).alias("row_idx"), "unit_price", "price_action"
    )


@query
def repair_amount(spark, d):
    return sl.repair_amount(t.sales(spark, d)).select(
        F.col(ROW).alias("row_idx"), "revenue", "amount_action"
    )


@query
def unknown_key_flag(spark, d):
    sales = t.sales(spark, d)
    parts = [
        sl.unknown_key_flag(sales, dim, key).select(
            F.lit(key).alias("key_name"), F.col(key).alias("key_value"),
            F.col(ROW).alias("row_idx"), "action",
        )
        for key, dim in (("sku", t.products(spark, d)), ("store_id", t.stores(spark, d)))
    ]
    return parts[0].unionByName(parts[1])


@query
def currency_normalize(spark, d):
    return sl.currency_normalize(t.sales(spark, d), t.rates(spark, d)).select(
        F.col(ROW).alias("row_idx"), "currency", "revenue", "revenue_usd", "currency_action"
    )


@query
def quality_log_build(spark, d):
    return _quality_log(_looked_up(spark, d))


@query
def load_batch_audit(spark, d):
    return _batches(spark, d, _looked_up(spark, d))


# ---- streaming

DROP = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("event_id", "event_ts", "event_type", "user_id", "value")
    ]
)
EVENT_SPEC = FeedSpec(
    "events", "incremental", "*.parquet", "sales_transactions", SALES, sheet="events",
    key=("event_id",), rules={"value": "positive_numeric"},
    mapping={
        "event_id": "transaction_id", "event_ts": "transaction_ts", "event_type": "sku",
        "user_id": "store_id", "value": "revenue",
    },
    literals={"source_system": "EVENTS"}, mode="append",
)
EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("category", T.StringType()),
        T.StructField("region", T.LongType()),
        T.StructField("value", T.DecimalType(12, 2)),
        T.StructField("arrived", T.DateType()),
    ]
)


def _events(spark, d) -> DataFrame:
    """Events with their day of arrival: every seventh one comes three days late."""
    late = F.when(F.col("event_id") % 7 == 0, 3).otherwise(0)
    return t.table(spark, d, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("category"),
        (F.col("user_id") % 5).alias("region"),
        F.col("value").cast("decimal(12,2)").alias("value"),
        F.date_add(F.to_date("ts"), late).alias("arrived"),
    )


def _drops(spark, rows: DataFrame) -> str:
    """The rows as drops in a folder, and every tenth one dropped again."""
    path = scratch(spark, "drops")
    rows.write.parquet(f"{path}/first")
    rows.filter("event_id % 10 = 0").write.parquet(f"{path}/again")
    return path


@query
def stream_incremental_ingest(spark, d):
    texts = t.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_ts"),
        "event_type",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("$"), F.col("value").cast("decimal(12,2)")).alias("value"),
    )
    out = scratch(spark, "stream")
    args = (spark, _drops(spark, texts), DROP, EVENT_SPEC, out)
    st.stream_incremental_ingest(*args, f"{out}/checkpoint", files_per_trigger=1)
    st.stream_incremental_ingest(*args, f"{out}/replayed")
    return _sales_back(spark, f"{out}/curated/sales_transactions").select(
        "transaction_id", "transaction_ts", "store_id", "sku", "revenue", "source_system"
    )


def _file_sink(spark, stream: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    st.drain(writer.option("path", f"{path}/out"))
    return spark.read.parquet(f"{path}/out")


@query
def stream_dedup(spark, d):
    stream = st.read_drops(spark, _drops(spark, _events(spark, d)), EVENT)
    rows = stream.select("*", F.col("_metadata.row_index").alias(ROW))
    unique = st.stream_dedup(rows, ["event_id"], "ts", "40 days", spread=ROW)
    return _file_sink(spark, unique, "dedup").select("event_id", "category", "region", "value")


@query
def stream_late_flag(spark, d):
    # three drops of eleven days of arrival, the stream stopped after each
    src, out = scratch(spark, "late-drops"), scratch(spark, "late")
    rows = _events(spark, d).withColumn("drop", F.datediff("arrived", F.lit(date(2024, 1, 1))) / 11)
    for k in range(3):
        rows.where(F.floor("drop") == k).drop("drop").write.parquet(f"{src}/{k}")
        stream = st.read_drops(spark, src, EVENT, files_per_trigger=1_000_000)
        st.stream_late_flag(stream, "ts", timedelta(days=2), out)
    return spark.read.parquet(f"{out}/rows").select("event_id", "arrived", "is_late_arriving")


@query
def stream_daily_revenue(spark, d):
    drops = _drops(spark, _events(spark, d))
    stream = st.read_drops(spark, f"{drops}/first", EVENT, files_per_trigger=1)
    daily = st.stream_daily_revenue(stream, "ts", "value", ["category", "region"], "40 days")
    path = scratch(spark, "daily")
    st.keep_changes(daily, f"{path}/log", f"{path}/checkpoint")
    return st.latest_changes(spark, f"{path}/log", ["ds", "category", "region"])
