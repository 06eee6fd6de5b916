"""The driver's tables seen as feeds, facts and dimensions.

Every view reads whole tables. Faults (missing prices, unknown keys, mixed date
formats, repeated rows) are set by arithmetic on the order key, so that the checking
SQL can state the same rows.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.operators.series import daily_series
from tallyhouse.session import scratch
from tallyhouse.sources.workbooks import CELLS
from tallyhouse.specs import FILE, ROW, SHEET

POS, ONLINE = "POS", "ONLINE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with file name and row number in the file, as the scan counts it."""
    return table(spark, sf_dir, name).select(
        "*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(ROW)
    )


#: Bytes of a table per core from which its own splits keep all cores busy.
SPREAD_BELOW = 8_000_000


def _spread(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame) -> DataFrame:
    """``rows`` of a table spread over the cores, if it is so small that it may be one row group.
    The splits of a longer one are many, and its rows need not cross the network for that."""
    found = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet").agg(F.sum("length"))
    small = (found.first()[0] or 0) < SPREAD_BELOW * spark.sparkContext.defaultParallelism
    return rows.hint("rebalance") if small else rows


def _every(n: int, k: int, key: str = "l_orderkey") -> Column:
    return F.col(key) % n == k


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def sales(spark: SparkSession, sf_dir: str, lineage: bool = True) -> DataFrame:
    """Curated fact: a POS half with amounts and an online half without. Without
    ``lineage`` the scan does not build file names and row numbers."""
    qty = F.col("l_quantity").cast("decimal(12,4)")
    price = F.col("l_extendedprice").cast("decimal(12,4)")
    # exact to four places, so rounding the DOUBLE product loses nothing
    paid = F.col("l_quantity") * F.col("l_extendedprice") * (1 - F.col("l_discount"))
    paid = paid.cast("decimal(14,4)")
    pos = F.col("l_linestatus") == "F"
    lines = numbered(spark, sf_dir, "lineitem") if lineage else table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.when(~_every(211, 0), F.col("l_shipdate")).alias("transaction_ts"),
        F.when(_every(199, 1), "STORE999").otherwise(_text("l_suppkey")).alias("store_id"),
        F.when(_every(197, 2), "SKU999").otherwise(_text("l_partkey")).alias("sku"),
        qty.alias("quantity"),
        F.when(~_every(51, 3), price).alias("unit_price"),
        F.when(pos & ~_every(49, 4), paid).alias("revenue"),
        F.when(_every(67, 0), "EUR").otherwise("USD").alias("currency"),
        F.when(pos, POS).otherwise(ONLINE).alias("source_system"),
        *([F.col(FILE).alias("source_file"), F.col(ROW)] if lineage else []),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir, "part").select(
        _text("p_partkey").alias("sku"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        _text("p_size").alias("package_size"),
        F.col("p_retailprice").cast("decimal(12,4)").alias("list_price"),
        F.lit("1994-01-01").cast("date").alias("launch_date"),
        ROW,
    )


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A view as a curated table, written once per session. Its file size then tells
    the planner whether it may be broadcast; the estimate of a join cannot."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "stores", lambda: _stores(spark, sf_dir))


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        numbered(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            _text("s_suppkey").alias("store_id"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("city"),
            F.when(F.col("s_acctbal") < 0, "ONLINE").otherwise("SUPERMARKET").alias("store_type"),
            ROW,
        )
    )


def promos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One promotion per part, with overlaps, open bounds, mixed case and padding."""
    n = F.col("p_partkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (n * 37 % 2400).cast("int"))
    category = F.when(n % 3 == 0, F.lower("p_type")).otherwise(F.concat(F.lit(" "), "p_type", F.lit("  ")))
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "part")
        .join(region, n % 5 == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("PROMO"), n).alias("promo_id"),
            category.alias("category"),
            F.when(n % 4 == 0, F.lower("r_name")).otherwise(F.col("r_name")).alias("region"),
            F.when(n % 41 != 0, start).alias("start_date"),
            F.when(n % 43 != 0, F.date_add(start, F.col("p_size"))).alias("end_date"),
            F.when(n % 29 != 0, (n % 35 - 2).cast("decimal(8,4)")).alias("discount_pct"),
        )
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign per customer."""
    n = F.col("c_custkey")
    start = F.date_add(F.lit("1995-02-01").cast("date"), (n * 53 % 2300).cast("int"))
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, n == F.col("p_partkey"))
        .select(
            F.concat(F.lit("CAMP"), n).alias("campaign_id"),
            F.col("p_type").alias("category"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("channel"),
            start.alias("start_date"),
            F.date_add(start, (n % 60).cast("int")).alias("end_date"),
            F.when(n % 31 != 0, 1000 + n % 977).alias("exposure"),
        )
    )


def competitor_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every online sale line read as one price observation of a competitor."""
    seen = sales(spark, sf_dir, False).filter("transaction_ts is not null and unit_price is not null")
    return (
        seen.join(products(spark, sf_dir).select("sku", "category"), "sku")
        .join(stores(spark, sf_dir).select("store_id", "region"), "store_id")
        .select(
            F.to_date("transaction_ts").alias("obs_date"),
            "category",
            "region",
            F.col("unit_price").alias("competitor_price"),
        )
    )


def product_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line read as one attribute change of its product."""
    line = F.col("l_linenumber")
    return numbered(spark, sf_dir, "lineitem").select(
        _text("l_partkey").alias("sku"),
        F.when(line <= 2, "list_price")
        .when(line <= 4, "package_size")
        .otherwise("brand")
        .alias("attribute"),
        F.when(line <= 2, F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
        .when(line <= 4, F.concat(F.col("l_quantity").cast("int"), F.lit(" pack")))
        .otherwise(F.concat(F.lit("Brand#"), F.col("l_suppkey")))
        .alias("new_value"),
        F.to_date("l_shipdate").alias("effective_date"),
        ROW,
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange rates of the currencies seen in the sales."""
    return stored(spark, sf_dir, "rates", lambda: _rates(spark, sf_dir))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sales(spark, sf_dir, False).select("currency").distinct()
    rate = F.when(F.col("currency") == "EUR", 1.08).cast("decimal(8,4)")
    return seen.select("currency", rate.alias("rate")).filter("rate is not null")


def pos_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as a landed point-of-sale sheet: texts with faults, and one
    row in a hundred sent twice."""
    day = F.col("l_shipdate")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    amount = (F.col("l_quantity").cast("decimal(12,2)") * price).cast("decimal(18,2)")

    def choose(n: int, cases: dict[int, Column], other: Column) -> Column:
        out = other
        for k, v in reversed(cases.items()):
            out = F.when(_every(n, k), v).otherwise(out)
        return out

    ts = choose(
        60,
        {
            1: F.date_format(day, "MM/dd/yyyy HH:mm"),
            2: F.date_format(day, "dd-MMM-yyyy HH:mm"),
            3: F.date_format(day, "yyyy/MM/dd HH:mm:ss"),
            4: F.date_format(day, "MM/dd/yyyy"),
            5: F.lit("NULL"),
            6: F.lit("not a date"),
        },
        F.date_format(day, "yyyy-MM-dd HH:mm:ss"),
    )
    qty = choose(
        120,
        {1: F.lit("0"), 2: F.lit("-3"), 3: F.lit("three"), 4: F.lit(" N/A "), 5: F.lit("N/A")},
        F.col("l_quantity").cast("int").cast("string"),
    )
    unit = choose(
        70,
        {1: F.concat(F.lit("$"), F.format_number(price, 2)), 2: F.lit("None"), 3: F.lit("n.a.")},
        price.cast("string"),
    )
    total = choose(
        80,
        {1: F.concat(F.lit("€"), F.format_number(amount, 2)), 2: F.lit(""), 3: F.lit("free")},
        amount.cast("string"),
    )
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    # the test file is one row group: spread it before the costly texts are built
    feed = _spread(spark, sf_dir, "lineitem", numbered(spark, sf_dir, "lineitem")).select(
        FILE,
        F.lit("Sales").alias(SHEET),
        (F.col(ROW) * 2).alias(ROW),
        F.when(_every(1009, 7), F.lit("NA")).otherwise(key).alias("transaction_id"),
        ts.alias("ts"),
        F.when(_every(199, 1), "STORE999").otherwise(_text("l_suppkey")).alias("store_id"),
        F.when(_every(50, 9), F.concat(F.lit("\t "), _text("l_partkey"), F.lit(" ")))
        .when(_every(197, 2), F.lit("SKU999"))
        .otherwise(_text("l_partkey"))
        .alias("sku"),
        qty.alias("qty"),
        unit.alias("unit_price"),
        total.alias("amount"),
        F.when(_every(67, 0), "EUR").otherwise("USD").alias("currency"),
        _every(101, 5).alias("again"),
    )
    copies = F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = feed.withColumn("copy", F.explode(copies))
    return sent.withColumn(ROW, F.col(ROW) + F.col("copy")).drop("again", "copy")


def online_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as a landed online sheet, which has no amount."""
    return numbered(spark, sf_dir, "lineitem").select(
        FILE,
        F.lit("Orders").alias(SHEET),
        ROW,
        F.concat_ws("-", F.lit("W"), "l_orderkey", "l_linenumber").alias("Order_ID "),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias(" order_datetime"),
        _text("l_suppkey").alias("Location_Id"),
        _text("l_partkey").alias("PRODUCT_SKU"),
        F.col("l_quantity").cast("int").cast("string").alias("Units"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("price_per_unit"),
        F.lit("USD").alias("currency"),
    )


HEADER = ["Order_ID ", " Customer", None, "Status", "Order Date"]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as sheet rows: a workbook per year, a sheet per priority, with a
    title row, a blank row, a header row; plus a ghost and a header-only sheet."""
    orders = numbered(spark, sf_dir, "orders")
    file = F.concat(F.lit("orders_"), F.year("o_orderdate"), F.lit(".xlsx"))
    cells = F.array(
        _text("o_orderkey"),
        _text("o_custkey"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("  ")),
        F.col("o_orderstatus"),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    body = orders.select(
        file.alias(FILE), F.col("o_orderpriority").alias(SHEET), (F.col(ROW) + 3).alias(ROW),
        cells.alias(CELLS),
    )

    def row(n: int, *values: str | None) -> Column:
        texts = [F.lit(v).cast("string") for v in values]
        return F.struct(F.lit(n).cast("long").alias(ROW), F.array(*texts).alias(CELLS))

    blanks = [None, " ", None, None, "\t"]
    sheets = body.select(FILE, SHEET).distinct()
    heads = sheets.select(
        FILE,
        SHEET,
        F.inline(F.array(row(0, "Order extract", *[None] * 4), row(1, *blanks), row(2, *HEADER))),
    )
    books = sheets.select(FILE).distinct()
    stale = books.select(
        FILE, F.lit("Notes").alias(SHEET), F.inline(F.array(row(0, *blanks), row(1, *blanks)))
    ).unionByName(
        books.select(FILE, F.lit("Template").alias(SHEET), F.inline(F.array(row(0, *HEADER))))
    )
    return body.unionByName(heads).unionByName(stale)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets found in dropped workbooks: file by market segment, sheet by nation."""
    books = {
        "HOUSEHOLD": "weekly_POS.xlsx",
        "MACHINERY": "online_week27.xlsx",
        "FURNITURE": "promo_windows.xlsx",
        "AUTOMOBILE": "Spring_Campaign.xlsx",
    }
    file = F.lit("misc_2024.xlsx")
    for segment, name in books.items():
        file = F.when(F.col("c_mktsegment") == segment, name).otherwise(file)
    tabs = ["Sales", "orders", "product_updates", "Competitor prices", "promo plan", "campaigns"]
    sheet = F.concat(F.lit("Sheet"), F.col("c_nationkey"))
    for i, name in enumerate(tabs):
        sheet = F.when(F.col("c_nationkey") == i, name).otherwise(sheet)
    return table(spark, sf_dir, "customer").groupBy(file.alias(FILE), sheet.alias(SHEET)).agg(
        F.count("*").alias("n_rows")
    )


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders packed into workbook files, one per Arrow batch: (path, content)."""
    rows = table(spark, sf_dir, "orders").hint("rebalance").select(
        F.array(
            _text("o_orderkey"),
            _text("o_custkey"),
            F.col("o_orderstatus"),
            F.col("o_orderpriority"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        ).alias(CELLS)
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            body = [["Orders"], ["order_id", "customer", "status", "priority", "ts"], *batch[CELLS]]
            path = f"drop/orders_{uuid.uuid4().hex}.xlsx"
            content = workbook({"Orders": body, "Notes": []})
            yield pd.DataFrame([(path, content)], columns=["path", "content"])

    return rows.mapInPandas(pack, "path string, content binary")


def workbook(sheets: dict[str, list], numeric: bool = False) -> bytes:
    """A minimal workbook with inline texts, for fixtures."""
    out, head = io.BytesIO(), '<?xml version="1.0" encoding="UTF-8"?>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)
        )
        z.writestr("xl/workbook.xml", f'{head}<workbook {main} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
            for i, _ in enumerate(sheets, 1)
        )
        z.writestr("xl/_rels/workbook.xml.rels", f"{head}<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            lines = [
                f'<row r="{r}">' + "".join(_cell(v, numeric) for v in row) + "</row>"
                for r, row in enumerate(rows, 1)
            ]
            z.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f"{head}<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>",
            )
    return out.getvalue()


def _cell(v, numeric: bool) -> str:
    if v is None:
        return "<c/>"
    if numeric and isinstance(v, (int, float)):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue read as forecast points of one run per year."""
    series = daily_series(sales(spark, sf_dir, False), products(spark, sf_dir), stores(spark, sf_dir))
    y = F.col("y").cast("decimal(14,4)")
    width = (1 + F.dayofmonth("ds")).cast("decimal(4,2)") / 100
    return series.select(
        F.date_sub(F.trunc("ds", "year"), 1).alias("run_date"),
        "category",
        "region",
        F.col("ds").alias("target_date"),
        y.alias("predicted_revenue"),
        (y * (1 - width)).cast("decimal(14,4)").alias("yhat_lower"),
        (y * (1 + width)).cast("decimal(14,4)").alias("yhat_upper"),
        F.lit("piecewise-v1").alias("model_version"),
    )


def target_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys an earlier load has landed: the lines of finished orders, each key once."""
    return stored(spark, sf_dir, "target", lambda: _target_keys(spark, sf_dir))


def _target_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem")
    # keys are made distinct as numbers, by the side they were joined on, before they are texts
    kept = lines.join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")
    return kept.distinct().select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"))
