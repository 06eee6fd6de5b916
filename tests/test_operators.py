"""Small hand-made frames for cleaning, gate, marts, series and history."""

import random
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F, types as T

from tallyhouse.functions.rules import register_rule, violates
from tallyhouse.operators import audit, calendars as cal, cleaning as cl, quality as dq, sales as sl, scd, series as sr
from tallyhouse.operators import forecast as fc, inventory as inv, keys
from tallyhouse.operators.layers import (
    insert_ignore_rows, sink_csv, sink_curated_overwrite, sink_forecast_replace,
)
from tallyhouse.plans import context
from tallyhouse.sources import grids
from tallyhouse.specs import FILE, ROW, SALES, SHEET

GRID = f"{FILE} string, {SHEET} string, {ROW} long"


def feed(spark, cols, rows, sheet="S"):
    return spark.createDataFrame([("f.xlsx", sheet, i, *r) for i, r in enumerate(rows)], f"{GRID}, {cols}")


def values(df, *cols):
    return [tuple(r) for r in df.orderBy(ROW).select(*cols).collect()]


# ---- cleaning


def test_currency_text_turns_numeric_and_ids_stay(spark):
    df = feed(spark, "amount string, store_id string", [("$1,234.56", "S01"), ("€2,000.00", "S02"), ("3500", "S03")])
    out = cl.coerce_numeric_vote(df)
    assert values(out, "amount", "store_id") == [(1234.56, "S01"), (2000.0, "S02"), (3500.0, "S03")]


def test_numeric_vote_needs_half(spark):
    df = feed(spark, "a string, b string", [("1", "1"), ("x", "x"), (None, "y")])
    out = cl.coerce_numeric_vote(df)
    assert values(out, "a", "b") == [(1.0, "1"), (None, "x"), (None, "y")]


def test_java_number_forms_are_text(spark):
    df = feed(spark, "a string", [("1d",), ("2f",), ("Infinity",), ("0x10",), (" 1e3 ",), ("-.5",)])
    assert values(df.withColumn("a", cl.to_number(F.col("a"))), "a") == [(None,)] * 4 + [(1000.0,), (-0.5,)]


def test_trim_takes_all_white_space(spark):
    df = feed(spark, "n string", [("  Alice  ",), ("Bob\t\n",), (" Eve　",)])
    assert values(cl.trim_strings(df), "n") == [("Alice",), ("Bob",), ("Eve",)]


def test_markers_match_exactly_and_before_trimming(spark):
    df = feed(spark, "amount string, store string", [("100", "S01"), ("NULL", "NA"), ("N/A", "S03"), (" NA ", "")])
    out = cl.trim_strings(cl.null_markers(df))
    assert values(out, "amount", "store") == [("100", "S01"), (None, None), (None, "S03"), ("NA", None)]


def test_all_null_rows_go(spark):
    df = feed(spark, "a string, b string", [("1", "x"), ("NULL", "N/A"), (None, "y")])
    assert values(cl.clean_text(df), "a", "b") == [("1", "x"), (None, "y")]


def test_date_columns_by_name_and_vote(spark):
    df = feed(spark, "transaction_date string, ts string",
              [("2024-01-01", "x"), ("2024-06-15", "y"), ("03/04/2024", "z")])
    out = cl.parse_dates_vote(df)
    assert values(out, "transaction_date", "ts") == [
        (datetime(2024, 1, 1), "x"), (datetime(2024, 6, 15), "y"), (None, "z")]


def test_date_vote_without_winner_parses_each_value(spark):
    rows = [("2024-01-01",), ("01/02/2024",), ("3-Jan-2024",)]
    out = cl.parse_dates_vote(feed(spark, "sold_at string", rows))
    assert values(out, "sold_at") == [(datetime(2024, 1, i),) for i in (1, 2, 3)]


@pytest.mark.parametrize("text, day", [
    ("2024-07-08 09:05:01", datetime(2024, 7, 8, 9, 5, 1)), ("2024-07-08T09:05:01", datetime(2024, 7, 8, 9, 5, 1)),
    ("7/8/2024 9:05", datetime(2024, 7, 8, 9, 5)), ("08-Jul-2024 09:05", datetime(2024, 7, 8, 9, 5)),
    ("2024/07/08 09:05:01", datetime(2024, 7, 8, 9, 5, 1)), ("2024-13-40", None), ("08/07/24", None), ("", None)])
def test_each_date_format(spark, text, day):
    assert values(cl.parse_dates_coalesce(feed(spark, "d string", [(text,)]), ["d"]), "d") == [(day,)]


def test_mapping_drops_unmapped_and_keeps_map_order(spark):
    df = feed(spark, "Units string, note string, ORDER_ID string", [("2", "n", "O1")])
    out = cl.map_columns(df, {"order_id": "transaction_id", "units": "quantity", "gone": "revenue"})
    assert out.columns == ["transaction_id", "quantity"]
    assert out.first()[:] == ("O1", "2")


# ---- gate




def test_gate_order_loses_a_key_whose_first_row_is_bad(spark):
    rows = [("K", "-1"), ("K", "5"), ("A", "1"), ("A", "1"), (None, "2"), (None, "3"), ("B", "x")]
    tagged = dq.dq_gate(feed(spark, "id string, qty string", rows), ["id"], {"qty": "positive_numeric", "no": "numeric", "id": "odd"})
    assert values(tagged, "_dq_issue") == [
        ("DATATYPE_VIOLATION",), ("PK_DUPLICATE",), (None,), ("DUPLICATE_ROW",), (None,), ("PK_DUPLICATE",),
        ("DATATYPE_VIOLATION",)]
    details = dict(enumerate(v[0] for v in values(tagged, "_dq_detail")))
    assert details[1] == "duplicate value in 'id': K" and details[5] == "duplicate value in 'id': <NA>"
    assert details[6] == "qty(positive_numeric)"


def test_gate_is_per_sheet_and_skips_a_missing_key(spark):
    two = feed(spark, "id string", [("A",)]).unionByName(feed(spark, "id string", [("A",)], sheet="T"))
    assert dq.rejected_rows(dq.dq_gate(two, ["id"], {})).count() == 0
    assert dq.rejected_rows(dq.dq_gate(two, ["nope"], {})).count() == 0


def test_new_rule(spark):
    register_rule("short", lambda c: F.length(c) > 2)
    df = feed(spark, "a string", [("abc",), ("ab",)])
    assert values(df.withColumn("bad", violates("short", F.col("a"))), "bad") == [(True,), (False,)]


def brute_gate(rows, key, positive):
    seen, keys_seen, out = set(), set(), []
    for r in rows:
        if r in seen:
            out.append("DUPLICATE_ROW")
            continue
        seen.add(r)
        if r[key] in keys_seen:
            out.append("PK_DUPLICATE")
            continue
        keys_seen.add(r[key])
        try:
            bad = r[positive] is not None and float(r[positive]) <= 0
        except ValueError:
            bad = True
        out.append("DATATYPE_VIOLATION" if bad else None)
    return out


def test_gate_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["HOT"] * 10 + [None] * 5 + [f"K{i}" for i in range(15)]),
             rng.choice(["1", "0", "x", None, "2", "3"])) for _ in range(3000)]
    tagged = dq.dq_gate(feed(spark, "id string, qty string", rows), ["id"], {"qty": "positive_numeric"})
    assert [v[0] for v in values(tagged, "_dq_issue")] == brute_gate(rows, 0, 1)
    assert dq.clean_rows(tagged).count() + dq.rejected_rows(tagged).count() == len(rows)


# ---- keep-first and insert-ignore


def test_first_per_key_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["HOT"] * 8 + [None, "a", "b", "c"]), rng.random()) for _ in range(2000)]
    out = keys.first_per_key(feed(spark, "k string, v double", rows).repartition(7), ["k"], ROW)
    want = {}
    for k, v in rows:
        want.setdefault(k, v)
    assert {r["k"]: r["v"] for r in out.collect()} == want


def test_insert_ignore_keeps_existing_keys(spark):
    batch = feed(spark, "id string, v string", [("A", "new"), ("B", "1"), ("B", "2")])
    target = spark.createDataFrame([("A",)], "id string")
    out = insert_ignore_rows(batch, target, ["id"])
    assert [(r["id"], r["v"]) for r in out.collect()] == [("B", "1")]


def test_overwrite_twice_and_csv_append(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())])
    df = feed(spark, "id string, value string", [("1", "a"), ("2", "b"), ("3", "c")])
    for _ in range(2):
        sink_curated_overwrite(df, f"{tmp_path}/t", schema)
        assert spark.read.parquet(f"{tmp_path}/t").count() == 3
        sink_csv(df.select("id", "value"), f"{tmp_path}/c")
    sink_csv(df.select("value"), f"{tmp_path}/c", "append")
    back = spark.read.csv(f"{tmp_path}/c", header=True)
    assert back.columns == ["id", "value"] and back.count() == 6


# ---- marts


def star(spark):
    sales = spark.createDataFrame(
        [("T1", datetime(2024, 1, 1, 9), "S01", "SKU01", D(2), D(10), D(20), "USD", "POS", "a.xlsx"),
         ("T2", datetime(2024, 1, 2, 9), "S01", "SKU02", D(3), D(20), D(60), "USD", "POS", "a.xlsx"),
         ("T3", datetime(2024, 1, 3, 9), "S02", "SKU01", D(1), D(10), D(10), "USD", "POS", "a.xlsx"),
         ("T4", datetime(2024, 1, 3, 23, 59), "S02", "SKU02", D(4), D(20), None, "USD", "ONLINE", "b.xlsx")], SALES)
    products = spark.createDataFrame([("SKU01", "Beverages", "B1", 0), ("SKU02", "Snacks", "B2", 1)],
                                     f"sku string, category string, brand string, {ROW} long")
    stores = spark.createDataFrame([("S01", "NORTHEAST", 0), ("S02", "SOUTHEAST", 1)], f"store_id string, region string, {ROW} long")
    return sales, products, stores


def test_star_schema_revenue(spark):
    enriched = sl.sales_enriched(*star(spark))
    got = {(r["section"], r["name"]): r["revenue"] for r in sl.revenue_kpis(enriched).collect()}
    assert got == {("total", "ALL"): D("170.00"), ("category", "Beverages"): D("30.00"), ("category", "Snacks"): D("140.00"),
                   ("region", "NORTHEAST"): D("80.00"), ("region", "SOUTHEAST"): D("90.00")}
    head = sl.kpi_headline(enriched).first()
    assert head[:] == (D("170.00"), 4, "Snacks", "SOUTHEAST")


def test_no_sales_gives_zero_and_na(spark):
    sales, products, stores = star(spark)
    head = sl.kpi_headline(sl.sales_enriched(sales.limit(0), products, stores)).first()
    assert head[:] == (D("0.00"), 0, "N/A", "N/A")


def test_total_counts_unplaced_rows(spark):
    sales, products, stores = star(spark)
    enriched = sl.sales_enriched(sales, products.filter("sku = 'SKU01'"), stores)
    got = {(r["section"], r["name"]): r["revenue"] for r in sl.revenue_kpis(enriched).collect()}
    assert got[("total", "ALL")] == D("170.00") and ("category", "Snacks") not in got
    share = sl.revenue_share(enriched, "category").first()
    assert share["share"] == 30 / 170


def test_date_range_includes_the_whole_last_day(spark):
    sales, products, stores = star(spark)
    day = sl.sales_enriched(sales, products, stores, date(2024, 1, 2), date(2024, 1, 3))
    assert day.count() == 3


def test_growth_drops_zero_base_and_needs_two_months(spark):
    rows = [(date(2024, 1, 5), "A", "R", D(0)), (date(2024, 1, 5), "B", "R", D(10)), (date(2024, 2, 5), "A", "R", D(5)),
            (date(2024, 2, 5), "B", "R", D(15)), (date(2024, 2, 5), "C", "R", D(1))]
    df = spark.createDataFrame(rows, "ds date, category string, region string, revenue decimal(18,4)")
    assert [(r["category"], r["growth"]) for r in sl.category_mom_growth(df).collect()] == [("B", 0.5)]
    assert sl.category_mom_growth(df.filter("ds > '2024-02-01'")).count() == 0


def test_cube_answers_like_the_sales(spark):
    enriched = sl.sales_enriched(*star(spark))
    cube = sl.revenue_cube(enriched)
    for f in (sl.revenue_kpis, sl.data_span, sl.category_month_revenue, sl.monthly_revenue):
        assert sorted(map(str, f(cube).collect())) == sorted(map(str, f(enriched).collect()))


def test_insights_text(spark):
    lines = [r["text"] for r in context.insights_summary(sl.revenue_cube(sl.sales_enriched(*star(spark)))).collect()]
    assert "Total revenue: $170.00" in lines and "Leading category 'Snacks' accounts for 82.4% of total revenue." in lines


def test_page_bounds(spark):
    df = spark.range(5)
    assert [r[:] for r in inv.page_rows(df, [F.asc("id")], 2, 3).collect()] == [(3, 5), (4, 5)]
    with pytest.raises(ValueError):
        inv.page_rows(df, [F.asc("id")], 1001)


# ---- series and calendars


def test_series_join_derives_and_drops(spark):
    sales, products, stores = star(spark)
    series = sr.daily_series(sales.withColumn("store_id", F.when(F.col("transaction_id") == "T1", "S99").otherwise(F.col("store_id"))),
                             products, stores)
    got = {(r["ds"], r["category"]): r["y"] for r in series.collect()}
    assert got == {(date(2024, 1, 2), "Snacks"): D("60.00"), (date(2024, 1, 3), "Beverages"): D("10.00"),
                   (date(2024, 1, 3), "Snacks"): D("80.00")}


def test_holidays(spark):
    cal_rows = [(date(2024, 7, 4), "True", " Fourth "), (date(2024, 7, 5), "false", "x"), (date(2024, 12, 25), " TRUE ", None)]
    df = spark.createDataFrame(cal_rows, "calendar_date date, is_holiday string, holiday_name string")
    got = [r[:] for r in cal.holiday_calendar(df).orderBy("ds").collect()]
    assert got == [("Fourth", date(2024, 7, 4), 0, 1), ("US_Holiday", date(2024, 12, 25), 0, 1)]
    none = cal.holiday_calendar(df.filter("is_holiday = 'false'"))
    assert none.count() == 0 and none.columns == ["holiday", "ds", "lower_window", "upper_window"]


def test_promo_days_against_brute_force(spark):
    rng = random.Random(5)
    spine = [("Snacks", "West", date.fromordinal(738000 + i)) for i in range(60)]
    wins = [("P", rng.choice([" snacks", "SNACKS ", "Other"]), rng.choice(["WEST", "west "]),
             rng.choice([None, date.fromordinal(737990 + rng.randrange(60))]), rng.choice([None, date.fromordinal(738000 + rng.randrange(80)), date(9999, 12, 31)]),
             rng.choice([None, D(rng.randrange(-5, 30))])) for _ in range(40)]
    s = spark.createDataFrame(spine, "category string, region string, ds date")
    w = spark.createDataFrame(wins, "promo_id string, category string, region string, start_date date, end_date date, discount_pct decimal(8,4)")
    got = {r["ds"]: float(r["promo_active"]) for r in cal.promo_calendar(s, w).collect()}
    for _, _, d in spine:
        hit = [float(p[5] or 0) / 100 for p in wins if p[1].strip().lower() == "snacks" and p[3] and p[4] and p[3] <= d <= p[4]]
        assert got[d] == pytest.approx(max([0.0, *hit]))


# ---- history


def test_scd2_closes_old_and_opens_new(spark):
    dim = spark.createDataFrame([("S1", "Beverages", "B", "1L", D("2.50"), date(2023, 1, 1))],
                                "sku string, category string, brand string, package_size string, list_price decimal(12,4), launch_date date")
    ups = spark.createDataFrame([("S1", "category", "Dairy", date(2024, 3, 2), 0), ("S1", "brand", "X", date(2024, 3, 2), 1),
                                 ("S1", "brand", "Y", date(2024, 3, 2), 2)],
                                f"sku string, attribute string, new_value string, effective_date date, {ROW} long")
    versions = scd.scd2_apply(dim, ups)
    got = [r[:] for r in versions.orderBy("valid_from").select("category", "brand", "package_size", "valid_from", "valid_to", "is_current").collect()]
    assert got == [("Beverages", "B", "1L", date(2023, 1, 1), date(2024, 3, 1), False),
                   ("Dairy", "Y", "1L", date(2024, 3, 2), None, True)]
    sales = spark.createDataFrame([("a", datetime(2024, 3, 1, 23), "S1"), ("b", datetime(2024, 3, 2), "S1"), ("c", datetime(2020, 1, 1), "S1"), ("d", datetime(2025, 1, 1), "S9")],
                                  "id string, transaction_ts timestamp_ntz, sku string")
    got = {r["id"]: r["category"] for r in scd.scd2_asof_lookup(sales, versions, ("category",)).collect()}
    assert got == {"a": "Beverages", "b": "Dairy", "c": None, "d": None}


# ---- audit


def test_quality_counts(spark):
    log = spark.createDataFrame([("NULL_REQUIRED", "REPAIRED")] * 2 + [("TYPE_MISMATCH", "REJECTED")], "issue_type string, action_taken string")
    batches = spark.createDataFrame([(1, "HISTORICAL", 9, 9, 0), (2, "INCREMENTAL", 50, 48, 2)],
                                    "load_batch_id int, load_type string, rows_in int, inserted int, repaired int")
    assert [r[:] for r in audit.quality_by_issue(log).collect()] == [("NULL_REQUIRED", 2), ("TYPE_MISMATCH", 1)]
    got = {(r["section"], r["name"]): r["n"] for r in audit.quality_summary(log, batches).collect()}
    assert got[("total_issues", "ALL")] == 3 and got[("total_batches", "ALL")] == 2
    assert got[("latest_batch", "rows_in")] == 50 and got[("latest_batch", "repaired")] == 2


# ---- forecast table


def points(spark, run, pairs, days, base=100, version="v1"):
    rows = [(run, c, r, date.fromordinal(date(2024, 7, 1).toordinal() + i), D(base + 5 * i), D(1), D(999), version)
            for c, r in pairs for i in range(days)]
    from tallyhouse.specs import FORECASTS
    return spark.createDataFrame(rows, FORECASTS)


def test_forecast_query(spark):
    df = points(spark, date(2024, 6, 30), [("A", "X")], 10)
    got = fc.forecast_points(df, "A", "X").collect()
    assert len(got) == 10 and got[0]["predicted_revenue"] == 100
    assert fc.forecast_points(df, "A", "nowhere").count() == 0


def test_unfiltered_limit_mixes_pairs_and_per_pair_does_not(spark):
    df = points(spark, date(2024, 6, 30), [("A", "X"), ("B", "Y")], 10)
    assert fc.forecast_points(df, horizon=6).count() == 6
    assert fc.forecast_points_per_pair(df, 6).count() == 12


def test_forecast_replace_touches_only_its_group(spark, tmp_path):
    path, run = f"{tmp_path}/f", date(2024, 6, 30)
    sink_forecast_replace(points(spark, run, [("A", "X"), ("B", "Y")], 5), path)
    sink_forecast_replace(points(spark, date(2024, 5, 31), [("A", "X")], 3), path)
    for _ in range(2):
        sink_forecast_replace(points(spark, run, [("A", "X")], 2, 500, "v2"), path)
    got = {(str(r["run_date"]), r["category"], r["model_version"]): r["n"] for r in
           spark.read.parquet(path).groupBy("run_date", "category", "model_version").agg(F.count("*").alias("n")).collect()}
    assert got == {("2024-06-30", "A", "v2"): 2, ("2024-06-30", "B", "v1"): 5, ("2024-05-31", "A", "v1"): 3}


def test_unknown_keys_are_flagged_and_kept(spark):
    sales, products, _ = star(spark)
    out = sl.unknown_key_flag(sales.withColumn("sku", F.when(F.col("transaction_id") == "T4", "SKU999").otherwise(F.col("sku"))), products, "sku")
    assert [(r["transaction_id"], r["action"]) for r in out.collect()] == [("T4", "FLAGGED")]


def test_late_rows_keep_their_flag(spark):
    df = spark.createDataFrame([(datetime(2022, 1, 15),), (datetime(2022, 2, 1),), (None,)], "transaction_ts timestamp_ntz")
    out = sl.late_arriving_flag(df, F.lit(datetime(2022, 2, 1)).cast("timestamp_ntz"))
    assert [r["is_late_arriving"] for r in out.collect()] == [True, False, False]


def test_repairs(spark):
    df = spark.createDataFrame([(None, D(4), D(10)), (D(5), D(2), None), (None, D(0), D(3)), (None, None, None)],
                               "unit_price decimal(12,4), quantity decimal(12,4), revenue decimal(14,4)")
    got = [r[:] for r in sl.repair_price(df).select("unit_price", "price_action").collect()]
    assert got == [(D("2.5"), "REPAIRED"), (D(5), None), (None, None), (None, None)]
    got = [r[:] for r in sl.repair_amount(df).select("revenue", "amount_action").collect()]
    assert got == [(D(10), None), (D(10), "REPAIRED"), (D(3), None), (None, None)]


def test_empty_growth_says_so(spark):
    rows = [(date(2024, 1, 5), "A", "R", D(7), 1)]
    cube = spark.createDataFrame(rows, "ds date, category string, region string, revenue decimal(18,4), n long")
    log = spark.createDataFrame([("X",)], "issue_type string")
    out = context.bounded_context(cube, log, log.limit(0), points(spark, date(2024, 6, 30), [("A", "X")], 2))
    got = {(r["section"], r["line_no"]): r["text"] for r in out.collect()}
    assert got[(5, 1)] == "N/A" and got[(6, 2)] == "Total ingestion batches: 0"
    assert got[(1, 1)] == "Date range : 2024-01-05 to 2024-01-05"


def test_sheet_that_starts_below_the_scan_keeps_its_rows(spark):
    rows = [("f", "late", 20 + i, ["a", str(i)]) for i in range(3)]
    rows += [("f", "twice", 0, ["id", "note", "note"]), ("f", "twice", 1, ["1", "x", "y"])]
    grid = spark.createDataFrame(rows, f"{FILE} string, {SHEET} string, {ROW} long, cells array<string>")
    assert grids.drop_ghost_sheets(grid).count() == 5
    late = grids.grid_to_table(grid.filter(F.col(SHEET) == "late"))
    assert sorted(r["_col1"] for r in late.collect()) == ["0", "1", "2"]
    twice = grids.grid_to_table(grid.filter(F.col(SHEET) == "twice")).first()
    assert (twice["id"], twice["note"], twice["note_col2"]) == ("1", "x", "y")


def test_rows_without_a_file_are_not_copies(spark):
    rows = [(None, None, 0, "a", "1"), (None, None, 1, "b", "2"), (None, None, 2, "b", "2")]
    df = spark.createDataFrame(rows, f"{FILE} string, {SHEET} string, {ROW} long, k string, v string")
    assert [r[ROW] for r in dq.dq_duplicate_rows(df).collect()] == [2]
    assert dq.dq_pk_duplicates(df, ["k"]).count() == 0


def test_currency_without_a_rate_is_flagged(spark):
    df = spark.createDataFrame([("JPY", 1000.0), ("USD", 2.0), ("EUR", 1.0), (None, 1.0)], "currency string, revenue double")
    rates = spark.createDataFrame([("EUR", 1.5)], "currency string, rate double")
    got = {r.currency: (r.revenue_usd and float(r.revenue_usd), r.currency_action) for r in sl.currency_normalize(df, rates).collect()}
    assert got == {"JPY": (None, "FLAGGED"), "USD": (2.0, None), "EUR": (1.5, None), None: (None, "FLAGGED")}


def test_unknown_keys_of_several_dimensions(spark):
    rows = [(1, "a", 10), (2, "zz", 10), (3, None, 99), (4, "zz", None), (5, "a", 99), (5, "a", 99)]
    rows = spark.createDataFrame(rows + [(k, "hot", 10) for k in range(6, 400)], "id int, store string, item int")
    stores = spark.createDataFrame([("a", 0), ("a", 1), (None, 2), ("99", 3)], "store string, flag int")
    items = spark.createDataFrame([("10",), ("10",)], "code string")
    out = audit.unknown_keys(rows, {"no_store": ("store", stores, "store"), "no_item": ("item", items, "code")})
    assert out.columns == ["id", "store", "item", "no_store", "no_item"] and out.count() == rows.count()
    got = {r["id"]: (r["no_store"], r["no_item"]) for r in out.collect()}
    assert [got[k] for k in range(1, 6)] == [(False, False), (True, False), (False, True), (True, False), (False, True)]
    assert all(got[k] == (True, False) for k in range(6, 400))
    none = audit.unknown_keys(rows.limit(0), {"no_store": ("store", stores, "store")})
    assert none.count() == 0 and none.columns[-1] == "no_store"
