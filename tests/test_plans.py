"""Physical plans: what must hold when the tables are large."""

import re
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tallyhouse import testbed as t
from tallyhouse.operators import keys, layers as ly, quality as dq, sales as sl, scd
from tallyhouse.plans.catalogue import END, QUERIES, START
from tallyhouse.session import materialize
from tallyhouse.specs import ROW


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {n for n in QUERIES if n.startswith("stream_")}))
def test_no_query_crosses_tables(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_revenue_reads_few_columns_and_pushes_the_dates(spark):
    text = plan(QUERIES["revenue_kpis"](spark, SF))
    scan = next(line for line in text.split("\n") if "lineitem" in line)
    assert "l_tax" not in scan and "l_linenumber" not in scan and "l_returnflag" not in scan


def test_date_filter_reaches_a_stored_fact(spark, tmp_path):
    t.sales(spark, SF).write.parquet(f"{tmp_path}/s")
    df = sl.date_range_filter(spark.read.parquet(f"{tmp_path}/s"), START, END)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(transaction_ts,.*LessThan", plan(df))


def test_facts_are_not_shuffled_for_a_breakdown(spark):
    """Between the fact scan and the first exchange stands a partial aggregate."""
    lines = plan(QUERIES["revenue_by_category"](spark, SF)).split("\n")
    fact = next(i for i, s in enumerate(lines) if "FileScan" in s and "lineitem" in s)
    above = [s for s in lines[:fact] if re.search(r"Exchange hashpartitioning|partial_sum", s)]
    assert "partial_sum" in above[-1]


def test_dimensions_beyond_the_threshold_are_merged(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(sl.sales_enriched(t.sales(spark, SF), t.products(spark, SF), t.stores(spark, SF)))
        assert "Broadcast" not in text and text.count("SortMergeJoin") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_gate_has_no_window_and_reads_its_input_once(spark):
    feed = t.pos_feed(spark, SF)
    tagged = dq.dq_gate(feed, ["transaction_id"], {"qty": "positive_numeric"})
    assert "Window" not in plan(tagged)
    tagged.collect()
    final = plan(tagged).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_keep_first_combines_before_the_shuffle(spark):
    text = plan(keys.first_per_key(t.sales(spark, SF), ["transaction_id"], ROW))
    assert "partial_min_by" in text and "Window" not in text


def test_top_products_take_before_the_join(spark):
    text = plan(QUERIES["top_products"](spark, SF))
    assert "TakeOrderedAndProject" in text
    assert text.index("Join") < text.rindex("TakeOrderedAndProject")


def test_antijoin_cuts_the_target_to_the_batch_first(spark):
    batch, target = spark.range(10).withColumnRenamed("id", "k"), spark.range(1000).withColumnRenamed("id", "k")
    text = plan(keys.antijoin(batch, target, ["k"]))
    assert "LeftSemi" in text and "LeftAnti" in text


def test_forecast_groups_are_days_not_sales(spark):
    """What reaches the Python workers is one row per pair and day."""
    text = plan(QUERIES["fit_forecast"](spark, SF))
    assert text.index("FlatMapGroupsInPandas") < text.index("series-")
    rows = QUERIES["training_frame"](spark, SF).groupBy("category", "region", "ds").count()
    assert rows.agg(F.max("count")).first()[0] == 1


def test_insert_ignore_reads_the_buckets_of_the_batch(spark, tmp_path):
    """The target's scan lists them as partition filters, and none but its key column."""
    schema = spark.range(1).selectExpr("CAST(id AS STRING) AS k", "id AS v").schema
    rows = lambda a, b: spark.range(a, b).selectExpr("CAST(id AS STRING) AS k", "id AS v", "id AS n")
    path = f"{tmp_path}/t"
    ly.sink_curated_insert_ignore(rows(0, 2000), path, schema, ["k"], 1, order="n")
    target = ly.read_or_empty(spark, path, schema)
    assert keys.bucket_column(target) == "_key_of_64"
    batch = materialize(spark, rows(1998, 2002), "batch")
    fresh = keys.antijoin(batch, target, ["k"])
    wanted = keys.touched(keys.with_bucket(batch, ["k"], "_key_of_64"), "_key_of_64")
    scan = next(line for line in plan(fresh).split("\n") if f"{tmp_path}" in line and "PartitionFilters" in line)
    listed = re.search(r"_key_of_64#\d+ IN \(([\d,]+)\)", scan) or re.search(r"_key_of_64#\d+ INSET ([\d, ]+)", scan)
    assert sorted(map(int, listed.group(1).split(","))) == wanted and len(wanted) <= 4
    assert "ReadSchema: struct<k:string>" in scan
    assert {r.k for r in fresh.collect()} == {"2000", "2001"}
    for _ in range(2):
        ly.sink_curated_insert_ignore(rows(1998, 2002), path, schema, ["k"], 2, order="n")
    assert spark.read.parquet(path).count() == 2002


def test_history_merge_leaves_other_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/history"
    dim = spark.range(300).selectExpr("CAST(id AS STRING) AS sku", "DATE'2023-01-01' AS launch_date", "'c' AS category", "'b' AS brand", "'p' AS package_size", "'1' AS list_price")
    kinds = f"sku string, attribute string, new_value string, effective_date string, {ROW} long"
    batch = lambda rows: spark.createDataFrame(rows, kinds).withColumn("effective_date", F.to_date("effective_date"))
    one = batch([("7", "brand", "x", "2024-03-02", 0), ("7", "brand", "y", "2024-03-02", 1), ("9", "category", "k", "2024-05-01", 2)])
    two = batch([("7", "list_price", "2", "2024-02-01", 3), ("7", "brand", "z", "2024-06-01", 4), ("400", "brand", "n", "2024-01-01", 5)])
    scd.scd2_create(dim, path)
    files = lambda: {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}
    before = files()
    for updates in (one, two, two):
        scd.scd2_merge(spark, path, updates)
    assert order(scd.scd2_read(spark, path)) == order(scd.scd2_apply(dim, one.unionByName(two)))
    changed = {f.split("/")[0] for f in before ^ files()}
    skus = spark.createDataFrame([("7",), ("9",), ("400",)], "sku string")
    assert changed == {f"_key_of_64={n}" for n in keys.touched(keys.with_bucket(skus, ["sku"], "_key_of_64"), "_key_of_64")}


def order(df):
    return sorted(map(str, df.collect()))
