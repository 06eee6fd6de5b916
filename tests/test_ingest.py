"""Workbooks through all layers, replays, and the streaming path."""

from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans.catalogue import DROP, EVENT_SPEC
from tallyhouse.operators.quality import dq_gate
from tallyhouse.plans import ingest
from tallyhouse.plans.ingest import run_ingest
from tallyhouse.sources import workbooks as wb
from tallyhouse.sources.files import discover_files
from tallyhouse.sources.grids import drop_ghost_sheets, grid_to_table
from tallyhouse.sources.tables import scan_curated
from tallyhouse.specs import FEEDS, FeedSpec
from tallyhouse.streaming.incremental import read_drops, stream_incremental_ingest, stream_late_flag
from tallyhouse.testbed import workbook

POS = [["transaction_id", "ts", "store_id", "sku", "qty", "unit_price", "amount", "currency"],
       ["T1", "2024-07-01 09:00:00", "S01", " SKU1 ", "2", "$10.00", "20", "USD"],
       ["T2", "07/02/2024 10:30", "S01", "SKU2", "0", "5", "0", "USD"],
       ["T3", "2024-07-03 09:00:00", "S02", "SKU1", "3", "N/A", "€1,030.50", "EUR"],
       ["T3", "2024-07-03 09:00:00", "S02", "SKU1", "4", "1", "4", "USD"],
       ["T1", "2024-07-01 09:00:00", "S01", " SKU1 ", "2", "$10.00", "20", "USD"]]
ONLINE = [["ORDER_ID", "order_datetime ", "location_id", "product_sku", "units", "price_per_unit", "currency"],
          ["O1", "2024-07-01 11:00:00", "S02", "SKU2", "2", "7.5", "USD"],
          ["T1", "2024-07-09 11:00:00", "S02", "SKU2", "9", "9", "USD"]]
UPDATES = [["sku", "attribute", "old_value", "new_value", "effective_date", "change_reason"],
           ["SKU1", "list_price", "8.99", "9.49", "2024-07-08", "r"],
           ["SKU1", "package_size", "1kg", "1.2kg", "2024-07-08", "r"]]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("drop")
    (root / "incremental").mkdir()
    (root / "incremental/week1.xlsx").write_bytes(
        workbook({"Sales": [["Week 1"], *POS], "orders": ONLINE, "product_updates": UPDATES, "Notes": []}))
    out = str(tmp_path_factory.mktemp("lake"))
    audit = {r["feed"]: r for r in run_ingest(spark, str(root), out, FEEDS, "incremental", 1).collect()}
    return str(root), out, audit


def curated(spark, out, table="sales_transactions"):
    return spark.read.parquet(f"{out}/curated/{table}")


def test_curated_rows(spark, loaded):
    _, out, _ = loaded
    rows = {r["transaction_id"]: r for r in curated(spark, out).collect()}
    assert set(rows) == {"T1", "T3", "O1"}
    t1 = rows["T1"]
    assert (t1["sku"], t1["quantity"], t1["unit_price"], t1["revenue"]) == ("SKU1", D(2), D(10), D(20))
    assert (t1["source_system"], t1["source_file"], t1["transaction_ts"]) == ("POS", "week1.xlsx", datetime(2024, 7, 1, 9))
    assert rows["T3"]["revenue"] == D("1030.5") and rows["T3"]["unit_price"] is None
    assert rows["O1"]["revenue"] is None and rows["O1"]["source_system"] == "ONLINE"


def test_errors_carry_the_whole_row(spark, loaded):
    _, out, _ = loaded
    rows = spark.read.parquet(f"{out}/error/dq_rejected_rows").collect()
    assert sorted(r["dq_issue"] for r in rows) == ["DATATYPE_VIOLATION", "DUPLICATE_ROW", "PK_DUPLICATE"]
    bad = next(r for r in rows if r["dq_issue"] == "DATATYPE_VIOLATION")
    assert '"transaction_id":"T2"' in bad["row_data"] and bad["_load_batch_id"] == 1
    reports = spark.read.csv(f"{out}/reports", header=True)
    assert reports.count() == 3


def test_raw_layer_keeps_the_texts(spark, loaded):
    _, out, _ = loaded
    raw = spark.read.parquet(f"{out}/raw/pos_batch")
    assert raw.count() == 5
    assert {r["amount"] for r in raw.collect()} >= {"€1,030.50", "0"} and " SKU1 " in {r["sku"] for r in raw.collect()}


def test_audit_counts(loaded):
    audit = loaded[2]
    assert (audit["pos_batch"]["rows_in"], audit["pos_batch"]["rejected"], audit["pos_batch"]["attempted"]) == (5, 3, 2)
    assert (audit["online_batch"]["rows_in"], audit["online_batch"]["rejected"]) == (2, 0)
    assert audit["product_updates"]["attempted"] == 2


def test_replay_changes_nothing(spark, loaded):
    root, out, _ = loaded
    before = sorted(map(str, curated(spark, out).drop("_load_batch_id", "_ingested_at").collect()))
    run_ingest(spark, root, out, FEEDS, "incremental", 2)
    assert sorted(map(str, curated(spark, out).drop("_load_batch_id", "_ingested_at").collect())) == before
    assert curated(spark, out, "product_updates").count() == 2


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "incremental").mkdir(parents=True)
    (root / "incremental/week1.xlsx").write_bytes(workbook({"Sales": POS, "orders": ONLINE}))
    first = run_ingest(spark, str(root), out, FEEDS, "incremental", 5).collect()
    layers = lambda: {
        "raw": spark.read.parquet(f"{out}/raw/pos_batch").count(), "error": spark.read.parquet(f"{out}/error/dq_rejected_rows").count(),
        "csv": spark.read.csv(f"{out}/csv/sales_transactions", header=True).count(), "curated": curated(spark, out).count(),
        "reports": spark.read.csv(f"{out}/reports", header=True).count(), "audit": ingest.committed(spark, out).count(),
    }
    before = layers()
    assert before == {"raw": 5, "error": 3, "csv": 4, "curated": 3, "reports": 3, "audit": 2}
    assert sorted(run_ingest(spark, str(root), out, FEEDS, "incremental", 5).collect()) == sorted(first)
    assert layers() == before
    by_feed = {r.feed: r for r in first}
    assert (by_feed["pos_batch"].inserted, by_feed["pos_batch"].repaired, by_feed["pos_batch"].flagged) == (2, 1, 1)
    assert (by_feed["online_batch"].attempted, by_feed["online_batch"].inserted) == (2, 1)


def test_a_broken_load_is_hidden_and_taken_up_again(spark, tmp_path, monkeypatch):
    landed = spark.createDataFrame([(*POS[i], "/a/x.parquet", "Sales", i) for i in range(1, 6)],
                                   "transaction_id string, ts string, store_id string, sku string, qty string, unit_price string, amount string, currency string, _source_file string, _sheet_name string, _row_idx long")
    spec, out = next(s for s in FEEDS if s.name == "pos_batch"), str(tmp_path / "out")

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "audit_feed", broken)
    with pytest.raises(RuntimeError, match="lost"):
        ingest.ingest_landed(spark, [(spec, landed)], out, 1)
    monkeypatch.undo()
    assert curated(spark, out).count() == 2 and ingest.visible(curated(spark, out), out).isEmpty()
    audit = ingest.ingest_landed(spark, [(spec, landed)], out, 1).collect()
    assert [(r.rows_in, r.attempted, r.inserted, r.rejected) for r in audit] == [(5, 2, 2, 3)]
    raw = spark.read.parquet(f"{out}/raw/pos_batch")
    assert raw.count() == 5 and ingest.visible(raw, out, "pos_batch").count() == 5
    assert {(r._source_file, r._source_path) for r in raw.collect()} == {("x.parquet", "/a/x.parquet")}
    assert ingest.visible(curated(spark, out), out).count() == 2
    assert spark.read.parquet(f"{out}/error/dq_rejected_rows").count() == 3
    # without a number the next one
    assert [r.load_batch_id for r in ingest.ingest_landed(spark, [(spec, landed)], out).collect()] == [2]


def test_files_of_one_name_are_two_files(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    for folder, n in (("a", 1), ("b", 2)):
        (root / "incremental" / folder).mkdir(parents=True)
        body = [POS[0], [f"N{n}", *POS[1][1:]], ["BOTH", *POS[1][1:]]]
        (root / "incremental" / folder / "week.xlsx").write_bytes(workbook({"Sales": body}))
    grid = wb.scan_workbooks(spark, f"{root}/incremental/*")
    rows = grid_to_table(drop_ghost_sheets(grid), POS[0])
    assert rows.count() == 4
    tagged = dq_gate(rows, ["transaction_id"], {}).collect()
    assert len(tagged) == 4 and all(r._dq_issue is None and r._dq_source_file == "week.xlsx" for r in tagged)
    spec = next(s for s in FEEDS if s.name == "pos_batch")
    audit = ingest.ingest_landed(spark, [(spec, rows)], out, 1).first()
    assert (audit.rows_in, audit.attempted, audit.inserted) == (4, 4, 3)
    assert {r["transaction_id"] for r in curated(spark, out).collect()} == {"N1", "N2", "BOTH"}


def test_overwrite_replaces_only_its_channel(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "historical").mkdir(parents=True)
    (root / "historical/pos_history.xlsx").write_bytes(workbook({"S": POS}))
    (root / "historical/online_history.xlsx").write_bytes(workbook({"S": ONLINE[:2]}))
    run_ingest(spark, str(root), out, FEEDS, "historical", 1)
    (root / "historical/pos_history.xlsx").write_bytes(workbook({"S": POS[:2]}))
    run_ingest(spark, str(root), out, FEEDS, "historical", 2)
    assert {r["transaction_id"] for r in curated(spark, out).collect()} == {"T1", "O1"}
    csv = spark.read.csv(f"{out}/csv/sales_transactions", header=True)
    assert {r["transaction_id"] for r in csv.collect()} == {"T1", "O1"}


def test_vote_typing(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "incremental").mkdir(parents=True)
    body = [POS[0], *[[f"V{i}", "2024-07-01 09:00:00", "S01", "SKU1", "three" if i == 0 else "2", "5", "10", "USD"] for i in range(4)]]
    (root / "incremental/w.xlsx").write_bytes(workbook({"Sales": body}))
    run_ingest(spark, str(root), out, FEEDS, "incremental", 1, typing="vote")
    rows = {r["transaction_id"]: r["quantity"] for r in curated(spark, out).collect()}
    assert rows == {"V0": None, "V1": D(2), "V2": D(2), "V3": D(2)}


def test_discover_modes(spark, loaded):
    root = loaded[0]
    assert {r["feed"] for r in discover_files(spark, root, FEEDS, "incremental").collect()} == {"pos_batch", "online_batch", "product_updates"}
    assert discover_files(spark, root, FEEDS, "historical").count() == 0
    off = FeedSpec("x", "incremental", "*.xlsx", "t", FEEDS[0].schema, enabled=False)
    assert discover_files(spark, root, [off]).count() == 0


def test_scan_curated_refuses_empty_tables(spark):
    df = spark.range(3)
    assert scan_curated({"a": df}, {"a": ["id"]})["a"].columns == ["id"]
    with pytest.raises(RuntimeError, match="a"):
        scan_curated({"a": df.limit(0)}, {"a": ["id"]})


def test_stream_replay_and_rejects(spark, tmp_path):
    rows = [("1", "2024-01-01 00:00:00", "view", "7", "$2.50"), ("2", "2024-01-01 00:00:01", "view", "7", "-1"),
            ("1", "2024-01-02 00:00:00", "buy", "8", "3")]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame(rows[:2], DROP).coalesce(1).write.parquet(f"{src}/a")
    args = (spark, src, DROP, EVENT_SPEC, out)
    stream_incremental_ingest(*args, f"{out}/ck")
    spark.createDataFrame(rows[2:], DROP).coalesce(1).write.parquet(f"{src}/b")
    stream_incremental_ingest(*args, f"{out}/ck")
    stream_incremental_ingest(*args, f"{out}/ck2")
    got = curated(spark, out).collect()
    assert [(r["transaction_id"], r["revenue"], r["sku"]) for r in got] == [("1", D("2.5"), "view")]


def test_lateness_follows_from_the_stream_and_outlives_a_restart(spark, tmp_path):
    src, out = f"{tmp_path}/drops", f"{tmp_path}/out"
    drops = [
        [(1, "2024-01-10 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "9999-01-01 00:00:00")],  # nothing before: none late
        [(4, "2024-01-07 23:59:59"), (5, "2024-01-08 00:00:00"), (6, None), (7, "2024-01-20 00:00:00")],
        [(8, None)],  # no time: the bound stays
        [(9, "2024-01-17 00:00:00"), (10, "2024-01-19 00:00:00"), (11, "2024-02-01 00:00:00")],
    ]
    for k, drop in enumerate(drops):
        rows = spark.createDataFrame([(i, t, "x") for i, t in drop], "id int, ts string, batch_note string")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{src}/{k}")
        for _ in range(2):  # stopped and started again; the second time nothing is new
            stream_late_flag(read_drops(spark, src, rows.withColumn("ts", F.col("ts").cast("timestamp")).schema), "ts", timedelta(days=2), out)
    flagged = spark.read.parquet(f"{out}/rows")
    assert {r["id"] for r in flagged.where("is_late_arriving").collect()} == {4, 9}
    assert flagged.count() == 11 and flagged.where("is_late_arriving IS NULL").isEmpty()
