"""What the gate and the layers send and store, and that cheaper forms give the same rows."""

import uuid
from pathlib import Path

from conftest import SF
from pyspark.sql import functions as F

from tallyhouse import session, testbed as t
from tallyhouse.functions.columns import to_timestamp, to_timestamp_any
from tallyhouse.operators import keys as ks, layers as ly, quality as dq
from tallyhouse.operators.keys import with_digest
from tallyhouse.plans import catalogue, ingest
from tallyhouse.session import METHOD_LIMIT, compiled, materialize
from tallyhouse.specs import FILE, ROW, SHEET, TIMESTAMP_PATTERNS

ODD = [
    (None, "ab", 1.0), ("ab", None, 1.0), ("a", "b", 1.0), ("", "ab", 1.0), ("ab", "", 1.0), ("1:a", "b", 1.0),
    ("ab", "-", -0.0), ("ab", "-", 0.0), ("ab", None, float("nan")), ("ab", None, float("nan")), ("ab", "é", None),
    (None, None, None), (None, None, None), ("-", "-", None), ("1:-", None, None), ("ab", "é", None),
]


def test_a_digest_groups_like_the_columns_themselves(spark):
    rows = spark.createDataFrame(ODD, "a string, b string, x double").withColumn("l", F.array("a"))
    digested, keys = with_digest(rows, rows.columns, "_content")
    assert keys == ["_content", "l"]
    plain = [r.n for r in rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).collect()]
    short = digested.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in "ab"])).alias("k"))
    found = short.collect()
    assert sorted(r.n for r in found) == sorted(plain) and all(r.k == 1 for r in found)


def _feed(spark):
    cells = [("k1", "x"), ("k1", "x"), ("k1", "y"), (None, "x"), (None, "x"), (None, "z"), ("k2", None), ("k2", None), ("k2", "x")]
    rows = [(f"d/{f}.xlsx", "S", i, k, v) for f in "ab" for i, (k, v) in enumerate(cells)]
    return spark.createDataFrame(rows, f"{FILE} string, {SHEET} string, {ROW} long, id string, v string")


def test_the_checks_send_digests_and_the_rows_once(spark):
    feed = materialize(spark, _feed(spark), "feed")
    tagged = dq.dq_gate(feed, ["id"], {"v": "numeric"})
    text = tagged._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in text
    grouped = [line for line in text.split("\n") if "HashAggregate" in line]
    assert grouped and not any(", v#" in line.split("functions")[0] for line in grouped)
    issue = {(r[FILE], r[ROW]): r._dq_issue for r in tagged.collect()}
    want = [dq.DATATYPE, dq.DUPLICATE_ROW, dq.PK_DUPLICATE, dq.DATATYPE, dq.DUPLICATE_ROW, dq.PK_DUPLICATE, None, dq.DUPLICATE_ROW, dq.PK_DUPLICATE]
    assert issue == {(f"d/{f}.xlsx", i): w for f in "ab" for i, w in enumerate(want)}
    for issues, rows in ((dq.DUPLICATE_ROW, dq.dq_duplicate_rows(feed)), (dq.PK_DUPLICATE, dq.dq_pk_duplicates(feed, ["id"]))):
        assert {(r[FILE], r[ROW]) for r in rows.collect()} == {k for k, v in issue.items() if v == issues}
        assert rows.columns == [*feed.columns, *dq.DQ]


def test_layers_are_stored_small_and_read_back_whole(spark, tmp_path):
    tagged = materialize(spark, dq.dq_gate(_feed(spark), ["id"], {"v": "numeric"}), "gate")
    rejected = dq.rejected_rows(tagged)
    ly.sink_raw(_feed(spark), f"{tmp_path}/raw", ["id", "v"], 3)
    ly.sink_error(rejected, f"{tmp_path}/error", 3, "f")
    ly.dq_report_sink(rejected, f"{tmp_path}/reports", "20240101_000000")
    ly.sink_csv_batch(rejected.select("id", "v"), f"{tmp_path}/csv", "f", 3, False)
    names = [f.name for f in Path(tmp_path).rglob("part-*")]
    assert names and all(n.endswith((".zstd.parquet", ".csv.gz")) for n in names)
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 18
    assert spark.read.parquet(f"{tmp_path}/error").count() == 16
    for layer in ("reports", "csv"):
        assert spark.read.csv(f"{tmp_path}/{layer}", header=True).count() == 16


def test_the_usual_time_is_read_as_its_pattern_reads_it(spark):
    texts = [
        "2024-02-29 23:59:59", "2023-02-29 00:00:00", "2024-01-01 24:00:00", "2024-01-01 00:00:60", "0000-01-01 00:00:00",
        "0999-01-01 00:00:00", "1500-02-29 00:00:00", "2024-01-01 00:00:00\n", " 2024-01-01 00:00:00", "2024-1-1 0:0:0",
        "2024-01-01T00:00:00", "01/02/2024", "03-Feb-2024 10:11", "9999-12-31 23:59:59", "2024-13-01 00:00:00", "", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.coalesce(*[to_timestamp(F.col("t"), p) for p in TIMESTAMP_PATTERNS])
    found = rows.select("t", to_timestamp_any(F.col("t")).cast("string").alias("new"), old.cast("string").alias("old")).collect()
    assert [r.new for r in found] == [r.old for r in found] and found[0].new is not None


def test_a_silent_session_compiles_wide_projections(spark):
    other = spark.newSession()
    other.conf.unset(METHOD_LIMIT)
    compiled(other)
    assert other.conf.get(METHOD_LIMIT) == "8000"
    other.conf.set(METHOD_LIMIT, "4000")
    compiled(other)
    assert other.conf.get(METHOD_LIMIT) == "4000"


def test_copies_are_the_same_beside_a_key_and_share_its_exchange(spark):
    feed = materialize(spark, _feed(spark), "feed").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in dq.SCOPE})
    alone, beside = dq.dq_duplicate_rows(feed), dq.dq_duplicate_rows(feed, key=["id"])
    assert sorted(map(str, beside.collect())) == sorted(map(str, alone.collect())) and beside.count() == 6
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = dq.union_rejected(beside, dq.dq_pk_duplicates(feed, ["id"]))
        assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_insert_ignore_stores_keys_and_sends_rows_once(spark, tmp_path, monkeypatch):
    """Loads of few and of many rows give the same, with NULL, hot and repeated keys."""
    kinds = "k string, d int, n long, v string"
    rows = [(None if i % 3 == 0 else f"k{i % 50}", None if i % 7 == 0 else i % 4, i // 2, f"v{i}") for i in range(400)]
    one = spark.createDataFrame(rows[:150], kinds)
    two = spark.createDataFrame(rows, kinds).repartition(5)
    key, schema, stored = ["k", "d"], one.select("k", "d", "v").schema, []

    def keep(session, df, *args):
        stored.append(df.columns)
        return materialize(session, df, *args)

    monkeypatch.setattr(ly, "materialize", keep)
    want = {}
    for k, d, n, v in sorted(rows[:150], key=lambda r: r[2]) + sorted(rows, key=lambda r: r[2]):
        want.setdefault((k, d), n)
    number = {v: n for _, _, n, v in rows}
    for few, name in ((500_000, "few"), (0, "many")):
        monkeypatch.setattr(ly, "FEW", few)
        monkeypatch.setattr(ly, "PART", 10)
        for batch in (one, two, two):
            ly.sink_curated_insert_ignore(batch, f"{tmp_path}/{name}", schema, key, 1, order="n")
        found = spark.read.parquet(f"{tmp_path}/{name}").collect()
        assert {(r.k, r.d): number[r.v] for r in found} == want and len(found) == len(want)
        assert ly.insert_ignore_rows(two, spark.read.parquet(f"{tmp_path}/{name}"), key, "n").isEmpty()
    assert stored and all("v" not in columns for columns in stored)
    at = materialize(spark, spark.range(300).selectExpr("id AS n", "CAST(id % 9 AS STRING) AS k"), "at")
    wide = spark.range(300).selectExpr("CAST(id % 9 AS STRING) AS k", "id AS n", "id AS v").coalesce(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = ks.rows_at_in_parts(wide, at, ["k", "n"], ks.bucket(["k"], "_key_of_64"))
        texts = [df._jdf.queryExecution().executedPlan().toString() for df in (near, ks.rows_at(wide, at, ["k", "n"]))]
        assert [t.count("Exchange hashpartitioning") for t in texts] == [1, 2] and near.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_verdicts_of_the_log_hold_what_it_reads(spark):
    stored = catalogue._stored_tagged(spark, SF)
    assert stored.columns == catalogue.LOGGED and stored.count() > 6000
    tagged = catalogue._looked_up(spark, SF)
    assert catalogue._quality_log(tagged).count() > 0 and catalogue._batches(spark, SF, tagged).count() > 0


def test_a_long_table_is_not_spread(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id AS l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = t.table(spark, str(tmp_path), "lineitem")

    def text():
        return t._spread(spark, str(tmp_path), "lineitem", rows)._jdf.queryExecution().optimizedPlan().toString()

    assert "Rebalance" in text()
    monkeypatch.setattr(t, "SPREAD_BELOW", 1)
    assert "Rebalance" not in text()


def test_a_load_leaves_its_layers_and_no_scratch(spark, tmp_path, monkeypatch):
    """What one step hands to the next is emptied, and shuffle files go with their job."""
    monkeypatch.setattr(session, "scratch", lambda _, name: f"{tmp_path}/scratch/{name}-{uuid.uuid4().hex}")
    rows = _feed(spark).select(FILE, SHEET, ROW, F.col("id").alias("transaction_id"), F.lit("2024-01-01").alias("ts"), F.lit("1").alias("qty"))
    landed, seen, audit = materialize(spark, rows, "landed"), [], ingest.audit_feed

    def spy(tagged, *args):
        seen.append((tagged.count(), spark.conf.get(session.SHUFFLE_CLEANUP)))
        return audit(tagged, *args)

    monkeypatch.setattr(ingest, "audit_feed", spy)
    old = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    done = ingest.ingest_landed(spark, [(catalogue.POS_SPEC, landed)], f"{tmp_path}/lake", 1).first()
    assert (done.rows_in, done.attempted, done.inserted) == (18, 6, 3)
    assert seen == [(18, "true")] and spark.conf.get(session.SHUFFLE_CLEANUP, None) == old
    left = {p.name.rsplit("-", 1)[0]: spark.read.schema("_row_idx long").parquet(str(p)).count() for p in Path(f"{tmp_path}/scratch").iterdir()}
    assert left.pop("landed") == 18 and "gate-pos_batch" in left
    assert all(n == 0 for name, n in left.items() if name.startswith(("gate", "typed")))
    with session.stored(spark, landed, "kept") as kept:
        assert kept.count() == 18
    assert sum(f.stat().st_size for f in Path(f"{tmp_path}/scratch").rglob("kept-*/*.parquet")) < 5000


def test_a_load_cleans_its_rows_once(spark, tmp_path, monkeypatch):
    """The gate reads its rows twice: they are a stored table by then, emptied after it."""
    rows = _feed(spark).select(FILE, SHEET, ROW, F.col("id").alias("transaction_id"), F.lit(" 2024-01-01 ").alias("ts"), F.lit("$1").alias("qty"))
    plans, gate = [], ingest.dq_gate

    def spy(df, *args):
        plans.append((df.inputFiles(), df._jdf.queryExecution().optimizedPlan().toString()))
        return gate(df, *args)

    monkeypatch.setattr(ingest, "dq_gate", spy)
    with ingest.stored_verdicts(materialize(spark, rows, "landed"), catalogue.POS_SPEC) as tagged:
        assert sorted(map(str, tagged.collect())) == sorted(map(str, ingest.gate_feed(rows, catalogue.POS_SPEC).collect()))
    ((files, text), _) = plans
    assert files and all("/typed-pos_batch-" in f for f in files) and "trim" not in text
    assert not any(Path(f.removeprefix("file:")).exists() for f in files)


def test_clustered_loads_send_their_rows_once_to_few_sorted_files(spark, tmp_path, monkeypatch):
    """A load of fresh rows and one of fresh and known ones, with NULL, hot and repeated keys."""
    kinds, path = "k string, at int, n long, ch string", f"{tmp_path}/t"
    one = spark.createDataFrame([(None if i == 0 else f"k{i}", -i, i, "A" if i % 3 else "B") for i in range(400)], kinds).repartition(7)
    two = spark.createDataFrame([(None if i % 5 == 0 else f"k{i % 900}", i % 50, i, "B") for i in range(1200)], kinds).repartition(7)
    schema, layout, saved, save = one.drop("n").schema, {"by": ["ch"], "cluster": ["at", "k"]}, [], ly.save_rows

    def spy(df, *args, **kwargs):
        saved.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, *args, **kwargs)

    monkeypatch.setattr(ly, "save_rows", spy)
    monkeypatch.setattr(ly, "FEW", 100)
    monkeypatch.setattr(ly, "PART", 1000)
    for number, batch in ((1, one), (2, two), (3, two)):
        ly.sink_curated_insert_ignore(materialize(spark, batch, "batch"), path, schema, ["k"], number, order="n", **layout)
    assert len(saved) == 3 and "Join" not in saved[0] and all("rangepartitioning" not in text for text in saved[:2])
    want = {r.k: (r.at, r.ch) for r in reversed(two.orderBy("n").collect())} | {r.k: (r.at, r.ch) for r in one.collect()}
    found = spark.read.parquet(path).collect()
    assert {r.k: (r.at, r.ch) for r in found} == want and len(found) == len(want)
    files = {}
    for r in sorted(spark.read.parquet(path).select("at", "_metadata.file_path", "_metadata.row_index").collect(), key=lambda r: r.row_index):
        files.setdefault(r.file_path, []).append(r["at"])
    assert all(times == sorted(times) for times in files.values())
    folders = [f.rsplit("/", 1)[0] for f in files]
    assert max(map(folders.count, folders)) <= 2
