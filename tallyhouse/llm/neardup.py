"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is that of its distinct runs of ``width`` words (fewer words make one
run). Its sketch holds the ``K`` least hash values of the set, all of them if fewer.

1. Documents with equal sets are one node from here on.
2. Inverted lists of sketch values give candidates. Nodes whose similarity reaches the
   threshold share a number ``need`` of their values but for a chance below one in 100,000
   (for sets below ``K``: all they must, without exception); it follows from the threshold
   and is ``NEED`` at most. So each node stands only in the lists of its
   ``size - need + 1`` rarest values: one of them must be common.
3. Candidates pass a filter by size and by bitmaps of their sketches, which travel with
   the lists and lose nothing, then by the share of the union's sketch that both have;
   then the exact Jaccard of the whole sets decides.
4. In a list nodes first meet its hub only: the node with the most common values, from
   which copies derive as a rule. That makes a list linear. Nodes then linked are one
   component, and only pairs of one list from different components are still open.
   Runs of words that one open node alone has bound the similarity of its pairs from
   above. Lists up to ``SHORT`` nodes try what that leaves; in longer ones a node stands
   for what it differs in from the runs that most nodes with its hub have. With similar
   sets the differences of a pair must overlap by a number that follows from their sizes;
   they are joined by prefixes of the differences, own runs first, and by position. Pairs
   that need no overlap are linked by way of the node with the least difference for its
   size. Copies of one text with edits of their own, too many to be linked, differ in runs
   of their own, so a large group of them does not pair with itself; and no link is lost.

Null or empty texts, or texts of blanks, have an empty set and are linked with nothing.
Repeated rows are one node. A null id takes part; a component is named by its smallest
id that is not null, by null if there is none. An empty table gives an empty one. Only
the columns named are read. Single hash values are 64 bits, sets are told apart by 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.graph import components
from tallyhouse.llm.text import mix, word_hashes
from tallyhouse.session import materialize

K = 48
NEED = 28
#: The chance with which a pair at the threshold may share less than it needs.
LOSS = 1e-5
#: A bitmap of the sketch, a bit per value.
BITS = ["b0", "b1", "b2", "b3"]
#: Open nodes of a list that are paired directly.
SHORT = 32
#: Runs of words that are counted at once.
STRETCH = 1 << 20


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of every text's runs of ``width`` words."""
    hashes, counts = word_hashes(column)
    for own in np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else ():
        n = min(width, len(own))
        if not n:
            yield np.zeros(0, np.int64)
            continue
        runs = np.full(len(own) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            runs = mix(runs + own[k : len(own) - n + 1 + k])
        yield np.unique(runs.view(np.int64))


def _name(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    u = s.view(np.uint64)
    one, two = mix(u).sum(dtype=np.uint64), mix(u ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return np.array([one + np.uint64(len(s)), two], dtype=np.uint64).tobytes()


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, kept, bits = [], [], [], np.zeros((batch.num_rows, 256), dtype=np.uint8)
            for i, s in enumerate(shingle_sets(batch.column(batch.num_columns - 1), width)):
                sizes.append(len(s))
                names.append(_name(s))
                kept.append(s[:K])
                bits[i, mix(kept[-1].view(np.uint64)) & np.uint64(255)] = 1
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(kept, pa.list_(pa.int64())), *(pa.array(words[:, k].copy()) for k in range(4))],
                names=[*batch.schema.names[:-1], "n", "name", "sketch", *BITS],
            )

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Links:
    """Turns candidate pairs of nodes into links."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, width: int, percent: int):
        self.nodes, self.texts, self.width, self.percent = nodes, texts, width, percent

    def sets(self, spark: SparkSession, ids: DataFrame) -> DataFrame:
        """id, whole: the whole sets of some nodes."""
        wanted = ids.join(self.nodes.select("id", "name", "rep_id", "rep_hash"), "id")
        texts = self.texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
        sets = texts.select("id", "name", "text").mapInArrow(_keyed_sets(self.width), "id long, whole binary").dropDuplicates(["id"])
        return materialize(spark, sets, "sets")

    def __call__(self, spark: SparkSession, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """pairs: a, b; sets: the whole sets of their nodes, if they are there already."""
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        small = self.nodes.select("id", "n", "sketch")
        both = ordered.join(small.toDF("a", "n_a", "s_a"), "a").join(small.toDF("b", "n_b", "s_b"), "b")
        both = both.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        m = F.least(F.size("s_a"), F.size("s_b"))
        common = F.array_intersect("s_a", "s_b")
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), F.lit(1), m)
        likely = F.when(m < K, F.size(common) >= _need(m, self.percent)).otherwise(F.size(F.array_intersect(union, common)) >= need_of(self.percent))
        passed = materialize(spark, both.where(likely).select("a", "b"), "candidates")

        if sets is None:
            sets = self.sets(spark, passed.select(F.col("a").alias("id")).unionByName(passed.select(F.col("b").alias("id"))).distinct())
        first = passed.join(sets.toDF("a", "whole_a"), "a")
        met = first.join(sets.toDF("b", "whole_b"), "b").select("a", "b", "whole_a", "whole_b")
        return materialize(spark, met.mapInArrow(_exact(self.percent), "a long, b long"), "near")


def _keyed_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s if name == _name(s) else None for name, s in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(2), width), strict=True)]
            own = pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if s is None else s.tobytes() for s in sets], pa.binary())], names=["id", "whole"])
            yield own.filter(own.column(1).is_valid())

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            runs = np.frombuffer(whole.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), i)), pa.array(runs)], names=["id", "run"])


def _common_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hub, whole) in the order of hubs: per stretch of one hub's nodes, how many they
    are, and the runs that more than half of them have with their numbers. A run that more than
    half of all nodes of a hub have is among those of one stretch at least."""
    hub, held, size = None, [], 0

    def part() -> pa.RecordBatch:
        runs, n = np.unique(np.concatenate(held), return_counts=True)
        most = 2 * n > len(held)
        columns = [pa.array([x], t) for x, t in ((hub, pa.int64()), (len(held), pa.int64()), (runs[most], pa.list_(pa.int64())), (n[most], pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, names=["hub", "nodes", "runs", "counts"])

    for batch in batches:
        for h, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and (h != hub or size > STRETCH):
                yield part()
                held, size = [], 0
            hub = h
            held.append(np.frombuffer(whole.as_buffer(), np.int64).copy())
            size += len(held[-1])
    if held:
        yield part()


def _most_have(long: DataFrame) -> DataFrame:
    """hub, most_have: runs that most nodes of a hub have, to tell their sets apart by. Any set
    of runs would do, so a run is counted in those stretches only where most nodes have it; the
    rows are as many as stretches, not as runs of nodes."""
    # sorted by ranges of both, so that a hub of very many nodes is spread over tasks
    ordered = long.select("hub", "whole", "node.id").repartitionByRange("hub", "id").sortWithinPartitions("hub")
    parts = ordered.select("hub", "whole").mapInArrow(_common_runs, "hub long, nodes long, runs array<long>, counts array<long>")
    parts = materialize(long.sparkSession, parts, "common-runs")
    total = parts.groupBy("hub").agg(F.sum("nodes").alias("nodes"))
    each = parts.select("hub", F.explode(F.arrays_zip("runs", "counts")).alias("r"))
    had = each.groupBy("hub", F.col("r.runs").alias("run")).agg(F.sum("r.counts").alias("c"))
    return had.join(total, "hub").where("2 * c > nodes").groupBy("hub").agg(F.collect_list("run").alias("most_have"))


def _differences(percent: int):
    """Of every (hub, node): the first runs of its difference, as far as another node's must
    begin. A row without a run tells of the difference as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, valid, rows, places, sizes, early = [], [], [], [], [], []
            for i, (most_have, own, lone) in enumerate(zip(*(batch.column(c) for c in ("most_have", "whole", "lone")), strict=True)):
                r, x = np.sort(most_have.values.to_numpy()), np.frombuffer(own.as_buffer(), np.int64)
                more, less = np.setdiff1d(x, r, assume_unique=True), np.setdiff1d(r, x, assume_unique=True)
                shared = np.setdiff1d(more, lone.values.to_numpy())
                alone = len(more) - len(shared)  # these stand first and meet nothing
                most = (100 - percent) * len(x) // percent  # by how many runs a similar set may differ
                ordered = np.concatenate((shared, less))[: max(0, most + 1 - alone)]
                runs += [np.zeros(1, np.int64), ordered]
                valid += [np.zeros(1, bool), np.ones(len(ordered), bool)]
                rows.append(np.full(len(ordered) + 1, i))
                places.append(alone - 1 + np.arange(len(ordered) + 1))
                sizes.append(np.full(len(ordered) + 1, len(more) + len(less)))
                early.append(places[-1] <= most // 2)
            if rows:
                kept = batch.select(["hub", "node", "component"]).take(pa.array(np.concatenate(rows)))
                run = pa.array(np.concatenate(runs), mask=~np.concatenate(valid))
                new = [run, *(pa.array(np.concatenate(c)) for c in (places, sizes, early))]
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=["hub", "node", "component", "run", "place", "differs", "early"])

    return run


def _open_pairs(spark: SparkSession, open_: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of one list and of different components that may still be similar.

    ``open_``: value, node, component; ``sets``: the whole sets of its nodes."""
    # runs of words that one open node alone has can be common to no pair
    runs = sets.mapInArrow(_elements, "id long, run long").groupBy("run").agg(F.count("*").alias("c"), F.min("id").alias("of"))
    lone = materialize(spark, runs.where("c = 1").groupBy("of").agg(F.collect_list("run").alias("runs")), "lone")
    counts = lone.select("of", F.size("runs").alias("lone"))
    places = open_.join(counts, F.col("node.id") == F.col("of"), "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    places = places.where(100 * (F.col("node.n") - F.col("lone")) >= percent * F.col("node.n")).select("value", "node", "component", "lone")
    each = places.groupBy("value", "component").agg(F.count("*").alias("c"))
    length = each.groupBy("value").agg(F.sum("c").alias("length"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    places = materialize(spark, places.join(length, "value"), "places")

    few = places.where(F.col("length") <= SHORT)
    x, y = (few.select("value", F.col("node").alias(v), F.col("component").alias(f"c_{v}"), F.col("lone").alias(f"u_{v}")) for v in "xy")
    within = F.least(F.col("x.n") - F.col("u_x"), F.col("y.n") - F.col("u_y"))
    around = F.greatest(F.col("x.n") + F.col("u_y"), F.col("y.n") + F.col("u_x"))
    fits = (F.col("c_x") < F.col("c_y")) & (100 * within >= percent * around) & _possible(F.col("x"), F.col("y"), percent)
    direct = x.join(y, (x["value"] == y["value"]) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    hub = hubs.select("value", F.col("hub.id").alias("hub"))
    long = places.where(F.col("length") > SHORT).join(hub, "value").select("hub", "node", "component").distinct()
    held = sets.join(lone, F.col("id") == F.col("of"), "left").select(F.col("id").alias("own"), "whole", F.coalesce("runs", F.array().cast("array<long>")).alias("lone"))
    long = materialize(spark, long.join(held, F.col("node.id") == F.col("own")).drop("own"), "long")
    # at most twice as many runs as a set has are those that more than half of the nodes have
    had = _most_have(long)
    long = long.join(had, "hub", "left").withColumn("most_have", F.coalesce("most_have", F.array().cast("array<long>")))
    kind = long.schema["node"].dataType.simpleString()
    differ = long.mapInArrow(_differences(percent), f"hub long, node {kind}, component long, run long, place long, differs long, early boolean")
    differ = materialize(spark, differ, "differences")

    # no overlap is needed where the differences are together below what the sizes allow
    over = (100 + percent) * F.col("differs") - (100 - percent) * F.col("node.n")
    alone = differ.where("run IS NULL").select("hub", F.struct(over.alias("over"), F.col("node.id").alias("id")).alias("s"))
    star = alone.join(alone.groupBy("hub").agg(F.min("s").alias("least")), "hub").where("s.over + least.over <= 0 AND s.id <> least.id")
    star = star.select(F.col("s.id").alias("a"), F.col("least.id").alias("b"))
    differ = differ.where("run IS NOT NULL")
    x = differ.where("early").select("hub", "run", F.col("node").alias("x"), *(F.col(c).alias(f"{c}_x") for c in ("component", "place", "differs")))
    y = differ.select("hub", "run", F.col("node").alias("y"), *(F.col(c).alias(f"{c}_y") for c in ("component", "place", "differs")))
    in_order = F.struct("differs_x", "x.id") < F.struct("differs_y", "y.id")
    # the first common run leaves no more to overlap than stands behind it
    rest = F.least(F.col("differs_x") - F.col("place_x"), F.col("differs_y") - F.col("place_y"))
    apart = F.col("differs_x") + F.col("differs_y") - 2 * rest
    near = (100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    fits = in_order & (F.col("component_x") != F.col("component_y")) & near & _possible(F.col("x"), F.col("y"), percent)
    met = x.join(y, (x["hub"] == y["hub"]) & (x["run"] == y["run"]) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return direct.unionByName(star).unionByName(met)


def need_of(percent: int) -> int:
    """The most of ``K`` values, each common with a chance of ``percent`` of 100, that fail
    to be common with a chance below ``LOSS``; ``NEED`` at most."""
    p, less = percent / 100, 0.0
    for n in range(NEED):
        less += comb(K, n) * p**n * (1 - p) ** (K - n)
        if less >= LOSS:
            return max(n, 1)
    return NEED


def _need(size: Column, percent: int) -> Column:
    """The values a node must share, of ``size`` in its sketch."""
    return F.least(F.lit(need_of(percent)), F.ceil(size * percent / F.lit(100.0)).cast("int"))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row; rows whose Jaccard is
    ``percent`` of 100 or more are linked."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(_sketches(width), f"doc_id {kind}, text_hash long, n long, name binary, sketch array<long>, b0 long, b1 long, b2 long, b3 long")
    rows = materialize(spark, rows, "sketches")
    nodes = rows.where("n > 0").groupBy("name").agg(
        F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), *(F.first(b).alias(b) for b in BITS)
    )
    nodes = nodes.select("name", "doc", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "n", "sketch", *BITS)
    nodes = materialize(spark, nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")

    # each node in the lists of its rarest values; a value of one node alone links nothing
    values = nodes.select("id", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = values.join(shared, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("own"))
    own = own.join(nodes.select("id", "n", F.size("sketch").alias("size"), *BITS), "id")
    alone = F.col("size") - F.size("own")
    length = F.col("size") - _need(F.col("size"), percent) + 1 - alone
    common = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    rank = F.struct(F.size("own").alias("shared"), common.alias("common"), "id")
    node = F.struct("id", "n", "size", *BITS)
    lists = own.where(length > 0).select(node.alias("node"), rank.alias("rank"), F.explode(F.slice("own", F.lit(1), length)).alias("x"))
    lists = materialize(spark, lists.select(F.col("x.value").alias("value"), "node", "rank"), "lists")

    link = _Links(nodes, texts, width, percent)
    hubs = lists.groupBy("value").agg(F.max(F.struct("rank", "node"))["node"].alias("hub"))
    near = link(spark, _spokes(lists, hubs, percent))
    group = components(spark, near)
    placed = lists.join(group.withColumnRenamed("node", "of"), F.col("node.id") == F.col("of"), "left")
    placed = materialize(spark, placed.select("value", "node", F.coalesce("component", "node.id").alias("component")), "lists")
    each = placed.groupBy("value", "component").agg(F.count("*").alias("c"))
    mixed = each.groupBy("value").agg(F.sum("c").alias("c"), F.count("*").alias("groups")).where("groups > 1 AND c > 2")
    open_ = materialize(spark, placed.join(mixed.select("value"), "value"), "open")
    if not open_.isEmpty():
        sets = link.sets(spark, open_.select("node.id").distinct())
        near = link(spark, _open_pairs(spark, open_, hubs, sets, percent), sets)
        group = components(spark, group.toDF("a", "b").unionByName(near))

    named = nodes.select("id", "name", "doc").join(group.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "component").select("name", "component_id")
    out = rows.drop("sketch").join(named, "name", "left")
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _spokes(lists: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    hubs = hubs.withColumnRenamed("value", "hub_value")
    met = lists.join(hubs, (F.col("value") == F.col("hub_value")) & (F.col("node.id") != F.col("hub.id")) & _possible(F.col("node"), F.col("hub"), percent))
    return met.select(F.col("node.id").alias("a"), F.col("hub.id").alias("b"))


def _possible(x: Column, y: Column, percent: int) -> Column:
    """Sets of like size whose sketches' bitmaps differ in no more bits than the sketches may in values."""
    sizes = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    differ = reduce(lambda a, b: a + b, (F.bit_count(x[b].bitwiseXOR(y[b])) for b in BITS))
    return sizes & (differ <= x["size"] + y["size"] - 2 * _need(F.least(x["size"], y["size"]), percent))
