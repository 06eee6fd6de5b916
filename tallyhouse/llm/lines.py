"""Line dedup by a segment-partition edit join.

Two lines are linked when their edit distance, in bytes of UTF-8, is at most ``EDITS``.
Lines are what stands between line ends, without blanks at their ends; those below
``SHORTEST`` bytes are linked with none, as a few edits would turn one into another; with
``all_lines`` those that are not empty take part by equality.

1. Equal lines are one from here on.
2. A line is split into ``EDITS`` + 1 segments. If another line of this or a greater
   length is within ``EDITS`` edits, one segment stands in it unchanged, at a place that
   the lengths of the two lines and the segment's number confine. Segments are indexed by
   (length of the line, number, bytes); a line probes the index with its substrings at
   those places, for each length up to ``EDITS`` below its own.
3. Probes meet lists, not entries: a probe that finds a list is one row, however long the
   list. In a list of several lines all first meet its hub only, the line whose own lists
   are longest, from which the others derive as a rule. That makes a list linear.
4. What meets is verified by banded bit-parallel edit distance after common ends are cut
   off. Lines then linked are one component, and only pairs of one list from different
   components are still open. These are paired where bitmaps of their pairs of bytes differ
   in no more bits than ``EDITS`` edits can flip, which loses nothing, and verified.
5. Links make classes: a class is named by its first line. A class is the same whether all
   its links were looked at or those that join it. ``count_links`` looks at all, for those
   who want their number: its work grows with the square of a family of near lines.

Index entries and probes are hashes made by running sums, a fixed number per line, so the
join is an equi-join on short keys and shuffles the same small amount for long lines.

A null or empty text has no lines. Lines of rows that share doc_id and text stand at the
same place and are kept or dropped together. Null ids come first. An empty table gives an
empty one. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.graph import components
from tallyhouse.llm.text import Spans, bytes_and_offsets, mix
from tallyhouse.session import materialize

EDITS = 2
SHORTEST = 24


def lines_of(docs: DataFrame, shortest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, line_no (from 0), line: the lines that dedup looks at."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")))
    return rows.where(F.octet_length("line") >= shortest)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of a line, as even as they go, the longer ones last."""
    parts, short = edits + 1, length // (edits + 1)
    longer = length - short * parts
    sizes = [short + (i >= parts - longer) for i in range(parts)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def probes(length: int, other: int, edits: int) -> list[tuple[int, int, int]]:
    """(number, start, size) of the substrings with which a line of ``length`` looks for
    one of ``other`` <= ``length`` bytes: the places that alignments from the left and
    from the right both allow."""
    gap, out = length - other, []
    for i, (start, size) in enumerate(segments(other, edits)):
        low = max(0, start - i, start + gap - (edits - i))
        high = min(length - size, start + i, start + gap + (edits - i))
        out += [(i, at, size) for at in range(low, high + 1)]
    return out


def _keys(edits: int, probes: bool):
    """key, id of every line's index entries; or key, own, id of its probes (own: the one
    that is its entry too)."""

    def hashed(spans: Spans, start: np.ndarray, at: np.ndarray, size: np.ndarray, number: int, other: np.ndarray) -> np.ndarray:
        own = spans.hash(start + at, start + at + size)
        tag = other.astype(np.uint64) * np.uint64(edits + 1) + np.uint64(number)
        x = own ^ (tag * np.uint64(0x9E3779B97F4A7C15))
        return (x ^ (x >> np.uint64(32))).view(np.int64)

    places = [(gap, i, shift) for gap in range(edits + 1) for i in range(edits + 1) for shift in range(-edits, edits + 1)]
    places = [(gap, i, shift) for gap, i, shift in places if abs(shift) <= i and abs(shift - gap) <= edits - i]
    if not probes:
        places = [(0, i, 0) for i in range(edits + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = bytes_and_offsets(batch.column(1))
            # a line is never cut: runs of whole lines of about a megabyte, or one longer line
            first = 0
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 20), side="right")) - 1)
                base = int(offsets[first])
                spans = Spans(data[base : int(offsets[last])])
                start = offsets[first:last] - base
                length = np.diff(offsets[first : last + 1])
                keys, kinds, owners = [], [], []
                for gap, i, shift in places:
                    other = length - gap
                    part = other // (edits + 1)
                    longer = other - part * (edits + 1)
                    size = part + (i >= edits + 1 - longer)
                    at = i * part + np.maximum(0, i - (edits + 1 - longer)) + shift
                    fits = (at >= 0) & (at + size <= length)
                    keys.append(hashed(spans, start[fits], at[fits], size[fits], i, other[fits]))
                    kinds.append(np.full(len(keys[-1]), gap == 0 and shift == 0))
                    owners.append(ids[first:last][fits])
                columns = {"key": keys, "own": kinds, "id": owners} if probes else {"key": keys, "id": owners}
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns.values()], names=list(columns))
                first = last

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and two words of bits of every line: of each pair of neighbouring bytes, by a hash,
    whether it stands there an odd number of times. An edit changes four pairs at most."""
    for batch in batches:
        words = np.zeros((batch.num_rows, 2), dtype=np.int64)
        for i, line in enumerate(batch.column(1)):
            x = np.frombuffer(line.as_buffer(), dtype=np.uint8).astype(np.uint64)
            pair = mix((x[:-1] << np.uint64(8)) | x[1:]) & np.uint64(127)
            words[i] = np.packbits((np.bincount(pair.view(np.int64), minlength=128) & 1).astype(np.uint8)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], names=["id", "b0", "b1"])


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """The edit distance if it is at most ``most``, else ``most`` + 1.

    Bit-parallel over a band of 2 * ``most`` + 1 diagonals: one word per number of edits,
    a bit per diagonal, a step per byte of the shorter text.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a:
        return min(len(b), most + 1)
    width, gap = 2 * most + 1, len(b) - len(a)
    full, places = (1 << width) - 1, {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j + most
    # within[e]: diagonals on which the prefixes so far are at most e edits apart
    within = [((1 << e + 1) - 1) << most & full for e in range(most + 1)]
    for i, c in enumerate(a):
        equal = places.get(c, 0) >> i & full
        new: list[int] = []
        for e, own in enumerate(within):
            row = own & equal
            if e:  # another byte, one of `a` left out, one of `b` put in
                row |= within[e - 1] | within[e - 1] >> 1 | new[e - 1] << 1 | new[e - 1]
            new.append(row & full)
        within = new
        if not within[most]:
            return most + 1
    return next((e for e in range(most + 1) if within[e] >> most + gap & 1), most + 1)


def _verified(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edit_distance(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes(), edits) <= edits for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _links(spark: SparkSession, text: DataFrame, edits: int, every: bool) -> DataFrame:
    """a, b: links between the lines of ``text`` (id, line) that join each class; ``every``:
    all links."""
    lists = text.mapInArrow(_keys(edits, probes=False), "key long, id long").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    hits = text.mapInArrow(_keys(edits, probes=True), "key long, own boolean, id long").join(lists, "key")
    # a list of one line is met by other lines only
    hits = materialize(spark, hits.where("n > 1 OR least <> id"), "line-hits")
    encoded = text.select("id", F.encode("line", "UTF-8").alias("line"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(spark, pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
        met = pairs.join(encoded.toDF("a", "line_a"), "a").join(encoded.toDF("b", "line_b"), "b").select("a", "b", "line_a", "line_b")
        return materialize(spark, met.mapInArrow(_verified(edits), "a long, b long"), "line-links")

    single = hits.where("n = 1").select(F.col("least").alias("a"), F.col("id").alias("b"))
    several = hits.where("n > 1").select("key", "own", "id", "n")
    entries = several.where("own")
    if every:
        return verified(single.unionByName(entries.select("key", F.col("id").alias("a")).join(several.select("key", F.col("id").alias("b")), "key").select("a", "b")))

    rank = entries.groupBy("id").agg(F.sum("n").alias("common"))
    hubs = entries.join(rank, "id").groupBy("key").agg(F.max(F.struct("common", "id"))["id"].alias("a"))
    near = verified(single.unionByName(several.join(hubs, "key").select("a", F.col("id").alias("b"))))
    group = components(spark, near)
    placed = several.join(group.withColumnRenamed("node", "id"), "id", "left").select("key", "own", "id", F.coalesce("component", "id").alias("component"))
    placed = materialize(spark, placed, "line-places")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ = materialize(spark, placed.join(mixed, "key"), "line-open")
    if open_.isEmpty():
        return near
    bits = encoded.join(open_.select("id").distinct(), "id").mapInArrow(_bitmaps, "id long, b0 long, b1 long")
    open_ = materialize(spark, open_.join(bits, "id"), "line-open")
    x, y = (open_.select("key", "own", *(F.col(c).alias(f"{c}_{v}") for c in ("id", "component", "b0", "b1"))) for v in "xy")
    apart = sum((F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y"))) for b in ("b0", "b1")), F.lit(0))
    x, y = x.where("own").drop("own"), y.drop("own").withColumnRenamed("key", "key_y")
    met = x.join(y, (x["key"] == y["key_y"]) & (F.col("component_x") != F.col("component_y")) & (apart <= 4 * edits))
    return near.unionByName(verified(met.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))))


def line_classes(
    spark: SparkSession, docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text", all_lines: bool = False,
    count_links: bool = True,
) -> DataFrame:
    """Per line of at least ``shortest`` bytes (``all_lines``: of one byte): doc_id, text_hash, line_no, n_bytes, n_links
    (other different lines within ``edits``; without ``count_links`` there is no such column), the doc_id and line_no of
    its class's first line, and whether it is that one (kept). Shorter lines are classed by equality alone."""
    if shortest <= edits:
        raise ValueError("a line must be longer than the edits it may differ by")
    rows = lines_of(docs, 1 if all_lines else shortest, id_col, text_col).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    place = ["doc_id", "text_hash", "line_no"]
    first = F.min(F.struct(*place)).alias("first")
    distinct = rows.groupBy("h1", "h2").agg(first, F.first("line").alias("line"))
    distinct = materialize(spark, distinct.withColumn("id", F.monotonically_increasing_id()), "lines")

    links = _links(spark, distinct.where(F.octet_length("line") >= shortest).select("id", "line"), edits, count_links)
    member = components(spark, links).withColumnRenamed("node", "id")
    counted = []
    if count_links:
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
        member = member.join(ends.groupBy("id").agg(F.count("*").alias("n_links")), "id")
        counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    linked = distinct.select("id", "first").join(member, "id")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component").drop("component", "first")
    named = distinct.select("id", "h1", "h2", "first").join(linked, "id", "left")
    named = named.select("h1", "h2", *counted, F.coalesce("head", "first").alias("head"))
    out = rows.select(*place, F.octet_length("line").alias("n_bytes"), "h1", "h2").join(named, ["h1", "h2"])
    return out.select(
        *place, "n_bytes", *(["n_links"] if count_links else []), F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"),
        F.struct(*place).eqNullSafe(F.col("head")).alias("kept"), F.col("head.text_hash").alias("class_text_hash"), "h1",
    )


def _rest(text: Column, lost: Column) -> Column:
    """The text without the lines of the numbers ``lost``."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for t, n in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
            gone = set(n or ())
            out.append(None if t is None else "\n".join(p for k, p in enumerate(t.split("\n")) if k not in gone))
        return pa.array(out, pa.string())

    return cut(F.when(lost.isNotNull(), text), lost)


def without_repeats(
    spark: SparkSession, docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without lines that repeat an earlier one; lines below ``shortest``
    bytes repeat those they equal.

    One case stays as it is: a document whose lines are, one for one and in order, those that
    another one keeps. Cut, it would be empty; whole, it is a copy for document dedup to take.
    A column ``n_chars`` follows the text.
    """
    found = line_classes(spark, docs, edits, shortest, id_col, text_col, all_lines=True, count_links=False)
    key = ["doc_id", "text_hash"]
    line = F.struct("line_no", "h1", "kept", F.col("class_doc_id").alias("head_id"), F.col("class_text_hash").alias("head_hash"))
    # as many entries as a document has lines; rows that repeat a document repeat its lines
    each = found.groupBy(*key).agg(F.sort_array(F.collect_set(line)).alias("lines"))
    signs = lambda x: F.xxhash64(F.transform(x, lambda v: v["h1"]))
    gone = F.filter("lines", lambda v: ~v["kept"])
    each = each.select(*key, signs(F.col("lines")).alias("all_signs"), signs(F.filter("lines", lambda v: v["kept"])).alias("kept_signs"), F.size("lines").alias("n"), gone.alias("gone"))
    each = materialize(spark, each.withColumn("head", F.get("gone", F.lit(0))), "document-lines")
    heads = each.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("kept_signs").alias("s"), F.lit(True).alias("copy"))
    other = F.col("head.head_id").eqNullSafe(F.col("d")) & (F.col("head.head_hash") == F.col("t")) & (F.col("all_signs") == F.col("s"))
    lost = each.where(F.size("gone") > 0).join(heads, other & (F.size("gone") == F.col("n")), "left").where("copy IS NULL")
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), F.transform("gone", lambda v: v["line_no"]).alias("lost"))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    plain = plain.withColumn("h", F.xxhash64(text.cast("string")))
    joined = plain.join(lost, own.eqNullSafe(F.col("lost_id")) & (F.col("h") == F.col("lost_hash")), "left")
    joined = joined.withColumn("rest", F.when(F.col("lost").isNotNull(), _rest(text.cast("string"), F.col("lost"))).otherwise(text))
    out = []
    for i, (name, field) in enumerate(zip(names, docs.schema.fields, strict=True)):
        column = F.col(f"c{i}")
        if name == text_col:
            column = F.col("rest")
        elif name == "n_chars":
            column = F.when(F.col("lost").isNotNull(), F.length("rest").cast(field.dataType)).otherwise(column)
        out.append(column.alias(name))
    return joined.select(*out)
