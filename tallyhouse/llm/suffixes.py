"""Removal of byte strings that occur more than once, by a distributed suffix array.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the
same text or another; strings never cross texts, and all are judged on the input.

1. Equal texts are one row from here on; a text that occurs twice loses all of its strings.
   Texts lie in buckets by hash, so later steps bring rows to them and never move them again.
2. Suffixes are taken where content says so: of the starts in a string, the one whose next
   ``seed`` bytes have the least hash, the leftmost among equals. Equal strings choose alike,
   so a string and its repeat have the same anchor, and a run of strings in a row shares one:
   its span. A span whose anchor's seed occurs nowhere else is done, and so is one whose
   seed occurs in equal spans only. Seeds and spans are compared by 64-bit hashes of both.
3. What is left are anchors with unlike spans, each distinct span once. Where more than ``HOT``
   share a seed (a passage in many contexts), each is cut into spans of ``FEW`` strings; what
   such strings have in common is their seed, nearly as long as a string, and step 2 is taken
   once more, which leaves the few strings about the ends of the passage.
4. Sampled splitters range-partition the suffixes by leading bytes, as many as a string has, so
   that a frequent seed is spread. A task sorts its suffixes by multikey quicksort, eight bytes
   a level and only among those equal so far, and takes the common prefixes of neighbours; and
   likewise the bytes before the anchors, backwards. A string is repeated if another span agrees
   in as many bytes before and after the anchor as it has there: two classes read off the prefixes.
5. What lies beyond a boundary agrees with a suffix in no more bytes than the first or the last
   suffix of its task does. Strings that this allows are compared across boundaries by 128-bit
   fingerprints, those alone a row each, those met twice one row together.

Nothing is paired, so the work is linear in the bytes for groups of any size.

A null text is an empty one. Texts shorter than ``length`` keep all bytes. Repeated rows and ids
are judged each for itself: two equal texts repeat one another. An empty table gives no rows.
Only the columns named are read, so others may have any name. Texts of any size are hashed in
blocks. What is kept of a text need not be valid UTF-8, as strings are cut at bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.text import BLOCK, Spans, bytes_and_offsets
from tallyhouse.session import materialize, scratch

LENGTH = 200
#: Spans that a task sorts, on average.
SORTED = 32_768
#: Unlike spans with one seed that are sorted as they are.
HOT = 1024
#: Strings of a span that stands for a part of one with a frequent seed.
FEW = 8
#: Bits of a place behind its start: anchor and number of strings take half each.
_BITS = 12
_POSITION = np.uint64((1 << 21) - 1)
_SHIFT = np.uint64(0x9FB21C651E98DF25)
_OTHER = np.random.default_rng(11).permutation(256).astype(np.uint8)


def seed_of(length: int) -> int:
    return max(length // 5, 1)


def _opened(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places: start of the span in its text, the anchor from there, number of strings."""
    return place >> 2 * _BITS, place >> _BITS & (1 << _BITS) - 1, place & (1 << _BITS) - 1


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, from running minima of blocks both ways."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spans_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of strings that begin in ``starts`` to ``ends`` (exclusive, one range a text): first and
    number of every run with one anchor, the anchor, and hashes of seed and span."""
    seed = seed_of(length)
    none = np.zeros(0, np.int64)
    some = ends > starts
    starts, ends = starts[some], ends[some]
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    spans = Spans(data)
    at = np.arange(len(data) - seed + 1)
    hashes = spans.hash(at, at + seed)
    best = least(hashes & ~_POSITION | at.astype(np.uint64), length - seed + 1)
    size = ends - starts
    first = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
    anchor = (best[first] & _POSITION).astype(np.int64)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(begin, append=len(first))
    lo, anchor = first[begin], anchor[begin]
    whole = spans.hash(lo, lo + count + length - 1) ^ (anchor - lo).astype(np.uint64) * _SHIFT
    return lo, count, anchor, hashes[anchor], whole


def _windows(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts, or of a long one overlapping: begin and end in the bytes, and the
    ranges of strings to look at, from the begin on."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(int(np.searchsorted(offsets, offsets[k] + BLOCK, side="right")) - 1, k + 1)
        begin, stop = int(offsets[k]), int(offsets[end])
        if stop - begin <= BLOCK:
            own = offsets[k : end + 1] - begin
            yield begin, stop, own[:-1], np.maximum(own[1:] - length + 1, own[:-1])
        else:
            for at in range(begin, stop - length + 1, BLOCK):
                last = min(at + BLOCK, stop - length + 1)
                yield at, last + length - 1, np.zeros(1, np.int64), np.array([last - at])
        k = end


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _texts(spark: SparkSession, docs: DataFrame, text_col: str) -> DataFrame:
    """k1, k2, text, many (whether it occurs twice): every text once, in buckets by its hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = docs.select(*_key(text), text.alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("many"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each.write.format("parquet").bucketBy(buckets, "k1", "k2").option("compression", "zstd").option("path", scratch(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def _anchored(texts: DataFrame, length: int) -> DataFrame:
    """k1, k2, place, many, seed, span: a row per span of every text."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int64()), ("many", pa.bool_()), ("seed", pa.int64()), ("span", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_and_offsets(batch.column("text"))
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            many = batch.column("many").to_numpy(zero_copy_only=False)
            for begin, stop, starts, ends in _windows(data, offsets, length):
                lo, count, anchor, seed, span = spans_of(data[begin:stop], starts, ends, length)
                of = np.searchsorted(offsets, lo + begin, side="right") - 1
                place = (lo + begin - offsets[of]) << 2 * _BITS | (anchor - lo) << _BITS | count
                columns = (keys[0][of], keys[1][of], place, many[of], seed.view(np.int64), span.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = texts.where(F.octet_length("text") >= length).select("k1", "k2", "many", "text")
    return rows.mapInArrow(run, "k1 long, k2 long, place long, many boolean, seed long, span long")


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of big-endian words: their order, and how many leading bytes
    each has in common with the one before."""
    n, levels = words.shape
    order, common = np.arange(n), np.full(n, 8 * levels)
    common[:1] = 0
    at, group = np.arange(n), np.zeros(n, dtype=np.int64)
    for level in range(levels):
        if not len(at):
            break
        own = order[at]
        key = words[own, level]
        by = np.lexsort((key, group))
        order[at], key = own[by], key[by]
        split = (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        place = np.flatnonzero(split) + 1
        unlike = (key[place] ^ key[place - 1]).astype(">u8").view(np.uint8).reshape(-1, 8)
        common[at[place]] = 8 * level + (unlike != 0).argmax(axis=1)
        new = np.concatenate(([True], (group[1:] != group[:-1]) | split))
        group = np.cumsum(new)
        going = np.bincount(group)[group] > 1
        at, group = at[going], group[going]
    return order, common


def _words(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Byte rows as big-endian words, filled up with zeros."""
    wide = np.zeros((len(rows), -(-width // 8) * 8), dtype=np.uint8)
    size = np.array([len(r) for r in rows], dtype=np.int64)
    wide[np.arange(wide.shape[1]) < size[:, None]] = np.concatenate(rows) if len(rows) else 0
    return wide.view(">u8").astype(np.uint64)


def repeated(spans: list[bytes], anchor: np.ndarray, count: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct spans: which of their strings (a row a span, a column a number of bytes before
    the anchor) are repeated among them, the class of each string in its column, and how many
    bytes behind its anchor a span can have in common with any that sorts before or after all of these."""
    n = len(spans)
    raw = [np.frombuffer(s, dtype=np.uint8) for s in spans]
    after, after_common = suffix_order(_words([r[a:] for r, a in zip(raw, anchor, strict=True)], length))
    before, before_common = suffix_order(_words([r[:a][::-1] for r, a in zip(raw, anchor, strict=True)], int(anchor.max())))
    first, last = np.full(n, length), np.full(n, length)
    first[1:] = np.minimum.accumulate(after_common[1:])
    last[:-1] = np.minimum.accumulate(after_common[:0:-1])[::-1]
    reach = np.zeros(n, dtype=np.int64)
    reach[after] = np.maximum(first, last)
    found = np.zeros((n, int(anchor.max()) + 1), dtype=bool)
    classes = np.full(found.shape, -1, dtype=np.int32)
    weight = 1 + many.astype(np.int64)
    right, left = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for d in range(found.shape[1]):
        own = np.flatnonzero((anchor >= d) & (anchor - count < d))
        if len(own):
            right[after] = np.cumsum(after_common < length - d)
            left[before] = np.cumsum(before_common < d)
            _, of = np.unique(right[own] * (n + 1) + left[own], return_inverse=True)
            found[own, d] = np.bincount(of, weights=weight[own])[of] > 1
            classes[own, d] = of
    return found, classes, reach


def _judged(spans: DataFrame, length: int) -> DataFrame:
    """k1, k2, first, last (strings of a text that are repeated), or a string to compare across
    boundaries: its place and fingerprints f1, f2, and in ``weight`` 2 if it is known to be repeated."""
    names = ("k1", "k2", "first", "last", "f1", "f2", "weight")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def batch_of(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if c is not None else pa.nulls(len(columns[-1]), pa.int64()) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]  # a task's share of the spans
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        k1, k2, place = (table.column(c).to_numpy() for c in ("k1", "k2", "place"))
        many, spans = table.column("many").to_numpy(), table.column("bytes").to_pylist()
        lo, anchor, count = _opened(place)
        found, classes, reach = repeated(spans, anchor, count, many, length)
        # strings by their start in the text: the more bytes before the anchor the earlier
        turned = np.zeros((len(spans), found.shape[1] + 2), dtype=np.int8)
        turned[:, 1:-1] = (found & ~many[:, None])[:, ::-1]
        step = np.diff(turned, axis=1)
        row, opens = np.nonzero(step > 0)
        _, closes = np.nonzero(step < 0)
        shift = (lo + anchor)[row] - (found.shape[1] - 1)
        yield batch_of(k1[row], k2[row], opens + shift, closes + shift, None, None, np.ones(len(row), np.int64))
        row, d = np.nonzero((classes >= 0) & (length - np.arange(found.shape[1]) <= reach[:, None]))
        known = found[row, d]
        # a repeated string once for all
        _, one = np.unique(np.stack([d[known], classes[row, d][known]]), axis=1, return_index=True)
        pick = np.concatenate([np.flatnonzero(~known), np.flatnonzero(known)[one]])
        row, d, known = row[pick], d[pick], known[pick]
        data = np.frombuffer(b"".join(spans), dtype=np.uint8)
        size = np.array([len(s) for s in spans])
        start = (np.cumsum(size) - size + anchor)[row] - d
        prints = [Spans(x).hash(start, start + length).view(np.int64) for x in (data, _OTHER[data])]
        at = (lo + anchor)[row] - d
        yield batch_of(k1[row], k2[row], at, at + 1, *prints, 1 + known.astype(np.int64))

    return spans.select("k1", "k2", "place", "many", "bytes").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _parts(spans: DataFrame, length: int) -> DataFrame:
    """Spans with their bytes in parts of ``FEW`` strings at most, which begin at the same numbers
    of bytes before the anchor in all: k1, k2, place, many, seed, span. All strings of a part
    hold its seed."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int64()), ("many", pa.bool_()), ("seed", pa.int64()), ("span", pa.int64())])
    seed = length - min(FEW, length // 2) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = length - seed + 1
        for batch in batches:
            k1, k2, place = (batch.column(c).to_numpy() for c in ("k1", "k2", "place"))
            many = batch.column("many").to_numpy(zero_copy_only=False)
            raw = batch.column("bytes").to_pylist()
            data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
            lo, anchor, count = _opened(place)
            low, high = (anchor - count + 1) // few, anchor // few
            row = np.repeat(np.arange(len(place)), high - low + 1)
            part = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - high - 1, high - low + 1)
            # strings by bytes before the anchor, and the part's own anchor: the seed's start
            near, far = np.maximum(part * few, (anchor - count + 1)[row]), np.minimum(part * few + few - 1, anchor[row])
            core = anchor[row] - part * few
            begin, size = anchor[row] - far, far - near + 1
            spans = Spans(data)
            seeds = spans.hash(offsets[row] + core, offsets[row] + core + seed)
            whole = spans.hash(offsets[row] + begin, offsets[row] + begin + size + length - 1) ^ (core - begin).astype(np.uint64) * _SHIFT
            columns = (k1[row], k2[row], (lo[row] + begin) << 2 * _BITS | (core - begin) << _BITS | size, many[row], seeds.view(np.int64), whole.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spans.select("k1", "k2", "place", "many", "bytes").mapInArrow(run, "k1 long, k2 long, place long, many boolean, seed long, span long")


def _sifted(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of spans (k1, k2, place, many, seed, span): k1, k2, place of those that others equal; and
    k1, k2, place, many, seed of every distinct one that must be sorted among unlike ones."""
    seeds = rows.groupBy("seed").agg(F.count("*").alias("n"), F.max("many").alias("twice"), F.min("span").alias("low"), F.max("span").alias("high"))
    seeds = seeds.where((F.col("n") > 1) | F.col("twice")).select("seed", (F.col("low") != F.col("high")).alias("unlike"))
    # a table of its own, so that a join on a frequent seed can be split
    met = materialize(spark, rows.join(materialize(spark, seeds, "seeds").hint("merge"), "seed"), "anchors")
    unlike = met.where("unlike")
    one = (F.first(c).alias(c) for c in ("k1", "k2", "place"))  # any row of the group, the same for all three
    kinds = materialize(spark, unlike.groupBy("seed", "span").agg((F.max("many") | (F.count("*") > 1)).alias("many"), *one), "spans")
    equal = unlike.join(kinds.where("many").select("seed", "span").hint("merge"), ["seed", "span"], "left_semi")
    runs = met.where("NOT unlike").unionByName(equal).where("NOT many").select("k1", "k2", "place")
    return runs, kinds.drop("span")


def _with_bytes(texts: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Spans with their bytes, from the one text that stands for each."""
    wanted = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "many")).alias("wanted"))
    raw = texts.select("k1", "k2", F.col("text").cast("binary").alias("raw")).join(wanted.hint("shuffle_hash"), ["k1", "k2"])
    each = raw.select("k1", "k2", "raw", F.explode("wanted").alias("w")).select("k1", "k2", "w.place", "w.many", "raw")
    start, size = F.shiftright("place", 2 * _BITS), (F.col("place").bitwiseAND((1 << _BITS) - 1) + length - 1).cast("int")
    return each.withColumn("bytes", F.substring("raw", (start + 1).cast("int"), size)).drop("raw")


def _marks(spark: SparkSession, texts: DataFrame, length: int) -> DataFrame:
    """k1, k2, marks: byte ranges of texts that occur once, whose strings occur elsewhere."""
    runs, kinds = _sifted(spark, _anchored(texts, length))
    hot = materialize(spark, kinds.groupBy("seed").count().where(F.col("count") > HOT).select("seed"), "hot-seeds")
    spans = kinds.drop("seed")
    if not hot.isEmpty():
        cut = _parts(_with_bytes(texts, kinds.join(hot, "seed", "left_semi"), length), length)
        more, parts = _sifted(spark, cut)
        runs = runs.unionByName(more)
        spans = kinds.join(hot, "seed", "left_anti").drop("seed").unionByName(parts.drop("seed"))
    each = materialize(spark, _with_bytes(texts, spans, length), "span-bytes")
    anchor = F.shiftright("place", _BITS).bitwiseAND((1 << _BITS) - 1).cast("int")
    tasks = each.count() // SORTED + 1
    parted = each.withColumn("suffix", F.substring("bytes", anchor + 1, F.lit(length))).repartitionByRange(tasks, "suffix", "bytes")
    judged = materialize(spark, _judged(parted, length), "judged")
    across = judged.where("f1 IS NOT NULL")
    twice = across.groupBy("f1", "f2").agg(F.sum("weight").alias("n")).where("n > 1").select("f1", "f2")
    last = lambda c: F.col(c) + length - 1
    lone = judged.where("f1 IS NULL").unionByName(across.where("weight = 1").join(twice, ["f1", "f2"])).select("k1", "k2", "first", last("last").alias("last"))
    runs = runs.select("k1", "k2", F.shiftright("place", 2 * _BITS).alias("first"), F.col("place").bitwiseAND((1 << _BITS) - 1).alias("n"))
    runs = runs.select("k1", "k2", "first", (F.col("first") + last("n")).alias("last"))
    return runs.unionByName(lone).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("marks"))


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch as one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > last[:-1])) if len(first) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return first[begin], last[np.append(begin[1:], len(first)) - 1] if len(first) else last


def without_repeats(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, with_kept: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, n_bytes, spans (maximal removed ranges of bytes, end exclusive),
    kept_sha256, and, if asked for, kept: the bytes left."""
    if not 2 <= length < 1 << _BITS:
        raise ValueError(f"length must be from 2 to {(1 << _BITS) - 1}")
    texts = _texts(spark, docs, text_col)
    marks = _marks(spark, texts, length)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, *([("kept", pa.binary())] if with_kept else [])])
    ddl = "k1 long, k2 long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string" + (", kept binary" if with_kept else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_and_offsets(batch.column("text"))
            lists = batch.column("marks").fill_null([])
            cuts = lists.offsets.to_numpy()
            firsts, lasts = (x.to_numpy() for x in lists.values.flatten())
            spans, kept = [], []
            for k, many in enumerate(batch.column("many").to_pylist()):
                own = data[offsets[k] : offsets[k + 1]]
                if many:
                    a, b = (np.array([x]) if len(own) >= length else np.zeros(0, np.int64) for x in (0, len(own)))
                else:
                    a, b = merged(firsts[cuts[k] : cuts[k + 1]], lasts[cuts[k] : cuts[k + 1]])
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(own)]
                kept.append(b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": x, "end": y} for x, y in zip(edges[1::2], edges[2::2])])
            columns = [batch.column("k1"), batch.column("k2"), np.diff(offsets), spans, [hashlib.sha256(x).hexdigest() for x in kept], kept]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    judged = texts.join(marks.hint("shuffle_hash"), ["k1", "k2"], "left").select("k1", "k2", "many", "text", "marks").mapInArrow(run, ddl)
    judged = materialize(spark, judged, "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), *_key(text)).join(judged, ["k1", "k2"]).drop("k1", "k2")
