"""Packing of documents into sequences of a fixed length, by non-negative least squares.

1. Every document becomes ids and an end id. Whole windows are sequences of their
   own; what remains is shorter than a window.
2. The histogram of remainders over all documents has at most ``window`` bins. The
   shallow combinations of two to four lengths that fill a window exactly, or nearly,
   are enumerated; non-negative least squares gives how often each is repeated, and
   the counts are rounded within what the histogram holds.
3. A remainder takes the slot that its rank among equal lengths leads to. Those that
   no combination takes are packed greedily, largest first: cut into powers of two,
   which fill windows one after another without a gap.

The plan depends on the histogram alone, so a remainder finds its place without
meeting other documents; only counts per (part, length) are shuffled, and a length
that a third of the documents share is ranked part by part.

A null or empty text is the end id alone. Repeated rows and ids are packed each for
itself. An empty table gives no pieces. Only the columns named are read, so others
may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyhouse.llm.tokens import encoder
from tallyhouse.session import materialize

WINDOW = 2048
#: A near combination may leave a window this short.
SLACK = 8
#: Lengths that combinations of three and four start from: the most frequent ones.
LEADERS = 96
PATTERNS = 20_000


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _bits(n: int) -> list[int]:
    """The powers of two that make up ``n``, largest first."""
    return [b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def measured(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: its length, checksums of windows, remainder and the remainder's
    binary parts, its part of the table and its rank there among equal remainders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ranks = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                full, rest = divmod(len(ids), window)
                tail, at, parts = ids[full * window :], 0, []
                for b in _bits(rest):
                    parts.append(_crc(tail[at : at + (1 << b)]))
                    at += 1 << b
                rows.append((
                    key, part, len(ids), full, rest, int(ranks[window]), int(ranks[rest]),
                    [_crc(ids[k * window : (k + 1) * window]) for k in range(full)], _crc(tail), parts,
                ))
                ranks[window] += full
                ranks[rest] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table().to_batches()[0]

    key_type = docs.schema[id_col].dataType
    longs = pa.list_(pa.int64())
    schema = pa.schema([
        ("doc_id", to_arrow_type(key_type)), ("part", pa.int32()), ("doc_tokens", pa.int64()), ("full", pa.int64()), ("rest", pa.int32()),
        ("full_rank", pa.int64()), ("rest_rank", pa.int64()), ("full_crc", longs), ("rest_crc", pa.int64()), ("bit_crc", longs),
    ])
    ddl = f"doc_id {key_type.simpleString()}, part int, doc_tokens long, full long, rest int, full_rank long, rest_rank long, full_crc array<long>, rest_crc long, bit_crc array<long>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of two to four lengths present that fill a window, or all but ``SLACK`` of it."""
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    have = set(lengths.tolist())
    leaders = sorted(lengths.tolist(), key=lambda n: (-histogram[n], n))[:LEADERS]
    found: dict[tuple[int, ...], int] = {}

    def add(*parts: int) -> None:
        need: dict[int, int] = {}
        for n in parts:
            need[n] = need.get(n, 0) + 1
        most = min(int(histogram[n]) // k for n, k in need.items())
        if most:
            found.setdefault(tuple(sorted(parts, reverse=True)), most)

    for a in have:
        for short in range(SLACK + 1):
            b = window - short - a
            if b in have and b <= a:
                add(a, b)
    for i, a in enumerate(leaders):
        for b in leaders[i:]:
            for short in (0, 1, SLACK):
                if (c := window - short - a - b) in have:
                    add(a, b, c)
            if i < LEADERS // 4 and (c := window - a - b) > 1:
                for d in leaders[: LEADERS // 4]:
                    if c - d in have:
                        add(a, b, d, c - d)
    best = sorted(found, key=lambda p: (window - sum(p), -found[p], p))
    return best[:PATTERNS]


def solve(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise the squared distance of the lengths
    they use to the histogram. Multiplicative steps keep x non-negative."""
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.fromiter((n for p in patterns for n in p), np.int64)
    h = histogram.astype(float)
    x = np.ones(len(patterns))
    target = np.bincount(column, weights=h[row], minlength=len(patterns))
    for _ in range(rounds):
        used = np.bincount(row, weights=x[column], minlength=len(h))
        x *= target / np.maximum(np.bincount(column, weights=used[row], minlength=len(patterns)), 1e-12)
    return x


@dataclass
class Plan:
    """Where the remainder of a given length and rank goes."""

    window: int
    first: int  # number of the first sequence after the whole windows
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # rank from, sequence, offset
    planned: np.ndarray | None = None  # ranks below are planned
    tail: int = 0  # number of the first sequence of binary parts
    base: list[int] = field(default_factory=list)  # place of the first part of each power
    before: np.ndarray | None = None  # parts of each power in shorter remainders

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of every piece."""
        if rank < self.planned[length]:
            since, sequence, offset = self.slots[length]
            k = int(np.searchsorted(since, rank, side="right")) - 1
            return [(int(sequence[k]) + rank - int(since[k]), int(offset[k]), length)]
        out, left = [], rank - int(self.planned[length])
        for b in _bits(length):
            at = self.base[b] + (int(self.before[length, b]) + left << b)
            out.append((self.tail + at // self.window, at % self.window, 1 << b))
        return out


def plan(histogram: np.ndarray, windows: int, window: int) -> Plan:
    """histogram: remainders of each length; windows: whole ones, which come first."""
    patterns = combinations(histogram, window)
    repeats = solve(patterns, histogram)
    left, sequence = histogram.copy(), windows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    for k in sorted(range(len(patterns)), key=lambda k: (-repeats[k], patterns[k])):
        need: dict[int, int] = {}
        for n in patterns[k]:
            need[n] = need.get(n, 0) + 1
        times = min(int(repeats[k] + 0.5), *(int(left[n]) // m for n, m in need.items()))
        if times <= 0:
            continue
        offset = 0
        for n in patterns[k]:
            slots.setdefault(n, []).append((int(histogram[n] - left[n]), sequence, offset))
            left[n] -= times
            offset += n
        sequence += times
    out = Plan(window, windows, planned=histogram - left, tail=sequence)
    out.slots = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*s, strict=True)) for n, s in slots.items()}
    powers = window.bit_length()
    has = (np.arange(len(left))[:, None] >> np.arange(powers)) & 1
    parts = has * left[:, None]
    out.before = np.cumsum(parts, axis=0) - parts
    totals, at = parts.sum(axis=0), 0
    out.base = [0] * powers
    for b in range(powers - 1, -1, -1):
        out.base[b] = at
        at += int(totals[b]) << b
    return out


def pack(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a power of two. ``start`` is the place in the document's ids and
    ``offset`` the place in the sequence. Numbers of sequences start at 0 without a gap.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    lengths = materialize(spark, measured(docs, path, end_id, window, id_col, text_col), "lengths")
    # whole windows are ranked as one more length, `window`
    counts = lengths.groupBy("part", F.col("rest").alias("bin")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(lengths.groupBy("part").agg(F.sum("full").alias("n")).withColumn("bin", F.lit(window)))
    counts = materialize(spark, counts, "length-counts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # window + 1 rows at most
        histogram[r.bin] = r.n
    windows, histogram[window] = int(histogram[window]), 0
    histogram[0] = 0
    places = plan(histogram, windows, window)

    earlier = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = lengths.join(offsets.withColumnsRenamed({"bin": "rest", "ahead": "rest_ahead"}), ["part", "rest"])
    ranked = ranked.join(offsets.where(F.col("bin") == window).select("part", F.col("ahead").alias("full_ahead")), "part")
    ranked = ranked.select(
        "doc_id", "doc_tokens", "full", "rest", (F.col("full_ahead") + F.col("full_rank")).alias("full_rank"),
        (F.col("rest_ahead") + F.col("rest_rank")).alias("rest_rank"), "full_crc", "rest_crc", "bit_crc",
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            owner = []
            for i, (n, full, rest, full_rank, rest_rank, full_crc, rest_crc, bit_crc) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                rows = [(k * window, window, full_crc[k], full_rank + k, 0) for k in range(full)]
                at = full * window
                found = places.place(rest, rest_rank) if rest else []
                whole = len(found) == 1
                for k, (sequence, offset, length) in enumerate(found):
                    rows.append((at, length, rest_crc if whole else bit_crc[k], sequence, offset))
                    at += length
                owner.extend([i] * len(rows))
                for start, length, crc, sequence, offset in rows:
                    for column, x in zip(out, (start, length, crc, n, sequence, offset), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in out)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
