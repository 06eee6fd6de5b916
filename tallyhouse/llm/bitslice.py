"""Exact top-k inner products over a bit-sliced index.

A component x becomes the integer floor(256 * x). Rows are dealt to blocks of about
``BLOCK``; in a block every attribute, moved to start at 0, is a pile of bitmaps, one
per binary digit, a bit per row. A query's scores are never computed row by row: the
bitmaps of each attribute are added as often as the query's digits say, shifted, by
full adders on whole bitmaps (negative query components take the complement of the
attribute's digits, which differs from its negation by a constant). The outcome is the
bit-sliced score. Going down from its most significant slice, rows that have the bit
stay as long as at least k of them remain; what is left at the last slice are rows
tied at the boundary, resolved by their ids; the digits of the few selected rows give
their exact scores.

Every query of a block of queries meets every block of rows once; k answers of each
are merged.

Vectors that are null or hold null or non-finite components take no part. A shorter
vector counts as filled up with zeros. Ties go to the smaller vec_id; rows repeated
under one id are candidates each for itself, and a query leaves out the rows of its own
id. A query id that is repeated is asked once, with its smallest vector. Null ids take
no part. Without queries or rows the answer is empty. Scores must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.vectors import best, block_of, matrix, usable, widened
from tallyhouse.session import materialize

BLOCK = 1 << 16
#: Components of a block at most; wide vectors take blocks of fewer rows.
VALUES = 1 << 22
QUERIES = 256
SCALE = 256


def slices(column: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of the binary digits of non-negative integers, lowest first."""
    padded = np.zeros(-(-len(column) // 64) * 64, dtype=np.int64)
    padded[: len(column)] = column
    top = int(column.max()) if len(column) else 0
    return [np.packbits((padded >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(top.bit_length())]


class Index:
    """The sliced attributes of a block of rows. values: integers, a row each."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low = self.values.min(axis=0)
        self.plain = [slices(c) for c in (self.values - self.low).T]
        self.all = np.packbits(np.arange(-(-len(ids) // 64) * 64) < len(ids), bitorder="little").view(np.uint64)
        self.turned = [[b ^ self.all for b in pile] for pile in self.plain]

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """The bit-sliced sum, lowest digit first; it differs from the inner product by
        the same constant in every row."""
        columns: list[list[np.ndarray]] = []
        for q, plain, turned in zip(query.tolist(), self.plain, self.turned, strict=True):
            pile, digits = (plain, q) if q > 0 else (turned, -q)
            shift = 0
            while digits:
                if digits & 1:
                    while len(columns) < shift + len(pile):
                        columns.append([])
                    for b, bits in enumerate(pile, shift):
                        columns[b].append(bits)
                digits, shift = digits >> 1, shift + 1
        out, weight = [], 0
        while weight < len(columns):
            pile = columns[weight]
            if weight + 1 == len(columns) and len(pile) > 1:
                columns.append([])
            carry = columns[weight + 1] if weight + 1 < len(columns) else []
            while len(pile) > 2:  # full adder: three bitmaps of a digit make one here and one above
                a, b, c = pile.pop(), pile.pop(), pile.pop()
                half = a ^ b
                carry.append((a & b) | (half & c))
                pile.append(half ^ c)
            if len(pile) == 2:
                a, b = pile
                carry.append(a & b)
                pile = [a ^ b]
            out.append(pile[0] if pile else np.zeros_like(self.all))
            weight += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows of the block."""
        left = self.all.copy()
        own = np.arange(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right"))
        for i in own.tolist():
            left[i >> 6] &= ~np.uint64(1 << (i & 63))
        sure, wanted = np.zeros_like(left), k
        for bits in reversed(self.score_slices(query)):
            high = left & bits
            n = int(np.bitwise_count(high).sum())
            if n >= wanted:
                left = high
            else:  # all of these are in, the rest is sought among the others
                sure, wanted, left = sure | high, wanted - n, left & ~bits
            if not wanted:
                break
        rows = np.concatenate([_places(sure), _places(left)[:wanted]])  # tied rows stand in order of their ids
        if not len(rows):
            return []
        score = self.values[rows] @ query
        return [(int(self.ids[r]), int(s)) for r, s in zip(rows, score, strict=True)]


def _places(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64)
    at, bit = np.nonzero(bits)
    return words[at] * 64 + bit


def _quantised(v: np.ndarray) -> np.ndarray:
    return np.floor(v * SCALE).astype(np.int64)


def top_k(
    spark: SparkSession, table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = BLOCK, queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the exact answers of the rows whose id is divisible by ``every``."""
    rows = materialize(spark, usable(table, id_col, vector_col), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    size, m = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first(), asked.count()
    n, block = size.n, min(block, max(1, VALUES // max(1, size.width or 1)))
    row_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // queries))

    # every block of rows meets every block of queries
    held = rows.withColumn("block", block_of(row_blocks, F.monotonically_increasing_id())).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("query_block", block_of(query_blocks, "query_id")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def meet(own: pa.Table, others: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if own.num_rows and others.num_rows:
            v, q = _quantised(matrix(own["v"])), _quantised(matrix(others["q"]))
            width = max(v.shape[1], q.shape[1])
            index = Index(own["vec_id"].to_numpy(), widened(v, width))
            for query_id, query in zip(others["query_id"].to_pylist(), widened(q, width), strict=True):
                for vec_id, score in index.top(query_id, query, k):
                    for column, x in zip(out, (query_id, vec_id, score), strict=True):
                        column.append(x)
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    pairs = held.groupBy("block", "query_block").cogroup(asked.groupBy("block", "query_block"))
    return best(pairs.applyInArrow(meet, "query_id long, vec_id long, score long"), k, "long")
