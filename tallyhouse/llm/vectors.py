"""What the two vector searches share: usable vectors, blocks and merged answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles): rows whose vector is there and holds finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))


def matrix(column) -> np.ndarray:
    """A column of number lists as rows, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def best(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """The ``k`` best of the answers (query_id, vec_id, score) of all blocks: query_id,
    rank, vec_id, score. Only ``k`` per query and block arrive here."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score_type).alias("score"))


def block_of(n: Column | int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n) if isinstance(n, int) else n).cast("int")
