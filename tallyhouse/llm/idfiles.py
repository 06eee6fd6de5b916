"""Token ids in files of byte-aligned variable length, frequent ids shortest.

Ids are replaced by their rank of frequency over the whole table, so that the most
frequent 256 take one byte. Four ids share a control byte with two bits for the
length of each; control bytes and id bytes are separate streams. Reading looks up a
control byte's four lengths in a numpy table and gathers the bytes without a loop.

A file is a row of a Parquet table, as only Spark's writers reach every store: part,
number, ids ahead of it in its part, doc_ids, ids of each document, control stream,
data stream. A part holds a range of rows in their order, parts ascend, and files of a part are
numbered in order. A file takes ``FILE_IDS`` ids or one longer document. The ids by rank
stand beside the files, so any session can read them.

Texts are encoded where they are read, ids counted in the same pass; the ids, shorter than
the texts, are then put in order and written once, as ranks. The order is that of doc_id,
of the texts' hash and of the rows' numbers, so an id that many rows share is many parts.

A null or empty text is the end id alone. Null ids come first; rows with equal ids
stand in the order of their texts' hash. An empty table gives an empty one. Only the
columns named are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyhouse.llm.tokens import encoder
from tallyhouse.session import scratch

FILE_IDS = 1 << 18
#: Lengths of the four values of every control byte, lowest two bits first.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of values below 2**32."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    wide = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) < size[:, None]].tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of the two streams."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    wide = np.zeros((n, 4), dtype=np.uint8)
    wide[np.arange(4) < size[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return wide.view("<u4").ravel()


def write_ids(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> np.ndarray:
    """Writes the files and the ids by rank (a table as long as the vocabulary) below
    ``path``; returns the latter. Texts are encoded once."""
    kind = docs.schema[id_col].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = pa.field("doc_id", to_arrow_type(kind))
    encoded = pa.schema([key, ("text_hash", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's ids; behind a task's rows one without ids, with how often it met each id."""
        total, row = np.zeros(0, dtype=np.int64), TaskContext.get().partitionId() << 33
        for batch in batches:
            held = [np.append(ids, np.uint32(end_id)).astype("<u4") for ids in encoder(tokenizer).encode(batch.column(2))]
            n = np.bincount(np.concatenate(held)) if held else np.zeros(0, np.int64)
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
            numbers = pa.array(np.arange(row, row + len(held)))
            row += len(held)
            sizes = pa.array([len(x) for x in held], pa.int64())
            # two bytes an id in rows where each fits
            ids = pa.array([(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in held], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key.type), batch.column(1), numbers, sizes, ids, pa.nulls(len(held), pa.binary())], schema=encoded)
        last = [pa.array([x], f.type) for x, f in zip((None, None, None, None, None, total.tobytes()), encoded, strict=True)]
        yield pa.RecordBatch.from_arrays(last, schema=encoded)

    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    stored = scratch(spark, "ids")
    ddl = f"doc_id {kind.simpleString()}, text_hash long, row long, n long, ids binary, counts binary"
    texts.mapInArrow(coded, ddl).write.option("compression", "zstd").parquet(stored)
    table = spark.read.parquet(stored)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                n = np.frombuffer(raw.as_buffer(), dtype=np.int64)
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = table.where("counts IS NOT NULL").select("counts").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one row per id of the vocabulary
    ranked = [r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))]
    spark.createDataFrame(list(enumerate(ranked)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    by_rank = np.array(ranked, dtype=np.uint32)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    file = pa.schema(
        [
            ("part", pa.int32()), ("number", pa.int32()), ("ahead", pa.int64()), ("doc_ids", pa.list_(key.type)), ("sizes", pa.list_(pa.int64())),
            ("control", pa.binary()), ("data", pa.binary()),
        ]
    )

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ahead = TaskContext.get().partitionId(), 0, 0
        keys, held, sizes = [], [], []

        def written() -> pa.RecordBatch:
            row = (part, number, ahead, keys, sizes, *pack_values(rank[np.concatenate(held)]))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, file, strict=True)], schema=file)

        size = 0
        for batch in batches:
            for name, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and size + n > FILE_IDS:
                    yield written()
                    number, ahead = number + 1, ahead + size
                    keys, held, sizes, size = [], [], [], 0
                keys.append(name)
                held.append(np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4"))
                sizes.append(n)
                size += n
        if held:
            yield written()

    order = ["doc_id", "text_hash", "row"]
    ordered = table.where("ids IS NOT NULL").select(*order, "n", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ddl = f"part int, number int, ahead long, doc_ids array<{kind.simpleString()}>, sizes array<long>, control binary, data binary"
    ordered.select("doc_id", "n", "ids").mapInArrow(files, ddl).write.parquet(f"{path}/files")
    return by_rank


def read_ranks(spark: SparkSession, path: str) -> np.ndarray:
    """The ids by rank of the files below ``path``: a table as long as the vocabulary."""
    found = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()
    return np.array([r.id for r in found], dtype=np.uint32)


def read_ids(spark: SparkSession, path: str, by_rank: np.ndarray | None = None) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before
    it), n_tokens, ids. ``by_rank`` is read from beside the files if not given."""
    return _read(spark, path, by_rank, "ids", pa.list_(pa.int64()), "array<long>", lambda ids: ids.astype(np.int64))


def read_checksums(spark: SparkSession, path: str, by_rank: np.ndarray | None = None) -> DataFrame:
    """``read_ids`` with a checksum of every document's ids in place of them."""
    return _read(spark, path, by_rank, "ids_crc32", pa.int64(), "long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, by_rank: np.ndarray | None, name: str, arrow: pa.DataType, sql: str, last) -> DataFrame:
    by_rank = read_ranks(spark, path) if by_rank is None else by_rank
    table = spark.read.parquet(f"{path}/files")
    ends = table.groupBy("part").agg(F.max(F.col("ahead") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, at = {}, 0
    for r in ends.orderBy("part").collect():  # a number per part, and parts are shuffle partitions
        before[r.part], at = at, at + r.n
    kind = table.schema["doc_ids"].dataType.elementType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, arrow)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ahead, keys, sizes, control, data in zip(*(batch.column(c) for c in ("part", "ahead", "doc_ids", "sizes", "control", "data")), strict=True):
                n = np.array(sizes.as_py(), dtype=np.int64)
                ids = by_rank[unpack_values(control.as_buffer(), data.as_buffer(), int(n.sum()))]
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.values.cast(schema[0].type), pa.array(before[part.as_py()] + ahead.as_py() + ends - n), pa.array(n),
                        pa.array([last(x) for x in np.split(ids, ends[:-1])], arrow),
                    ],
                    schema=schema,
                )

    return table.mapInArrow(rows, f"doc_id {kind.simpleString()}, start long, n_tokens long, {name} {sql}")
