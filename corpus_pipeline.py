"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import language, lines, mixing, neardup, packing
from tallyhouse.llm.queries import WORD_TOKENIZER
from tallyhouse.session import materialize


#: Texts go to Python in batches of so many bytes; a number of rows alone bounds no memory.
BATCH = "4m"


def _in_bytes(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Those that the model rejects go: texts that are null
    or without a letter, and those far from every centroid."""
    _in_bytes(spark)
    model = language.fit(docs)
    return docs.where(language.accepted(model, F.col("text")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one. Those that are line for line what
    another one keeps are left for the next stage, which takes them whole."""
    _in_bytes(spark)
    return lines.without_repeats(spark, docs)


def copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Rows that
    repeat it whole stay with it once; rows without an id stay if no other of the group has one."""
    _in_bytes(spark)
    found = neardup.near_duplicates(spark, docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()
    kept = kept.toDF("kept_id", "kept_hash")
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}").cast("string")
    same = own.eqNullSafe(F.col("kept_id")) & F.xxhash64(text).eqNullSafe(F.col("kept_hash"))
    once = rows.join(kept, same).dropDuplicates(["kept_id", "kept_hash"])
    return once.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    _in_bytes(spark)
    return mixing.mixed_rows(spark, docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    _in_bytes(spark)
    return packing.pack(spark, docs, WORD_TOKENIZER)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", copy_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: The models, draws and plans of the stages are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
