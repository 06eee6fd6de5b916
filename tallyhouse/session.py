"""Session defaults for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Temporary folders of local sessions without that setting, by application.
_local_bases: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyhouse")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # methods above 8000 bytes are never JIT-compiled; split expressions instead
        .config(METHOD_LIMIT, "8000")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compiled(spark: SparkSession) -> None:
    """Wide projections compile only in methods of at most 8000 bytes; a session that says
    nothing about it runs them interpreted, more than five times slower in a trial."""
    if spark.conf.get(METHOD_LIMIT, None) is None:
        spark.conf.set(METHOD_LIMIT, "8000")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary
    folder, which every executor of a local session can see.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        # a setting of the core: a running session cannot set it
        base = _local_bases.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tallyhouse-")
        _local_bases[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/tallyhouse/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df, name: str, codec: str | None = None):
    """Write ``df`` to the shared folder and read it back, so that later jobs
    start from a table that survives lost executors."""
    path = scratch(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.parquet(path)


@contextmanager
def stored(spark: SparkSession, df, name: str, codec: str | None = None) -> Iterator:
    """As ``materialize``, for as long as the block runs. After it the table is overwritten by
    an empty one, so that what is read in one step only does not stay on disk."""
    path = scratch(spark, name)
    df.write.parquet(path, compression=codec)
    rows = spark.read.parquet(path)
    try:
        yield rows
    finally:
        spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block the shuffle files of a job go when it ends; else they stay until the
    driver happens to collect its garbage. For steps that write what they share to tables."""
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if old is None else spark.conf.set(SHUFFLE_CLEANUP, old)
