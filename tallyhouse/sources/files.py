"""Files of the declared feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.specs import FeedSpec

FILES = "feed string, file_name string, path string, length long"


def select_feeds(specs: Sequence[FeedSpec], mode: str = "all") -> list[FeedSpec]:
    """Enabled feeds of the mode, in declared order."""
    return [s for s in specs if s.enabled and (mode == "all" or mode in s.folder.lower())]


def discover_files(
    spark: SparkSession, root: str, specs: Sequence[FeedSpec], mode: str = "all"
) -> DataFrame:
    """(feed, file_name, path, length) in feed and name order; listing only, the
    unread ``content`` column is pruned. Missing folders count as empty."""
    found = spark.createDataFrame([], FILES)
    for spec in select_feeds(specs, mode):
        try:
            files = (
                spark.read.format("binaryFile")
                .option("pathGlobFilter", spec.pattern)
                .load(f"{root}/{spec.folder}".rstrip("/"))
            )
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        name = F.element_at(F.split("path", "/"), -1)
        found = found.union(files.select(F.lit(spec.name), name, "path", "length"))
    return found
