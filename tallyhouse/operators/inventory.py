"""Table list with exact row counts, and paged reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def table_counts(tables: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """(schema_name, table_name, row_count); counts come from file footers."""
    out = None
    for (schema, table), df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "row_count"
        )
        out = one if out is None else out.unionByName(one)
    return out


def catalog_join(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Listed tables with their counts, 0 where none is known."""
    key = ["schema_name", "table_name"]
    joined = catalog.join(counts, key, "left")
    return joined.select(*key, F.coalesce("row_count", F.lit(0)).alias("row_count")).orderBy(*key)


def table_inventory(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Tables with counts, a subtotal per schema and the grand total."""
    listed = catalog_join(catalog, counts)
    return listed.rollup("schema_name", "table_name").agg(F.sum("row_count").alias("row_count"))


def page_rows(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in a stated order, with the total number of rows."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset not negative")
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)
