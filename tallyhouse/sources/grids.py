"""From grid rows (file, sheet, row number, cells) to named columns.

A sheet is bounded by the file format (1 048 576 rows), a file set is not; every
step aggregates per sheet on the map side or is a plain projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.columns import is_blank, strip
from tallyhouse.session import materialize
from tallyhouse.sources.workbooks import CELLS
from tallyhouse.specs import FILE, HEADER_SCAN_ROWS, ROW, SHEET, FeedSpec

SHEET_KEY = [FILE, SHEET]


def filled(cells: Column) -> Column:
    """Number of non-blank cells of a row."""
    return F.size(F.filter(cells, lambda c: ~is_blank(c)))


def drop_ghost_sheets(grid: DataFrame) -> DataFrame:
    """Sheets without any non-blank cell go, and so do sheets with only a header."""
    sizes = grid.groupBy(*SHEET_KEY).agg(
        F.max(ROW).alias("last_row"), F.max(filled(F.col(CELLS))).alias("fullest")
    )
    live = sizes.join(_headers(grid), SHEET_KEY).filter("fullest > 0 and last_row > header_row")
    return grid.join(_listed(live.select(*SHEET_KEY)), SHEET_KEY, "left_semi")


def _listed(sheets: DataFrame) -> DataFrame:
    """One row per sheet as a stored table: its true size decides whether the rows
    meet it by broadcast or by merge, where a sheet that dominates can be split."""
    return materialize(sheets.sparkSession, sheets, "sheets")


def detect_header(grid: DataFrame, max_scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """Per sheet the fullest of the first rows, the earliest one on a tie."""
    return _headers(grid, max_scan).select(
        *SHEET_KEY, "header_row", filled(F.col("header")).alias("n_cells")
    )


def _headers(grid: DataFrame, max_scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """Header row and cells per sheet. A sheet that starts below the rows looked at has
    its first row, a blank one, for a header."""
    best = grid.filter(F.col(ROW) < max_scan).groupBy(*SHEET_KEY)
    best = best.agg(
        F.max_by(F.struct(ROW, CELLS), F.struct(filled(F.col(CELLS)), -F.col(ROW))).alias("h")
    )
    sheets = grid.groupBy(*SHEET_KEY).agg(F.max(F.size(CELLS)).alias("width"))
    blank = F.array_repeat(F.lit(None).cast("string"), F.col("width"))
    return sheets.join(best, SHEET_KEY, "left").select(
        *SHEET_KEY,
        F.coalesce(F.col(f"h.{ROW}"), F.lit(0)).alias("header_row"),
        F.coalesce(F.col(f"h.{CELLS}"), blank).alias("header"),
    )


def header_names(header: Column) -> Column:
    """Trimmed header texts; an empty header cell is named after its position, and a
    repeated text gets its position behind it."""
    names = F.transform(
        header,
        lambda c, i: F.when(c.isNull(), F.concat(F.lit("_col"), i.cast("string"))).otherwise(
            strip(c)
        ),
    )
    return F.transform(
        names,
        lambda c, i: F.when(
            F.array_position(names, c) <= i, F.concat(c, F.lit("_col"), i.cast("string"))
        ).otherwise(c),
    )


def grid_to_table(
    grid: DataFrame, columns: Sequence[str] | None = None, max_scan: int = HEADER_SCAN_ROWS
) -> DataFrame:
    """Rows below the header as text columns plus file, sheet and row number.

    Sheets of different layouts go through one projection: each cell is found by
    the position of its name in the header of its own sheet. Without ``columns``
    the distinct header names, a piece of metadata, are looked up first.
    """
    named = _headers(grid, max_scan).withColumn("header", header_names(F.col("header")))
    headers = _listed(named)
    if columns is None:
        names = headers.select(F.posexplode("header").alias("at", "name"))
        ordered = names.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name")
        columns = [r["name"] for r in ordered.collect()]
        folded = F.col("header")
    else:
        folded = F.transform("header", lambda c: F.lower(c))
    body = grid.join(headers.withColumn("header", folded), SHEET_KEY).filter(
        F.col(ROW) > F.col("header_row")
    )
    cells = [
        F.get(F.col(CELLS), (F.array_position("header", F.lit(n)) - 1).cast("int")).alias(n)
        for n in columns
    ]
    return body.select(*SHEET_KEY, ROW, *cells)


def source_system_tag(file: Column, sheet: Column) -> Column:
    """Channel of a sheet by its names; the first match wins."""
    stem = F.lower(F.regexp_replace(file, r"\.[^.]*$", ""))
    sheet = F.lower(sheet)
    return (
        F.when(stem.contains("pos") | (sheet == "sales"), "POS")
        .when(stem.contains("online") | (sheet == "orders"), "ONLINE")
        .when(stem.contains("promo") | sheet.contains("promo"), "PROMO")
        .when(stem.contains("campaign") | sheet.contains("campaign"), "MARKETING")
        .when(stem.contains("competitor") | sheet.contains("competitor"), "COMPETITOR")
        .otherwise("UNKNOWN")
    )


def route_sheet(sheet: Column, specs: Sequence[FeedSpec]) -> Column:
    """Name of the first enabled spec that takes the sheet, NULL when none does."""
    route = F.lit(None).cast("string")
    for spec in reversed([s for s in specs if s.enabled]):
        takes = F.lit(True) if spec.sheet == "*" else F.lower(sheet) == spec.sheet.lower()
        route = F.when(takes, spec.name).otherwise(route)
    return route
