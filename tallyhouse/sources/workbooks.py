"""Spreadsheet workbooks to rows of cell texts.

``binaryFile`` hands one workbook to one task; the decoder streams its sheets and
emits Arrow batches, so memory holds one batch plus the shared string table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.specs import FILE, ROW, SHEET

CELLS = "cells"
GRID = f"{FILE} string, {SHEET} string, {ROW} long, {CELLS} array<string>"

# ---- fixed values: built-in number formats that show a date or a time
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH = datetime(1899, 12, 30)
BATCH = 5000


def scan_workbooks(
    spark: SparkSession, path: str, glob: str = "*.xlsx", sheets: list[str] | None = None
) -> DataFrame:
    """All sheets of all workbooks below ``path``; a missing sheet is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    grid = decode_workbooks(files)
    return pick_sheets(grid, sheets) if sheets else grid


def decode_workbooks(files: DataFrame) -> DataFrame:
    """(path, content) -> grid rows. Row numbers count from 0 in each sheet; a file is known
    by its whole path, since folders may hold files of one name."""
    named = files.select(F.col("path").alias("name"), "content")
    return named.mapInPandas(_decode, GRID)


def pick_sheets(grid: DataFrame, sheets: list[str]) -> DataFrame:
    """Only these sheets; raises when a workbook lacks one of them."""
    names = grid.groupBy(FILE).agg(F.collect_set(SHEET).alias("have"))
    lacking = names.select(
        FILE, F.explode(F.array_except(F.array(*map(F.lit, sheets)), F.col("have"))).alias("sheet")
    ).first()
    if lacking:
        raise KeyError(f"{lacking[FILE]} has no sheet {lacking['sheet']}")
    return grid.filter(F.col(SHEET).isin(sheets))


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, content in zip(batch["name"], batch["content"]):
            yield from _decode_one(name, content)


def _decode_one(name: str, content: bytes) -> Iterator[pd.DataFrame]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = set(book.namelist())
        shared = [_text(si) for si in _nodes(book, parts, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book, parts)
        targets = {
            r.get("Id"): r.get("Target").removeprefix("/xl/")
            for r in _nodes(book, parts, "xl/_rels/workbook.xml.rels", "Relationship")
        }
        for sheet in _nodes(book, parts, "xl/workbook.xml", "sheet"):
            rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            rows, seen = [], False
            for i, el in enumerate(_nodes(book, parts, f"xl/{targets.get(rid)}", "row")):
                number = int(el.get("r", i + 1)) - 1
                rows.append((name, sheet.get("name"), number, _row(el, shared, dates)))
                if len(rows) == BATCH:
                    yield _frame(rows)
                    rows, seen = [], True
            if not rows and not seen:
                rows = [(name, sheet.get("name"), 0, [])]  # shows that the sheet exists
            if rows:
                yield _frame(rows)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[FILE, SHEET, ROW, CELLS])


def _local(el, tag: str) -> bool:
    return el.tag.rpartition("}")[2] == tag


def _nodes(book, parts, member: str, tag: str):
    """Stream the elements of one kind out of one member."""
    if member not in parts:
        return
    with book.open(member) as f:
        for _, el in ElementTree.iterparse(f):
            if _local(el, tag):
                yield el
                el.clear()


def _date_styles(book, parts) -> set[int]:
    """Positions of the cell styles that show dates."""
    if "xl/styles.xml" not in parts:
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter()
        if _local(f, "numFmt")
        and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)
    }
    styles = root.find("{*}cellXfs")
    kinds = [int(x.get("numFmtId", 0)) for x in (styles if styles is not None else [])]
    return {i for i, k in enumerate(kinds) if k in DATE_FORMATS or k in custom}


def _row(el, shared: list[str], dates: set[int]) -> list[str | None]:
    cells: list[str | None] = []
    for c in el:
        if not _local(c, "c"):
            continue
        letters = re.match(r"[A-Z]*", c.get("r", "")).group()
        at = 0
        for ch in letters:
            at = at * 26 + ord(ch) - 64
        at = at - 1 if letters else len(cells)
        cells.extend([None] * (at + 1 - len(cells)))
        cells[at] = _value(c, shared, dates)
    return cells


def _value(c, shared: list[str], dates: set[int]) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return _text(c)
    v = c.findtext("{*}v")
    if v is None:
        return None
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return "True" if v == "1" else "False"
    if kind == "n" and int(c.get("s", 0)) in dates:
        seconds = round(float(v) * 86400)
        return str(EPOCH + timedelta(seconds=seconds))
    return v


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter() if _local(t, "t"))
