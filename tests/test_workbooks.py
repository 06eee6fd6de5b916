"""Workbook decoding and sheet shapes, on workbooks built in the test."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyhouse.sources.grids import detect_header, drop_ghost_sheets, grid_to_table, source_system_tag
from tallyhouse.sources.workbooks import scan_workbooks
from tallyhouse.specs import FILE, ROW, SHEET
from tallyhouse.testbed import workbook


def save(folder, name, sheets, numeric=False):
    (folder / name).write_bytes(workbook(sheets, numeric))
    return str(folder)


def table(spark, path, sheets=None):
    return grid_to_table(drop_ghost_sheets(scan_workbooks(spark, path, sheets=sheets)))


def test_title_row_is_skipped(spark, tmp_path):
    rows = [["Monthly Sales Report", None, None, None], ["transaction_id", "store_id", "amount", "date"],
            ["T1", "S1", "10", "2024-01-01"], ["T2", "S2", "20", "2024-01-02"]]
    path = save(tmp_path, "a.xlsx", {"Sales": rows})
    header = detect_header(scan_workbooks(spark, path)).first()
    assert (header["header_row"], header["n_cells"]) == (1, 4)
    out = table(spark, path)
    assert out.columns[3:] == ["transaction_id", "store_id", "amount", "date"]
    assert out.count() == 2


def test_short_title_keeps_values(spark, tmp_path):
    rows = [["Q1 Report"], ["sku", "qty", "revenue"], ["SKU001", 10, 500.0]]
    out = table(spark, save(tmp_path, "a.xlsx", {"Data": rows}, numeric=True)).collect()
    assert [(r["sku"], r["qty"], r["revenue"]) for r in out] == [("SKU001", "10", "500.0")]


def test_ghost_sheets_are_dropped(spark, tmp_path):
    path = save(tmp_path, "a.xlsx", {"RealData": [["id"], ["1"]], "EmptySheet": [], "Blank": [[" ", None]]})
    kept = drop_ghost_sheets(scan_workbooks(spark, path)).select(SHEET).distinct().collect()
    assert [r[0] for r in kept] == ["RealData"]


def test_all_ghost(spark, tmp_path):
    path = save(tmp_path, "a.xlsx", {"Empty": []})
    assert drop_ghost_sheets(scan_workbooks(spark, path)).count() == 0


def test_named_sheet_and_missing_sheet(spark, tmp_path):
    body = [["id"], ["1"]]
    path = save(tmp_path, "a.xlsx", {"Sales": body, "Notes": body, "Admin": body})
    assert table(spark, path, ["Sales"]).select(SHEET).distinct().collect()[0][0] == "Sales"
    with pytest.raises(KeyError, match="NonExistent"):
        scan_workbooks(spark, path, sheets=["NonExistent"])


def test_layouts_of_different_sheets_meet_in_one_table(spark, tmp_path):
    save(tmp_path, "a.xlsx", {"S": [["id", "x"], ["1", "2"]]})
    path = save(tmp_path, "b.xlsx", {"S": [["x", None, "id", "y"], ["5", "6", "4"]]})
    out = {r[FILE].rsplit("/", 1)[-1]: r.asDict() for r in table(spark, path).collect()}
    assert (out["a.xlsx"]["id"], out["a.xlsx"]["x"], out["a.xlsx"]["_col1"]) == ("1", "2", None)
    assert (out["b.xlsx"]["id"], out["b.xlsx"]["x"], out["b.xlsx"]["_col1"]) == ("4", "5", "6")


def test_header_tie_takes_the_earliest_row(spark):
    grid = spark.createDataFrame(
        [("f", "s", 0, ["t", None]), ("f", "s", 1, ["a", "b"]), ("f", "s", 2, ["c", "d"])],
        f"{FILE} string, {SHEET} string, {ROW} long, cells array<string>",
    )
    assert detect_header(grid).first()["header_row"] == 1


def test_cells_of_every_kind(spark, tmp_path):
    """Shared texts, numbers, booleans, styled dates, formula results, skipped columns."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="/xl/worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>id</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c>'
        '<c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>d</t></is></c><c r="E1" t="str"><v>e</v></c></row>'
        '<row r="3"><c r="A3"><v>7</v></c><c r="B3" t="b"><v>1</v></c><c r="D3" s="1"><v>45293.5</v></c>'
        '<c r="E3" t="str"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    (tmp_path / "k.xlsx").write_bytes(out.getvalue())
    row = table(spark, str(tmp_path)).first()
    assert (row["id"], row["ab"], row["_col2"], row["d"], row["e"]) == ("7", "True", None, "2024-01-02 12:00:00", "2")
    assert row[ROW] == 2


def test_large_sheet_is_read_whole(spark, tmp_path):
    rows = [["n"], *[[str(i)] for i in range(10_000)]]
    out = table(spark, save(tmp_path, "big.xlsx", {"S": rows}))
    assert out.agg(F.sum(F.col("n").cast("int"))).first()[0] == sum(range(10_000))


@pytest.mark.parametrize(
    "file, sheet, tag",
    [("pos_sales_history.xlsx", "x", "POS"), ("b.xlsx", "Orders", "ONLINE"), ("promo_windows.xlsx", "x", "PROMO"),
     ("marketing_campaigns.xlsx", "x", "MARKETING"), ("competitor_prices.xlsx", "x", "COMPETITOR"), ("random.xlsx", "x", "UNKNOWN")],
)
def test_source_tags(spark, file, sheet, tag):
    df = spark.createDataFrame([(file, sheet)], "f string, s string")
    assert df.select(source_system_tag(F.col("f"), F.col("s"))).first()[0] == tag
