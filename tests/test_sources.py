import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from panelwright.sources import files, tables

PAGE = """<html><body><p>no table</p><table id=c><tr><th rowspan=2>Date</th><th colspan="2">Added</th></tr>
<tr><th>Ticker</th><th>Name</th></tr><tr><td rowspan=2>2020<br>May</td><td>AB.C<sup>[1]</sup></td><td>A &amp; B</td></tr>
<tr><td>X<table><tr><td>inner</table></td><td></td></tr></table><table><tr></tr></table></body></html>"""

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINKS}"><sheets><sheet name="Prices" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>date</t></si><si><r><t>clo</t></r><r><t>se</t></r></si></sst>")
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>20240131</v></c><c r="B3" t="inlineStr"><is><t>x</t></is></c><c r="C3"><v>1.5</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


def test_html_tables(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "b.html").write_text("")
    out = tables.read_html_tables(spark, str(tmp_path)).cache()
    got = {(r["tbl"], r["row"]): (r["header"], r["cells"]) for r in out.collect()}
    assert got == {
        ("0", 0): (True, ["Date", "Added", "Added"]),
        ("0", 1): (True, ["Date", "Ticker", "Name"]),
        ("0", 2): (False, ["2020 May", "AB.C", "A & B"]),
        ("0", 3): (False, ["2020 May", "X", ""]),
        ("1", 0): (False, ["inner"]),
        ("2", 0): (False, []),
    }
    assert [r["names"] for r in tables.flat_header(out).collect()] == [["Date", "Added_Ticker", "Added_Name"]]


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "book.xlsx")
    out = tables.read_xlsx(spark, str(tmp_path))
    assert [(r["tbl"], r["row"], r["cells"]) for r in out.orderBy("row").collect()] == [("Prices", 0, ["date", None, "close"]), ("Prices", 2, ["20240131", "x", "1.5"])]
    day = out.filter("row = 2").select(tables.day_of_number(F.col("cells")[0]).alias("d")).first()["d"]
    assert day == datetime.date(2024, 1, 31)


def test_days_of_numbers(spark):
    rows = spark.createDataFrame([("20240229",), ("20230229",), ("2024-01-31",), ("20240131.0",), (None,)], "x string")
    got = [r["d"] for r in rows.select(tables.day_of_number("x").alias("d")).collect()]
    assert got == [datetime.date(2024, 2, 29), None, None, datetime.date(2024, 1, 31), None]


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_artefacts(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "a,b", [1, 2]), (2, None, None)], "k long, name string, xs array<int>")
    path = str(tmp_path / "out")
    tables.write_artefact(rows, path, kind)
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    back = {int(r["k"]): (r["name"], r["xs"]) for r in reader.format(kind).load(path).collect()}
    assert back == {1: ("a,b", "[1,2]" if kind == "csv" else [1, 2]), 2: (None, None)}
    with pytest.raises(ValueError):
        tables.write_artefact(rows, path, "pickle")


def test_series_and_members(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,V\n2020-01-01,1.5\n2020-01-02,.\nbad,3\n")
    got = [(str(r["d"]), r["v"]) for r in files.read_series_csv(spark, str(tmp_path / "s.csv"), "DATE", "V").orderBy("d").collect()]
    assert got == [("2020-01-01", 1.5), ("2020-01-02", None)]
    (tmp_path / "m.csv").write_text('date,tickers\n2020-01-01,"brk.b, AAPL,aapl"\n')
    assert files.read_membership_csv(spark, str(tmp_path / "m.csv")).first()["tickers"] == ["AAPL", "BRK-B"]


def test_window_store(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "w long, src string, dst string, weight double"
    (tmp_path / "store").mkdir()
    assert files.read_windows(spark, path, schema).count() == 0
    files.write_windows(spark.createDataFrame([(1, "a", "b", 0.5)], schema), path)
    jobs = spark.createDataFrame([(1,), (2,)], "w long")
    done = files.read_windows(spark, path, schema)
    assert [r["w"] for r in files.pending_windows(jobs, done).collect()] == [2]
    files.write_windows(spark.createDataFrame([(2, "b", "a", 0.1)], schema), path)
    assert sorted(r["w"] for r in files.read_windows(spark, path, schema).collect()) == [1, 2]
