"""Workbooks read back equal to their csv twins; cells of every kind."""

import io
import zipfile

import pytest

from canopy.sources import posts, sheets

ROWS = [("c1", "Tốt <&>", None), (None, None, None), ("c2", "", "x\ny"), ("c3", " two  blanks ", "0012")]


def test_workbooks_are_their_csv_twins(spark, tmp_path):
    df = spark.createDataFrame(ROWS * 30, "comment_id string, label string, note string").repartition(3)
    sheets.write_sheets(df, str(tmp_path / "x"))
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "c"))
    plain = lambda d: sorted(tuple(v or "" for v in r) for r in d.select("comment_id", "label", "note").collect())
    got = posts.read_annotations(spark, [str(tmp_path / "x")])
    assert len(list((tmp_path / "x").iterdir())) == 3 and got.count() == 90
    assert plain(got) == plain(posts.read_annotations(spark, [str(tmp_path / "c")]).filter("comment_id is not null"))


def book(sheet: str, shared: str = "") -> bytes:
    out, main, rel = io.BytesIO(), sheets.MAIN[1:-1], sheets.LINK[1:-3]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="/xl/worksheets/two.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{shared}</sst>')
    return out.getvalue()


def test_cells_of_every_kind(spark, tmp_path):
    sheet = ('<row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2" t="inlineStr"><is><t>row</t></is></c><c r="E2" t="s"><v>0</v></c></row><row r="3"/>'
             '<row r="4"><c r="A4"><v>9</v></c><c r="B4"><v>1.5</v></c><c r="D4" t="b"><v>1</v></c></row>'
             '<row r="5"><c r="B5" t="e"><v>#N/A</v></c><c r="D5" t="str"><v>sum</v></c></row><row r="6"><c r="B6" t="s"><v>1</v></c><c r="AB6"><v>7</v></c></row>')
    (tmp_path / "a.xlsx").write_bytes(book(sheet, "<si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si><si><t/></si>"))
    got = sheets.read_sheet(spark, [str(tmp_path)], "B")
    assert got.columns == ["file", "row", "name", "row_"]
    assert [(r["row"], r["name"], r["row_"]) for r in got.orderBy("row").collect()] == [(4, "1.5", "True"), (5, None, "sum")]
    assert sheets.read_sheet(spark, [str(tmp_path)], 0).count() == 0
    assert [sheets.column_number(x) for x in ("A1", "Z9", "AA3", "BA1")] == [0, 25, 26, 52]
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="no readable workbook"):
        sheets.read_sheet(spark, [str(tmp_path)], "B")
