"""Workbooks made here, part by part, and delimited files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from factgrid.sources.records import read_csv, read_excel, sniff_delimiter
from factgrid.sources.workbooks import Workbook, sheet_rows

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = f"""<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="[Red]0.00&quot; days&quot;"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="21"/><xf numFmtId="46"/></cellXfs></styleSheet>"""
SHARED = f"<sst {MAIN}><si><t>Name</t></si><si><r><t>Jo</t></r><r><t xml:space='preserve'>an &amp; Co</t></r><rPh sb='0' eb='1'><t>reading</t></rPh></si><si><t/></si></sst>"


def sheet(*rows):
    return f"<worksheet {MAIN}><cols><col min='1' max='9'/></cols><sheetData>{''.join(rows)}</sheetData></worksheet>"


def book(path, sheets, shared=SHARED, active=0, base=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        tabs = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}"><workbookPr {base}/><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", STYLES)
        if shared:
            z.writestr("xl/sharedStrings.xml", shared)
        for i, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", xml)
    return str(path)


CELLS = sheet(
    "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='inlineStr'><is><t>When</t></is></c><c r='D1' t='str'><v>Total</v></c></row>",
    "<row r='2'><c r='A2' t='s'><v>1</v></c><c r='B2' s='1'><v>45000.75</v></c><c r='C2' t='b'><v>1</v></c><c r='D2'><f>1+1</f><v>2</v></c><c r='E2'><v>9</v></c></row>",
    "<row r='4'><c r='A4' t='s'><v>2</v></c><c r='B4' s='4'><v>0.5</v></c><c r='C4' t='e'><v>#DIV/0!</v></c><c r='D4' s='3'><v>2.50</v></c></row>",
    "<row><c t='inlineStr'><is><t>last</t></is></c><c s='2'><v>59</v></c><c s='5'><v>1.5</v></c><c><v>1E3</v></c></row>",
)


def test_values_of_cells(tmp_path):
    rows = list(Workbook(open(book(tmp_path / "a.xlsx", {"One": CELLS}), "rb").read()).rows(None))
    assert rows == [
        ["Name", "When", None, "Total"],
        ["Joan & Co", "2023-03-15 18:00:00", "True", "2", "9"],
        [],
        ["", "12:00:00", "#DIV/0!", "2.5"],
        ["last", "1900-02-28 00:00:00", "1 day, 12:00:00", "1000.0"],
    ]
    late = book(tmp_path / "b.xlsx", {"One": sheet("<row><c s='1'><v>1</v></c></row>")}, base='date1904="1"')
    assert list(Workbook(open(late, "rb").read()).rows("One")) == [["1904-01-02 00:00:00"]]


def test_entries_of_workbooks(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"One": CELLS, "Two": sheet("<row><c t='s'><v>0</v></c></row>", "<row><c><v>7</v></c></row>")}, active=1)
    one = read_excel(spark, f"file://{tmp_path}/a.xlsx", "One", id_column="Name", tag_columns=["Total"]).collect()
    assert (one[0].id, one[0].text, one[0].tags) == ("Joan & Co", "Joan & Co\nWhen: 2023-03-15 18:00:00\ncol_2: True\nTotal: 2", ["2"])
    assert len(one) == 4 and (one[1].id, one[1].text) == (None, "")  # a row that is not stored
    assert [r.text for r in read_excel(spark, f"file://{tmp_path}/a.xlsx").collect()] == ["Name: 7"]
    with pytest.raises(Exception, match="no sheet"):
        read_excel(spark, f"file://{tmp_path}/a.xlsx", "Three").collect()


def test_folder_of_workbooks(spark, tmp_path):
    cell = lambda t: f"<c t='inlineStr'><is><t>{t}</t></is></c>"
    table = lambda *rows: sheet(*["<row>" + "".join(map(cell, r)) + "</row>" for r in rows])
    many = [[f"k{i}", f"v{i}"] for i in range(9000)]
    book(tmp_path / "a.xlsx", {"S": table(["Key", "Value"], *many)}, shared="")
    book(tmp_path / "b.xlsx", {"S": table(["Extra", "Key", "Key"], ["x", "lost", "kept", "beyond"])}, shared="")
    book(tmp_path / "c.xlsx", {"S": sheet()}, shared="")
    rows = sheet_rows(spark, f"file://{tmp_path}/*.xlsx")
    assert sorted(rows.columns) == ["Extra", "Key", "Value"]
    got = {(r.Key, r.Value, r.Extra) for r in rows.collect()}
    assert got == {(k, v, None) for k, v in many} | {("kept", None, "x")}
    ids = [r.id for r in read_excel(spark, f"file://{tmp_path}/a.xlsx").collect()]
    assert ids == [f"row_{i}" for i in range(9000)]
    assert read_excel(spark, f"file://{tmp_path}/c.xlsx").count() == 0


@pytest.mark.parametrize(
    "head, mark",
    [
        ('"a, b, c, d";x;y\n1;2;3', ";"),
        ("name, first;amount\nX;1\nY;2", ";"),
        ("a\tb\n1,5\t2,5\n3,5\t4,5", "\t"),
        ('a|b\n"x|y;z;w"|2\n"line\nbreak"|3', "|"),
        ("﻿a,b\n1,2", ","),
        ("\n\nonly\n1\n2", ","),
        ("", ","),
        ("a;b\n1;2\n\n3;4", ";"),
    ],
)
def test_delimiter(head, mark):
    assert sniff_delimiter(head) == mark


def test_csv_with_commas_in_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;"price, net";note\n' + "".join(f'R{i};"{i},5";"a; b\n, c"\n' for i in range(60)))
    got = read_csv(spark, f"file://{tmp_path}/a.csv", id_column="id").orderBy(F.length("id"), "id").collect()
    assert len(got) == 60 and got[1].text == "R1\nprice, net: 1,5\nnote: a; b\n, c"
