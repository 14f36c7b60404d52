"""Zipped documents, made here part by part."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verdigris.operators import reshape
from verdigris.sources import files, office

MAIN, REL = "http://main", "http://rel"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text if isinstance(text, str) else json.dumps(text))
    return out.getvalue()


def workbook():
    sheet = """<worksheet xmlns="http://main"><sheetData>
      <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c><c r="D1" t="str"><v>note</v></c></row>
      <row r="3"><c r="A3"><v>3.0</v></c><c r="B3" s="1"><v>45065</v></c><c r="C3" t="b"><v>1</v></c></row>
      <row r="4"><c r="A4"><v>0.1</v></c><c r="B4" s="2"><v>45065.604166666664</v></c></row></sheetData></worksheet>"""
    return zipped(**{
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><r><t>do</t></r><r><t>se</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet,
    })


def word():
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    return zipped(**{"word/document.xml": f'<w:document xmlns:w="http://w"><w:body>{run("Intro")}<w:tbl><w:tr><w:tc>{run("a  b")}{run("c")}</w:tc><w:tc>{run("d")}</w:tc></w:tr></w:tbl></w:body></w:document>'})


def slides():
    slide = lambda t: f'<p:sld xmlns:p="http://p" xmlns:a="http://a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p/></p:sld>'
    return zipped(**{"ppt/slides/slide10.xml": slide("last"), "ppt/slides/slide2.xml": slide("first")})


def prism():
    return zipped(**{
        "document.json": {"sheets": {"data": ["s1", "s2"]}},
        "data/sheets/s1/sheet.json": {"title": "Dose", "table": {"uid": "t1", "xDataSet": "x", "dataSets": ["y1", "y2"]}},
        "data/sheets/s2/sheet.json": {"title": "No table"},
        "data/tables/t1/content.json": {"numberOfColumns": 5},
        "data/tables/t1/data.csv": "row a,1.0,0.50,7,x\nrow b,2,,8\n",
        "data/sets/x.json": {"replicates": [0]},
        "data/sets/y1.json": {"title": "PBS", "replicate ranges": [{"range": "0~1"}]},
        "data/sets/y2.json": {"title": "Drug"},
    })


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([("a.xlsx", workbook()), ("b.DOCX", word()), ("c.pptx", slides()), ("d.prism", prism()), ("e.md", b"# plain"), ("f.docx", b"PK\x03\x04 broken"), ("g.pdf", b"%PDF-")], "path string, content binary")
    return lambda name, column: df.where(F.col("path") == name).select(column.alias("x")).first().x


def test_sheets(read):
    (sheet,) = read("a.xlsx", office.xlsx_sheets(F.col("content")))
    assert sheet.name == "Data"
    assert sheet.rows == [["dose", "when", "", "note"], ["", "", "", ""], ["3", "2023-05-19", "True", ""], ["0.1", "2023-05-19 14:30:00", "", ""]]
    table = read("a.xlsx", office.sheet_table(office.xlsx_sheets(F.col("content"))[0].rows))
    assert table.header == ["dose", "when", "", "note"] and len(table.rows) == 2


def test_word_and_slides(read):
    assert read("b.DOCX", office.docx_tables(F.col("content"))) == [[["a b c", "d"]]]
    prose = office.prose(F.col("path"), F.col("content"))
    assert read("b.DOCX", prose).startswith("Intro") and read("c.pptx", prose) == "first\n\nlast" and read("e.md", prose) == "# plain"
    assert read("f.docx", prose) is None and read("g.pdf", prose) is None
    assert read("g.pdf", office.prose(F.col("path"), F.col("content"), files.reader(lambda data: data.decode()[1:4]))) == "PDF"
    assert all(read("e.md", f(F.col("content"))) is None for f in (office.xlsx_sheets, office.docx_tables, office.prism_zip))


def test_prism_project(spark, read):
    (table,) = read("d.prism", office.prism_zip(F.col("content")))
    assert table.title == "Dose" and table.x == ["1", "2"]
    assert [(y.title, y.subs) for y in table.ys] == [("PBS", [["0.5", ""], ["7", "8"]]), ("Drug", [["x", ""]])]
    assert read("d.prism", files.prism_container(F.col("content"))) == "zip"
    wide = reshape.wide(spark.createDataFrame([(prism(),)], "content binary").select(F.explode(office.prism_zip("content")).alias("t")).select("t.*")).first()
    assert wide.header == ["", "PBS_0", "PBS_1", "Drug_2"] and [list(r) for r in wide.rows] == [["1", "0.5", "7", "x"], ["2", "", "8", ""]]
