"""Zipped documents by the standard library alone: sheets, tables and text of Office Open XML, tables of zipped Prism projects.

Each reader is a column function over the bytes of files. What is not such a document is null, so one
bad file stops no batch. PDF and the binary formats before Office 2007 need libraries that are not
here; their readers are given by the caller (``files.reader``).
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.sources.files import PRISM_TYPE

_ROWS = T.ArrayType(T.ArrayType(T.StringType()))
SHEETS_TYPE = T.ArrayType(T.StructType().add("name", "string").add("rows", _ROWS))
#: The built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), 45, 46, 47}


def _bare(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in e.iter() if _bare(x) == name]


def _said(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _bare(x) == "t")


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def number_text(text: str) -> str:
    """A number in its shortest form, whole ones without a fraction; other text as it is."""
    said = text.strip()
    try:
        value = float(said)
    except ValueError:
        return said
    return str(int(value)) if value.is_integer() else repr(value)


def _moment_text(serial: float, base: dt.datetime) -> str:
    moment = base + dt.timedelta(seconds=round(serial * 86_400))
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(sep=" ")


class _Workbook:
    def __init__(self, z: zipfile.ZipFile):
        self.z, names = z, set(z.namelist())
        book = self._xml("xl/workbook.xml")
        self.base = dt.datetime(1904, 1, 1) if any(_attribute(p, "date1904") in ("1", "true") for p in _all(book, "workbookPr")) else dt.datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in _all(self._xml("xl/_rels/workbook.xml.rels"), "Relationship")}
        self.sheets = [(s.get("name"), posixpath.normpath(posixpath.join("/xl", targets[_attribute(s, "id")])).lstrip("/")) for s in _all(book, "sheet")]
        self.strings = [_said(s) for s in _all(self._xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.z.read(name))

    def _date_styles(self) -> set[int]:
        styles = self._xml("xl/styles.xml")
        plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())
        own = {int(f.get("numFmtId")) for f in _all(styles, "numFmt") if re.search("[ymdhs]", plain(f.get("formatCode", "")))}
        formats = [int(x.get("numFmtId", 0)) for xs in _all(styles, "cellXfs") for x in xs if _bare(x) == "xf"]
        return {k for k, f in enumerate(formats) if f in DATE_FORMATS or f in own}

    def cell(self, c: ElementTree.Element) -> str:
        kind, value = c.get("t", "n"), next((v.text or "" for v in c if _bare(v) == "v"), "")
        if kind == "inlineStr":
            return _said(c)
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            return "True" if value == "1" else "False"
        if kind != "n" or not value:
            return value
        return _moment_text(float(value), self.base) if int(c.get("s", 0)) in self.dates else number_text(value)

    def rows(self, part: str) -> list[list[str]]:
        out: list[list[str]] = []
        for row in _all(self._xml(part), "row"):
            cells: list[str] = []
            for c in row:
                letters = re.match("[A-Z]*", c.get("r", "")).group()
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                cells += [""] * (at - 1 - len(cells)) + [self.cell(c)]
            number = int(row.get("r", len(out) + 1))
            out += [[] for _ in range(number - 1 - len(out))] + [cells]
        width = max(map(len, out), default=0)
        return [r + [""] * (width - len(r)) for r in out]


def _sheets(z: zipfile.ZipFile) -> list[dict]:
    book = _Workbook(z)
    return [{"name": name, "rows": book.rows(part)} for name, part in book.sheets]


def _document(z: zipfile.ZipFile) -> ElementTree.Element:
    return ElementTree.fromstring(z.read("word/document.xml"))


def _word_tables(z: zipfile.ZipFile) -> list[list[list[str]]]:
    cell = lambda c: " ".join(" ".join(_said(p) for p in _all(c, "p")).split())
    return [[[cell(c) for c in r if _bare(c) == "tc"] for r in t if _bare(r) == "tr"] for t in _all(_document(z), "tbl")]


def _word_text(z: zipfile.ZipFile) -> str:
    return "\n".join(_said(p) for p in _all(_document(z), "p"))


def _slides_text(z: zipfile.ZipFile) -> str:
    parts = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return "\n\n".join("\n".join(filter(None, map(_said, _all(ElementTree.fromstring(z.read(n)), "p")))) for _, n in parts)


def _prism_tables(z: zipfile.ZipFile) -> list[dict]:
    """Data sheets in the project's order. A grid has columns of row titles first, then those of X, then of each Y."""
    read = lambda name: json.loads(z.read(name))

    def width(a_set: dict) -> int:
        ranges = [str(r.get("range", "0")).split("~")[-1] for r in a_set.get("replicate ranges") or []]
        return max(map(int, ranges)) + 1 if ranges else len(a_set.get("replicates", [])) or 1

    out = []
    for uid in read("document.json").get("sheets", {}).get("data", []):
        sheet = read(f"data/sheets/{uid}/sheet.json")
        table = sheet.get("table") or {}
        if not table.get("uid"):
            continue
        folder = f"data/tables/{table['uid']}"
        grid = list(csv.reader(io.StringIO(z.read(f"{folder}/data.csv").decode())))  # a binary store raises: not such a document
        x_width = width(read(f"data/sets/{table['xDataSet']}.json")) if table.get("xDataSet") else 0
        ys = [read(f"data/sets/{u}.json") for u in table.get("dataSets", [])]
        first = max(0, int(read(f"{folder}/content.json").get("numberOfColumns", 0)) - x_width - sum(map(width, ys)))
        column = lambda k, grid=grid: [number_text(r[k]) if k < len(r) else "" for r in grid]
        told, at = [], first + x_width
        for y in ys:
            told.append({"title": y.get("title", ""), "subs": [column(at + k) for k in range(width(y))]})
            at += width(y)
        out.append({"title": sheet.get("title", ""), "x": column(first) if x_width else [], "ys": told})
    return out


def _zipped(read: Callable[[zipfile.ZipFile], object], kind: T.DataType) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def column(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> object:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    return read(z)
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, TypeError, AttributeError):
                return None

        return contents.map(one)

    return column


xlsx_sheets = _zipped(_sheets, SHEETS_TYPE)
docx_tables = _zipped(_word_tables, T.ArrayType(_ROWS))
docx_text = _zipped(_word_text, T.StringType())
pptx_text = _zipped(_slides_text, T.StringType())
prism_zip = _zipped(_prism_tables, PRISM_TYPE)


def prose(path: Column, content: Column, pdf: Callable[[Column], Column] | None = None) -> Column:
    """The text of a narrative file by its suffix; null where there is no reader for it."""
    is_ = lambda *suffixes: F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*suffixes)
    told = F.when(is_(".docx"), docx_text(F.when(is_(".docx"), content))).when(is_(".pptx"), pptx_text(F.when(is_(".pptx"), content))).when(is_(".md", ".txt", ".html"), F.decode(content, "UTF-8"))
    return told.when(is_(".pdf"), pdf(F.when(is_(".pdf"), content))) if pdf is not None else told


def sheet_table(rows: Column, drop_blank: bool = True) -> Column:
    """struct(header, rows) of a sheet: the first row is the header, rows without any cell go if asked."""
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    kept = F.filter(body, lambda r: F.exists(r, lambda c: c != "")) if drop_blank else body
    return F.when(F.size(rows) > 0, F.struct(F.get(rows, F.lit(0)).alias("header"), kept.alias("rows")))
