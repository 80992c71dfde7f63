"""Rows of spreadsheet workbooks (zipped XML), read by Spark tasks.

A workbook is read whole by one task, as its compression allows no start in
the middle: the archive's bytes and its table of shared texts are held, its
rows are streamed from the XML into Arrow batches. A sheet has at most 2^20
rows by its format; many workbooks are as many tasks. The driver sees headers.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch.
BATCH_ROWS = 4096
# Number formats of the file format that show dates and times, and letters that stand for parts of them.
DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])
ELAPSED_FORMATS = frozenset([46])
DATE_LETTERS = re.compile(r"[dmyhs]", re.IGNORECASE)
ELAPSED = re.compile(r"\[(?:h+|m+|s+)\]", re.IGNORECASE)
#: What a number format shows as it stands, and its colours and conditions.
NOT_SHOWN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]')


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node: ET.Element, name: str) -> str | None:
    """An attribute by its name in any namespace (transitional and strict files have different ones)."""
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _nodes(book: zipfile.ZipFile, part: str, *names: str) -> Iterator[ET.Element]:
    """Finished elements of some names in a part of the archive, forgotten afterwards; none if there is no such part."""
    if part not in book.namelist():
        return
    with book.open(part) as f:
        path: list[ET.Element] = []
        for event, node in ET.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(node)
                continue
            path.pop()
            if _local(node.tag) in names:
                yield node
                if path and not any(_local(p.tag) in names for p in path):
                    path[-1].remove(node)


def _shown(node: ET.Element) -> str:
    """The text of a cell's or shared string's runs, without readings in another script."""
    if _local(node.tag) == "t":
        return node.text or ""
    return "".join(_shown(x) for x in node if _local(x.tag) != "rPh")


def _kind(code: str) -> str:
    """What a number format makes of a number: ``date``, ``elapsed`` or ``number``."""
    first = code.split(";", 1)[0]
    if ELAPSED.search(first):
        return "elapsed"
    return "date" if DATE_LETTERS.search(NOT_SHOWN.sub("", first)) else "number"


class Workbook:
    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        links = {_attribute(x, "Id"): x.get("Target", "") for x in _nodes(self.zip, "xl/_rels/workbook.xml.rels", "Relationship")}
        self.sheets: dict[str, str] = {}
        self.first, self.from_1904 = 0, False
        for x in _nodes(self.zip, "xl/workbook.xml", "sheet", "workbookView", "workbookPr"):
            if _local(x.tag) == "sheet":
                target = links.get(_attribute(x, "id"), "")
                self.sheets[x.get("name", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            elif _local(x.tag) == "workbookView":
                self.first = int(x.get("activeTab", 0))
            else:
                self.from_1904 = x.get("date1904") in ("1", "true")
        self.shared = [_shown(x) for x in _nodes(self.zip, "xl/sharedStrings.xml", "si")]
        self.kinds = self._kinds()

    def _kinds(self) -> list[str]:
        """What the cell styles make of numbers."""
        codes, kinds = {}, []
        for x in _nodes(self.zip, "xl/styles.xml", "numFmt", "cellXfs"):
            if _local(x.tag) == "numFmt":
                codes[int(x.get("numFmtId", 0))] = _kind(x.get("formatCode", ""))
            else:
                for style in x:
                    n = int(style.get("numFmtId", 0))
                    kinds.append(codes.get(n) or ("elapsed" if n in ELAPSED_FORMATS else "date" if n in DATE_FORMATS else "number"))
        return kinds

    def _moment(self, value: float, elapsed: bool) -> str:
        days, rest = divmod(value, 1)
        rest = dt.timedelta(milliseconds=round(rest * 86_400_000))
        if elapsed:
            return str(dt.timedelta(days=days) + rest)
        if 0 <= value < 1 and rest < dt.timedelta(days=1):
            return str((dt.datetime.min + rest).time())
        if self.from_1904:
            return str(dt.datetime(1904, 1, 1) + dt.timedelta(days=days) + rest)
        # the format counts a 29 February 1900 that never was
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(days=days + (0 < value < 60)) + rest)

    def _cell(self, cell: ET.Element) -> str | None:
        """A cell's value as text; of a formula the value that was stored with it."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(_shown(x) for x in cell if _local(x.tag) == "is")
        value = next((x.text for x in cell if _local(x.tag) == "v"), None)
        if value is None:
            return None
        if kind == "s":
            return self.shared[int(value)]
        if kind == "b":
            return str(value.strip() in ("1", "true")).capitalize()
        if kind == "d":
            try:
                return str(dt.datetime.fromisoformat(value))
            except ValueError:
                return value
        if kind != "n":
            return value
        number = float(value) if re.search("[.eE]", value) else int(value)
        style = int(cell.get("s", 0))
        shown = self.kinds[style] if style < len(self.kinds) else "number"
        if shown != "number":
            try:
                return self._moment(number, shown == "elapsed")
            except OverflowError:
                return "#VALUE!"
        return str(number)

    def rows(self, sheet: str | None) -> Iterator[list[str | None]]:
        """The sheet's rows; cells and rows that are not stored are None and empty."""
        if sheet is None:
            part = [*self.sheets.values()][self.first if self.first < len(self.sheets) else 0] if self.sheets else ""
        elif sheet in self.sheets:
            part = self.sheets[sheet]
        else:
            raise ValueError(f"no sheet {sheet!r} among {[*self.sheets]}")
        seen = 0
        for row in _nodes(self.zip, part, "row"):
            at = int(row.get("r", seen + 1))
            while seen + 1 < at:  # rows left out in the file
                seen += 1
                yield []
            seen = at
            cells: list[str | None] = []
            for cell in row:
                if _local(cell.tag) != "c":
                    continue
                place = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (place + 1 - len(cells))
                cells[place] = self._cell(cell)
            yield cells


def _column(ref: str) -> int:
    """The place of a cell's column from its name: A is 0, AA is 26."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _header(rows: Iterator[list[str | None]]) -> list[str]:
    return [f"col_{i}" if c is None else c for i, c in enumerate(next(rows, []))]


def sheet_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows below the header of a workbook's sheet (all text, in order), or of those of a folder or pattern.

    Columns are those of all headers, by name; of repeated names in a header the
    last counts. A cell without a value is null, one without a name is
    ``col_<n>``, cells beyond the header are left out, and a row without cells
    is a row of nulls. Without a header anywhere there are no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def headers(batches):
        for batch in batches:
            got = [_header(Workbook(raw).rows(sheet)) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.string()))], names=["header"])

    found = files.mapInArrow(headers, "header array<string>")
    names: dict[str, None] = {}
    for r in found.distinct().orderBy("header").collect():  # as many as there are tables with other columns
        names |= dict.fromkeys(r.header)
    columns = [*names]

    def body(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], names=columns)

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = Workbook(raw).rows(sheet)
                own = _header(rows)
                place = {n: columns.index(n) for n in own}
                held = []
                for cells in rows:
                    out: list[str | None] = [None] * len(columns)
                    for name, value in zip(own, cells):
                        out[place[name]] = value
                    held.append(out)
                    if len(held) == BATCH_ROWS:
                        yield batch_of(held)
                        held = []
                if held and columns:
                    yield batch_of(held)

    if not columns:
        return spark.createDataFrame([], "`col_0` string")
    return files.mapInArrow(body, ", ".join(f"`{n.replace('`', '``')}` string" for n in columns))
