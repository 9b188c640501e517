"""Excel workbooks as a Spark source: one partition a workbook, the sheet with the purchase-line headers, values only."""

from __future__ import annotations

import csv
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from costweave.schema import HEADERS, RECEIPT_HEADERS

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that stand for dates by their number.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
#: Headers that a sheet must have at least, and the sheet that is taken first where it has them.
LEAST_HEADERS, FIRST_SHEET = 8, "Sheet2"


def csv_rows(path: Path) -> list[list[str]]:
    with path.open(newline="", encoding="utf-8-sig") as f:
        return list(csv.reader(f))


def _unescaped(text: str) -> str:
    """A stored text with its ``_xHHHH_`` as the characters they stand for."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _rich_text(item: ElementTree.Element) -> str:
    """The text of a shared or inline string: its own or that of its runs, without phonetic hints."""
    runs = [item, *item.findall(f"{_MAIN}r")]
    return _unescaped("".join(t.text or "" for r in runs for t in r.findall(f"{_MAIN}t")))


def _column(reference: str) -> int:
    """Place of a cell reference: A1 is 0, AA1 is 26."""
    place = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        place = 26 * place + ord(letter) - 64
    return place - 1


class Workbook:
    """The sheets of one .xlsx or .xlsm file, cell by cell: shared and inline texts, numbers, booleans and dates."""

    def __init__(self, path: str | Path):
        self.zip = zipfile.ZipFile(path)
        names = set(self.zip.namelist())
        self.texts = []
        if "xl/sharedStrings.xml" in names:
            for item in self._items("xl/sharedStrings.xml", "si"):
                self.texts.append(_rich_text(item))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(targets[s.get(_LINK)]) for s in book.iter(f"{_MAIN}sheet")}
        properties = book.find(f"{_MAIN}workbookPr")
        since_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        self.epoch = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
        self.is_date = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            for style in styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf"):
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(style.get("numFmtId"), ""))
                self.is_date.append(int(style.get("numFmtId", 0)) in _DATE_FORMATS or bool(re.search("[dmyhs]", code, re.I)))

    def _items(self, name: str, tag: str) -> Iterator[ElementTree.Element]:
        """Elements of a part, one after the other; what was read is let go."""
        with self.zip.open(name) as f:
            root = None
            for event, element in ElementTree.iterparse(f, ("start", "end")):
                root = element if root is None else root
                if event == "end" and element.tag == _MAIN + tag:
                    yield element
                    element.clear()
                    if tag == "row":
                        root.clear()

    def _value(self, cell: ElementTree.Element) -> Any:
        kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = cell.find(f"{_MAIN}is")
            return None if inline is None else _rich_text(inline)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind in ("str", "d"):
            return v.text
        number, style = float(v.text), int(cell.get("s", 0))
        if style < len(self.is_date) and self.is_date[style]:
            try:
                return (self.epoch + timedelta(days=number)).isoformat()
            except (OverflowError, ValueError):  # a number that is no day of the calendar
                return None
        return int(number) if number.is_integer() else number

    def rows(self, sheet: str) -> Iterator[tuple[int, list]]:
        """Row number in the sheet and the values of each row that the sheet has."""
        before = 0
        for row in self._items(self.sheets[sheet], "row"):
            before = int(row.get("r", before + 1))
            values: list = []
            for cell in row.iter(f"{_MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(values)
                values += [None] * (at + 1 - len(values))
                values[at] = self._value(cell)
            yield before, values


def sheets(path: str) -> dict[str, list[list]]:
    """All sheets of a small workbook, with all their rows."""
    book = Workbook(path)
    return {name: [values for _, values in book.rows(name)] for name in book.sheets}


def header(values: list) -> list[str]:
    return [" ".join(str(v).split()) if v is not None else "" for v in values]


def choose_sheet(book: Workbook, name: str) -> str:
    """The sheet with most of the required headers in its first row (ties: the last by name); ``Sheet2`` where it has enough."""
    scores = {}
    for sheet in book.sheets:
        number, values = next(book.rows(sheet), (0, []))
        scores[sheet] = len(set(header(values)) & set(HEADERS)) if number == 1 else 0
    best = max(scores, key=lambda s: (scores[s], s), default=None)
    if best is None or scores[best] < LEAST_HEADERS:
        raise ValueError(f"{name}: no sheet has {LEAST_HEADERS} of the required headers")
    return FIRST_SHEET if scores.get(FIRST_SHEET, 0) >= LEAST_HEADERS else best


_COLUMNS = [*HEADERS, *RECEIPT_HEADERS]
_SCHEMA = StructType([StructField(c, StringType()) for c in (*_COLUMNS, "part_number_type", "source_file", "source_sheet")]).add("source_row_number", LongType())


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


class _Files(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = Path(partition.value)
        book = Workbook(path)
        sheet = choose_sheet(book, path.name)
        lines = book.rows(sheet)
        names = header(next(lines)[1])
        missing = [h for h in HEADERS if h not in names]
        if missing:
            raise ValueError(f"{path.name}: missing headers: {', '.join(missing)}")
        at = {name: i for i, name in reversed(list(enumerate(names)))}
        for number, values in lines:
            if all(v is None or v == "" for v in values):
                continue
            cells = {c: values[at[c]] if c in at and at[c] < len(values) else None for c in _COLUMNS}
            part = cells["Part Number"]
            kind = "str" if isinstance(part, bool) or not isinstance(part, int | float) else type(part).__name__
            if isinstance(part, float):
                cells["Part Number"] = f"{part:f}"
            yield (*(_text(cells[c]) for c in _COLUMNS), kind, path.name, sheet, number)


class PurchaseWorkbooks(DataSource):
    """Format ``purchase_workbooks``; the option ``paths`` has one path a line, which every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "purchase_workbooks"

    def schema(self) -> StructType:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Files([p for p in self.options.get("paths", "").split("\n") if p])


def read_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Purchase lines of workbooks under the line contract; one task reads one workbook row by row.

    The row number is that of the sheet. Cells hold what was last calculated; macros and formulas are not run.
    """
    from costweave.sources.files import typed_lines

    spark.dataSource.register(PurchaseWorkbooks)
    raw = spark.read.format("purchase_workbooks").option("paths", "\n".join(map(str, paths))).load()
    return typed_lines(raw, [c for c in RECEIPT_HEADERS], F.col("part_number_type"))
