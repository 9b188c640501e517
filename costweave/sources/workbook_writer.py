"""Excel workbooks as a Spark sink: each table is one sheet, rows stream through one task into one file, which appears whole or not at all."""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Limits of the file format.
MAX_ROWS, MAX_COLUMNS, MAX_TEXT, MAX_NAME = 1_048_576, 16_384, 32_767, 31

_NS = "http://schemas.openxmlformats.org/"
_MAIN, _LINKS, _PACKAGE = f"{_NS}spreadsheetml/2006/main", f"{_NS}officeDocument/2006/relationships", f"{_NS}package/2006/"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml."
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell styles by place: general, date, date with time, bold (headers).
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/><xf numFmtId="0" fontId="1" applyFont="1"/></cellXfs></styleSheet>'
)
_STYLE_OF = {"d": ' s="1"', "t": ' s="2"'}


def letters(place: int) -> str:
    """Name of a column: 0 is A, 26 is AA."""
    name, place = "", place + 1
    while place:
        place, digit = divmod(place - 1, 26)
        name = chr(65 + digit) + name
    return name


def xml_text(text: str) -> str:
    """A text as the format stores it: characters that XML forbids, and what looks like their escape, as ``_xHHHH_``."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text))


def sheet_names(titles: Iterable[str]) -> list[str]:
    """Names that the format allows, unlike each other without regard to case."""
    out: list[str] = []
    for title in titles:
        stem = re.sub(r"[\[\]:*?/\\]", " ", title).strip("' ") or "Sheet"
        name, n = stem[:MAX_NAME], 1
        while name.lower() in (o.lower() for o in out):
            n += 1
            name = f"{stem[: MAX_NAME - len(str(n)) - 3]} ({n})"
        out.append(name)
    return out


class WorkbookFile:
    """An .xlsx file written sheet by sheet and row by row; one row is in memory.

    A cell is None or a letter with a value: ``n`` number, ``s`` text, ``b`` 0 or 1, ``d`` day number, ``t`` day number with time.
    """

    def __init__(self, path: str | Path):
        self.zip, self.names, self.out = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED), [], None

    def sheet(self, name: str, headers: list[str]) -> None:
        self._end()
        if len(headers) > MAX_COLUMNS:
            raise ValueError(f"sheet {name}: {len(headers)} columns, a sheet holds {MAX_COLUMNS}")
        self.names.append(name)
        self.rows, self.width = 0, max(len(headers), 1)
        self.columns = [letters(i) for i in range(self.width)]
        self.out = io.TextIOWrapper(self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), "utf-8")
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        self.out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{pane}<sheetData>')
        self.row([f"s{h}" for h in headers], ' s="3"')

    def row(self, cells: list[str | None], style: str = "") -> None:
        self.rows += 1
        if self.rows > MAX_ROWS:
            raise ValueError(f"sheet {self.names[-1]}: more than {MAX_ROWS:,} rows")
        out = [f'<row r="{self.rows}">']
        for column, cell in zip(self.columns, cells, strict=False):
            if cell is None:
                continue
            kind, value = cell[0], cell[1:]
            at = f'<c r="{column}{self.rows}"{style or _STYLE_OF.get(kind, "")}'
            if kind == "s":
                if len(value) > MAX_TEXT:
                    raise ValueError(f"sheet {self.names[-1]}, cell {column}{self.rows}: a text of {len(value)} characters, a cell holds {MAX_TEXT}")
                out.append(f'{at} t="inlineStr"><is><t xml:space="preserve">{xml_text(value)}</t></is></c>')
            else:
                out.append(f'{at}{" t=" + chr(34) + "b" + chr(34) if kind == "b" else ""}><v>{value}</v></c>')
        self.out.write("".join(out) + "</row>")

    def _end(self) -> None:
        if self.out is not None:
            self.out.write(f'</sheetData><autoFilter ref="A1:{self.columns[-1]}{self.rows}"/></worksheet>')
            self.out.close()
            self.out = None

    def close(self) -> None:
        self._end()
        n = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, self.names, strict=True))
        links = "".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}worksheet+xml"/>' for i in n)
        files = {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}relationships">{links}<Relationship Id="rId0" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{_KIND}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}styles+xml"/>{parts}</Types>',
        }
        for name, content in files.items():
            self.zip.writestr(name, _HEAD + content)
        self.zip.writestr("xl/styles.xml", _STYLES)
        self.zip.close()


def cell(field: T.StructField) -> Column:
    """A column as cells of :class:`WorkbookFile`.

    Null and numbers that are not finite are empty; whole numbers over 2**53 and days before March 1900 are texts, for a
    cell cannot hold them; structures are JSON.
    """
    c, kind = F.col("`" + field.name.replace("`", "``") + "`"), field.dataType
    mark = lambda k, v: F.concat(F.lit(k), v.cast("string"))
    day = lambda d: F.datediff(d, F.lit("1899-12-30").cast("date"))
    if isinstance(kind, T.BooleanType):
        return mark("b", c.cast("int"))
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
        return mark("n", c)
    if isinstance(kind, T.LongType):
        return F.when(c.between(-(1 << 53), 1 << 53), mark("n", c)).otherwise(mark("s", c))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), mark("n", c.cast("double")))
    if isinstance(kind, T.DecimalType):
        return mark("n" if kind.precision <= 15 else "s", c)
    if isinstance(kind, T.DateType):
        return F.when(c >= F.lit("1900-03-01").cast("date"), mark("d", day(c))).otherwise(mark("s", c))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        return F.when(F.to_date(c) >= F.lit("1900-03-01").cast("date"), mark("t", day(F.to_date(c)) + seconds / 86400.0)).otherwise(mark("s", c))
    if isinstance(kind, T.BinaryType):
        return mark("s", F.base64(c))
    return mark("s", F.to_json(c) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else c)


@dataclass
class _Written(WriterCommitMessage):
    file: str


class _Writer(DataSourceWriter):
    """The task writes a file of its own name beside the target; the commit gives it the target's name, an abort removes it."""

    def __init__(self, path: str, sheets: list[tuple[str, list[str]]], overwrite: bool):
        self.path, self.sheets, self.overwrite = Path(path), sheets, overwrite
        self.aside = self.path.parent / f".{self.path.name}-{uuid.uuid4().hex}"

    def _file(self, rows: Iterable[tuple[int, list[str | None]]]) -> str:
        self.aside.mkdir(parents=True, exist_ok=True)
        own = self.aside / uuid.uuid4().hex
        book, opened = WorkbookFile(own), 0
        for sheet, cells in rows:
            while opened <= sheet:
                book.sheet(*self.sheets[opened])
                opened += 1
            book.row(cells)
        for name, headers in self.sheets[opened:]:
            book.sheet(name, headers)
        book.close()
        return str(own)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return _Written(self._file((r.sheet, r.cells) for r in iterator))

    def commit(self, messages: list) -> None:
        written = [m.file for m in messages if m is not None]
        if len(written) > 1:
            raise ValueError("a workbook is written by one task")
        file = written[0] if written else self._file([])
        if self.path.exists() and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(str(self.path))
        os.replace(file, self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class WorkbookTables(DataSource):
    """Format ``workbook_tables``; options ``path`` (a file in a folder that driver and executors share) and ``sheets`` (JSON: name and headers of each)."""

    @classmethod
    def name(cls) -> str:
        return "workbook_tables"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [(n, h) for n, h in json.loads(self.options["sheets"])], overwrite)


def write_workbook(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> list[str]:
    """Write each table as a sheet of one workbook and return the sheets' names; rows keep the order of their table.

    One task writes the file, row by row: a sheet holds 1,048,575 rows below its header, so the work of that task is bounded by the
    format. A larger table raises, as does a text over 32,767 characters; nothing is cut, and no file is left then.
    A table without rows is a sheet of headers. ``path`` must be a file path that executors can open.
    """
    if not tables:
        raise ValueError("no tables to write")
    if "://" in path:
        raise ValueError(f"a workbook needs a path in a mounted folder: {path}")
    spark = next(iter(tables.values())).sparkSession
    names = sheet_names(tables)
    parts = []
    for i, (name, df) in enumerate(zip(names, tables.values(), strict=True)):
        if (n := df.count()) >= MAX_ROWS:
            raise ValueError(f"sheet {name}: {n:,} rows, a sheet holds {MAX_ROWS - 1:,}")
        cells = [cell(f) for f in df.schema.fields]
        parts.append(df.select(F.lit(i).alias("sheet"), F.monotonically_increasing_id().alias("place"), F.array(*cells).cast("array<string>").alias("cells")))
    rows = reduce(DataFrame.unionAll, parts).repartition(1).sortWithinPartitions("sheet", "place").select("sheet", "cells")
    spark.dataSource.register(WorkbookTables)
    heads = json.dumps([(name, df.columns) for name, df in zip(names, tables.values(), strict=True)])
    rows.write.format("workbook_tables").mode("overwrite" if overwrite else "append").option("path", path).option("sheets", heads).save()
    return names
