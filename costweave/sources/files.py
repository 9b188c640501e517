"""Purchase-line files: discovery, fingerprints, and typed reading of CSV and Parquet."""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.functions import columns as C
from costweave.schema import HEADERS, PO_LINE, RECEIPT_HEADERS, conform


def discover(folder: str, suffixes: tuple[str, ...] = (".csv", ".parquet", ".xlsx", ".xlsm")) -> list[Path]:
    """Source files of a local folder by case-insensitive name, without editors' lock files."""
    found = sorted((p for p in Path(folder).iterdir() if p.suffix.lower() in suffixes and not p.name.startswith("~$")), key=lambda p: p.name.lower())
    if not found:
        raise FileNotFoundError(f"no source files in {folder}")
    return found


#: Bytes at either end of a file that its fingerprint takes.
EDGE = 65_536


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".csv", ".parquet", ".xlsx", ".xlsm"), fingerprints: bool = False) -> DataFrame:
    """``path, file, bytes, modified`` of the source files at or in a folder, by any file system that Spark reads.

    Editors' lock files and files of 0 bytes are left out (Spark's listing skips the latter, which hold no lines).
    With ``fingerprints`` also :func:`fingerprint`, worked out where a file is read; without it no content is read.
    """
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    found = spark.read.format("binaryFile").load(folder).withColumn("file", name)
    wanted = F.lower("file").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") & ~F.startswith("file", F.lit("~$"))
    columns = ["path", "file", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    if fingerprints:
        size = F.col("length").cast("int")
        head = F.encode(F.concat_ws("|", "file", "length", F.unix_seconds("modificationTime")), "utf-8")
        tail = F.when(size > EDGE, F.substring("content", F.greatest(F.lit(EDGE), size - EDGE) + 1, F.lit(EDGE))).otherwise(F.lit(b""))
        columns.append(F.left(F.sha2(F.concat(head, F.substring("content", 1, EDGE), tail), 256), F.lit(24)).alias("fingerprint"))
    return found.where(wanted).select(*columns)


def fingerprint(path: Path, edge: int = EDGE) -> str:
    """Cheap identity of a file: name, size, modification second, and both ends."""
    stat = path.stat()
    digest = hashlib.sha256(f"{path.name}|{stat.st_size}|{int(stat.st_mtime)}".encode())
    with path.open("rb") as f:
        digest.update(f.read(edge))
        if stat.st_size > edge:
            f.seek(max(edge, stat.st_size - edge))
            digest.update(f.read(edge))
    return digest.hexdigest()[:24]


def combined_fingerprint(paths: list[Path], version: str) -> str:
    """Identity of a set of files under one version of the cleaning rules."""
    parts = [version, *(f"{fingerprint(p)}:{p.stat().st_size}" for p in sorted(paths, key=lambda p: p.name))]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]


#: Ways in which people type dates, tried in order; month before day, as in the source system.
DATE_FORMATS = ("yyyy-MM-dd['T'HH:mm:ss[.SSSSSS]]", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yy", "M-d-yyyy", "yyyy/M/d", "yyyyMMdd", "d-MMM-yyyy", "d-MMM-yy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy")


def parsed_date(text: Column) -> Column:
    """The date of a text in one of ``DATE_FORMATS``; null where none fits."""
    value = F.trim(text)
    return F.to_date(F.coalesce(F.try_to_timestamp(value), *(F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS)))


def typed_lines(raw: DataFrame, receipts: list[str], part_type: Column) -> DataFrame:
    """The line contract from text columns with the source headers; numbers and dates that do not parse are null.

    The receipt date is the first of ``receipts`` that some row has, row by row. Rows without any value are left out.
    """
    numbers = {"cost", "qty_ordered", "qty_received", "extension_received", "po_value"}
    columns = {name: C.number(F.col(f"`{h}`")) if name in numbers else F.col(f"`{h}`") for h, name in HEADERS.items() if name != "po_date"}
    receipt = F.coalesce(*(parsed_date(F.col(f"`{h}`")) for h in receipts)) if receipts else F.lit(None).cast("date")
    typed = raw.select(
        parsed_date(F.col("`P.O. Date`")).alias("po_date"), receipt.alias("receipt_date"), *(c.alias(n) for n, c in columns.items()),
        part_type.alias("part_number_type"), "source_file", "source_sheet", "source_row_number", F.col("`P.O. Date`").isNotNull().alias("date_was_given"),
    )
    filled = F.lit(False)
    for name in HEADERS.values():
        filled |= F.col(name).isNotNull()
    return conform(typed.where(filled))


def _records(data: bytes) -> list[list[str]]:
    return list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")))


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of CSV files, every file by its own header, all text at first, then parsed without failing.

    Columns are taken by name, so files may order them differently. A file without a required
    header raises at once: the first records of all files are looked at before. The row number is the record's place in its file (the header is 1). A file is one
    task, for a quoted line break may stand anywhere; tables too large for that are read as Parquet.
    """
    receipts = list(RECEIPT_HEADERS)
    names = [*HEADERS, *receipts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = _records(data)
                heads = [" ".join(h.split()) for h in records[0]] if records else []
                file = unquote(path.rsplit("/", 1)[-1])
                at = {h: i for i, h in reversed(list(enumerate(heads)))}
                for begin in range(1, len(records), 10_000):
                    part = [(n, r) for n, r in enumerate(records[begin : begin + 10_000], begin + 1) if any(r)]
                    cells = [pa.array([r[at[h]] or None if h in at and at[h] < len(r) else None for _, r in part], pa.string()) for h in names]
                    yield pa.RecordBatch.from_arrays([*cells, pa.array([file] * len(part), pa.string()), pa.array([n for n, _ in part], pa.int64())], names=[*names, "source_file", "source_row_number"])

    binary = spark.read.format("binaryFile").load(paths).select("path", "content")
    for path, start in binary.select("path", F.substring("content", 1, 1 << 16)).toLocalIterator():
        first = _records(bytes(start))[:1] or [[]]
        missing = [h for h in HEADERS if h not in [" ".join(c.split()) for c in first[0]]]
        if missing:
            raise ValueError(f"{unquote(path.rsplit('/', 1)[-1])}: missing headers: {', '.join(missing)}")
    schema = ", ".join([*(f"`{h}` string" for h in names), "source_file string", "source_row_number long"])
    raw = binary.mapInArrow(run, schema).withColumn("source_sheet", F.lit("csv"))
    kind = F.when(F.col("`Part Number`").try_cast("double").isNotNull(), "float").otherwise("str")
    return typed_lines(raw, receipts, kind)


def read_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines that were written under the contract."""
    return conform(spark.read.schema(PO_LINE).parquet(*([paths] if isinstance(paths, str) else paths)))
