"""Output packages: one folder a table, a summary and a manifest."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.sources.workbook_writer import MAX_ROWS, write_workbook
from costweave.sources.workbooks import Workbook

#: File of a package with its tables as sheets.
WORKBOOK = "report.xlsx"


def json_value(value: Any) -> Any:
    """What JSON can hold: dates as text, numbers that are not finite as null."""
    if isinstance(value, dict):
        return {str(k): json_value(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_value(v) for v in value]
    if isinstance(value, date | datetime):
        return value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def snapshot(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, bytes, modified, sha256`` of all files at these paths or below them, hashed where they are read.

    The distributed state of a run's inputs: taken before the first and after the last read, it tells whether they changed meanwhile.
    One file is one row of Spark's binary source, so files of over 2 GB raise.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def changes(before: DataFrame, after: DataFrame) -> list[str]:
    """Some paths (ten at most, in order) whose content differs between two snapshots or that only one of them has."""
    other = after.select("path", F.col("sha256").alias("now"))
    differ = before.join(other, "path", "full").where(~F.col("sha256").eqNullSafe(F.col("now")))
    return [r.path for r in differ.select("path").orderBy("path").limit(10).collect()]


def _workbook(written: dict[str, DataFrame], folder: str, summary: dict[str, Any], counts: dict[str, int], required: tuple[str, ...]) -> dict[str, Any]:
    """Write the tables of a package that fit a sheet as one workbook, reopen it, and say which tables it holds.

    Its first sheets are ``Contents`` (every table, its rows and whether a sheet has it; larger ones are in their folder only) and ``Summary``.
    """
    spark = next(iter(written.values())).sparkSession
    fit = [t for t, n in counts.items() if n < MAX_ROWS]
    contents = spark.createDataFrame([(t, n, t in fit) for t, n in counts.items()], "table string, rows long, in_workbook boolean").coalesce(1)
    # Long lists of warnings stand whole in summary.json; a cell says so.
    texts = [(k, json.dumps(json_value(v), sort_keys=True)) for k, v in summary.items()]
    facts = spark.createDataFrame([(k, v if len(v) <= 30_000 else "see summary.json") for k, v in texts], "key string, value string").coalesce(1)
    path = f"{folder}/{WORKBOOK}"
    sheets = write_workbook({"Contents": contents, "Summary": facts, **{t: written[t] for t in fit}}, path)
    by_table = dict(zip(fit, sheets[2:], strict=True))
    there = Workbook(path).sheets
    if missing := [s for s in ("Contents", "Summary", *(by_table[t] for t in required if t in fit)) if s not in there]:
        raise ValueError(f"sheets missing in {WORKBOOK}: {', '.join(missing)}")
    r = snapshot(spark, [path]).select("bytes", "sha256").first()
    return {"sheets": by_table, "tables_in_folders_only": [t for t in counts if t not in fit], "bytes": r.bytes, "sha256": r.sha256}


def write_package(
    tables: dict[str, DataFrame], folder: str, summary: dict[str, Any], fmt: str = "parquet", inputs: list[str] | None = None, before: DataFrame | None = None, required: tuple[str, ...] = (),
    workbook: bool = False, texts: dict[str, str] | None = None,
) -> dict[str, Any]:
    """Write every table with Spark, then ``summary.json`` and ``run_manifest.json``; reopen each table and count it.

    A table without rows is written with its schema. The manifest is written last, so a folder without one is an unfinished run; it
    holds the rows, columns and files of every table with their hashes. With ``inputs`` and the snapshot
    ``before`` of them, a second one is taken after the tables are written; if they differ, a ValueError says so and
    there is no manifest. Tables named in ``required`` must be there and have rows. With ``workbook`` the tables are sheets of
    ``report.xlsx`` too (a table over the rows of a sheet stays in its folder only, which the workbook and the manifest say).
    ``texts`` are further files, by name. Controls of the summary are ``resolved_config.json`` as well.
    """
    if not tables:
        raise ValueError("no tables to write")
    if missing := [t for t in required if t not in tables]:
        raise ValueError(f"tables missing: {', '.join(missing)}")
    manifest: dict[str, Any] = {"format": fmt, "tables": {}}
    reopened = {}
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{folder}/{name}")
        back = df.sparkSession.read.schema(df.schema)
        reopened[name] = (back.option("header", True).csv if fmt == "csv" else back.parquet)(f"{folder}/{name}")
        n = reopened[name].count()
        if name in required and not n:
            raise ValueError(f"table {name} has no rows")
        manifest["tables"][name] = {"rows": n, "columns": df.columns}
    spark = next(iter(tables.values())).sparkSession
    written = snapshot(spark, [f"{folder}/{name}" for name in tables]).where(F.element_at(F.split("path", "/"), -1).rlike("^part-"))
    for r in written.select("path", "bytes", "sha256").orderBy("path").collect():
        parts = r.path.split("/")
        manifest["tables"][parts[-2]].setdefault("files", {})[parts[-1]] = {"bytes": r.bytes, "sha256": r.sha256}
    if workbook:
        manifest["workbook"] = _workbook(reopened, folder, summary, {t: m["rows"] for t, m in manifest["tables"].items()}, required)
    if before is not None:
        if changed := changes(before, snapshot(spark, inputs or [])):
            raise ValueError(f"inputs changed during the run: {', '.join(changed)}")
        manifest["inputs"] = {r.path: {"bytes": r.bytes, "modified": r.modified, "sha256": r.sha256} for r in before.orderBy("path").collect()}
    files = dict(texts or {}) | {"summary.json": _json(summary)}
    if "controls" in summary:
        files["resolved_config.json"] = _json({k: summary[k] for k in ("controls", "sources") if k in summary})
    manifest["files"] = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in files.items()}
    for name, text in (*files.items(), ("run_manifest.json", _json(manifest))):
        if "://" in folder:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
        else:
            Path(folder, name).write_text(text, encoding="utf-8")
    return manifest


def _json(content: Any) -> str:
    return json.dumps(json_value(content), indent=1, sort_keys=True)
