import json
import math
import zipfile
from datetime import date, datetime
from decimal import Decimal
from xml.etree import ElementTree

import pytest

from costweave import cli, config
from costweave.plans.sinks import write_package
from costweave.sources import workbooks
from costweave.sources.workbook_writer import letters, sheet_names, write_workbook

SCHEMA = "flag boolean, small int, large long, x double, dec decimal(10,2), wide decimal(38,2), day date, at timestamp, text string, raw binary, many array<int>"


def test_cells_of_every_kind_come_back(spark, tmp_path):
    rows = [
        (True, 1, 2**53, 2.5, Decimal(1), Decimal(1), date(2024, 2, 29), datetime(2024, 2, 29, 18, 0), "a <b> & \"c\" _x0041_ \x07\n", b"\x00\x01", [1, None]),
        (None,) * 11,
        (False, -5, 2**53 + 1, math.nan, None, None, date(1899, 1, 1), None, "", None, []),
        (None, None, None, math.inf, None, None, None, None, "ä€😀 ", None, None),
    ]
    path = str(tmp_path / "t.xlsx")
    assert write_workbook({"Cells": spark.createDataFrame(rows, SCHEMA).coalesce(1), "cells": spark.range(0).toDF("n")}, path) == ["Cells", "cells (2)"]
    got = workbooks.sheets(path)
    assert got["cells (2)"] == [["n"]] and got["Cells"][0] == [f.split()[0] for f in SCHEMA.split(", ")]
    assert got["Cells"][1] == [True, 1, 2**53, 2.5, 1, "1.00", "2024-02-29T00:00:00", "2024-02-29T18:00:00", "a <b> & \"c\" _x0041_ \x07\n", "AAE=", "[1,null]"]
    assert got["Cells"][2] == [] and got["Cells"][3] == [False, -5, str(2**53 + 1), None, None, None, "1899-01-01", None, "", None, "[]"]
    assert got["Cells"][4] == [None] * 8 + ["ä€😀 "]
    with zipfile.ZipFile(path) as z:  # every part is well-formed and named in the list of contents
        kinds = z.read("[Content_Types].xml").decode()
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
            assert name.endswith(".rels") or name == "[Content_Types].xml" or f'PartName="/{name}"' in kinds
    assert [p.name for p in tmp_path.iterdir()] == ["t.xlsx"]


def test_rows_keep_their_order_over_partitions(spark, tmp_path):
    tables = {"a": spark.range(5000).repartition(7).orderBy("id"), "b": spark.range(10, 0, -1, 3)}
    write_workbook(tables, str(tmp_path / "t.xlsx"))
    got = workbooks.sheets(str(tmp_path / "t.xlsx"))
    assert [r[0] for r in got["a"][1:]] == list(range(5000)) and [r[0] for r in got["b"][1:]] == list(range(10, 0, -1))


def test_what_does_not_fit_raises_and_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    with pytest.raises(Exception, match="a cell holds 32767"):
        write_workbook({"long": spark.createDataFrame([("x" * 32_768,)], "t string")}, path)
    with pytest.raises(ValueError, match="a sheet holds 1,048,575"):
        write_workbook({"n": spark.range(1_048_576)}, path)
    with pytest.raises(ValueError, match="mounted"):
        write_workbook({"n": spark.range(1)}, "s3a://b/t.xlsx")
    assert list(tmp_path.iterdir()) == []
    write_workbook({"n": spark.range(1)}, path)
    with pytest.raises(Exception, match="t.xlsx"):
        write_workbook({"n": spark.range(2)}, path)
    assert workbooks.sheets(path) == {"n": [["id"], [0]]}
    write_workbook({"n": spark.range(2)}, path, overwrite=True)
    assert workbooks.sheets(path) == {"n": [["id"], [0], [1]]} and [p.name for p in tmp_path.iterdir()] == ["t.xlsx"]


def test_names_of_sheets_and_columns():
    assert sheet_names(["a/b", "A b", "x" * 40, "x" * 40, "''"]) == ["a b", "A b (2)", "x" * 31, "x" * 27 + " (2)", "Sheet"]
    assert [letters(i) for i in (0, 25, 26, 701, 702, 16_383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_a_package_with_a_workbook(spark, tmp_path):
    big = spark.range(1_048_576).toDF("n")
    tables = {"one": spark.createDataFrame([(1, "a")], "n long, t string"), "none": spark.range(0), "big": big}
    manifest = write_package(tables, str(tmp_path / "p"), {"controls": {"a": 1}, "x": "y" * 40_000}, required=("one",), workbook=True)
    got = workbooks.sheets(str(tmp_path / "p/report.xlsx"))
    assert got["Contents"][1:] == [["one", 1, True], ["none", 0, True], ["big", 1_048_576, False]] and got["one"] == [["n", "t"], [1, "a"]] and got["none"] == [["id"]]
    assert manifest["workbook"]["tables_in_folders_only"] == ["big"] and len(manifest["workbook"]["sha256"]) == 64
    assert got["Summary"][1:] == [["controls", '{"a": 1}'], ["x", "see summary.json"]]
    assert json.loads((tmp_path / "p/resolved_config.json").read_text()) == {"controls": {"a": 1}} and set(manifest["files"]) == {"summary.json", "resolved_config.json"}


def test_a_template_as_a_workbook_reads_back(spark, tmp_path):
    mapping = spark.createDataFrame([("b", "d", "Include", "Inventory", "why", None)], "bucket string, description string, default_decision string, category string, reason string, manual_override string")
    assert config.write_template(str(tmp_path / "c.xlsx"), mapping) == [str(tmp_path / "c.xlsx")]
    back = config.load_tables(spark, str(tmp_path / "c.xlsx"))
    assert back.controls == config.Controls() and back.part_overrides is None
    assert [tuple(r) for r in back.scope_mapping.collect()] == [("b", "d", "Include", "Inventory", "why", None)]


def test_cells_that_no_reader_should_trip_over(tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as z:
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row><c s="1"><v>5000000</v></c><c t="s"><v>0</v></c><c s="1"><v>45230</v></c></row></sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="S" sheetId="1" xmlns:r="{links}" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><r><t>to</t></r><r><t>kyo</t></r><rPh sb='0' eb='1'><t>TOKYO</t></rPh></si></sst>")
    assert workbooks.sheets(str(tmp_path / "o.xlsx")) == {"S": [[None, "tokyo", "2023-10-31T00:00:00"]]}


def test_historical_package_with_report_and_workbook(spark, tmp_path):
    out = tmp_path / "h"
    cli.main(["historical-actuals", "--input", "/root/testdata/sf0.001", "--format", "star", "--output", str(out), "--base-date", "2001-06-30", "--first-fiscal-year", "1999", "--workbook"])
    manifest, report = json.loads((out / "run_manifest.json").read_text()), (out / "report.md").read_text()
    assert set(manifest["workbook"]["sheets"]) == set(manifest["tables"]) and "report.md" in manifest["files"]
    assert "## Comparisons" in report and "physical_inputs" in report
    sheets = workbooks.sheets(str(out / "report.xlsx"))
    assert all(len(sheets[s]) == manifest["tables"][t]["rows"] + 1 for t, s in manifest["workbook"]["sheets"].items())
