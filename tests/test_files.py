import hashlib
import json
import math
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from costweave import cli, config
from costweave.operators import windows
from costweave.operators.clean import clean_lines
from costweave.plans import sinks
from costweave.plans.sinks import json_value, write_package
from costweave.sources import files, workbooks

HEAD = "P.O. Date, Part Number,Description 1,Description 2, Cost ,Qty Ordered,Qty Received,Extension (Qty Received),PO Value,Bucket,Description\n"


def test_csv_lines(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEAD.replace(", P", ",P") + '2024-02-01,ab 1,x,,"$1,100.5",5,5,55,55,1,Inventory\n,,,,,,,,,,\nbad,12.0,x,,oops,1,0,0,9,1,Inventory\n')
    rows = clean_lines(files.read_csv(spark, str(tmp_path / "b.csv"))).orderBy("source_row_number").collect()
    assert len(rows) == 2 and rows[0].cost == 1100.5 and rows[0].part_key == "AB 1" and rows[0].source_file == "b.csv"
    assert rows[1].part_key == "12" and rows[1].invalid_date and rows[1].cost is None and rows[1].exclusion_reason == "invalid_or_missing_date"
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing headers"):
        files.read_csv(spark, str(tmp_path / "c.csv"))


def test_discovery_and_fingerprints(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.discover(str(tmp_path))
    for name in ("B.csv", "a.CSV", "~$a.csv", "x.txt"):
        (tmp_path / name).write_text("x" * 200_000)
    found = files.discover(str(tmp_path))
    assert [p.name for p in found] == ["a.CSV", "B.csv"]
    before = files.combined_fingerprint(found, "1")
    assert before == files.combined_fingerprint(found[::-1], "1") != files.combined_fingerprint(found, "2")
    (tmp_path / "B.csv").write_text("y" * 200_000)
    assert files.combined_fingerprint(found, "1") != before


def test_package_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    m = write_package({"t": df, "none": df.limit(0)}, str(tmp_path / "out"), {"x": math.nan})
    assert m["tables"]["t"]["rows"] == 1 and m["tables"]["none"]["rows"] == 0
    assert json.loads((tmp_path / "out/summary.json").read_text()) == {"x": None} and json_value({"k": (1, math.inf)}) == {"k": [1, None]}


def test_full_run_on_the_star_schema(spark, tmp_path):
    cli.main(["run", "--input", "/root/testdata/sf0.001", "--format", "star", "--output", str(tmp_path / "run"), "--base-date", "2000-12-31", "--fast"])
    manifest = json.loads((tmp_path / "run/run_manifest.json").read_text())
    assert manifest["tables"]["composite_forecast"]["rows"] == 3 and manifest["tables"]["tornqvist_FY"]["rows"] > 0
    assert json.loads((tmp_path / "run/summary.json").read_text())["pairs"] >= 50


def test_files_with_other_column_orders_keep_their_columns(spark, tmp_path):
    heads = [h.strip() for h in HEAD.strip().split(",")]
    line = dict(zip(heads, ["10/31/2023", "P1", "x", "", "2", "7", "1", "2", "14", "1210AC", "Inventory"], strict=True))
    for name, order in (("a.csv", heads), ("b.csv", heads[::-1])):
        (tmp_path / name).write_text(",".join(order) + '\n' + ",".join(line[h] for h in order) + "\n" + ",".join(["" for _ in order]) + "\n" + ",".join(f'"{line[h]}\n"' if h == "Description 1" else line[h] for h in order) + "\n")
    rows = files.read_csv(spark, str(tmp_path)).orderBy("source_file", "source_row_number").collect()
    assert [(r.source_file, r.source_row_number, r.qty_ordered, r.qty_received) for r in rows] == [(f, n, 7.0, 1.0) for f in ("a.csv", "b.csv") for n in (2, 4)]
    assert {str(r.po_date) for r in rows} == {"2023-10-31"}


def test_dates_as_people_type_them(spark):
    texts = {"2023-10-31": 0, "10/31/2023": 0, "10/31/23": 0, "2023-10-31 08:15:00": 0, "2023-10-31T00:00:00": 0, "10/31/2023 8:15": 0, "31-Oct-2023": 0, "Oct 31, 2023": 0, "20231031": 0, "31.31.2023": 1, "": 1, "soon": 1}
    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", files.parsed_date(F.col("t")).alias("d")).collect()}
    assert {t for t, d in got.items() if d is None} == {t for t, bad in texts.items() if bad}
    assert {str(d) for d in got.values() if d} == {"2023-10-31"}


def write_workbook(path, sheets, dated=(0,)):
    """A small .xlsx: shared texts, a date style for the columns ``dated``, one entry of ``sheets`` a sheet."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    texts = []

    def cell(value, row, column):
        ref = f"{chr(65 + column)}{row}"
        if value is None:
            return ""
        if isinstance(value, str):
            texts.append(value)
            return f'<c r="{ref}" t="s"><v>{len(texts) - 1}</v></c>'
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        return f'<c r="{ref}" s="{int(column in dated and row > 1)}"><v>{value}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">' + "".join(cell(v, n, c) for c, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        names = "".join(f'<sheet name="{n}" sheetId="{i}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="t" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")


def test_workbooks(spark, tmp_path):
    heads = [h.strip() for h in HEAD.strip().split(",")]
    lines = [heads, [45230, 12345.0, "x", None, 2.5, 7, 1, 2.5, 17.5, "1210AC", "Inventory"], [], [45231, "a-1", None, None, "$3", 1, 0, 0, 3, "1210AC", "Inventory"]]
    write_workbook(tmp_path / "b.xlsx", {"Notes": [["nothing"]], "Sheet2": lines, "Z": lines[:2]})
    write_workbook(tmp_path / "a.xlsm", {"Z": lines[:2], "A": lines})
    rows = files.discover(str(tmp_path), (".xlsx", ".xlsm"))
    got = clean_lines(workbooks.read_workbooks(spark, rows)).orderBy("source_file", "source_row_number").collect()
    assert [(r.source_file, r.source_sheet, r.source_row_number, r.part_key, str(r.po_date), r.cost) for r in got] == [
        ("a.xlsm", "Z", 2, "12345", "2023-10-31", 2.5), ("b.xlsx", "Sheet2", 2, "12345", "2023-10-31", 2.5), ("b.xlsx", "Sheet2", 4, "A-1", "2023-11-01", 3.0),
    ]
    write_workbook(tmp_path / "c.xlsx", {"Sheet2": [["a"]]})
    with pytest.raises(Exception, match="no sheet has 8"):
        workbooks.read_workbooks(spark, [str(tmp_path / "c.xlsx")]).collect()


def test_configuration_from_a_workbook_and_a_template(spark, tmp_path):
    write_workbook(tmp_path / "c.xlsx", {"controls ": [["Key", "Value", "Description"], ["fast_mode", "yes", ""], ["lambda_smooth", 5, ""]], "Planned Basket": [["PartKey", "ExpectedQuantity"], ["A", 3], [None, None]]}, dated=())
    got = config.load_tables(spark, str(tmp_path / "c.xlsx"), {"base_date": "2024-01-31"})
    assert got.controls.fast_mode and got.controls.lambda_smooth == 5.0 and str(got.controls.base_date) == "2024-01-31" and got.scope_mapping is None
    assert [tuple(r) for r in got.planned_basket.collect()] == [("A", 3.0, None)]
    mapping = spark.createDataFrame([("b", "d", "Include", "Inventory", "why", "")], "bucket string, description string, default_decision string, category string, reason string, manual_override string")
    assert len(config.write_template(str(tmp_path / "t"), mapping)) == 5
    back = config.load_tables(spark, str(tmp_path / "t"))
    assert back.controls == config.Controls() and back.scope_mapping.first().default_decision == "Include" and back.part_overrides is None
    with pytest.raises(ValueError, match="boolean"):
        config.parse_bool("maybe")


def test_historical_run_and_windows(spark, tmp_path):
    w, pairs = windows.comparisons(2023, date(2026, 7, 9))
    assert w == [("FY2023", date(2022, 10, 1), date(2023, 9, 30)), ("FY2024", date(2023, 10, 1), date(2024, 9, 30)), ("FY2025", date(2024, 10, 1), date(2025, 9, 30)),
                 ("FY2025 YTD", date(2024, 10, 1), date(2025, 7, 9)), ("FY2026 YTD", date(2025, 10, 1), date(2026, 7, 9))]
    assert pairs == [("FY2023-FY2024", "FY2023", "FY2024"), ("FY2024-FY2025", "FY2024", "FY2025"), ("FY2025YTD-FY2026YTD", "FY2025 YTD", "FY2026 YTD")]
    assert windows.ytd_window(2025, date(2024, 2, 29))[2] == date(2025, 2, 28) and windows.ytd_window(2024, date(2023, 11, 5))[2] == date(2023, 11, 5)
    cli.main(["historical-actuals", "--input", "/root/testdata/sf0.001", "--format", "star", "--output", str(tmp_path / "h"), "--base-date", "2001-06-30", "--first-fiscal-year", "1998"])
    tables = json.loads((tmp_path / "h/run_manifest.json").read_text())["tables"]
    assert tables["comparisons"]["rows"] == 9 and tables["huber_grid"]["rows"] == 8 and tables["matched_parts"]["rows"] > 0


def test_a_file_that_changes_during_a_run_stops_it(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / "in" / name).write_text("x\n1\n")
    tables, inputs = {"one": spark.range(3).toDF("n"), "none": spark.range(0).toDF("n")}, [str(tmp_path / "in")]
    before = spark.createDataFrame(sinks.snapshot(spark, inputs).collect(), "path string, bytes long, modified timestamp, sha256 string")
    manifest = sinks.write_package(tables, str(tmp_path / "first"), {}, inputs=inputs, before=before, required=("one",))
    assert len(manifest["inputs"]) == 2 and manifest["tables"]["one"]["rows"] == 3
    for name, kept in manifest["tables"]["one"]["files"].items():
        content = (tmp_path / "first/one" / name).read_bytes()
        assert (kept["bytes"], kept["sha256"]) == (len(content), hashlib.sha256(content).hexdigest())
    (tmp_path / "in/b.csv").write_text("x\n2\n")
    (tmp_path / "in/c.csv").write_text("x\n")
    with pytest.raises(ValueError, match=r"inputs changed.*b\.csv.*c\.csv"):
        sinks.write_package(tables, str(tmp_path / "second"), {}, inputs=inputs, before=before)
    assert not (tmp_path / "second/run_manifest.json").exists()
    with pytest.raises(ValueError, match="none has no rows"):
        sinks.write_package(tables, str(tmp_path / "third"), {}, required=("none",))
    with pytest.raises(ValueError, match="tables missing: two"):
        sinks.write_package(tables, str(tmp_path / "fourth"), {}, required=("two",))
