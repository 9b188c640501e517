from datetime import date

from pyspark.sql import functions as F

from costweave.operators import quality
from costweave.operators.clean import FINGERPRINT, flag_duplicates, with_fingerprint
from costweave.plans import registry


def test_lines_alike_are_counted_by_fingerprint_as_by_window(spark):
    day = date(2024, 1, 2)
    rows = [
        (day, "A", 1.0, 2.0, 0.0, 5.0, "b", "d", "x", None), (day, "A", 1.0, 2.0, -0.0, 5.0, "b", "d", "x", None),  # alike: -0.0 is 0.0
        (day, "A", 1.0, 2.0, 0.0, 5.0, "b", "d", None, "x"), (None, "A", None, 2.0, None, 7.0, None, "d", "x", None), (None, "A", None, 2.0, None, 7.0, None, "d", "x", None),
        (None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (day, "B", 1.0, None, 2.0, 3.0, "b", "d", "x", "y"), (day, "B", 1.0, 2.0, None, 3.0, "b", "d", "x", "y"),
    ]
    schema = "po_date date, part_key string, cost double, qty_ordered double, qty_received double, po_value double, bucket string, description string, description_1 string, description_2 string"
    assert tuple(x.split()[0] for x in schema.split(", ")) == FINGERPRINT
    lines = spark.createDataFrame(rows, schema).withColumns({
        "in_direct_costs": F.lit(True), "realized_spend": F.lit(1.0), "has_open_commitment": F.lit(False), "remaining_open_spend": F.lit(0.0), "effective_date": F.col("po_date"), "po_value_matches_ordered": F.lit(True),
        "extension_received": F.lit(None).cast("double"), "received_ratio": F.lit(None).cast("double"), "realized_price_source": F.lit("unavailable"),
    })
    found = [{r.issue: (r.row_count, r.value) for r in quality.data_quality(x).collect()} for x in (flag_duplicates(lines), with_fingerprint(lines))]
    assert found[0] == found[1] and found[1]["duplicate_looking_rows"] == (6, 24.0)


def test_data_quality_writes_no_texts_and_no_more_columns_than_it_reads(spark, monkeypatch):
    held = {}
    whole = registry.staged

    def staged(df, name):
        held[name] = df.columns
        return whole(df, name)

    monkeypatch.setattr(registry, "staged", staged)
    rows = registry._quality(spark, "/root/testdata/sf0.001").collect()
    assert len({r.issue for r in rows}) == len(rows) == 13
    assert not {"description_1", "description_2", "match_tier"} & set(held["quality-lines"]) and len(held["pairs"]) == 5 and len(held["daily"]) == 6 and "flagged" not in held
