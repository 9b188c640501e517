"""The purchase-line contract that every source delivers and every operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PO_LINE = T.StructType(
    [
        T.StructField("po_date", T.DateType()),
        T.StructField("receipt_date", T.DateType()),
        T.StructField("part_number", T.StringType()),
        T.StructField("part_number_type", T.StringType()),
        T.StructField("description_1", T.StringType()),
        T.StructField("description_2", T.StringType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("qty_ordered", T.DoubleType()),
        T.StructField("qty_received", T.DoubleType()),
        T.StructField("extension_received", T.DoubleType()),
        T.StructField("po_value", T.DoubleType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_sheet", T.StringType()),
        T.StructField("source_row_number", T.LongType()),
        T.StructField("date_was_given", T.BooleanType()),
    ]
)

# The header of a source sheet, and the line columns they become.
HEADERS = {
    "P.O. Date": "po_date",
    "Part Number": "part_number",
    "Description 1": "description_1",
    "Description 2": "description_2",
    "Cost": "cost",
    "Qty Ordered": "qty_ordered",
    "Qty Received": "qty_received",
    "Extension (Qty Received)": "extension_received",
    "PO Value": "po_value",
    "Bucket": "bucket",
    "Description": "description",
}
RECEIPT_HEADERS = ("Receipt Date", "Received Date", "P.O. Receipt Date")


def conform(df: DataFrame) -> DataFrame:
    """The contract's columns in order; missing columns raise."""
    missing = [f.name for f in PO_LINE if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing line columns: {', '.join(missing)}")
    return df.select(*(df[f.name].cast(f.dataType) for f in PO_LINE))
