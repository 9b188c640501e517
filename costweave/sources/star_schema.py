"""Purchase lines from an order star schema: line items, their orders and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costweave.functions import columns as C
from costweave.schema import conform

# Which description a part type stands for.
TYPE_DESCRIPTIONS = {
    "ECONOMY": "Inventory",
    "LARGE": "COST OF SALES - OUTSIDE SERVICES",
    "MEDIUM": "Production Supplies",
    "SMALL": "Small Tools",
    "STANDARD": "Operating Supplies",
    "PROMO": "Office Supplies",
}


def po_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purchase line for each line item.

    Lines are ordered on the order date. Final lines (status F) are fully received, open returned
    ones half, others not at all. The row number is the order, line and a counter of equal
    line numbers, so it needs no global order; orders join on their key and the
    counter reuses that partitioning.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    same_line = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    lines = lines.withColumn("nth", F.row_number().over(same_line)).join(
        read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type"), "l_partkey"
    )
    day = F.to_date("o_orderdate")
    received = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).when(F.col("l_returnflag") == "A", F.floor(F.col("l_quantity") / 2).cast("double")).otherwise(0.0)
    descriptions = F.create_map(*(F.lit(x) for pair in TYPE_DESCRIPTIONS.items() for x in pair))
    return conform(
        lines.select(
            day.alias("po_date"),
            F.lit(None).cast("date").alias("receipt_date"),
            F.col("l_partkey").cast("string").alias("part_number"),
            F.lit("int").alias("part_number_type"),
            F.col("p_name").alias("description_1"),
            F.col("p_brand").alias("description_2"),
            ((F.col("l_extendedprice") / F.col("l_quantity")) * F.when(F.col("l_linenumber") == 7, 100.0).otherwise(1.0)).alias("cost"),
            F.col("l_quantity").alias("qty_ordered"),
            received.alias("qty_received"),
            (F.col("l_extendedprice") * received / F.col("l_quantity")).alias("extension_received"),
            F.col("l_extendedprice").alias("po_value"),
            F.col("p_type").alias("bucket"),
            F.try_element_at(descriptions, F.col("p_type")).alias("description"),
            C.fiscal_label(day).alias("source_file"),
            F.lit("lineitem").alias("source_sheet"),
            (F.col("l_orderkey") * 10_000 + F.col("l_linenumber") * 100 + F.col("nth")).cast("long").alias("source_row_number"),
            F.lit(True).alias("date_was_given"),
        )
    )
