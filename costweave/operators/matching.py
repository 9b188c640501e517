"""Reviewable part-family candidates: parts with one prefix, alike in description and price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.functions import columns as C


def part_stats(classified: DataFrame, prefix=None) -> DataFrame:
    """One row a (category, prefix, part) of realized direct lines: description, tokens, median price, years."""
    prefix = C.family_prefix(F.col("part_key")) if prefix is None else prefix
    text = F.concat_ws(" ", F.coalesce("description_1", F.lit("")), F.coalesce("description_2", F.lit("")))
    rows = classified.where(F.col("in_direct_costs") & F.col("part_key").isNotNull() & C.positive(F.col("realized_price"))).select(
        "direct_category", prefix.alias("prefix"), "part_key", "realized_price", C.words_only(text).alias("words"), C.fiscal_year(F.col("effective_date")).alias("fy"), F.struct("source_file", "source_row_number").alias("line")
    )
    return rows.where(F.col("prefix") != "").groupBy("direct_category", "prefix", "part_key").agg(
        F.min_by("words", "line").alias("words"), F.median("realized_price").alias("median_price"), F.count(F.lit(1)).alias("observations"), F.min("fy").cast("long").alias("first_fy"), F.max("fy").cast("long").alias("last_fy")
    )


def family_candidates(parts: DataFrame, min_similarity: float = 0.60, max_dispersion: float = 0.35, max_parts: int = 100) -> DataFrame:
    """Groups of 2 to ``max_parts`` parts in one category and prefix that pass both thresholds.

    ``parts`` is :func:`part_stats`, read three times, so better a written table. Larger groups are no families by
    definition and are dropped before any pair is made, so a group's pairs are bounded. Pairs are
    counted inside the group's row, not joined out. Nothing is activated.
    """
    group = ["direct_category", "prefix"]
    parts = parts.withColumn("tokens", C.tokens(F.col("words")))
    sized = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("n_parts"), F.stddev_pop(F.ln("median_price")).alias("dispersion"))
    small = parts.join(sized.where(F.col("n_parts").between(2, max_parts)), group)
    groups = small.groupBy(*group).agg(F.collect_list("tokens").alias("sets"), F.first("dispersion").alias("dispersion"), F.first("n_parts").alias("n_parts"))
    of_pair = lambda i, a: F.aggregate(F.slice("sets", i + 2, F.col("n_parts").cast("int")), F.lit(0.0), lambda acc, b: acc + C.jaccard(a, b))
    total = F.aggregate(F.transform("sets", lambda a, i: of_pair(i, a)), F.lit(0.0), lambda acc, x: acc + x)
    mean = total / (F.col("n_parts") * (F.col("n_parts") - 1) / 2)
    passed = (F.col("similarity") >= min_similarity) & (F.col("dispersion") <= max_dispersion)
    chosen = groups.withColumn("similarity", mean).where(passed).select(*group, "similarity", "dispersion")
    return parts.join(chosen, group).select(
        F.concat_ws("-", *group).alias("candidate_family"), *group, "part_key", "words", "observations", "first_fy", "last_fy", "median_price",
        "similarity", "dispersion", F.lit(False).alias("activated"),
    )
