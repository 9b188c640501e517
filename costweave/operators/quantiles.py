"""Exact percentiles of groups of any size: an approximate pass brackets them, a second one counts inside the brackets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.plans.stages import staged

#: Rank error of the first pass, as a part of a group; groups up to this size are counted whole.
_ACCURACY = 10_000


def beside(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Each row with the columns of its group in ``table`` (one row a group, null keys alike); of the only row where ``by`` is empty.

    A table of one row is broadcast; others join as their size decides, so ``table`` should be a written one. Of a shuffled table with few groups
    most partitions are empty, and Spark then deals and sorts the rows by group too, all rows of one in one task.
    """
    if not by:
        return rows.join(F.broadcast(table))
    renamed = table.withColumnsRenamed({k: f"beside_{k}" for k in by})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"beside_{k}")) for k in by))
    return rows.join(renamed, same, "left").drop(*(f"beside_{k}" for k in by))


def percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row a group: the columns ``by`` and for each name the interpolated percentile of its values (nulls do not count).

    ``percentile`` holds all distinct values of a group in one task. Here a first pass takes bounds
    whose ranks are surely on both sides, and a second one counts what is below and each
    distinct value between, about 4 in 10,000 of a group's rows. Equal to ``percentile`` bit for
    bit. ``rows`` is read twice and should be a written table. A group without values has nulls;
    no rows give no groups, or one of nulls where ``by`` is empty. What it returns is a written table.
    """
    names, margin = list(wanted), 2 / _ACCURACY
    values = rows.select(*by, *(wanted[k][0].cast("double").alias(f"x_{i}") for i, k in enumerate(names)))
    shared: dict[int, list[int]] = {}  # percentiles of one and the same column share a summary
    for i, k in enumerate(names):
        shared.setdefault(id(wanted[k][0]), []).append(i)
    bounds, brackets = [], []
    for places in shared.values():
        x = F.col(f"x_{places[0]}")
        around = [min(1.0, max(0.0, q)) for i in places for q in (wanted[names[i]][1] - margin, wanted[names[i]][1] + margin)]
        bounds += [F.count(x).alias(f"all_{places[0]}"), F.percentile_approx(x, around, _ACCURACY).alias(f"around_{places[0]}")]
        n, at = F.col(f"all_{places[0]}"), F.col(f"around_{places[0]}")
        whole = n <= _ACCURACY
        for k, i in enumerate(places):
            brackets += [n.alias(f"n_{i}"), F.when(whole, float("-inf")).otherwise(at[2 * k]).alias(f"low_{i}"), F.when(whole, float("inf")).otherwise(at[2 * k + 1]).alias(f"high_{i}")]
    first = staged(values.groupBy(*by).agg(*bounds).select(*by, *brackets), "brackets")
    places = [
        F.when(F.col(f"x_{i}") <= F.col(f"high_{i}"), F.struct(F.lit(i).alias("i"), F.col(f"n_{i}").alias("n"), F.when(F.col(f"x_{i}") >= F.col(f"low_{i}"), F.col(f"x_{i}")).alias("v")))
        for i in range(len(names))
    ]
    inside = beside(values, first, by).select(*by, F.inline(F.array_compact(F.array(*places))))
    counted = inside.groupBy(*by, "i", "n", "v").agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()))
    share = F.element_at(F.array(*(F.lit(float(wanted[k][1])) for k in names)), F.col("i") + 1)
    ranked = counted.withColumn("upto", upto).withColumn("rank", share * (F.col("n") - 1))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    ends = ranked.groupBy(*by, "i").agg(F.first("rank").alias("rank"), at(F.floor("rank")).alias("low"), at(F.ceil("rank")).alias("high"))
    mixed = (F.ceil("rank") - F.col("rank")) * F.col("low") + (F.col("rank") - F.floor("rank")) * F.col("high")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(mixed)
    found = ends.groupBy(*by).agg(*(F.max(F.when(F.col("i") == i, value)).alias(k) for i, k in enumerate(names)))
    return staged(beside(first.select(*by), found, by) if by else found, "percentiles")
