"""Sampling by weight without replacement, exact at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.operators.quantiles import beside

#: Hex digits of a hash that make one uniform number, and steps of a key's exponent in the two passes.
_DIGITS, _COARSE, _FINE = 13, 16, 4096


def exponential_key(weight: Column, seed: int, key: tuple[str, ...]) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the seed and the key: the rows with the least ones are a sample by weight."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key))
    drawn = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")
    return F.try_divide(-F.ln((drawn + 0.5) / float(16**_DIGITS)), weight)


def _reach(counts: DataFrame, by: list[str], step: str, n: Column) -> DataFrame:
    """Of each stratum the step in which its n-th row lies (null: it has fewer) and the rows below that step."""
    upto = F.sum("times").over(Window.partitionBy(*by).orderBy(step))
    passed = counts.withColumn("upto", upto).where(F.col("upto") >= n)
    first = passed.groupBy(*by).agg(F.min_by(F.struct(F.col(step).alias("at"), (F.col("upto") - F.col("times")).alias("below")), step).alias("x"))
    return first.select(*by, F.col("x.at").alias(f"{step}_at"), F.col("x.below").alias(f"{step}_below"))


def weighted_sample(df: DataFrame, weight: Column, n: int, seed: int = 42, key: tuple[str, ...] = ("part_key", "po_date"), by: tuple[str, ...] = ()) -> DataFrame:
    """``n`` rows of each stratum of ``by`` without replacement, with chances by weight; all rows of a stratum that has fewer.

    The rows with the least exponential keys, ties by ``key``; the same rows in every run. Counts of keys in steps of their exponent find the step
    that holds the n-th one, counts inside that step a far smaller one, and only rows of the latter are ranked: no stratum is sorted or
    sent to the driver, however large it or ``n`` is. Rows without a finite positive weight have no chance. ``key``
    should tell rows apart: rows with one key and weight are drawn together. ``df`` is read three times and should be a written table.
    """
    strata = [f"stratum_{i}" for i in range(len(by))]
    good = (weight > 0) & ~F.isnan(weight) & (weight < float("inf"))
    rows = df.where(good).select("*", exponential_key(weight, seed, key).alias("drawn_key"), *(F.col(c).alias(s) for c, s in zip(by, strata, strict=True)))
    place = F.floor(F.log2("drawn_key") * (_COARSE * _FINE))
    rows = rows.withColumns({"fine": place, "coarse": F.floor(place / _FINE)})
    if not by:
        rows, strata = rows.withColumn("stratum_0", F.lit(0)), ["stratum_0"]
    if n <= 0:
        return df.limit(0)
    coarse = _reach(rows.groupBy(*strata, "coarse").agg(F.count(F.lit(1)).alias("times")), strata, "coarse", F.lit(n))
    rows = beside(rows, coarse, strata)
    edge = rows.where(F.col("coarse") == F.col("coarse_at")).withColumn("still", n - F.col("coarse_below"))
    fine = _reach(edge.groupBy(*strata, "still", "fine").agg(F.count(F.lit(1)).alias("times")), strata, "fine", F.col("still"))
    rows = beside(rows, fine, strata).where(F.col("coarse_at").isNull() | (F.col("fine") <= F.col("fine_at")))
    last = F.coalesce(F.col("fine") == F.col("fine_at"), F.lit(False))
    inside = F.row_number().over(Window.partitionBy(*strata).orderBy("drawn_key", *key))
    ranked = rows.where(last).withColumn("inside", inside).where(F.col("inside") <= n - F.col("coarse_below") - F.col("fine_below"))
    return rows.where(~last).select(*df.columns).unionAll(ranked.select(*df.columns))
