"""Repeat-purchase pairs, extreme flags, weights and calendar-month exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions import columns as C
from costweave.operators.quantiles import beside, percentiles
from costweave.plans.stages import staged


def adjacent_pairs(daily: DataFrame, min_gap_days: int = 0) -> DataFrame:
    """Consecutive observations of a part.

    ``n_pairs_part`` counts before the gap filter. The category is that of the later observation.
    The window reuses the partitioning of the daily panel's aggregation by part where it can.
    """
    part = Window.partitionBy("part_key")
    before = F.lag(F.struct("po_date", "price", "qty", "spend")).over(part.orderBy("po_date"))
    rows = daily.select("part_key", "approved_category", "po_date", "price", "qty", "spend", before.alias("a")).where(F.col("a").isNotNull() & (F.col("a.price") > 0) & (F.col("price") > 0))
    days = F.datediff("po_date", F.col("a.po_date"))
    both = C.positive(F.col("qty")) & C.positive(F.col("a.qty"))
    pairs = rows.where(days > 0).select(
        "part_key", F.col("a.po_date").alias("date_a"), F.col("po_date").alias("date_b"), F.col("a.price").alias("price_a"), F.col("price").alias("price_b"),
        F.col("a.qty").alias("qty_a"), F.col("qty").alias("qty_b"), F.col("a.spend").alias("spend_a"), F.col("spend").alias("spend_b"),
        F.ln(F.col("price") / F.col("a.price")).alias("y"), F.when(both, F.ln(F.col("qty") / F.col("a.qty"))).otherwise(0.0).alias("x_q"),
        days.cast("long").alias("delta_days"), (days / 365.25).alias("delta_years"), (F.col("price") / F.col("a.price")).alias("price_ratio"),
        both.alias("qty_comparable"), "approved_category",
    ).withColumn("n_pairs_part", F.count(F.lit(1)).over(part))
    return pairs.where(F.col("delta_days") >= min_gap_days)


def flag_extremes(pairs: DataFrame, low: float = 0.25, high: float = 4.0, max_days: int = 548, max_z: float = 8.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Ratio and robust-z flags; the two exact medians of all pairs (of each run ``by``) are joined back.

    ``pairs`` is read five times and should be a written table.
    """
    annual = pairs.withColumn("annual", F.col("y") / F.greatest("delta_years", F.lit(1 / 365.25)))
    middle = percentiles(annual, [*by], {"middle": (F.col("annual"), 0.5)})
    centred = beside(annual, middle, [*by])
    mad = percentiles(centred, [*by], {"mad": (F.abs(F.col("annual") - F.col("middle")), 0.5)})
    z = 0.6745 * (F.col("annual") - F.col("middle")) / (F.col("mad") + 1e-12)
    by_ratio = (F.col("delta_days") <= max_days) & ((F.col("price_ratio") < low) | (F.col("price_ratio") > high))
    out = beside(centred, mad, [*by]).withColumns({"mad_z": z, "extreme_ratio": by_ratio}).withColumn("extreme_mad", F.abs("mad_z") > max_z)
    return out.withColumn("extreme_flag", F.col("extreme_ratio") | F.col("extreme_mad")).drop("annual", "middle", "mad")


def pair_weights(pairs: DataFrame, method: str = "capped_spend_sqrt_n", extreme_factor: float = 0.25, by: tuple[str, ...] = ()) -> DataFrame:
    """``pair_weight``: capped geometric spend over root of the part's pairs, mean 1, extremes damped, mean 1 again.

    With ``by`` the cap and the means are those of each run.
    """
    if method == "equal_part":
        raw = pairs.withColumn("w", 1 / F.greatest(F.col("n_pairs_part").cast("double"), F.lit(1.0)))
    else:
        value = lambda s: F.greatest(F.coalesce(F.col(f"spend_{s}"), F.col(f"price_{s}") * F.coalesce(F.col(f"qty_{s}"), F.lit(0.0))), F.lit(0.0))
        geometric = pairs.withColumn("g", F.sqrt(value("a") * value("b")))
        cap = percentiles(geometric, [*by], {"cap": (F.when(F.col("g") > 0, F.col("g")), 0.95)})
        cap = cap.withColumn("cap", F.coalesce("cap", F.lit(1.0)))
        w = F.least("g", "cap") / F.sqrt(F.greatest(F.col("n_pairs_part").cast("double"), F.lit(1.0)))
        raw = beside(geometric, cap, [*by]).withColumn("w", F.when(w > 0, w).otherwise(1.0)).drop("g", "cap")
    damped = F.col("w") * F.when(F.col("extreme_flag"), extreme_factor).otherwise(1.0)
    # The first normalisation to mean 1 cancels in the second.
    mean = staged(raw.groupBy(*by).agg(F.avg(damped).alias("mean_w")), "mean-weights")
    return beside(raw, mean, [*by]).withColumn("pair_weight", damped / F.col("mean_w")).drop("w", "mean_w")


def month_exposure(pairs: DataFrame, keys: tuple[str, ...] = ("part_key", "date_a", "date_b")) -> DataFrame:
    """Share of each calendar month that lies in (date_a, date_b], one row a pair and month."""
    months = F.sequence(F.trunc(F.date_add("date_a", 1), "month"), F.trunc("date_b", "month"), F.expr("interval 1 month"))
    rows = pairs.select(*keys, *(c for c in ("date_a", "date_b") if c not in keys), F.explode(months).alias("month"))
    last = F.last_day("month")
    days = F.datediff(F.least("date_b", last), F.greatest("date_a", F.date_sub("month", 1)))
    return rows.select(*keys, "month", (F.greatest(days, F.lit(0)) / F.day(last)).alias("exposure")).where("exposure > 0")


def weighted_gram(pairs: DataFrame) -> DataFrame:
    """Normal matrix of month exposures under pair weights: one weighted least-squares step in plain SQL form.

    Pairs of the same two days have the same months, so their weights are added first; what follows is bounded by the calendar.
    Months are short arrays; products are made in the row and summed on the way to the shuffle, so nothing is joined.
    """
    months = F.sequence(F.trunc(F.date_add("date_a", 1), "month"), F.trunc("date_b", "month"), F.expr("interval 1 month"))

    def share(m):
        days = F.datediff(F.least(F.col("date_b"), F.last_day(m)), F.greatest(F.col("date_a"), F.date_sub(m, 1)))
        return F.greatest(days, F.lit(0)) / F.day(F.last_day(m))

    shares = F.filter(F.transform(months, lambda m: F.struct(m.alias("month"), share(m).alias("exposure"))), lambda s: s["exposure"] > 0)
    spans = pairs.groupBy("date_a", "date_b").agg(F.sum("pair_weight").alias("pair_weight"))
    rows = spans.select("pair_weight", shares.alias("all")).select("pair_weight", "all", F.inline("all"))
    rows = rows.select((F.col("pair_weight") * F.col("exposure")).alias("weighted"), "month", F.explode("all").alias("other"))
    return rows.groupBy("month", F.col("other.month").alias("month_2")).agg(F.sum(F.col("weighted") * F.col("other.exposure")).alias("gram"))
