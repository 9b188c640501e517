"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm.common import WORD, dropped, fresh, staged

#: Rates are summed as integers of this many parts, so that reruns agree to the last copy.
PARTS = 1 << 20


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_rate: int = 3, weight_cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source``, ``source_size`` and ``target`` for every source of ``sizes`` (``source``, ``size``).

    Sources in code-point order, null last, weigh ``weight_cycle`` in turn. Together they
    share the sum of all sizes; a target stops at ``max_rate`` times its source's size and the
    excess goes to the others by weight, until none is above. That fixed point has a water
    level: with sources ordered by limit over weight, those before the first one whose limit
    is above the level are at their limit. One row a source passes the windows.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weight_cycle)), (place % len(weight_cycle) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_rate).alias("limit"))
    order = Window.orderBy((F.col("limit") / F.col("w")), F.col("source").asc_nulls_last())
    upto, everywhere = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    level = (F.sum("source_size").over(everywhere) - (F.sum("limit").over(upto) - F.col("limit"))) / (
        F.sum("w").over(everywhere) - (F.sum("w").over(upto) - F.col("w"))
    )
    levels = ranked.withColumn("level", level).withColumn("at", F.row_number().over(order))
    first_free = F.min(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct("at", "level"))).over(everywhere)
    return levels.select(
        "source", "source_size", F.least(F.col("limit").cast("double"), F.col("w") * first_free["level"]).alias("target")
    )


def balance(
    cells: DataFrame, targets: DataFrame, max_rate: int = 3, max_rounds: int = 30, tolerance: float = 1e-9
) -> DataFrame:
    """Dual variables of entropy balancing: ``source`` and ``tilt``.

    The rates r of the documents minimise the sum of size * r * ln(r / base) under one
    token constraint a source, sum of size * r = target, and 0 <= r <= ``max_rate``. The
    convex dual separates by source and its solution is r = min(max_rate, base * exp(tilt)).
    A round sums tokens and curvature over ``cells`` (``source``, ``base``, ``size``) with
    map-side combine and takes a Newton step on the logarithm of the constraint; where all
    documents stand at the limit there is no curvature and the step is the plain ratio.
    Sources without tokens keep tilt 0.
    """
    tilts = targets.select("source", "target", F.lit(0.0).alias("tilt"))
    for _ in range(max_rounds):
        tilts = staged(tilts, "tilts")
        rate = F.least(F.lit(float(max_rate)), F.col("base") * F.exp("tilt"))
        sums = (
            cells.join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                F.sum(F.col("size") * rate).alias("mass"),
                F.sum(F.when(rate < max_rate, F.col("size") * rate).otherwise(0.0)).alias("slope"),
            )
        )
        both = tilts.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.when((F.col("target") > 0) & (F.col("mass") > 0), F.ln(F.col("target") / F.col("mass"))).otherwise(0.0)
        step = F.when(F.col("slope") > 0, gap * F.col("mass") / F.col("slope")).otherwise(gap)
        both = staged(both.select("source", "target", "tilt", gap.alias("gap"), step.alias("step")), "steps")
        if (both.agg(F.max(F.abs("gap"))).first()[0] or 0.0) <= tolerance:
            break
        tilts = both.select("source", "target", (F.col("tilt") + F.greatest(F.lit(-5.0), F.least(F.lit(5.0), "step"))).alias("tilt"))
    return tilts.select("source", "tilt")


#: Equal rows that one row stands for while they are dealt into slots.
_RUN = 4096


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    base_col: str | None = None,
    max_rate: int = 3,
    rows_per_slot: int = 100_000,
) -> DataFrame:
    """Copies of every document in a mix that meets its sources' token targets.

    Returns ``doc_id, source, size, source_size, target, rate, copies, taken`` with one row a
    row of ``df``. Rates come from :func:`balance`; ``base_col`` (positive, 1 where absent or
    null) is the rate a document would have without constraints. Rounding: in each source
    and in order of falling size class, the running sum of rates is rounded and a document
    gets the difference, so that the copies follow the rates all along the sizes. A class of a
    source is dealt into slots of about ``rows_per_slot`` rows, so none is summed in one place.
    Then each source adds or drops one copy of the document whose size is nearest to its
    remaining gap, again and again until no single change makes any gap smaller. A null text
    has size 0; a null source is a source; repeated rows count each; an empty table gives no
    rows. Rows alike in id, source, size, base rate and text are counted first and dealt in runs of at most
    ``_RUN``, so null or repeated ids make no slot large. The same table gives the same copies whatever its partitions.
    """
    return _mixed_rows(df, id_col, text_col, source_col, base_col, max_rate, rows_per_slot).drop("digest")


def _mixed_rows(df: DataFrame, id_col: str, text_col: str, source_col: str, base_col: str | None = None, max_rate: int = 3, rows_per_slot: int = 100_000) -> DataFrame:
    """The rows of :func:`mix` with ``digest``, the 64-bit hash of the text."""
    base = F.coalesce(F.col(base_col).cast("double"), F.lit(1.0)) if base_col else F.lit(1.0)
    sizes = staged(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), base.alias("base"), F.xxhash64(F.col(text_col)).alias("digest")),
        "sizes",
    )
    targets = staged(source_targets(sizes, max_rate), "targets")
    cells = staged(sizes.groupBy("source", "base").agg(F.sum("size").alias("size")), "cells")
    tilts = balance(cells, targets, max_rate)
    plan = staged(targets.join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "plan")

    rate = F.least(F.lit(float(max_rate)), F.col("base") * F.exp("tilt"))
    size_class = F.when(F.col("size") > 0, F.floor(F.log2("size") * 8)).otherwise(-1).cast("int")
    classed = sizes.withColumn("cls", size_class)
    # Equal rows are interchangeable: one row stands for a run of them until their places are known.
    alike = classed.groupBy("doc_id", "source", "size", "base", "digest", "cls").agg(F.count(F.lit(1)).alias("n"))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN))))
    runs = runs.withColumn("n", F.least(F.lit(_RUN).cast("long"), F.col("n") - F.col("run") * _RUN))
    spread = F.xxhash64("doc_id", "size", "digest", "run")
    classes = classed.groupBy(F.col("source").alias("s"), F.col("cls").alias("c")).agg(F.ceil(F.count(F.lit(1)) / rows_per_slot).alias("slots"))
    plan = plan.withColumnRenamed("source", "s").join(classes.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    plan = staged(plan, "classes")
    rated = runs.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c"))).select(
        "doc_id", "source", "size", "source_size", "target", rate.alias("rate"), F.round(rate * PARTS).cast("long").alias("parts"),
        "cls", F.pmod(spread, F.col("slots")).cast("int").alias("slot"), spread.alias("spread"), "digest", "run", "n",
    )
    # Running sums in two levels: over the (class, slot) groups of a source, then inside each group.
    groups = rated.groupBy("source", "cls", "slot").agg(F.sum(F.col("parts") * F.col("n")).alias("group_parts"))
    before = F.sum("group_parts").over(Window.partitionBy("source").orderBy(F.desc("cls"), "slot")) - F.col("group_parts")
    groups = groups.select(F.col("source").alias("s"), F.col("cls").alias("c"), F.col("slot").alias("o"), before.alias("before"))
    inside = Window.partitionBy("source", "cls", "slot").orderBy(F.desc("size"), "spread", "doc_id", "digest", "run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = PARTS // 2
    rounded = (
        rated.withColumn("upto", F.sum(F.col("parts") * F.col("n")).over(inside))
        .withColumn("rows_upto", F.sum("n").over(inside))
        .join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c")) & (F.col("slot") == F.col("o")))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .withColumn("end", F.col("before") + F.col("upto") - (F.col("n") - F.col("nth")) * F.col("parts"))
        .select(
            "doc_id", "source", "size", "digest", "source_size", "target", "rate", "cls", "slot", (F.col("rows_upto") - F.col("n") + F.col("nth")).alias("pos"),
            (F.floor((F.col("end") + half) / PARTS) - F.floor((F.col("end") - F.col("parts") + half) / PARTS)).cast("long").alias("copies"),
        )
    )
    rounded = staged(rounded, "rounded")
    dropped(sizes, targets, cells)
    return _corrected(rounded, max_rate).withColumn("taken", F.col("copies") * F.col("size")).select(
        "doc_id", "source", "size", "digest", "source_size", "target", "rate", "copies", "taken"
    )


_KEY = ["cls", "slot", "pos"]
#: Words by which a change must make a gap smaller; targets are fractions.
_LEAST_GAIN = 1e-6


def _corrected(rounded: DataFrame, max_rate: int) -> DataFrame:
    """One copy more or less of one document a source and round, as long as that makes a gap smaller.

    A gap shrinks with each change, so the rounds end; rounding leaves gaps of about one document.
    """
    changed, now = None, rounded
    while True:
        gaps = now.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        here = now.join(gaps.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        fits = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap") - _LEAST_GAIN) & F.when(F.col("gap") > 0, F.col("copies") < max_rate).otherwise(F.col("copies") > 0)
        best = F.min_by(F.struct(*_KEY, F.signum("gap").cast("long").alias("delta")), F.struct(F.abs(F.col("size") - F.abs("gap")), F.col("doc_id"), *_KEY))
        picks = staged(here.where(fits).groupBy("source").agg(best.alias("pick")).select("source", "pick.*"), "picks")
        if picks.isEmpty():
            dropped(picks)
            return now
        if changed is None:
            changed = picks
        else:
            both = staged(changed.union(picks), "picks")
            dropped(changed, picks)
            changed = both
        now = _with_changes(rounded, changed)


def _with_changes(rounded: DataFrame, changed: DataFrame) -> DataFrame:
    sums = changed.groupBy("source", *_KEY).agg(F.sum("delta").alias("delta"))
    sums = sums.select(F.col("source").alias("s"), *(F.col(k).alias(f"to_{k}") for k in _KEY), "delta")
    same = F.col("source").eqNullSafe(F.col("s"))
    for k in _KEY:
        same &= F.col(k) == F.col(f"to_{k}")
    copies = (F.col("copies") + F.coalesce("delta", F.lit(0))).alias("copies")
    return rounded.join(sums, same, "left").select(*(c for c in rounded.columns if c != "copies"), copies)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as :func:`mix` says, with the columns of ``df``.

    Rows are matched by id, source, size and a hash of the text; rows alike in all of these share their copies
    out in text order. Helper columns get names that ``df`` does not have.
    """
    key, place, copies = (fresh(df, c) for c in ("mix_key", "mix_nth", "mix_copies"))
    plan = _mixed_rows(df, id_col, text_col, source_col, **options)
    plan = plan.select(F.to_json(F.struct("doc_id", "source", "size", "digest")).alias(key), F.col("copies").alias(copies))  # one string, so that nulls meet
    plan = plan.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(copies)))).where(F.col(copies) > 0)
    own_key = F.to_json(F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("digest")))
    own = df.withColumn(key, own_key).withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(text_col)))
    repeated = own.join(plan, [key, place]).select(*(F.col(f"`{c}`") for c in df.columns), F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies))
    return repeated.drop(copies)
