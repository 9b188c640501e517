"""Fits of many runs over the same pairs, each pair one row with a vector by run.

Resamples of whole parts carry how often each of them draws the pair; cutoffs carry how many pairs of the part are known at each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.operators import regression, robust

_NONE = "\t"
#: As in :func:`costweave.operators.pairs.flag_extremes` and ``pair_weights``: the robust z beyond which a change is extreme, and the part of its weight that is left.
_MAX_Z, _EXTREME = 8.0, 0.25


def with_times(rows: DataFrame, runs: int, seed: int = 42, key: str = "part_key") -> DataFrame:
    """Adds ``times``: for each run the number of times that the row's part is drawn.

    Run 0 is the original. In the others each part is drawn a Poisson(1) number of times, the distributed form of
    drawing as many parts with replacement as there are: no list of parts is made anywhere. The numbers come from a
    hash of seed, run and part, so they are the same in every attempt of a task.
    """
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(1, 15):
        total += term
        term /= k
        steps.append(total)
    chance = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.when(r > 0, (F.pmod(F.xxhash64(F.lit(seed), r, F.col(key)), F.lit(1 << 53)) + 0.5) / float(1 << 53)))

    def drawn(u):  # few rows get beyond the first branches
        found = F.when(u.isNull(), 1)
        for k, step in enumerate(steps):
            found = found.when(u < step, k)
        return found.otherwise(len(steps)).cast("tinyint")

    return rows.withColumn("times", F.transform(chance, drawn))


def _drawn(batch: pa.RecordBatch) -> np.ndarray:
    """How often each run has a row, in small whole numbers: rows by runs."""
    name = "known" if "known" in batch.schema.names else "times"
    held = batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)
    return (held > 0).astype(np.int8) if name == "known" else held


def _times(batch: pa.RecordBatch) -> np.ndarray:
    return _drawn(batch).astype(float)


def _by_category(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    codes = batch.column("category").dictionary_encode()
    index = codes.indices.to_numpy()
    for k, name in enumerate(codes.dictionary.to_pylist()):
        yield name, np.flatnonzero(index == k)


def _counted(size: int, batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Draws by run: overall, by category, with spend, and by first and last month."""
    times, g = _times(batch), batch.column("g").to_numpy(zero_copy_only=False)
    yield f"n\t{regression.OVERALL}", times.sum(axis=0)
    yield "spent", times[g > 0].sum(axis=0)
    for name, at in _by_category(batch):
        yield f"n\t{name}", times[at].sum(axis=0)
    first = batch.column("first").to_numpy(zero_copy_only=False)
    for what, month in (("first", first), ("last", batch.column("last").to_numpy(zero_copy_only=False))):
        by = np.zeros((size, times.shape[1]))
        np.add.at(by, month, times)
        yield what, by.ravel()


def _spend(runs: list[str], batch: pa.RecordBatch, wanted: dict) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    g = batch.column("g").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(g > 0)
    yield runs, np.broadcast_to(g[at, None], (len(at), len(runs))), _times(batch)[at]


@dataclass
class _Weights:
    """What weights of a run are made of: its cap and the mean they are brought to; median and spread of yearly changes where extremes are each run's own."""

    cap: np.ndarray | None = None
    mean: np.ndarray | float = 1.0
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None

    def of(self, batch: pa.RecordBatch) -> Callable[[np.ndarray], np.ndarray]:
        """Weights of the batch's rows of some numbers: rows by runs."""
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[:, None]
        own = "known" in batch.schema.names
        n = batch.column("known").flatten().to_numpy().reshape(batch.num_rows, -1) if own else column("n")
        g, runs = column("g"), n.shape[1] if own else _drawn(batch).shape[1]
        annual, ratio, fixed = (column("annual"), column("ratio"), None) if self.middle is not None else (None, None, column("damp"))

        def weighed(at: np.ndarray) -> np.ndarray:
            root = 1 / np.sqrt(np.maximum(n[at], 1.0))
            damp = fixed[at] if annual is None else np.where(ratio[at] | (np.abs(0.6745 * (annual[at] - self.middle) / (self.spread + 1e-12)) > _MAX_Z), _EXTREME, 1.0)
            if self.cap is None:
                return np.broadcast_to(root * root * damp / self.mean, (len(at), runs))
            w = np.minimum(g[at], self.cap)
            w *= root
            w[w <= 0] = 1.0
            w *= damp
            w /= self.mean
            return w

        return weighed


def _annual(runs: list[str], batch: pa.RecordBatch, wanted: dict) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    annual = batch.column("annual").to_numpy(zero_copy_only=False)
    yield runs, np.broadcast_to(annual[:, None], (len(annual), len(runs))), _times(batch)


def _weight_sums(weights: _Weights, batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    if batch.num_rows:
        yield "weights", (weights.of(batch)(np.arange(batch.num_rows)) * _times(batch)).sum(axis=0)


def _groups(weights: _Weights, names: list[str], batch: pa.RecordBatch) -> Iterator[robust.Group]:
    if not batch.num_rows:
        return
    times, weighed = _drawn(batch), weights.of(batch)
    name = lambda category: [f"{r}\t{category}" for r in names]
    yield robust.Group(name(regression.OVERALL), np.arange(batch.num_rows), weighed, times)
    for category, at in _by_category(batch):
        yield robust.Group(name(category), at, weighed, times[at[0] : at[-1] + 1] if at[-1] - at[0] == len(at) - 1 else times[at])


@dataclass
class Resampled:
    """Fits of all resamples that have one, the draws of each category by run, and the grid of months."""

    models: dict[str, regression.RepeatSales]
    draws: dict[str, np.ndarray]
    runs: int
    first: int
    size: int


def fit_resamples(flagged: DataFrame, controls: Controls | None = None, max_rounds: int | None = None, extreme_factor: float = 0.25) -> Resampled:
    """Repeat-sales fits of the original pairs (run 0) and of ``bootstrap_iterations`` - 1 resamples.

    Weights are those of :func:`costweave.operators.pairs.pair_weights`, with the cap and the mean of each resample, found
    for all of them in the same passes. Resamples start from the fit of run 0. No row is repeated: a task adds up the
    equations of all runs from the same rows. ``flagged`` is read twice; the prepared rows are persisted meanwhile.
    """
    c = controls or Controls()
    runs = max(2, c.bootstrap_iterations)
    month = lambda d: F.year(d) * 12 + F.month(d) - 1
    first, last = flagged.agg(F.min(month(F.date_add("date_a", 1))), F.max(month(F.col("date_b")))).first()
    if first is None:
        return Resampled({}, {}, runs, 0, 0)
    size = last - first + 2
    own = (F.col("n_pairs_part").cast("double").alias("n"), F.when(F.col("extreme_flag"), extreme_factor).otherwise(1.0).alias("damp"), "times")
    rows = with_times(regression.span_rows(flagged, first), runs, c.random_seed).select(*_row(), *own)
    rows, tasks = robust.spread_out(rows, ("category", "first", "last"))
    names = [str(r) for r in range(runs)]
    try:
        weights, draws, span, counts = _weighed(rows, names, size, c, tasks)
        fitted = partial(regression.fitted, rows, partial(_groups, weights, names), span=span, size=size, c=c, tasks=tasks, max_rounds=max_rounds)
        original = fitted({u: n for u, n in counts.items() if u.startswith("0\t")})
        start = {u: original[f"0\t{u.split(chr(9), 1)[1]}"][0] for u in counts if f"0\t{u.split(chr(9), 1)[1]}" in original}
        fits = original | fitted({u: n for u, n in counts.items() if not u.startswith("0\t")}, start=start)
    finally:
        rows.unpersist()
    whole = {u: (*f[:3], int(f[3])) for u, f in fits.items()}
    return Resampled(regression.models_of(whole, span, first, c), draws, runs, first, size)


def _row() -> tuple:
    """Columns of a pair that every fit reads; ``g`` is the geometric mean of both spends."""
    value = lambda s: F.greatest(F.coalesce(F.col(f"spend_{s}"), F.col(f"price_{s}") * F.coalesce(F.col(f"qty_{s}"), F.lit(0.0))), F.lit(0.0))
    return F.coalesce("approved_category", F.lit("Uncategorized")).alias("category"), "first", "last", "head", "tail", "x_q", "y", F.sqrt(value("a") * value("b")).alias("g")


def _weighed(rows: DataFrame, names: list[str], size: int, c: Controls, tasks: int, extremes: bool = False) -> tuple[_Weights, dict, dict, dict]:
    """Weights of all runs, each run's draws of every category, its months, and the rows of every unit."""
    runs, direct = len(names), tasks * 2 * size * len(names) * 8 <= robust.SENT
    sums = robust.sum_pass(rows, partial(_counted, size), direct)
    total, limit = sums[f"n\t{regression.OVERALL}"], robust.limit_of(runs, tasks)
    weights = _Weights()

    def exact(values: Callable, n: np.ndarray, share: float, with_spread: bool) -> dict[str, robust.Target]:
        targets = {r: robust.begun(k, limit) for r, k in zip(names, n.tolist(), strict=True) if k > 0}
        robust.quantiles(rows, partial(values, names), targets, share, with_spread, direct)
        return targets

    if extremes:
        found = exact(_annual, total, 0.5, True)
        weights.middle, weights.spread = (np.array([getattr(found[r], k) if r in found else 0.0 for r in names]) for k in ("middle", "spread"))
    if c.pair_weight_method != "equal_part":
        found = exact(_spend, sums["spent"], 0.95, False)
        weights.cap = np.array([found[r].middle if r in found else 1.0 for r in names])
    mean = robust.sum_pass(rows, partial(_weight_sums, weights), direct)["weights"] / np.maximum(total, 1)
    weights.mean = np.where(mean > 0, mean, 1.0)
    draws = {k.split("\t", 1)[1]: v for k, v in sums.items() if k.startswith("n\t")}
    months = {k: sums[k].reshape(size, runs) > 0 for k in ("first", "last")}
    drawn = [r for r in range(runs) if total[r] > 0]
    span = {names[r]: (int(np.flatnonzero(months["first"][:, r])[0]), int(np.flatnonzero(months["last"][:, r])[-1]) + 1) for r in drawn}
    counts = {f"{names[r]}\t{k}": float(v[r]) for k, v in draws.items() for r in drawn if v[r] > 0}
    return weights, draws, span, counts


def fit_known(pairs: DataFrame, runs: list[str], controls: Controls | None = None, extremes: bool = True) -> dict[str, regression.RepeatSales]:
    """:func:`costweave.operators.regression.fit_runs` of runs that know some of the same pairs each; a pair is one row for all of them.

    ``pairs`` has an array ``known`` in the order of ``runs``: how many pairs of the part a run knows, 0 where it does not know this one. Weights are those of
    :func:`costweave.operators.pairs.pair_weights`, with the cap and the mean of each run; with ``extremes`` changes are flagged by each run's
    own median and spread (:func:`costweave.operators.pairs.flag_extremes`), else none is. ``pairs`` is read twice and should be a written table.
    """
    c = controls or Controls()
    month = lambda d: F.year(d) * 12 + F.month(d) - 1
    some = pairs.where(F.exists("known", lambda n: n > 0))
    first, last = some.agg(F.min(month(F.date_add("date_a", 1))), F.max(month(F.col("date_b")))).first()
    if first is None:
        return {}
    size = last - first + 2
    ratio = (F.col("delta_days") <= c.extreme_ratio_max_days) & ((F.col("price_ratio") < c.extreme_ratio_low) | (F.col("price_ratio") > c.extreme_ratio_high))
    flags = ((F.col("y") / F.greatest("delta_years", F.lit(1 / 365.25))).alias("annual"), ratio.alias("ratio")) if extremes else (F.lit(1.0).alias("damp"),)
    rows = regression.span_rows(some, first).select(*_row(), F.lit(0.0).alias("n"), *flags, "known")
    rows, tasks = robust.spread_out(rows, ("category", "first", "last"))
    try:
        weights, _, span, counts = _weighed(rows, runs, size, c, tasks, extremes)
        fits = regression.fitted(rows, partial(_groups, weights, runs), counts, span, size, c, tasks)
    finally:
        rows.unpersist()
    return regression.models_of({u: (*f[:3], int(f[3])) for u, f in fits.items()}, span, first, c)


def _growth(first: int, path: np.ndarray, a: date, b: date) -> float:
    """Log price change over (a, b] along monthly rates from month ``first`` on; months outside take the last rate."""
    total, day = 0.0, a + timedelta(days=1)
    while day <= b:
        m = day.year * 12 + day.month - 1
        after = date((m + 1) // 12, (m + 1) % 12 + 1, 1)
        days = (min(b + timedelta(days=1), after) - day).days
        rate = path[m - first] if 0 <= m - first < len(path) else path[-1]
        total += days / (after - timedelta(days=1)).day * rate
        day = after
    return total


def _part_vectors(flagged: DataFrame, first: int, c: Controls) -> DataFrame:
    """One row a part: what its residual rate is made of, as a sum by category and month that any path can be applied to.

    The residual rate is linear in the path, so the rates of all runs follow from the same few sums. Places -1 and
    -2 hold the sums of the price changes and of the quantity changes.
    """
    stats = regression.part_residuals(flagged.withColumn("predicted", F.lit(0.0)), c).select("part_key", "category", "n_eff", "shrinkage")
    a = F.when(F.col("extreme_flag"), 0.25).otherwise(1.0) * F.when(F.col("qty_comparable"), 1.0).otherwise(0.7) * F.least(F.greatest(F.col("delta_years") / (30 / 365.25), F.lit(0.1)), F.lit(1.0))
    u = a / F.greatest("delta_years", F.lit(1e-6))
    rows = regression.exposure_rows(flagged.withColumn("u", u), first)
    months = F.transform("shares", lambda s, i: F.struct((F.col("first") + i).alias("m"), (F.col("u") * s).alias("s")))
    own = F.array(F.struct(F.lit(-1).alias("m"), (F.col("u") * F.col("y")).alias("s")), F.struct(F.lit(-2).alias("m"), (F.col("u") * F.col("x_q")).alias("s")))
    each = rows.select("part_key", "approved_category", F.inline(F.concat(months, own))).groupBy("part_key", "approved_category", "m").agg(F.sum("s").alias("s"))
    lists = each.groupBy("part_key").agg(F.collect_list(F.coalesce("approved_category", F.lit(_NONE))).alias("cs"), F.collect_list("m").alias("ms"), F.collect_list("s").alias("ss"))
    return stats.join(lists, "part_key")


@dataclass
class _Paths:
    """Coefficients by category and run on the grid of months, and the growth from base to target."""

    names: list[str]
    theta: np.ndarray  # categories, months and the elasticity, runs
    growth: np.ndarray  # categories, runs
    runs: list[int]
    years: float

    def multipliers(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Multiplier and category number of every part of the batch in every run."""
        n, size = batch.num_rows, self.theta.shape[1]
        number = {name: k for k, name in enumerate(self.names)}
        column = lambda c: batch.column(c).to_pylist()
        sums = np.zeros((len(self.names), n, size))
        change = np.zeros(n)
        for i, (cs, ms, ss) in enumerate(zip(column("cs"), column("ms"), column("ss"), strict=True)):
            for c, m, s in zip(cs or (), ms or (), ss or (), strict=True):
                if m == -1:
                    change[i] += s
                else:
                    sums[number.get(c, 0), i, size - 1 if m == -2 else m] += s
        rest = np.repeat(change[:, None], len(self.runs), 1)
        for k in range(len(self.names)):
            rest -= sums[k] @ self.theta[k]
        known = np.array([x is not None for x in column("n_eff")])
        drawn = known[:, None] & (_times(batch)[:, self.runs] > 0)
        n_eff, lam = (np.array([x or 0.0 for x in column(c)]) for c in ("n_eff", "shrinkage"))
        residual = np.where(drawn, (lam / np.where(n_eff > 0, n_eff, 1.0))[:, None] * rest, 0.0)
        code = lambda c: np.array([number.get(_NONE if x is None else x, 0) for x in column(c)])
        category = np.where(drawn, code("category")[:, None], code("approved_category")[:, None])
        return np.exp(self.growth[category, np.arange(len(self.runs))] + residual * self.years), category


def part_bands(flagged: DataFrame, parts: DataFrame, base: date, target: date, fits: Resampled, noisy: dict[str, list[float]], controls: Controls | None = None) -> DataFrame:
    """Quantiles over the runs of the multiplier from base to target of every part, every category and the whole basket.

    ``parts`` has ``part_key, approved_category, weight`` and ``noisy`` the future monthly rates of each run. One row a
    part with the vector of its draws passes through the tasks; a part that a run does not draw moves by its category there.
    """
    c, spark = controls or Controls(), flagged.sparkSession
    models = {r: m for r, m in fits.models.items() if m.months}
    runs = sorted(map(int, models))
    wanted = parts.where("weight > 0").select("part_key", "approved_category", F.col("weight").cast("double").alias("weight"))
    named = {r[0] for r in wanted.select("approved_category").distinct().collect()} | {k for m in models.values() for k in m.differences}
    names = [_NONE, *sorted(n for n in named if n is not None)]
    theta, growth = np.zeros((len(names), fits.size, len(runs))), np.zeros((len(names), len(runs)))
    for k, run in enumerate(runs):
        m, ahead = models[str(run)], np.array(noisy.get(str(run), []), float)
        start = m.months[0].year * 12 + m.months[0].month - 1
        for i, name in enumerate(names):
            u = m.differences.get(name)
            path = m.delta0 if u is None else m.delta0 + u
            theta[i, start - fits.first : start - fits.first + len(path), k] = path
            theta[i, -1, k] = m.gamma0 + (0.0 if u is None else m.kappa[name])
            growth[i, k] = _growth(start, np.append(path, ahead if u is None else ahead + u[-12:].mean()), base, target) if target > base else 0.0
    paths = _Paths(names, theta, growth, runs, (target - base).days / 365.25)
    table = with_times(wanted, fits.runs, c.random_seed).join(_part_vectors(flagged, fits.first, c), "part_key", "left")
    table = table.select("part_key", "approved_category", "weight", "times", "category", "n_eff", "shrinkage", "cs", "ms", "ss").persist()
    shares = (c.confidence_lower_quantile, 0.5, c.confidence_upper_quantile)

    def sums(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        if batch.num_rows:
            value, category = paths.multipliers(batch)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)[:, None]
            for k in np.unique(category):
                inside = category == k
                yield paths.names[k], np.stack([(weight * inside).sum(axis=0), (weight * inside * value).sum(axis=0)]).ravel()

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low, middle, high = np.quantile(paths.multipliers(batch)[0], shares, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(["part"] * batch.num_rows), batch.column("part_key").cast(pa.string()), *map(pa.array, (low, middle, high)), pa.array([len(runs)] * batch.num_rows, pa.int64())], names=names_out)

    schema = "level string, key string, lower double, median double, upper double, runs long"
    names_out = [x.split()[0] for x in schema.split(", ")]
    try:
        found = {k: v.reshape(2, -1) for k, v in robust.sum_pass(table, sums, True).items()}
    finally:
        table.unpersist()
    rows = []
    for k, (w, wm) in [*found.items(), *([("", sum(found.values()))] if found else [])]:
        value = wm[w > 0] / w[w > 0]
        level = ("composite", regression.OVERALL) if k == "" else ("category", None if k == _NONE else k)
        if len(value):
            rows.append((*level, *map(float, np.quantile(value, shares)), len(value)))
    return table.mapInArrow(bands, schema).unionByName(spark.createDataFrame(rows, schema))
