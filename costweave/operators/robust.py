"""Penalised Huber fits of many units at once: two passes a round over one table, whatever the number of units.

A table row belongs to one or more units (the overall fit and its category's, in one run or in many resamples). Tasks read
Arrow batches and handle all runs of one together; what leaves a task are sums a unit: counts in bins with the few values
near the wanted medians, and normal equations. A row covers all days between two dates, so its growth is the
difference of two points on the running sum of the monthly rates: four places and two shares, however many months lie between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values near the wanted ones that all tasks together may send along in a pass; where there are more, finer bins follow.
BUDGET = 2_000_000
#: Bins of each zone around a wanted value.
_BINS = 32
#: Values (rows by units) that are worked on at a time.
_PIECE = 100_000
#: First bins of a unit that nothing is known about.
_GRID = np.concatenate([-np.geomspace(1e12, 1e-13, 401), np.geomspace(1e-13, 1e12, 401)])
#: A table for fits has no more tasks than this or twice the cores, as each task sends sums of all units in every pass.
DIRECT = 32
#: Bytes of sums that all tasks together may send to the driver in a pass; where there are more, Spark adds them up first.
SENT = 64 << 20


@dataclass
class Group:
    """Rows of a batch and the units (one a run) that they belong to: times are rows by units, so are weights, which may be made of the numbers of some rows when they are read."""

    units: list[str]
    at: np.ndarray
    weights: np.ndarray | Callable[[np.ndarray], np.ndarray]
    times: np.ndarray

    def pieces(self) -> Iterator[slice]:
        """Rows a few at a time, so that rows by units stay in a processor's own memory."""
        step = max(512, _PIECE // max(1, len(self.units)))
        for a in range(0, len(self.at), step):
            yield slice(a, min(a + step, len(self.at)))

    def weighed(self, piece: slice) -> np.ndarray:
        return self.weights(self.at[piece]) if callable(self.weights) else self.weights[piece]


def plain_groups(batch: pa.RecordBatch) -> list[Group]:
    """Groups of rows that name their run and category themselves in the column ``unit``, with weights ``w``; a run's rows are its overall unit too."""
    codes = batch.column("unit").dictionary_encode()
    place, w = codes.indices.to_numpy(), np.maximum(batch.column("w").to_numpy(zero_copy_only=False), 1e-12)
    names = codes.dictionary.to_pylist()
    order = np.argsort(place, kind="stable")
    own = np.split(order, np.cumsum(np.bincount(place, minlength=len(names)))[:-1]) if names else []
    units = dict(zip(names, own, strict=True))
    runs: dict[str, list[np.ndarray]] = {}
    for unit, at in units.items():
        runs.setdefault(unit.split("\t", 1)[0], []).append(at)
    units |= {f"{run}\tOverall": np.concatenate(parts) for run, parts in runs.items()}
    return [Group([unit], at, w[at, None], np.ones((len(at), 1))) for unit, at in units.items()]


def variant_groups(variants: int, batch: pa.RecordBatch) -> list[Group]:
    """:func:`plain_groups` with each run fitted ``variants`` times, in runs named ``run|number``, on the same rows and weights."""
    out = []
    for g in plain_groups(batch):
        run, category = g.units[0].split("\t", 1)
        shape = (len(g.at), variants)
        out.append(Group([f"{run}|{i}\t{category}" for i in range(variants)], g.at, np.broadcast_to(g.weights, shape), np.broadcast_to(g.times, shape)))
    return out


@dataclass
class Spans:
    """Rows between two dates: first and last month, the part of the first from the start on and of the last up to the end, the quantity change.

    Where both are one month, ``head`` is 1 and ``tail`` the part between. With c the running sum of the monthly rates before each
    month, a row grows by -head c[first] + (head - 1) c[first + 1] + (1 - tail) c[last] + tail c[last + 1].
    """

    first: np.ndarray
    last: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    x_q: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Spans:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        return cls(column("first").astype(np.int64), column("last").astype(np.int64), column("head"), column("tail"), column("x_q"))

    def predicted(self, at: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Growth of the rows ``at`` under coefficients (months and the elasticity, by units): rows by units."""
        level = np.concatenate([np.zeros((1, theta.shape[1])), np.cumsum(theta[:-1], axis=0)])
        if theta.shape[1] >= 8:  # one product of matrices for many units
            f, l, h, t, i = self.first[at], self.last[at], self.head[at], self.tail[at], np.arange(len(at))  # noqa: E741
            places = np.zeros((len(at), len(level) + 1))
            for place, factor in ((l + 1, t), (l, 1 - t), (f + 1, h - 1), (f, -h)):
                places[i, place] += factor
            places[:, -1] = self.x_q[at]
            return places @ np.concatenate([level, theta[-1:]])
        f, l, h, t = self.first[at], self.last[at], self.head[at, None], self.tail[at, None]  # noqa: E741
        out = level[l + 1] * t
        out += level[l] * (1 - t)
        out += level[f + 1] * (h - 1)
        out -= level[f] * h
        out += self.x_q[at, None] * theta[-1]
        return out


def _sums_by(keys: np.ndarray, weights: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and for each the sums of the rows' terms under the weights of every unit: keys by units by terms."""
    once = np.flatnonzero(np.bincount(keys))
    number = np.zeros(once[-1] + 1, np.int64)
    number[once] = np.arange(len(once))
    place = number[keys]
    if weights.shape[1] == 1:
        return once, np.stack([np.bincount(place, weights[:, 0] * term, len(once)) for term in terms.T], 1)[:, None, :]
    if (place[1:] < place[:-1]).any():
        order = np.argsort(place, kind="stable")
        weights, terms = weights[order], terms[order]
    ends = np.cumsum(np.bincount(place, minlength=len(once)))
    out = np.empty((len(once), weights.shape[1], terms.shape[1]))
    for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
        np.matmul(weights[a:b].T, terms[a:b], out=out[k])
    return once, out


def _add_products(total: np.ndarray, s: Spans, at: np.ndarray, v: np.ndarray, y: np.ndarray) -> None:
    """Adds the equations of rows to ``total`` (places by places by units) on the running sums: half of each symmetric pair, the right side last.

    Places are the points of the running sum, then the elasticity. Products within an end are summed by its month, those of both ends by the pair of months.
    """
    size = total.shape[0] - 1
    f, l, h, t, q, y = (x[at] for x in (s.first, s.last, s.head, s.tail, s.x_q, y))  # noqa: E741
    one = np.ones(len(at))
    for month, part, near, far in ((f, h, lambda x, xp: -xp, lambda x, xp: xp - x), (l, t, lambda x, xp: x - xp, lambda x, xp: xp)):
        m, sums = _sums_by(month, v, np.stack([one, part, part * part, q, q * part, y, y * part], 1))
        n, p, pp, qn, qp, yn, yp = np.moveaxis(sums, 2, 0)
        # Points m and m + 1 have the factors -head and head - 1 at the start, 1 - tail and tail at the end.
        squares = (pp, p - pp, n - 2 * p + pp) if month is f else (n - 2 * p + pp, p - pp, pp)
        for place, other, value in ((m, m, squares[0] / 2), (m, m + 1, squares[1]), (m + 1, m + 1, squares[2] / 2)):
            total[place, other] += value
        for place, way in ((m, near), (m + 1, far)):
            total[place, size] += way(qn, qp)
            total[place, size + 1] += way(yn, yp)
    width = size + 1
    cell, sums = _sums_by(f * width + l, v, np.stack([one, h, t, h * t], 1))
    n, a, b, ab = np.moveaxis(sums, 2, 0)
    i, j = np.divmod(cell, width)
    for place, other, value in ((i, j, ab - a), (i, j + 1, -ab), (i + 1, j, a - ab - n + b), (i + 1, j + 1, ab - b)):
        total[place, other] += value
    total[size, size] += v.T @ (q * q) / 2
    total[size, size + 1] += v.T @ (q * y)


def _points(size: int) -> np.ndarray:
    """Points of the running sum, each the sum of the months before it, then the elasticity: points by coefficients."""
    months = np.zeros((size + 1, size))
    months[:-1, :-1] = np.tril(np.ones((size, size - 1)), -1)
    months[-1, -1] = 1.0
    return months


def _folded(total: np.ndarray) -> np.ndarray:
    """:func:`_add_products` without the lower half, which is the mirror of the upper one: half as much to send, a row a unit."""
    size = total.shape[0]
    i, j = np.triu_indices(size)
    return np.concatenate([total[i, j] + total[j, i], total[:, -1]]).T


def _unfolded(sent: np.ndarray, size: int) -> np.ndarray:
    """What rows of :func:`_folded` were made of, as far as :func:`_by_months` is concerned."""
    half, each = np.zeros((len(sent), size, size + 1)), np.arange(size)
    i, j = np.triu_indices(size)
    half[:, i, j] = sent[:, :-size]
    half[:, each, each] /= 2
    half[:, :, -1] = sent[:, -size:]
    return half


def _by_months(half: np.ndarray, months: np.ndarray | None = None) -> np.ndarray:
    """Equations on the running sums (one unit's :func:`_add_products`) as those of the monthly rates: matrix and right side."""
    whole, right, months = half[:, :-1] + half[:, :-1].T, half[:, -1], _points(half.shape[0] - 1) if months is None else months
    return np.column_stack([months.T @ whole @ months, months.T @ right])


def _merged(rows: DataFrame, direct: bool, columns: tuple[str, ...]) -> dict[str, dict[str, np.ndarray]]:
    """Rows ``unit`` and binary columns of doubles, brought to one a unit: added up, or all but the first end to end."""

    def join(parts: list[list[bytes]]) -> list[np.ndarray]:
        arrays = [[np.frombuffer(b, np.float64) for b in column] for column in parts]
        order = sorted(range(len(arrays[0])), key=lambda i: (float(arrays[0][i].sum()), arrays[0][i].tobytes()))  # one order of summation, whatever order the rows come in
        total = np.sum([arrays[0][i] for i in order], axis=0)
        return [total, *(np.concatenate([a[i] for i in order]) for a in arrays[1:])]

    def by_unit(records: Iterator[dict]) -> dict[str, list[np.ndarray]]:
        held: dict[str, list[list[bytes]]] = {}
        for r in records:
            parts = held.setdefault(r["unit"], [[] for _ in columns])
            for part, c in zip(parts, columns, strict=True):
                part.append(r[c])
        return {u: join(parts) for u, parts in held.items()}

    if not direct:

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = by_unit(r for batch in batches for r in batch.to_pylist())
            yield from _emit({u: tuple(arrays) for u, arrays in found.items()}, columns)

        cores = rows.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartition(cores, "unit").mapInArrow(merge, "unit string, " + ", ".join(f"{c} binary" for c in columns))
    found = by_unit(r for batch in rows.toArrow().to_batches() for r in batch.to_pylist())
    return {u: dict(zip(columns, arrays, strict=True)) for u, arrays in found.items()}


def _emit(sums: dict[str, tuple], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    units = list(sums)
    for a in range(0, len(units), 200):
        some = units[a : a + 200]
        arrays = [pa.array(some, pa.string()), *(pa.array([np.ascontiguousarray(sums[u][i], np.float64).tobytes() for u in some], pa.binary()) for i in range(len(columns)))]
        yield pa.RecordBatch.from_arrays(arrays, names=["unit", *columns])


@dataclass
class Target:
    """What is known of a unit's wanted value and spread: its bins, and whether values near them are to be sent."""

    n: float
    limit: int = 400  # distinct values that a task may send
    edges: np.ndarray = field(default_factory=lambda: _GRID)
    zones: list[tuple[float, float]] = field(default_factory=list)
    ship: bool = False
    middle: float = 0.0
    spread: float = 0.0
    half: float = 0.0
    exact: bool = False


def _bins(values: np.ndarray, times: np.ndarray, t: Target) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in the bins of a target, and the values in its zones with their times if it asks for them."""
    drawn = times > 0
    if not drawn.all():
        values, times = values[drawn], times[drawn]
    counts = np.bincount(np.searchsorted(t.edges, values, "right"), times, len(t.edges) + 1)
    near = np.zeros(len(values), bool)
    if t.ship:
        for low, high in t.zones:
            near |= (values >= low) & (values < high)
    return counts, *_distinct(values[near], times[near])


def _distinct(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    once, place = np.unique(values, return_inverse=True)
    return once, np.bincount(place, times, len(once))


def _zone_ends(t: Target) -> np.ndarray | None:
    """Both ends of each zone in order, where zones lie apart; else nothing."""
    zones = sorted(t.zones)
    apart = zones and np.isfinite(zones).all() and all(a < b for a, b in zones) and all(a[1] < b[0] for a, b in zip(zones, zones[1:], strict=False))
    return np.array(zones).ravel() if apart else None


class _Counter:
    """Counts of one set of units in their bins, and the values of their zones where they ask for them.

    Few values lie in the zones of a target that is nearly known: all are compared with the ends of the zones side by side, and only those inside go to bins one unit at a time.
    """

    def __init__(self, units: list[str], wanted: dict[str, Target]):
        self.units, self.targets = units, [wanted[u] for u in units]
        ends = [_zone_ends(t) for t in self.targets]
        self.most = max((len(e) for e in ends if e is not None), default=0)
        self.near = np.array([k for k, e in enumerate(ends) if e is not None and len(e) == self.most], int)
        self.rest = np.array(sorted({*range(len(units))} - {*self.near.tolist()}), int)
        self.ends = np.stack([ends[k] for k in self.near], 1) if len(self.near) else None
        self.below, self.total = np.zeros((self.most, len(self.near))), np.zeros(len(self.near))
        self.counts = [np.zeros(len(t.edges) + 1) for t in self.targets]
        self.sent: list[list] = [[[], []] for _ in units]
        self.inside: list[tuple] = []
        self.held: list[tuple] = []

    def add(self, values: np.ndarray, times: np.ndarray) -> None:
        if len(self.rest):
            self.held.append((values[:, self.rest], times[:, self.rest]))
        if len(self.near):
            v, t = (values, times) if not len(self.rest) else (values[:, self.near], times[:, self.near])
            self.total += t.sum(axis=0)
            within = np.zeros(v.shape, bool)
            for k, end in enumerate(self.ends):
                under = v < end
                self.below[k] += np.where(under, t, 0.0).sum(axis=0)
                within ^= under
            at = np.flatnonzero(within & (t > 0))
            self.inside.append((at % v.shape[1], v.ravel()[at], t.ravel()[at]))

    def _one(self, k: int, values: np.ndarray, times: np.ndarray) -> None:
        counts, v, m = _bins(values, times, self.targets[k])
        self.counts[k] += counts
        self.sent[k][0].append(v)
        self.sent[k][1].append(m)

    def flush(self) -> None:
        """Puts what is held of a batch into bins."""
        if self.held:
            values, times = (np.asfortranarray(np.concatenate(x)) for x in zip(*self.held, strict=True))
            for i, k in enumerate(self.rest):
                self._one(k, values[:, i], times[:, i])
        if self.inside:
            unit, values, times = map(np.concatenate, zip(*self.inside, strict=True))
            order = np.argsort(unit, kind="stable")
            values, times = values[order], times[order]
            upto = np.append(0, np.cumsum(np.bincount(unit, minlength=len(self.near))))
            for i, k in enumerate(self.near):
                if upto[i + 1] > upto[i]:
                    self._one(k, values[upto[i] : upto[i + 1]], times[upto[i] : upto[i + 1]])
        self.held, self.inside = [], []

    def found(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        for i, k in enumerate(self.near):  # what lies before, between and after the zones
            edges, below = self.targets[k].edges, [0.0, *self.below[:, i], self.total[i]]
            for z in range(0, self.most + 1, 2):
                self.counts[k][np.searchsorted(edges, self.ends[z - 1, i], "right") if z else 0] += below[z + 1] - below[z]
        for u, t, counts, sent in zip(self.units, self.targets, self.counts, self.sent, strict=True):
            v, m = _distinct(*map(np.concatenate, sent)) if sent[0] else (np.zeros(0), np.zeros(0))
            yield u, counts, *((v, m) if len(v) <= t.limit else (np.zeros(0), np.zeros(0)))


def count_pass(rows: DataFrame, values_of: Callable, targets: dict[str, Target], direct: bool) -> dict[str, dict[str, np.ndarray]]:
    """Counts of each open unit's values in its bins, and the values of its zones with their times where it asks for them."""
    wanted = {u: t for u, t in targets.items() if not t.exact}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple[str, ...], _Counter] = {}
        for batch in batches:
            for units, values, times in values_of(batch, wanted):
                own = [k for k, u in enumerate(units) if u in wanted]
                names = tuple(units[k] for k in own)
                if names not in counters:
                    counters[names] = _Counter(list(names), wanted)
                counters[names].add(*((values, times) if len(own) == len(units) else (values[:, own], times[:, own])))
            for counter in counters.values():
                counter.flush()
        yield from _emit({u: x for counter in counters.values() for u, *x in counter.found()}, ("counts", "near", "times"))

    return _merged(rows.mapInArrow(run, "unit string, counts binary, near binary, times binary"), direct, ("counts", "near", "times"))


def _atoms(t: Target, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low end, high end and times of what is known: single values of zones, else bins."""
    low, high, times = np.concatenate([[-np.inf], t.edges]), np.concatenate([t.edges, [np.inf]]), found["counts"]
    inside = np.zeros(len(low), bool)
    for a, b in t.zones:
        inside |= (low >= a) & (high <= b)
    if t.ship and np.isclose(times[inside].sum(), found["times"].sum(), rtol=0, atol=0.25):  # all tasks sent theirs
        ends = ((low, "near"), (high, "near"), (times, "times"))
        low, high, times = (np.concatenate([x[~inside], found[name]]) for x, name in ends)
    keep = times > 0
    low, high, times = low[keep], high[keep], times[keep]
    order = np.lexsort((high, low))
    return low[order], high[order], times[order]


def _kth(at: np.ndarray, times: np.ndarray, ranks: tuple[float, float]) -> tuple[float, float]:
    """The values of two ranks among values that occur ``times`` times."""
    order = np.argsort(at, kind="stable")
    upto = np.cumsum(times[order])
    one, two = (at[order[min(int(np.searchsorted(upto, k, "right")), len(order) - 1)]] for k in ranks)
    return float(one), float(two)


def narrowed(t: Target, found: dict[str, np.ndarray], share: float, with_spread: bool) -> Target:
    """The target after a pass: bounds of its value at ``share`` of the ranks and of the median distance from it.

    Both are interpolated between neighbours as in a full sort. Each single value or bin bounds what is in it, so the
    bounds always hold; the zones of the next pass span them. A target is exact when its bounds are no more than 1e-12 apart.
    """
    low, high, times = atoms = _atoms(t, found)
    rank = share * (t.n - 1)
    ranks, part = (np.floor(rank), np.ceil(rank)), rank - np.floor(rank)
    lows, highs = _kth(low, times, ranks), _kth(high, times, ranks)
    between = lambda two: (1 - part) * two[0] + part * two[1] if part else two[0]
    m = (between(lows), between(highs))
    d, ends = (0.0, 0.0), (0.0, 0.0)
    if with_spread and np.isfinite(m).all():
        near = np.maximum(np.maximum(low - m[1], m[0] - high), 0.0)
        far = np.maximum(high - m[0], m[1] - low)
        rank = 0.5 * (t.n - 1)
        least, most = (_kth(x, times, (np.floor(rank), np.ceil(rank))) for x in (near, far))
        d, ends = (sum(least) / 2, sum(most) / 2), (least[0], most[1])
    if not np.isfinite([*m, *d, *ends]).all():  # outside all bins: look further around the last values, then everywhere
        wider = 16 * t.half
        return around(t, (t.middle - wider, t.middle + wider), (max(t.spread - wider, 0.0), t.spread + wider), wider, None, with_spread) if 0 < wider < 1 else Target(t.n, t.limit)
    middle, spread = (m[0] + m[1]) / 2, (d[0] + d[1]) / 2
    if m[1] - m[0] <= 1e-12 and d[1] - d[0] <= 1e-12:
        moved = max(abs(middle - t.middle), abs(spread - t.spread)) if t.half else 0.1 * spread
        half = max(4 * moved, 1e-9 * (1e-3 + abs(middle) + spread))
        out = around(t, (middle - half, middle + half), (spread - half, spread + half), half, atoms, with_spread)
        out.middle, out.spread, out.exact = middle, spread, True
        return out
    out = around(t, (min(lows), max(highs)), ends, max(m[1] - m[0], d[1] - d[0]), atoms, with_spread)
    out.middle, out.spread = middle, spread
    return out


def begun(n: float, limit: int) -> Target:
    """A target that nothing is known about but the number of its rows; small ones send all their values."""
    return Target(n, limit, np.zeros(0), [(-np.inf, np.inf)], True) if n <= limit else Target(n, limit)


def around(t: Target, middle: tuple[float, float], spread: tuple[float, float], half: float, atoms: tuple | None, with_spread: bool) -> Target:
    """A target whose zones span the bounds of its value and of both places at its spread, cut into bins.

    Values are asked for where ``atoms`` say that the zones hold few enough.
    """
    if t.n <= t.limit:
        return begun(t.n, t.limit)
    zones = [middle]
    if with_spread:
        zones += [(middle[0] - spread[1], middle[1] - spread[0]), (middle[0] + spread[0], middle[1] + spread[1])]
    zones = [(low - 1e-13, high + 1e-13) for low, high in zones]
    edges = np.unique(np.concatenate([np.linspace(*z, _BINS + 1) for z in zones]))
    mass = np.inf
    if atoms is not None:
        low, high, times = atoms
        finite = np.isfinite(high - low) & (high > low)
        mass = 0.0
        for a, b in zones:
            inside = np.clip(np.minimum(high, b) - np.maximum(low, a), 0, None)
            portion = np.where(finite, inside / np.where(finite, high - low, 1.0), np.where(high > low, inside > 0, (low >= a) & (low < b)))
            mass += float((portion * times).sum())
    return Target(t.n, t.limit, edges, zones, mass <= 8 * t.limit, (middle[0] + middle[1]) / 2, (spread[0] + spread[1]) / 2, half)


def quantiles(rows: DataFrame, values_of: Callable, targets: dict[str, Target], share: float, with_spread: bool, direct: bool, passes: int = 12) -> None:
    """Brings all targets to exact values, one pass over the table for all that are still open."""
    for _ in range(passes):
        if all(t.exact for t in targets.values()):
            return
        for unit, found in count_pass(rows, values_of, targets, direct).items():
            targets[unit] = narrowed(targets[unit], found, share, with_spread)


def equations(rows: DataFrame, groups_of: Callable, state: dict[str, tuple[np.ndarray, float]], size: int, huber: float, direct: bool) -> dict[str, np.ndarray]:
    """Weighted normal equations of the units in ``state`` (coefficients, scale), each a matrix with its right side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, ...], np.ndarray] = {}
        for batch in batches:
            spans = Spans.of(batch)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for g in groups_of(batch):
                own = [k for k, u in enumerate(g.units) if u in state]
                if not own or not len(g.at):
                    continue
                names, every = tuple(g.units[k] for k in own), len(own) == len(g.units)
                if names not in sums:
                    sums[names] = np.zeros((size + 1, size + 2, len(names)))
                theta, sigma = np.stack([state[u][0] for u in names], 1), np.array([state[u][1] for u in names])
                for piece in g.pieces():
                    at = g.at[piece]
                    times, weights = (x if every else x[:, own] for x in (g.times[piece], g.weighed(piece)))
                    drawn = np.flatnonzero(times.any(axis=0))
                    if not len(drawn):
                        continue
                    some = slice(drawn[0], drawn[-1] + 1)  # runs that the piece has rows of
                    z = spans.predicted(at, theta[:, some])
                    np.subtract(y[at, None], z, out=z)
                    np.abs(z, out=z)
                    z /= sigma[some]
                    v = np.where(z > huber, huber / np.maximum(z, 1e-300), 1.0)
                    v *= weights[:, some]
                    v *= times[:, some]
                    _add_products(sums[names][:, :, some], spans, at, v, y)
        yield from _emit({u: (row,) for names, total in sums.items() for u, row in zip(names, _folded(total), strict=True)}, ("sums",))

    found = _merged(rows.mapInArrow(run, "unit string, sums binary"), direct, ("sums",))
    if not found:
        return {}
    halves, months = _unfolded(np.stack([f["sums"] for f in found.values()]), size + 1), _points(size)
    return {unit: _by_months(half, months) for unit, half in zip(found, halves, strict=True)}


def residuals_of(groups_of: Callable, state: dict[str, np.ndarray], size: int) -> Callable:
    """Values for :func:`count_pass`: what is left of y under each unit's coefficients."""

    def values(batch: pa.RecordBatch, wanted: dict) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        spans = Spans.of(batch)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for g in groups_of(batch):
            own = [k for k, u in enumerate(g.units) if u in wanted]
            if own and len(g.at):
                theta, units, every = np.stack([state[g.units[k]] for k in own], 1), [g.units[k] for k in own], len(own) == len(g.units)
                for piece in g.pieces():
                    at = g.at[piece]
                    left = spans.predicted(at, theta)
                    yield units, np.subtract(y[at, None], left, out=left), (g.times[piece] if every else g.times[piece][:, own]).astype(float)

    return values


def tasks_of(rows: DataFrame) -> int:
    """Partitions of the table that have rows; sums of few tasks are added up by the driver itself."""
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def limit_of(units: int, tasks: int) -> int:
    """Values that a task may send of each unit, so that all of them stay within the budget."""
    return max(16, BUDGET // max(1, units * tasks))


def spread_out(rows: DataFrame, order: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """The table, persisted, over at least as many partitions as there are cores if it has rows enough, and their number.

    With ``order`` rows are sorted within their partitions, so that a batch holds few units and months. There are no more partitions than
    ``DIRECT`` or twice the cores: sums of all units leave each of them in every pass, whatever the number of its rows.
    """
    in_order = lambda r: r.sortWithinPartitions(*order) if order else r
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = in_order(rows.coalesce(max(DIRECT, 2 * cores))).persist()
    tasks = tasks_of(rows)
    wanted = min(cores, rows.count() // 5000)
    if tasks >= wanted:
        return rows, tasks
    more = in_order(rows.repartition(wanted)).persist()
    tasks = tasks_of(more)
    rows.unpersist()
    return more, tasks


def fit(rows: DataFrame, groups_of: Callable, counts: dict[str, float], size: int, places: Callable[[str], np.ndarray], penalty: Callable[[str, int], np.ndarray], huber: float, max_rounds: int, tasks: int, start: dict[str, np.ndarray] | None = None) -> dict[str, tuple[np.ndarray, float, bool, float]]:
    """Iteratively reweighted fits: ``unit -> (theta, sigma, converged, rows)``.

    ``rows`` has ``first, last, head, tail, x_q, y`` and what ``groups_of`` reads, and should be persisted. A round takes one pass for the
    median of the residuals and the median of their distance from it, both exact (a few more in the first round, until the zones
    around them are known), and one for the normal equations; units that have converged leave both.
    """
    few, limit = lambda bytes_: tasks * len(counts) * bytes_ <= SENT, limit_of(len(counts), tasks)
    theta = {u: np.array((start or {}).get(u, np.zeros(size)), float) for u in counts}
    sigma, done = dict.fromkeys(counts, 1.0), dict.fromkeys(counts, False)
    targets = {u: begun(n, limit) for u, n in counts.items()}
    for _ in range(max_rounds):
        open_ = [u for u in counts if not done[u]]
        if not open_:
            break
        now = {u: targets[u] for u in open_}
        for t in now.values():
            t.exact = False
        quantiles(rows, residuals_of(groups_of, theta, size), now, 0.5, True, few(8_000))
        targets.update(now)
        for u in open_:
            sigma[u] = max(1e-6, targets[u].spread / 0.6745)
        for u, both in equations(rows, groups_of, {u: (theta[u], sigma[u]) for u in open_}, size, huber, few(4 * (size + 1) ** 2)).items():
            at = places(u)
            new = np.zeros(size)
            new[at] = np.linalg.lstsq(both[np.ix_(at, at)] + penalty(u, len(at) - 1), both[at, size], rcond=None)[0]
            done[u] = bool(np.linalg.norm(new - theta[u]) / (1 + np.linalg.norm(theta[u])) < 1e-6)
            theta[u] = new
    return {u: (theta[u], sigma[u], done[u], counts[u]) for u in counts}


def sum_pass(rows: DataFrame, vectors_of: Callable, direct: bool) -> dict[str, np.ndarray]:
    """Sums over the table of the named vectors that ``vectors_of`` makes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, vector in vectors_of(batch):
                sums[name] = sums.get(name, 0.0) + vector
        yield from _emit({u: (s,) for u, s in sums.items()}, ("sums",))

    return {u: found["sums"] for u, found in _merged(rows.mapInArrow(run, "unit string, sums binary"), direct, ("sums",)).items()}
