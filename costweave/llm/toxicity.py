"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from costweave.llm.common import arrow_rows, dropped, fold, hash_sample, staged

_WORD = re.compile(r"[^\W_]+")
#: Units of a word: itself and its first 7 to 3 characters; the longest one that the model has scores it.
_PREFIXES = (7, 6, 5, 4, 3)


def _units(word: str):
    """Word, then its first characters; a word over 40 characters stands as a hash of itself."""
    yield word if len(word) <= 40 else f"{xxh64_hexdigest(word)}..."
    for n in _PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


@dataclass
class Model:
    """What a task needs: unit log-odds, the cost of a token, Gumbel parameters and logistic weights."""

    odds: dict[str, float]
    cost: float
    scale: float = 1.0
    size: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    p_value: float = 0.01


def _lookup(model: Model) -> dict[str, float]:
    """word -> token score; filled as words come, emptied when it is large."""
    odds, cost = model.odds, model.cost

    class Scores(dict):
        def __missing__(self, word):
            if len(self) > 300_000:
                self.clear()
            value = next((odds[u] for u in _units(word) if u in odds), 0.0) - cost
            self[word] = value
            return value

    return Scores()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Runs of positive scores enter a list from the left, each with its cumulative scores at both ends.
    A new one links to the nearest earlier segment whose left end is lower; if that one's right
    end is not higher than the new one's, they merge and the search goes on from the merged left end.
    """
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    up = np.flatnonzero(np.diff(np.concatenate([[0], (scores > 0).view(np.int8), [0]])))
    found: list[tuple[int, int, float, float, int]] = []  # start, end, left, right, link
    for start, end in zip(up[::2].tolist(), up[1::2].tolist(), strict=True):
        left, right = float(total[start]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - l) for s, e, l, r, _ in found]


def _statistics(scores: np.ndarray, model: Model) -> tuple[float, int, float, list[tuple[int, int, float, float]]]:
    """Normalised best score, number of significant passages, their normalised sum, and the passages."""
    n = max(1, len(scores))
    base = math.log(model.size * n)
    passages = []
    best = 0.0
    for start, end, value in maximal_segments(scores):
        best = max(best, value)
        p = -math.expm1(-math.exp(min(50.0, base - model.scale * value)))
        if p <= model.p_value:
            passages.append((start, end, value, p))
    rest = sum(model.scale * x[2] - math.log(model.size * n) for x in passages)
    return model.scale * best - base, len(passages), rest, passages


def _features(best: float, count: int, rest: float) -> tuple[float, float, float, float]:
    return 1.0, max(-10.0, min(40.0, best)) / 10, math.log1p(count), math.log1p(max(0.0, rest)) / 3


#: Stands for all words together in a table of units; no word holds a line break.
_ALL = "\n"


def log_odds(labelled: DataFrame, prior_mass: float = 10.0, least: float = 0.5, min_z: float = 3.0, min_count: int = 5, min_share: float = 2e-5) -> dict[str, float]:
    """Log-odds of units between toxic and other texts under Dirichlet priors.

    ``labelled`` has ``text`` and ``toxic`` (0 or 1); every row counts, a unit once a text, so that one
    text that repeats a word proves nothing. The prior of a unit is ``prior_mass`` times its
    share of both classes plus ``least``; words in fewer than ``min_count`` texts are one unit of the prior, and
    class totals count all words. Units count where their log-odds are ``min_z`` standard
    deviations from 0 and where ``min_count`` texts and a ``min_share`` of all texts have them. So
    those that come to the driver number at most the mean count of distinct units in a text
    over ``min_share``, however large the table is.
    """

    def make():
        def handle(texts, toxic):
            by_class = (Counter(), Counter())
            for text, label in zip(texts, toxic, strict=True):
                units: set[str] = set()
                for word in set(_WORD.findall((text or "").lower())):
                    units.update(_units(word))
                by_class[label].update(units)
            for counter in by_class:
                counter[_ALL] = sum(n for u, n in counter.items() if not u.endswith("*"))
            every = list(dict.fromkeys([*by_class[0], *by_class[1]]))
            return {"unit": every, "n0": [by_class[0][u] for u in every], "n1": [by_class[1][u] for u in every]}

        return handle

    counts = arrow_rows(labelled, ["text", "toxic"], make, "unit string, n0 long, n1 long").groupBy("unit").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = staged(counts.where(F.col("n0") + F.col("n1") >= min_count), "units")
    texts = labelled.count()
    total = counts.where(F.col("unit") == _ALL).first()
    if total is None or not total.n0 or not total.n1:
        return {}
    t0, t1 = float(total.n0), float(total.n1)
    counts_known = counts.where(F.col("unit") != _ALL)
    prior = F.lit(prior_mass) * (F.col("n0") + F.col("n1")) / (t0 + t1) + least
    # every word that is known has its share of the prior, all others together have one
    mass = prior_mass + least * (counts_known.where(~F.col("unit").endswith("*")).count() + 1)
    logit = [F.ln((F.col(n) + prior) / F.greatest(F.lit(least), t + mass - F.col(n) - prior)) for n, t in (("n0", t0), ("n1", t1))]
    delta = logit[1] - logit[0]
    z = delta / F.sqrt(1 / (F.col("n0") + prior) + 1 / (F.col("n1") + prior))
    rows = counts_known.select("unit", delta.alias("odds"), F.abs(z).alias("z"), (F.col("n0") + F.col("n1")).alias("n"))
    odds = {r.unit: r.odds for r in rows.where((F.col("z") >= min_z) & (F.col("n") >= min_share * texts)).toLocalIterator()}
    dropped(counts)
    return odds


def _karlin_scale(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of mean(exp(scale * score)) = 1 over scores that come ``counts`` times; 1 where they are never positive."""
    if values.max(initial=0.0) <= 0 or values @ counts >= 0:
        return 1.0
    share = counts / counts.sum()
    low, high = 1e-6, 1.0
    with np.errstate(over="ignore"):
        while np.exp(high * values) @ share < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.exp(mid * values) @ share < 1 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, id_col: str = "doc_id", cost: float = 0.5, max_calibration_rows: int = 4000, seed_odds: dict[str, float] | None = None, hash_col: str | None = None) -> Model:
    """Fit on rows with ``text`` and ``toxic``; rows of fold 0 must not be among them.

    Token counts take all rows of folds 1 to 3. The Gumbel parameters and the logistic weights
    take at most ``max_calibration_rows`` rows of fold 4, whose tokens were not counted: the
    scale solves the score distribution of label-0 texts, the size matches the mean of
    their best segments, the logistic regression maps the statistics to the label.
    Without both labels every score is the share of label 1. Calibration rows are drawn by ``hash_col``,
    or by a hash of id, text and label; either way they do not depend on partitions or order.
    """
    drawn = F.col(hash_col) if hash_col else F.xxhash64(F.col(id_col), "text", "toxic")
    clean = labelled.where(F.col("toxic").isin(0, 1)).select(
        F.col(id_col).alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"), fold(F.col(id_col)).alias("fold"), drawn.alias("drawn")
    )
    odds = seed_odds if seed_odds is not None else log_odds(clean.where("fold <> 4"))
    model = Model(odds, cost)
    rows = hash_sample(clean.where("fold = 4"), max_calibration_rows, ["drawn", "toxic"])  # a text with both labels counts once under each
    rows = staged(rows.select("text", "toxic"), "calibration")

    def tokens(m: Model) -> DataFrame:
        def make():
            look = _lookup(m)

            def handle(texts, toxic):
                out = {k: [] for k in ("toxic", "n", "best", "sums", "edges")}
                for text, label in zip(texts, toxic, strict=True):
                    s = np.fromiter(map(look.__getitem__, _WORD.findall((text or "").lower())), np.float64)
                    values, counts = np.unique(np.round(s, 2), return_counts=True)
                    for k, v in zip(out, (label, len(s), max((x[2] for x in maximal_segments(s)), default=0.0), counts.tolist(), values.tolist()), strict=True):
                        out[k].append(v)
                return out

            return handle

        return arrow_rows(rows, ["text", "toxic"], make, "toxic int, n long, best double, sums array<long>, edges array<double>")

    got = sorted(tokens(model).collect(), key=tuple)
    zero = [r for r in got if r.toxic == 0 and r.n]
    if not zero or all(r.toxic == 0 for r in got):
        share = (sum(r.toxic for r in got) + 0.5) / (len(got) + 1)
        model.weights = (math.log(share / (1 - share)), 0.0, 0.0, 0.0)
        return model
    histogram: Counter = Counter()
    for r in zero:
        for value, count in zip(r.edges, r.sums, strict=True):
            histogram[value] += count
    edges = sorted(histogram)
    model.scale = _karlin_scale(np.array(edges, float), np.array([histogram[e] for e in edges], float))
    model.size = math.exp(min(20.0, max(-20.0, float(np.mean([model.scale * r.best - math.log(r.n) for r in zero]) - 0.5772))))
    x, y = [], []
    for r in sorted(_statistics_rows(rows, model).collect(), key=tuple):
        x.append(_features(r.best, r.passages, r.rest))
        y.append(r.toxic)
    model.weights = tuple(_logistic(np.array(x), np.array(y, float)).tolist())
    dropped(rows)
    return model


def _statistics_rows(rows: DataFrame, model: Model) -> DataFrame:
    def make():
        look = _lookup(model)

        def handle(texts, toxic):
            got = [_statistics(np.fromiter(map(look.__getitem__, _WORD.findall((t or "").lower())), np.float64), model) for t in texts]
            return {"toxic": toxic, "best": [g[0] for g in got], "passages": [g[1] for g in got], "rest": [g[2] for g in got]}

        return handle

    return arrow_rows(rows, ["text", "toxic"], make, "toxic int, best double, passages long, rest double")


def _places(text: str, lower: str):
    """From a place in the lower-cased text to that in the text itself; a few letters have a longer lower case."""
    if len(lower) == len(text):
        return lambda i: i
    return [i for i, c in enumerate(text) for _ in c.lower()].__getitem__


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1) and ``passages`` of every whole text.

    ``passages`` are all significant toxic segments: start and end character, segment score
    and p-value. A null or empty text has no passage and the score of a text without words.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        m = Model(**shared.value)
        look = _lookup(m)

        def handle(ids, texts):
            scores, passages = [], []
            for text in texts:
                lower = (text or "").lower()
                s = np.fromiter(map(look.__getitem__, _WORD.findall(lower)), np.float64)
                best, count, rest, found = _statistics(s, m)
                logit = sum(a * b for a, b in zip(m.weights, _features(best, count, rest), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
                spans = []
                if found:
                    words = list(_WORD.finditer(lower))
                    place = _places(text, lower)
                    spans = [{"start": place(words[a].start()), "end": place(words[b - 1].end() - 1) + 1, "score": v, "p_value": p} for a, b, v, p in found]
                passages.append(spans)
            return {"doc_id": ids, "score": scores, "passages": passages}

        return handle

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_rows(source, ["doc_id", "text"], make, "doc_id long, score double, passages array<struct<start:long,end:long,score:double,p_value:double>>")
