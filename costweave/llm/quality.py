"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm import gbt
from costweave.llm.common import arrow_rows, fold, hash_sample, staged

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "space", "newline", "punctuation", "non_ascii", "symbol", "letter_entropy",
    "unique_words", "top_word", "repeated_neighbours", "unique_pairs", "unique_triples", "capital_words", "symbol_words", "ended_words",
    "log_lines", "repeated_lines", "mean_line", "longest_word", "one_byte_words", "bar", "top_four_words",
)

_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_STOPS = np.isin(_BYTES, list(b".,;:?!'\"()-"))
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_STOPS


def text_statistics(text: str | None) -> np.ndarray:
    """The ``STATISTICS`` of one whole text as float32; all 0 without words."""
    out = np.zeros(len(STATISTICS), np.float32)
    data = (text or "").encode()
    words = data.split()
    if not words:
        return out
    n, size = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    share = counts / size
    solid = counts[~_SPACE] / max(1.0, counts[~_SPACE].sum())
    by_word = Counter(words)
    top = [c for _, c in by_word.most_common(4)]
    lines = [x for x in data.split(b"\n") if x.strip()]
    word_sizes = np.fromiter(map(len, words), np.int64, n)
    pairs, triples = list(zip(words, words[1:], strict=False)), list(zip(words, words[1:], words[2:], strict=False))
    distinct = list(by_word.items())
    capital = sum(c for w, c in distinct if len(w) > 1 and w.isupper())
    odd = sum(c for w, c in distinct if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?!'\")")
    ended = sum(c for w, c in distinct if w[-1:] in b".,;:?!")
    values = (
        np.log1p(size), np.log1p(n), word_sizes.mean(), share[_UPPER].sum(), share[_LOWER].sum(), share[_DIGIT].sum(), share[_SPACE].sum(), share[10],
        share[_STOPS].sum(), share[128:].sum(), share[_SYMBOL].sum(), -(solid[solid > 0] * np.log(solid[solid > 0])).sum(),
        len(by_word) / n, top[0] / n, sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(1, n - 1), len(set(triples)) / max(1, n - 2),
        capital / n, odd / n, ended / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), size / len(lines), np.log1p(word_sizes.max()),
        (word_sizes == 1).mean(), share[124], sum(top) / n,
    )
    out[:] = values
    return out


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` (array of float) of every row; a null text counts as empty."""

    def make():
        def handle(ids, texts):
            return {"doc_id": ids, "stats": [text_statistics(t) for t in texts]}

        return handle

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_rows(source, ["doc_id", "text"], make, "doc_id long, stats array<float>")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> tuple[gbt.Trees, tuple[float, float]]:
    """Trees and calibration from at most ``max_rows`` labelled rows outside fold 0.

    Trees learn from folds 1 to 3, the calibration from fold 4.
    """
    rows = stats.join(labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)"), "doc_id")
    rows = rows.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    got = hash_sample(rows, max_rows).orderBy("doc_id", "y", "stats").select("stats", "y", "fold").toPandas()
    x = np.array(got["stats"].tolist(), np.float64).reshape(len(got), len(STATISTICS))
    y, last = got["y"].to_numpy(float), (got["fold"] == 4).to_numpy()
    trees = gbt.train(x[~last], y[~last])
    return trees, gbt.calibrate(trees.raw(x[last]), y[last])


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """``doc_id, score`` (0 to 1, higher is better) of every whole text of ``df``.

    The model learns from rows of ``df`` that ``labels`` (``doc_id`` and a 0/1 label) marks and
    whose fold is not 0; only text statistics are inputs. Null and empty texts have the
    statistics of an empty text. Without labels all scores are one half.
    """
    stats = staged(statistics(df, id_col, text_col), "statistics")
    trees, (slope, shift) = train(stats, labels, label, max_rows)
    parts = (trees.feature, trees.threshold, trees.left, trees.value, trees.bias, trees.depth)
    shared = df.sparkSession.sparkContext.broadcast(parts)

    def make():
        own = gbt.Trees(*shared.value)

        def handle(ids, rows):
            x = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))
            return {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(slope * own.raw(x) + shift, -30, 30)))}

        return handle

    return arrow_rows(stats, ["doc_id", "stats"], make, "doc_id long, score double")
