"""I-Match fingerprints over several randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band. A text keeps its distinct
terms in the lexicon, in order; each of ``SUBSETS`` random subsets of the lexicon keeps some of
them, and the kept ones are hashed. A subset's rate halves from level to level. A text uses the
level at which a subset keeps one to two of its terms and the next one, so that long and
short texts alike have signatures that a partial edit leaves alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm.common import arrow_rows

SUBSETS = 48
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_terms(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit ids of a text's terms: runs of letters and digits, ASCII lower case."""
    from xxhash import xxh32_intdigest

    terms = set((text or "").encode().translate(_TERM_BYTES).split())
    return np.unique(np.fromiter((xxh32_intdigest(t) for t in terms), np.uint32, len(terms)))


def fingerprint(text: str | None, terms: np.ndarray, lexicon: np.ndarray) -> tuple[int, np.ndarray, int]:
    """Level, signatures (2 levels by ``SUBSETS``, 0: the subset keeps no term) and whole signature of one text.

    The whole signature hashes all kept terms. A text without lexicon terms uses all its terms, one without terms a hash of itself.
    """
    at = np.minimum(np.searchsorted(lexicon, terms), max(len(lexicon) - 1, 0))
    kept = terms[lexicon[at] == terms] if len(lexicon) else terms[:0]
    if not len(kept):
        kept = terms
    if not len(kept):
        kept = np.frombuffer(hashlib.sha256((text or "").encode()).digest()[:4], np.uint32)
    from xxhash import xxh64_intdigest

    level = int(math.log2(len(kept)))
    seeds = _mixed(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((2, SUBSETS), np.uint16)
    sums = np.zeros((2, SUBSETS), np.uint64)
    ranks = np.zeros((2, SUBSETS), np.uint64)
    for begin in range(0, len(kept), 4096):
        h = _mixed(kept[begin : begin + 4096, None].astype(np.uint64) ^ seeds[None, :])
        for i in (0, 1):
            inside = (h >> np.uint64(64 - level - i) == 0) if level + i else np.ones(h.shape, bool)
            rank = ranks[i] + np.cumsum(inside, axis=0, dtype=np.uint64)
            sums[i] += np.where(inside, _mixed(h + rank * np.uint64(0xD1342543DE82EF95)), np.uint64(0)).sum(axis=0)
            ranks[i] = rank[-1]
    filled = ranks > 0
    out[filled] = (_mixed(sums[filled]) % np.uint64(65535)).astype(np.uint16) + 1
    return level, out, xxh64_intdigest(kept.astype("<u4").tobytes())


def as_string(print_: tuple[int, np.ndarray, int]) -> str:
    """The signature of all kept terms, the level and the signatures of the subsets, in hex."""
    return f"{print_[2]:016x}{print_[0]:02x}" + print_[1].astype(">u2").tobytes().hex()


def likeness(a: tuple[int, np.ndarray, int], b: tuple[int, np.ndarray, int]) -> float:
    """Share of equal subset signatures among those that either text has, at the sparsest level of both.

    Equal fingerprints are at 1, fingerprints without a common level at 0.
    """
    if a[2] == b[2] and a[0] == b[0] and (a[1] == b[1]).all():
        return 1.0
    level = min(a[0], b[0]) + 1
    if level - a[0] > 1 or level - b[0] > 1 or level < max(a[0], b[0]):
        return 0.0
    x, y = a[1][level - a[0]], b[1][level - b[0]]
    either = (x > 0) | (y > 0)
    return float(((x == y) & (x > 0)).sum() / either.sum()) if either.any() else 0.0


def lexicon_terms(df: DataFrame, text_col: str = "text", min_share: float = 0.0002, max_share: float = 0.05) -> np.ndarray:
    """Ids of the terms that ``min_share`` to ``max_share`` of all rows hold (and two rows at least).

    The frequencies cover every row. Terms above a share of the rows number at most the mean count of
    distinct terms in a text over that share, whatever the size of the table; that bounds
    what comes to the driver and is broadcast.
    """

    def make():
        def handle(texts):
            every = np.concatenate([text_terms(t) for t in texts] or [np.zeros(0, np.uint32)])
            ids, counts = np.unique(every, return_counts=True)
            return {"term": ids.view(np.int32), "n": counts}

        return handle

    source = df.select(F.col(text_col).alias("text"))
    rows = source.count()
    low, high = max(2, math.ceil(min_share * rows)), max(2, max_share * rows)
    counted = arrow_rows(source, ["text"], make, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n").between(low, high)).select("term").toPandas()["term"].to_numpy(np.int32)
    return np.sort(found.view(np.uint32))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band) -> DataFrame:
    """``doc_id, fingerprint`` of every row; a null text counts as empty, other columns are ignored."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon_terms(df, text_col, **band))

    def make():
        lexicon = shared.value

        def handle(ids, texts):
            return {"doc_id": ids, "fingerprint": [as_string(fingerprint(t, text_terms(t), lexicon)) for t in texts]}

        return handle

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_rows(source, ["doc_id", "text"], make, "doc_id long, fingerprint string")


def _with_successors(df: DataFrame, id_col: str, text_col: str, n_ranges: int) -> DataFrame:
    """Rows dealt into ranges of falling id, each range with the first rows of the one after it.

    Ranges come from id quantiles; the first row's id of each range (one number a range) goes
    through the driver, texts are shuffled once. ``ahead`` marks the lent rows. Rows of one id stay in one range.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = docs.agg(F.percentile_approx("key", [i / n_ranges for i in range(1, n_ranges)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts if n_ranges > 1 else []))
    spark = df.sparkSession
    edges = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:  # falling ids: part 0 first
        return pd.Series((len(edges.value) - np.searchsorted(edges.value, keys.to_numpy(np.int64))).astype(np.int32))

    ranged = docs.withColumn("part", part_of("key"))
    tops = dict(ranged.groupBy("part").agg(F.max("key")).collect())
    order = sorted(tops)
    lender = sorted((tops[p], order[i - 1]) for i, p in enumerate(order))  # the first part lends to the last
    lenders = spark.sparkContext.broadcast(tuple(np.array([x[i] for x in lender], np.int64) for i in (0, 1)))

    @F.pandas_udf("int")
    def lent_to(keys: pd.Series) -> pd.Series:  # -1: not the first row of a part
        top, to = lenders.value
        at = np.minimum(np.searchsorted(top, keys.to_numpy(np.int64)), len(top) - 1)
        return pd.Series(np.where(top[at] == keys.to_numpy(np.int64), to[at], -1).astype(np.int32))

    places = F.filter(
        F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead")), F.struct(lent_to("key").alias("part"), F.lit(True).alias("ahead"))),
        lambda p: p["part"] >= 0,
    )
    dealt = ranged.select("doc_id", "text", "key", F.explode(places).alias("place")).select("place.part", "place.ahead", "doc_id", "key", "text")
    return dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "ahead", F.desc("key"), F.col("text").asc_nulls_first())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None, **band) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The next document is the one at the next lower id (null last, ties by text,
    null first), after the last the first. A null text is empty; a single row is its own next.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(lexicon_terms(df, text_col, **band))
    n_ranges = n_ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def make():
        lexicon = shared.value
        held = []  # the last own row, which waits for its successor

        def handle(ids, texts, ahead):
            rows = []
            for i, text, lent in zip(ids, texts, ahead, strict=True):
                if lent and not held:
                    continue
                text = text or ""
                own = fingerprint(text, text_terms(text), lexicon)
                if held:
                    j, before, print_ = held.pop()
                    new = edited(before, text)
                    other = fingerprint(new, text_terms(new), lexicon)
                    rows.append((j, len(before), hashlib.sha256(new.encode()).hexdigest(), as_string(print_), as_string(other), likeness(print_, other), likeness(print_, own)))
                if not lent:
                    held.append((i, text, own))
            return dict(zip(fields, zip(*rows, strict=True), strict=True)) if rows else {f: [] for f in fields}

        return handle

    return arrow_rows(
        _with_successors(df, id_col, text_col, n_ranges), ["doc_id", "text", "ahead"], make,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
