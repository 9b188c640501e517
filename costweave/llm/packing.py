"""Packing by optimal length buckets: the least padding for a given number of padded lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm.common import staged
from costweave.llm.mixing import word_count


def bucket_bounds(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets that minimise the total padding.

    Every length goes to the smallest bound that holds it. Dynamic programming over the
    distinct lengths in order: best[k][j] is the least number of padded tokens for the j
    shortest with k bounds. The best last cut never moves left as j grows (the cost meets the
    quadrangle inequality), so each k is solved by halving: n log n steps. No lengths give [].
    """
    order = np.argsort(lengths)
    size, count = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(size)
    if not n:
        return []
    total = np.concatenate([[0.0], np.cumsum(count)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(n_buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        work = [(1, n, 0, n - 1)]
        while work:
            low, high, first, last = work.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            cost = best[i] + (total[j] - total[i]) * size[j - 1]
            at = int(np.argmin(cost))
            new[j], cut[j] = cost[at], i[at]
            work += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        best = new
        cuts.append((best[n], cut))
    k = min(range(len(cuts)), key=lambda k: cuts[k][0])
    bounds, j = [], n
    while j > 0 and k >= 0:
        bounds.append(int(size[j - 1]))
        j, k = int(cuts[k][1][j]), k - 1
    return bounds[::-1]


#: Equal pieces that one row stands for while they are dealt into slots.
_RUN = 4096


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_length: int = 4096,
    n_buckets: int = 16,
    token_budget: int = 65_536,
    rows_per_slot: int = 100_000,
) -> DataFrame:
    """Batches of at most ``token_budget`` padded tokens, each inside one length bucket.

    Returns ``doc_id, piece, start, length, bucket_length, batch, row_in_batch`` with one row a
    piece. Tokens are words. A text over ``max_length`` is cut into pieces of that many words
    (``piece`` from 0, ``start`` its first word), so no word is lost; an empty or null text is
    one piece of length 0. The histogram of lengths covers all rows and has ``max_length`` + 1
    entries at most, which is what the driver gets. Places inside a bucket come from counts by
    slot (a hash of the row; about ``rows_per_slot`` rows each), never from one sort of a
    bucket. Repeated rows are pieces of their own. Pieces that agree in all columns (many rows with a null
    id, say) are counted first and dealt in runs of at most ``_RUN``, so no id makes a slot large.
    Batches number from 0 in each bucket.
    A ``token_budget`` below ``max_length`` could not hold one full piece and is an error.
    """
    if not 0 < max_length <= token_budget:
        raise ValueError("max_length is 1 or more and token_budget at least max_length")
    words = word_count(F.col(text_col))
    pieces = (
        df.select(F.col(id_col).alias("doc_id"), words.alias("words"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / max_length)))))
        .withColumn("start", F.col("piece") * max_length)
        .withColumn("length", F.least(F.lit(max_length).cast("long"), F.col("words") - F.col("start")))
        .drop("words")
    )
    pieces = staged(pieces, "pieces")
    histogram = pieces.groupBy("length").count().collect()
    bounds = bucket_bounds([r[0] for r in histogram], [r[1] for r in histogram], n_buckets)
    slots = max(64, -(-sum(r[1] for r in histogram) // rows_per_slot))
    bound = F.lit(bounds[-1] if bounds else 0).cast("long")
    for b in reversed(bounds[:-1]):
        bound = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(bound)
    # Equal pieces are interchangeable: one row stands for a run of them until places are known.
    alike = pieces.groupBy("doc_id", "piece", "start", "length").agg(F.count(F.lit(1)).alias("n"))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN))))
    runs = runs.withColumn("n", F.least(F.lit(_RUN).cast("long"), F.col("n") - F.col("run") * _RUN))
    spread = F.xxhash64("doc_id", "piece", "length", "run")
    placed = runs.withColumn("bucket_length", bound).withColumn("spread", spread).withColumn("slot", F.pmod("spread", F.lit(slots)))
    counts = placed.groupBy("bucket_length", "slot").agg(F.sum("n").alias("slot_rows"))
    before = F.sum("slot_rows").over(Window.partitionBy("bucket_length").orderBy("slot")) - F.col("slot_rows")
    offsets = counts.select("bucket_length", "slot", before.alias("before"))
    inside = Window.partitionBy("bucket_length", "slot").orderBy("spread", "doc_id", "piece", "start", "length", "run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows_per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.lit(1).cast("long"), F.col("bucket_length"))))
    return (
        placed.withColumn("upto", F.sum("n").over(inside))
        .join(offsets, ["bucket_length", "slot"])
        .withColumn("first", F.col("before") + F.col("upto") - F.col("n"))
        .withColumn("place", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
        .select(
            "doc_id", "piece", "start", "length", "bucket_length",
            F.floor(F.col("place") / rows_per_batch).alias("batch"), (F.col("place") % rows_per_batch).cast("long").alias("row_in_batch"),
        )
    )
