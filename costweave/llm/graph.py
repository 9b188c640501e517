"""Connected components of an edge table: tasks contract their edges, star rounds bring the rest together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm.common import dropped, staged

#: Edges that a task holds at once.
_CHUNK = 500_000


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges but the smallest of its component, with that smallest one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _contracted(pairs: DataFrame, n: int) -> DataFrame:
    """The edges of each task (about ``_CHUNK`` of ``n``) as the stars of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            found = local_stars(*(table.column(c).to_numpy() for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > _CHUNK:
                yield stars()
                held = []
        if held:
            yield stars()

    return pairs.coalesce(max(1, -(-n // _CHUNK))).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has the long columns ``a`` and ``b``; loops, repeats and both directions
    are allowed. Returns ``node`` and ``root`` with one row a node. Each round, tasks replace about half a
    million edges each by the stars of their components; edges that fit one such
    task are thereby done. Else every edge is rewritten once to the smallest node around its ends
    (minima with a map-side combine), so no neighbourhood is gathered in one place; rounds grow with the
    logarithm of the longest chain. An edge table without rows gives no rows. Raises if ``max_rounds`` do not suffice.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = staged(pairs, "edges"), None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        alone = state[0] <= _CHUNK
        if state[0] == 0 or state == before:
            return _with_roots(pairs)
        before = state
        stars = _contracted(pairs, state[0])
        moved = staged(stars if alone else _small_star(_large_star(stars)), "edges")
        dropped(pairs)
        pairs = moved
        if alone:
            return _with_roots(pairs)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _with_roots(stars: DataFrame) -> DataFrame:
    """``node`` and ``root`` of all nodes of settled stars, the roots among them."""
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return moved.where("u <> v")


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
