"""SimHash near-dedup at a similarity: deletion variants link what is almost equal, banded minima propose the rest.

At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in about 10 bits. Deletion variants for
that many bits would have segments of a few bits, each shared by a large part of all texts, so
:mod:`costweave.llm.simhash` (two bits) is the first pass here, which joins the crowds of almost
equal texts, and a second one proposes texts that share a band of minima: 128 minima in 32 bands of four. Two
texts of similarity s share no band with probability (1 - s^4)^32: 5e-8 at 0.8, less above. Every link
is verified on the whole texts.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm.common import ASCII_LOWER, arrow_rows, dropped, fresh, staged
from costweave.llm.graph import components
from costweave.llm.simhash import near_links, text_fingerprint, with_groups

_BANDS, _ROWS = 32, 4
_CELLS = 1 << 20
_DRAW = np.random.default_rng(42)
_XOR = _DRAW.integers(0, 1 << 32, _BANDS * _ROWS, np.uint32)
_MUL = _DRAW.integers(0, 1 << 31, _BANDS * _ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, shingle: int = 5) -> set[bytes]:
    """The distinct runs of ``shingle`` words, A-Z in lower case; a shorter text is one run, one without words none."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    """Shared shingles by all shingles; 1 where neither has any."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def band_keys(pieces: set[bytes]) -> np.ndarray:
    """One signed 64-bit key for each band of the minima of ``pieces``."""
    from xxhash import xxh32_intdigest

    hashes = np.fromiter((xxh32_intdigest(p, 42) for p in pieces), np.uint32, len(pieces))
    least = np.full(_BANDS * _ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[at : at + 1024, None] ^ _XOR) * _MUL
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, mixed.min(axis=0))
    keys = np.arange(1, _BANDS + 1, dtype=np.uint64)
    for column in least.reshape(_BANDS, _ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _ordered_prefix(pieces: set[bytes], uses: np.ndarray, min_similarity: float) -> tuple[np.ndarray, int]:
    """The rarest hashed shingles of a set that a near one cannot all lack, and how many of them one of no smaller size cannot.

    ``uses`` counts shingles by their hash modulo its length; any counts give a correct order, good ones a short search.
    """
    from xxhash import xxh64_intdigest

    h = np.unique(np.fromiter((xxh64_intdigest(p, 7) for p in pieces), np.uint64, len(pieces)))
    h = h[np.lexsort((h, uses[h % np.uint64(len(uses))]))]
    n = len(h)
    probe = n - math.ceil(min_similarity * n - 1e-9) + 1
    index = n - math.ceil(2 * min_similarity / (1 + min_similarity) * n - 1e-9) + 1
    return h[:probe].view(np.int64), min(index, probe)


def _verified(pairs: DataFrame, texts: DataFrame, min_similarity: float, shingle: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose texts (``node, text``) have ``min_similarity`` or more."""

    def make():
        cached = lru_cache(maxsize=32)(lambda text: shingles(text, shingle))

        def pieces(text: str) -> set[bytes]:
            return cached(text) if len(text) < 20_000 else shingles(text, shingle)

        def handle(a, b, left, right):
            near = [jaccard(pieces(x), pieces(y)) >= min_similarity for x, y in zip(left, right, strict=True)]
            return {"a": [v for v, ok in zip(a, near, strict=True) if ok], "b": [v for v, ok in zip(b, near, strict=True) if ok]}

        return handle

    one, other = (texts.select(F.col("node").alias(c), F.coalesce("text", F.lit("")).alias(t)) for c, t in (("a", "left"), ("b", "right")))
    return staged(arrow_rows(pairs.join(one, "a").join(other, "b"), ["a", "b", "left", "right"], make, "a long, b long"), "near-pairs")


def _sized_pairs(left: DataFrame, right: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs of nodes with one key whose sizes allow them to be near."""
    met = left.select("key", F.col("node").alias("x"), F.col("size").alias("x_size")).join(right.select("key", F.col("node").alias("y"), F.col("size").alias("y_size")).hint("merge"), "key")
    fits = F.least("x_size", "y_size") >= min_similarity * F.greatest("x_size", "y_size")
    return met.where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")


def _open_pairs(members: DataFrame, texts: DataFrame, min_similarity: float, shingle: int) -> DataFrame:
    """Pairs of ``members`` (``node, root``) in different components that can be near: an exact search by rare shingles.

    Shingles order by how often all members use them (counted in 2^20 cells, the bound of what is broadcast).
    Sets of similarity t share one of their rarest (1 - t) * size + 1, and the smaller one has it among
    fewer still, so a passage that thousands of texts share proposes no pair of them.
    """
    spark, own = members.sparkSession, members.join(texts, "node")

    def count():
        from xxhash import xxh64_intdigest

        def handle(found):
            cells = np.fromiter((xxh64_intdigest(p, 7) for t in found for p in shingles(t, shingle)), np.uint64) % np.uint64(_CELLS)
            cell, n = np.unique(cells, return_counts=True)
            return {"cell": cell.astype(np.int64), "n": n}

        return handle

    counted = arrow_rows(own, ["text"], count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    uses = np.zeros(_CELLS, np.int64)
    uses[counted["cell"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(uses)

    def prefixes():
        def handle(nodes, roots, found):
            out = {k: [] for k in ("key", "node", "root", "size", "pos", "index")}
            for node, root, text in zip(nodes, roots, found, strict=True):
                pieces = shingles(text, shingle)
                rare, index = _ordered_prefix(pieces, shared.value, min_similarity)
                for pos, key in enumerate(rare.tolist()):
                    for k, v in zip(out, (key, node, root, len(pieces), pos, pos < index), strict=True):
                        out[k].append(v)
            return out

        return handle

    rare = staged(arrow_rows(own, ["node", "root", "text"], prefixes, "key long, node long, root long, size long, pos long, index boolean"), "prefixes")
    small, large = (rare.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "root", "size", "pos", "index"))) for side in ("s", "l"))
    needed = F.ceil(min_similarity / (1 + min_similarity) * (F.col("s_size") + F.col("l_size")) - 1e-9)
    met = small.where("s_index").join(large.hint("merge"), "key").where(
        (F.col("s_root") != F.col("l_root"))
        & (F.struct("s_size", "s_node") < F.struct("l_size", "l_node"))
        & (F.col("s_size") >= min_similarity * F.col("l_size"))
        & (F.least(F.col("s_size") - F.col("s_pos"), F.col("l_size") - F.col("l_pos")) >= needed)
    )
    return met.select(F.least("s_node", "l_node").alias("a"), F.greatest("s_node", "l_node").alias("b")).distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_similarity: float = 0.8, shingle: int = 5, max_bits: int = 2, crowd: int = 16) -> DataFrame:
    """``doc_id``, ``node`` (xxhash64 of the text), ``component_id`` and ``keep`` of every row.

    Texts whose shingle sets have ``min_similarity`` (0.8 or more) are linked; the component id is
    the smallest id that links reach. Equal texts are one node (a null text is an empty one).
    Candidates: fingerprints within ``max_bits``, all pairs in bands of ``crowd`` or fewer nodes, and in
    larger bands each node with the three least members by a hash. Where a larger band
    then still spans several components, its members are searched by rare shingles, which
    proposes every near pair of them without pairing the crowd. ``keep`` marks the rows of
    one text and id in each component: the smallest id (null last), ties by ``node``;
    where rows repeat both, all of them. An empty table gives no rows.
    """
    if min_similarity < 0.8:
        raise ValueError("the bands are made for min_similarity 0.8 or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))

    def make():
        def handle(ids, nodes, found):
            fps, sizes, bands = [], [], []
            for text in found:
                pieces = shingles(text, shingle)
                fps.append(text_fingerprint(text, shingle))
                sizes.append(len(pieces))
                bands.append(band_keys(pieces))
            return {"doc_id": ids, "node": nodes, "fp": np.array(fps, "<u8").view("<i8"), "size": sizes, "bands": bands}

        return handle

    rows = staged(arrow_rows(docs, ["doc_id", "node", "text"], make, "doc_id long, node long, fp long, size long, bands array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    nodes = staged(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"), first.alias("first"), F.count(F.lit(1)).alias("n")), "nodes")

    owners = staged(nodes.groupBy("fp").agg(F.min("node").alias("owner")), "owners")
    near = near_links(owners.select("fp"), max_bits, crowd)
    fp_pairs = near.join(owners.withColumnsRenamed({"fp": "a", "owner": "x"}), "a").join(owners.withColumnsRenamed({"fp": "b", "owner": "y"}), "b").select("x", "y")
    fp_pairs = fp_pairs.union(nodes.join(owners, "fp").select("node", "owner")).toDF("x", "y").where("x <> y")
    fp_pairs = fp_pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    sized = staged(keyed.join(shared.hint("merge"), "key"), "bands")  # exploded rows are more than Spark takes them for
    small, large = sized.where(F.col("members") <= crowd), sized.where(F.col("members") > crowd)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    leaders = large.withColumn("place", place).where("place <= 3")
    pairs = staged(_sized_pairs(small, small, min_similarity).union(_sized_pairs(leaders, large, min_similarity)).union(fp_pairs).distinct(), "pairs")

    wanted = pairs.select("a").union(pairs.select("b")).union(large.select("node")).toDF("node").distinct()
    texts = staged(docs.join(wanted, "node", "left_semi").select("node", "text").groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = _verified(pairs, texts, min_similarity, shingle)
    roots = components(links)
    if not large.isEmpty():
        roots = staged(roots, "component-roots")
        known = staged(large.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "crowds")
        split = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        members = staged(known.join(split, "key").select("node", "root").distinct(), "members")
        if not members.isEmpty():
            more = _verified(_open_pairs(members, texts, min_similarity, shingle), texts, min_similarity, shingle)
            if not more.isEmpty():
                roots = components(links.unionByName(more))
    known = staged(nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    least = known.groupBy("root").agg(F.min(F.struct("first", "node")).alias("least"))
    group_of = known.join(least, "root").select(
        "node", "n", F.struct(F.col("least.first.doc_id").alias("id"), F.col("least.node").alias("node")).alias("component_id")
    )
    total = known.agg(F.sum("n")).first()[0] or 0
    dropped(nodes, owners, sized, pairs, texts)
    out = with_groups(rows.select("doc_id", "node"), staged(group_of, "groups"), "node", total)
    keep = (F.col("node") == F.col("component_id.node")) & F.col("doc_id").eqNullSafe(F.col("component_id.id"))
    return out.select("doc_id", "node", F.col("component_id.id").alias("component_id"), keep.alias("keep"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near copies: one row of each group of :func:`near_groups` stays.

    It is the one with the smallest id (a null id only where there is no other); of rows that
    repeat its id and text, one. Columns are those of ``df``, whatever their names.
    """
    groups = near_groups(df, id_col, text_col, **options)
    node, key, times = (fresh(df, c) for c in ("copy_node", "copy_key", "copy_times"))
    kept = groups.where("keep").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias(times)).withColumnsRenamed({"doc_id": key, "node": f"{node}_kept"})
    own = df.withColumn(node, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    met = own.join(kept, (F.col(node) == F.col(f"{node}_kept")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    repeated = met.where(F.col(times) > 1).dropDuplicates([node]).select(*columns)
    return met.where(F.col(times) == 1).select(*columns).unionByName(repeated)
