"""Prefix trie of conversations: digest-keyed nodes, rolled up to all ancestors by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm.common import dropped, staged

#: Turns of one conversation that are numbered or scanned in one task; longer ones are cut and carried over.
SEGMENT = 4096

#: A conversation: its id, with nulls apart so that joins need no null-safe comparison.
_CONV = ["none", "conv"]
_NODE = ["hi", "lo"]
_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``none, conv``, ``turn``, the digest ``hi, lo`` and ``chars`` of every turn; no text goes further than this.

    The digest has 128 bits: two hashes of role and text under different seeds. A null role or text counts as
    empty. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        *(F.xxhash64(F.lit(lane), F.octet_length(role), role, text).alias(lane) for lane in _NODE), F.char_length(text).cast("long").alias("chars"),
    )


def _placed(turns: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """``place`` of each turn from 1 on and ``turns`` of its conversation: by turn, null first, ties by digest.

    Stretches of 4,096 turn numbers are numbered in tasks of their own and take over the counts of earlier ones, so
    a conversation with a third of all rows is no single task; rows of one turn number sort together, on disk if need be.
    Columns of ``shape`` (one row a conversation) come along at the level of stretches.
    """
    stretch = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))).alias("stretch")
    counts = turns.groupBy(*_CONV, stretch).count()
    whole = Window.partitionBy(*_CONV)
    earlier = F.sum("count").over(whole.orderBy("stretch")) - F.col("count")
    counts = counts.select(*_CONV, "stretch", earlier.alias("earlier"), F.sum("count").over(whole).alias("turns"))
    if shape is not None:
        counts = counts.join(shape.hint("merge"), _CONV)
    inside = Window.partitionBy(*_CONV, "stretch").orderBy(F.col("turn").asc_nulls_first(), "hi", "lo")
    rows = turns.withColumn("stretch", stretch).join(counts.hint("merge"), [*_CONV, "stretch"])
    return rows.withColumn("place", F.row_number().over(inside) + F.col("earlier")).drop("earlier", "stretch", "turn")


def sequences(conversations: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that :func:`prefix_trie` takes: ``none, conv, place, length, hi, lo, chars``."""
    return _placed(turns_of(conversations)).select(*_CONV, "place", F.col("turns").alias("length"), "hi", "lo", "chars")


def grafted(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin like another one, in the form that :func:`prefix_trie` takes.

    Conversation c takes the first h turns of c - c % every (all if it has fewer, none if it is absent) in the
    place of its own first h, with h = crc32(c) % heads. A conversation that is left without turns keeps one row of place 0.
    The rows of a null conv_id are one conversation, which stays as it is.
    """
    turns = turns_of(conversations)
    base = F.col("conv") - F.col("conv") % every
    first = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "hi", "lo")
    lenders = turns.where(~F.col("none") & (F.col("conv") % every == 0)).withColumn("place", F.row_number().over(first)).where(F.col("place") < heads)
    lent = lenders.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "hi", "lo", "chars"))).alias("all_lent"))
    h = F.when(F.col("none"), 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    held = turns.groupBy(*_CONV).agg(F.count("*").alias("turns")).select("*", h.alias("h"), F.when(~F.col("none"), base).alias("base"))
    held = held.join(lent.hint("merge"), "base", "left").withColumn("lent", F.when(F.col("all_lent").isNotNull(), F.slice("all_lent", 1, F.col("h"))))
    k = F.coalesce(F.size("lent"), F.lit(0))
    held = held.select(*_CONV, "h", "lent", k.alias("k"), (k + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("length"))
    own = _placed(turns, held.select(*_CONV, "h", "k", "length")).where(F.col("place") > F.col("h"))
    own = own.select(*_CONV, (F.col("place") - F.col("h") + F.col("k")).alias("place"), "length", "hi", "lo", "chars")
    taken = held.select(*_CONV, "length", F.explode("lent").alias("t")).select(*_CONV, F.col("t.place").cast("long").alias("place"), "length", "t.hi", "t.lo", "t.chars")
    zero = F.lit(0).cast("long")
    bare = held.where("length = 0").select(*_CONV, zero.alias("place"), "length", zero.alias("hi"), zero.alias("lo"), zero.alias("chars"))
    return own.unionByName(taken).unionByName(bare)


def _scanned(salted: DataFrame) -> DataFrame:
    """Node (``hi``, ``lo``) and parent (``p_hi``, ``p_lo``) of every turn.

    A prefix is the exclusive or of its turns' digests, each hashed with its place. Segments of 4,096 places are
    scanned in tasks of their own, each from the exclusive or of all segments before it.
    """
    segment = F.floor((F.col("place") - 1) / SEGMENT).alias("segment")
    totals = salted.where(F.col("length") > SEGMENT).groupBy(*_CONV, segment).agg(F.bit_xor("x_hi").alias("x_hi"), F.bit_xor("x_lo").alias("x_lo"))
    before = Window.partitionBy(*_CONV).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*_CONV, "segment", *(F.bit_xor(f"x_{c}").over(before).alias(f"c_{c}") for c in _NODE))
    rows = salted.where("place > 0").withColumn("segment", segment).join(carried.hint("merge"), [*_CONV, "segment"], "left")
    upto = Window.partitionBy(*_CONV, "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.bit_xor(f"x_{c}").over(upto).bitwiseXOR(F.coalesce(f"c_{c}", F.lit(0).cast("long"))).alias(c) for c in _NODE))
    return rows.select(*_CONV, "place", "chars", "hi", "lo", *(F.col(c).bitwiseXOR(F.col(f"x_{c}")).alias(f"p_{c}") for c in _NODE))


def _ends(salted: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, ascending, joined by commas.

    Ids of one node within one stretch of 4,096 numbers are sorted and joined first, all over the cluster; the joined
    texts then stream through the hash in order. A node where very many end thus costs the time of one hash, not memory.
    """
    last = salted.groupBy(*_CONV).agg(F.bit_xor("x_hi").alias("hi"), F.bit_xor("x_lo").alias("lo"))
    # nulls first, as one stretch of their own
    stretch = F.when(F.col("none"), F.lit(-(1 << 62))).otherwise(F.floor(F.col("conv") / SEGMENT)).alias("stretch")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("conv", "none"))), lambda c: F.when(c["none"], F.lit("")).otherwise(c["conv"].cast("string")))
    pieces = last.groupBy("hi", "lo", stretch).agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])
        node, sha = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for hi, lo, text in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
                if (hi, lo) == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (hi, lo), hashlib.sha256()
                sha.update(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, sha.hexdigest()), strict=True))], schema=schema)

    return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "stretch").select("hi", "lo", "ids").mapInArrow(hashed, "hi long, lo long, ends_sha256 string")


def _rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """``leaves`` and ``saved`` of every node summed over its subtree, in about log2(deepest) rounds.

    In the round of a step, a node's sums cover all descendants less than ``step`` levels below, and its pointer names
    the ancestor ``step`` levels above. Sums are added up by pointer (combined before the shuffle, so the many
    descendants of one node are no hot group), taken in by the nodes pointed at, and pointers are replaced by the
    pointers they lead to. The root is never looked up: no node has a pointer beyond it.
    """
    step = 1
    while step <= deepest:
        giving = nodes.where(F.col("depth") >= step)
        given = giving.groupBy(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        taken = nodes.join(given.hint("merge"), _NODE, "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
        taken = taken.withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaves", "more_saved")
        far = nodes.where(F.col("depth") >= step).select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("a_hi").alias("b_hi"), F.col("a_lo").alias("b_lo"))
        jumping = taken.where(F.col("depth") >= 2 * step).join(far.hint("merge"), ["a_hi", "a_lo"])
        jumped = jumping.drop("a_hi", "a_lo").withColumnsRenamed({"b_hi": "a_hi", "b_lo": "a_lo"})
        resting = taken.where(F.col("depth") < 2 * step)
        after = staged(resting.unionByName(jumped) if 2 * step <= deepest else taken, "trie_round")
        dropped(nodes)
        nodes, step = after, 2 * step
    return nodes


def prefix_trie(rows: DataFrame) -> DataFrame:
    """Every distinct prefix of the conversations as a node, from the root (depth 0, no turns) down.

    ``rows`` come from :func:`grafted` or :func:`sequences`. Returns ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in the subtree),
    ``saved_tokens`` (code points that need not be read twice: over the subtree, members less one times the last text's
    length), ``ends_sha256`` (of the ids that end here) and ``node``, 32 hex digits of its digest. A conversation
    without an id is a member but never the smallest, and its id is written as nothing; a node of which it alone is a member has a null ``conv_id``.
    Repeated rows are turns of their own; an empty table has no nodes.
    """
    x = {c: F.when(F.col("place") > 0, F.xxhash64(F.lit(c), "place", "hi", "lo")).otherwise(0).alias(f"x_{c}") for c in _NODE}
    salted = staged(rows.select(*_CONV, "place", "length", "chars", *x.values()), "trie_turns")
    own_id = F.min(F.when(~F.col("none"), F.col("conv"))).alias("conv_id")
    zero = F.lit(0).cast("long")
    spark = rows.sparkSession
    root = salted.where("place < 2").agg(F.count("*").alias("n_convs"), own_id).first()
    if not root.n_convs:
        dropped(salted)
        return spark.createDataFrame([], _RESULT)
    nodes = _scanned(salted).groupBy(F.col("place").alias("depth"), "hi", "lo")
    nodes = nodes.agg(F.count("*").alias("n_convs"), own_id, F.max("chars").alias("chars"), F.max("p_hi").alias("a_hi"), F.max("p_lo").alias("a_lo"))
    top = spark.range(1).select(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), F.lit(root.n_convs).cast("long").alias("n_convs"), F.lit(root.conv_id).cast("long").alias("conv_id"), zero.alias("chars"), F.lit(None).cast("long").alias("a_hi"), F.lit(None).cast("long").alias("a_lo"))
    bare = staged(nodes.unionByName(top), "trie_nodes")
    deepest = bare.agg(F.max("depth")).first()[0]
    children = bare.where("depth > 0").groupBy(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    above = bare.where("depth > 0").select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("conv_id").alias("parent_conv_id"))
    known = bare.join(children.hint("merge"), _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    # children of the root know its members already; all others look up their parent
    low = known.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id)).cast("long"))
    known = low.unionByName(known.where("depth > 1").join(above.hint("merge"), ["a_hi", "a_lo"]))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    first = staged(known.withColumn("leaves", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"), "trie_round")
    dropped(bare)
    ended = _ends(salted)
    rolled = _rolled_up(first, deepest).join(ended.hint("merge"), _NODE, "left")
    node = F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in _NODE))
    return rolled.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), node.alias("node"),
    )

