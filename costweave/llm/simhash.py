"""SimHash near-duplicate groups by deletion-variant signatures.

A fingerprint is cut into two segments. Two fingerprints at two or fewer differing bits
differ by at most one bit in one of the segments, so masking each bit of each segment in
turn (64 one-wildcard variants) gives them a common variant. Variants meet by equality and
candidates are verified on the whole fingerprint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.llm.common import ASCII_LOWER, arrow_rows, dropped, staged
from costweave.llm.graph import components

SEED = 42


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    hashes = np.fromiter((xxh64_intdigest(p, SEED) for p in pieces), np.dtype("<u8"), len(pieces))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row.

    A null or empty text, or one of white space only, has the fingerprint 0. Rows with a
    null id stay. Other columns are ignored, whatever their names.
    """

    def make():
        def handle(ids, texts):
            fps = np.array([text_fingerprint(t, shingle) for t in texts], "<u8").view("<i8")
            return {"doc_id": ids, "fp": fps}

        return handle

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_rows(source, ["doc_id", "text"], make, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """The 64 one-wildcard segment variants of a fingerprint: variant number above 32 masked bits."""
    keys = []
    for segment in (0, 1):
        bits = F.shiftrightunsigned(fp, 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            masked = bits.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
            keys.append(masked.bitwiseOR(F.lit((32 * segment + bit) << 32)))
    return F.array(*keys)


def _balls(fp: Column, max_bits: int) -> Column:
    """Keys that meet exactly where whole fingerprints are within ``max_bits`` (1 or 2) bits.

    For two bits, the keys are the fingerprint and its 64 one-bit neighbours: two
    fingerprints share one if and only if at most two bits differ, and a key has at most 65
    owners. For one bit, the keys are the 64 one-wildcard variants of the whole fingerprint.
    """
    ones = [F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)]
    if max_bits == 2:
        return F.array(F.struct(F.lit(0).alias("bit"), fp.alias("value")), *(F.struct(F.lit(0).alias("bit"), fp.bitwiseXOR(o).alias("value")) for o in ones))
    return F.array(*(F.struct(F.lit(b).alias("bit"), fp.bitwiseAND(F.bitwise_not(o)).alias("value")) for b, o in enumerate(ones)))


def near_links(distinct_fps: DataFrame, max_bits: int = 2, crowd: int = 16) -> DataFrame:
    """Links ``a < b`` that connect all fingerprints within ``max_bits`` (0, 1 or 2) differing bits.

    ``distinct_fps`` has one row for each distinct ``fp``. Variants that ``crowd`` or fewer
    fingerprints share are self-joined and verified. Fingerprints of a more crowded variant
    (many near copies of one text) meet on keys of the whole fingerprint instead, where a
    key has at most 65 owners that all are within reach: each links to the least of them.
    That is exact too, and makes 65 rows a fingerprint however large the group is.
    Every returned link is real; of links within one key's owners, those to the least
    suffice for the same components.
    """
    spark = distinct_fps.sparkSession
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    if max_bits == 0:
        return spark.createDataFrame([], "a long, b long")
    keyed = distinct_fps.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the exploded rows for no more than their source; by that size it would broadcast all variants.
    sized = staged(keyed.join(shared.hint("merge"), "key"), "variants")
    small = sized.where(F.col("n") <= crowd)
    joined = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")).hint("merge"), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )
    crowded = sized.where(F.col("n") > crowd).select("fp").distinct()
    met = (
        crowded.select("fp", F.explode(_balls(F.col("fp"), max_bits)).alias("ball"))
        .groupBy("ball")
        .agg(F.collect_list("fp").alias("owners"))
        .where(F.size("owners") > 1)
        .select(F.array_min("owners").alias("a"), F.explode("owners").alias("b"))
        .where("a < b")
    )
    return joined.union(met).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, shingle: int = 3, crowd: int = 16
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Rows whose fingerprints differ in ``max_bits`` or fewer bits are linked; the component
    id is the smallest id that links reach. Equal fingerprints are one node, so exact
    copies cost one row each and no links. Null ids keep a row but are no component id
    unless a component has no other (then it is null). An empty table gives no rows.
    """
    docs = staged(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    first = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(near_links(first.select("fp"), max_bits, crowd)).withColumnRenamed("node", "fp")
    known = staged(first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    group_of = staged(known.join(least, "root").select("fp", "n", "component_id"), "groups")
    dropped(first, known)
    rows = group_of.agg(F.sum("n")).first()[0] or 0
    return with_groups(docs, group_of, "fp", rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_groups(rows: DataFrame, group_of: DataFrame, key: str, n_rows: int, most_hot: int = 10_000) -> DataFrame:
    """``rows`` with the ``component_id`` that ``group_of`` (one row a ``key``, which comes ``n`` times) has for their key.

    A key that holds more than one of ``most_hot`` parts of all rows (and 10,000 rows) is hot; there are at most
    ``most_hot`` of these, which is the bound of what is broadcast to their rows. The others meet in a shuffle.
    """
    hot = group_of.where(F.col("n") > max(10_000, n_rows // most_hot)).select(key, "component_id")
    cold = group_of.where(F.col("n") <= max(10_000, n_rows // most_hot)).select(key, "component_id")
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(few)
