"""The registered queries of the document operators, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm import bpe, chat, fim, imatch, langid, mixing, packing, pii, quality, simhash, tiff, toxicity, trie
from costweave.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Texts of the training folds with a label, and ``drawn``, a hash of each that is made before the join."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("drawn")).where(fold(F.col("doc_id")) != 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", label).where(F.col(label).isNotNull())
    return documents.join(labels.hint("merge"), "doc_id")  # one strategy at every size: both sides grow


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: maximal segments of token log-odds; ``n_passages`` counts the significant ones."""
    model = toxicity.train(labelled(spark, sf_dir, "toxic"), hash_col="drawn")
    scored = toxicity.score(table(spark, sf_dir, "documents"), model)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text, terms in 0.02 % to 5 % of the documents."""
    return imatch.compare_with_edits(table(spark, sf_dir, "documents"), min_share=0.0002, max_share=0.05)


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and the probe -7, as a reply tree of one branch: formatted, parsed again and digested."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_reply_trees(chat.turn_chain(conversations)))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a TIFF page 64 pixels wide (deflate, differences to the left), read back."""
    media = tiff.store_texts(table(spark, sf_dir, "documents"), width=64, compression=tiff.DEFLATE, predictor=2)
    pages = tiff.tiff_pages(media)
    return pages.select(
        "doc_id",
        F.regexp_extract("description", "n_bytes=([0-9]+)", 1).cast("long").alias("n_bytes"),
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature", "error",
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of SimHash fingerprints (3-word shingles) at two or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=2, shingle=3)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that meet the targets of its source; without base rates one tilt a source."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), max_rate=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 length buckets of least padding, batches of 65,536 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), max_length=4096, n_buckets=16, token_budget=65_536)


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by boosted trees over its statistics."""
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from the posteriors of its words."""
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.select("doc_id", "text", "lang"))
    return langid.predict(documents, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op10_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans by kind, and with those that the trees add; ``n_spans`` counts all."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at token borders and rearranged, and the text that its output gives back."""
    made = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as tokens of a public vocabulary of 50,256 ranks, and decoded again."""
    vocabulary = bpe.Vocabulary.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    made = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each begun like the first one of its hundred."""
    return trie.prefix_trie(trie.grafted(table(spark, sf_dir, "conversations"), every=100, heads=6)).drop("node")


#: The checksum bit by bit, prefixes as digests of joined digests, and each node handed to all nodes on its way up.
_PREFIX_TRIE_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations
), held AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
           list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)
), turns AS (
  SELECT held.c, place, role, txt FROM held JOIN t ON t.c = held.base WHERE place <= h
  UNION ALL
  SELECT held.c, place, role, txt FROM held JOIN t ON t.c = held.c WHERE place > h
), numbered AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY place) AS depth, md5(length(role) || ':' || role || txt) AS turn_key, length(txt) AS chars
  FROM turns
), path AS (
  SELECT c, depth, chars, md5(string_agg(turn_key, '') OVER (PARTITION BY c ORDER BY depth)) AS k,
         max(depth) OVER (PARTITION BY c) AS deep
  FROM numbered
  UNION ALL
  SELECT h.c, 0, 0, 'root', coalesce(max(n.depth), 0) FROM held h LEFT JOIN numbered n ON n.c = h.c GROUP BY h.c
), node AS (
  SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = deep), '')) AS ends_sha256
  FROM path GROUP BY k, depth
), up AS (
  SELECT n.k, n.depth, p.k AS parent, pn.conv_id AS parent_conv_id
  FROM node n LEFT JOIN path p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN node pn ON pn.k = p.k AND pn.depth = p.depth
), fan AS (
  SELECT parent, count(*) AS n FROM up WHERE depth > 0 GROUP BY parent
), below AS (
  SELECT a.k, a.depth, count(*) FILTER (WHERE f.n IS NULL) AS n_leaves, sum(n.own) AS saved
  FROM node n LEFT JOIN fan f ON f.parent = n.k JOIN path a ON a.c = n.conv_id AND a.depth <= n.depth
  GROUP BY a.k, a.depth
)
SELECT n.conv_id, n.depth, u.parent_conv_id, n.n_convs, coalesce(f.n, 0) AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN up u ON u.k = n.k AND u.depth = n.depth LEFT JOIN fan f ON f.parent = n.k JOIN below b ON b.k = n.k AND b.depth = n.depth
"""

#: Cuts and forms from the digest, tokens as a list; the text itself is what the output must give back.
_FILL_IN_MIDDLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || substr(k, 1, 8))::BIGINT AS h1, ('0x' || substr(k, 9, 8))::BIGINT AS h2,
         ('0x' || substr(k, 17, 8))::BIGINT AS h3, ('0x' || substr(k, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express whole; tests/llm holds the others against brute force."""
    return {"op11_fill_in_middle": _FILL_IN_MIDDLE_SQL, "op13_prefix_trie": _PREFIX_TRIE_SQL}
