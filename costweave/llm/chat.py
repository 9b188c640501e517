"""Chat formatting of reply trees: branches by iterative self-joins, one conversation a chosen branch."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm.common import arrow_rows, staged

#: The template's control strings. Inside texts each gets a backslash after its first character.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]")
_KEY = {"conv_id": "conv_id", "msg_id": "msg_id"}
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = rf"([<\[])(\\*)(?={_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={_REST})"
_TURN = re.compile(
    r"\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<role>.*?)\[TEXT\](?P<text>.*?)\[/ROLE\]| (?P<assistant>.*?)</s>",
    re.DOTALL,
)


def escaped(text: Column) -> Column:
    """Text that holds no control string: ``[INST]`` becomes ``[\\INST]``, ``[\\INST]`` ``[\\\\INST]``."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPE, r"$1$2\\")


def unescaped(text: str) -> str:
    return re.sub(_UNESCAPE, r"\1\2", text)


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted conversation; raises ValueError on anything else."""
    if not formatted.startswith("<s>"):
        raise ValueError("no <s> at the start")
    turns, at = [], len("<s>")
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastgroup
        turns.append((unescaped(m["role"]), unescaped(m["text"])) if kind == "text" else (kind, unescaped(m[kind])))
        at = m.end()
    return turns


def _joined(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """``left`` and ``right`` where each key of ``left`` equals its one of ``right`` or both are null; columns of ``left``, then the others of ``right``."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys.values()})
    same = reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(f"right_{b}")) for a, b in keys.items()))
    return left.join(renamed, same, how).drop(*(f"right_{k}" for k in keys.values()))


def branches(messages: DataFrame, n_branches: int = 1, max_rounds: int = 40) -> DataFrame:
    """The best root-to-leaf paths of every conversation's reply tree.

    ``messages`` has ``conv_id, msg_id, parent_id`` (null for a root) and ``score``. Returns
    ``conv_id, leaf_id, branch, branch_score, msg_id, depth``: the messages of each chosen
    path, depth 0 at the root. A path scores the sum of its messages' scores (null: 0);
    branches rank by score, ties by the smaller leaf id. Self-joins double the span of the
    ancestor links a round, so rounds grow with the logarithm of the depth, every row stays one
    message, and only messages whose link has not reached the root are joined. A message whose
    parent is missing is a root. A null ``conv_id`` is a conversation, a null ``msg_id`` a message that
    nothing answers. Raises on a cycle, or when (conv_id, msg_id) repeats. An empty table gives no rows.
    """
    own = messages.select("conv_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    if own.groupBy("conv_id", "msg_id").count().where("count > 1").limit(1).count():
        raise ValueError("msg_id repeats in a conversation")
    there = own.where(F.col("msg_id").isNotNull()).select("conv_id", "msg_id", F.lit(True).alias("has_parent"))
    links = staged(
        own.select("conv_id", "msg_id", "parent_id", "score").transform(_joined, there, {"conv_id": "conv_id", "parent_id": "msg_id"}, "left").select(
            "conv_id", "msg_id", F.when(F.col("has_parent"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("span"), "score"
        ),
        "links",
    )
    levels = [links]
    while not links.where(F.col("up").isNotNull()).isEmpty():
        if len(levels) > max_rounds:
            raise ValueError("the reply links have a cycle")
        above = links.select("conv_id", "msg_id", F.col("up").alias("up2"), F.col("span").alias("span2"), F.col("score").alias("score2"))
        moved = (
            links.where(F.col("up").isNotNull())
            .withColumnRenamed("msg_id", "own_id")
            .transform(_joined, above, {"conv_id": "conv_id", "up": "msg_id"}, "left")
            .withColumnRenamed("own_id", "msg_id")
            .select(
                "conv_id", "msg_id", F.col("up2").alias("up"),
                (F.col("span") + F.coalesce("span2", F.lit(0))).alias("span"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
            )
        )
        links = staged(links.where(F.col("up").isNull()).unionByName(moved), "links")
        levels.append(links)
    # All links now reach the root: span is the length of the path, score its sum.
    parents = levels[0].where(F.col("up").isNotNull()).select("conv_id", F.col("up").alias("msg_id")).distinct()
    leaves = _joined(links, parents, _KEY, "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "msg_id"))
    chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= n_branches)
    paths = chosen.select("conv_id", F.col("msg_id").alias("leaf_id"), "branch", F.col("score").alias("branch_score"), "msg_id", (F.col("span") - 1).alias("depth"))
    for k in reversed(range(len(levels) - 1)):  # each member of a path brings the one 2^k above it
        jump = levels[k].where(F.col("up").isNotNull()).select("conv_id", "msg_id", "up")
        more = _joined(paths, jump, _KEY).select("conv_id", "leaf_id", "branch", "branch_score", F.col("up").alias("msg_id"), (F.col("depth") - (1 << k)).alias("depth"))
        paths = staged(paths.unionByName(more), "paths")
    return paths


def format_reply_trees(messages: DataFrame, n_branches: int = 1) -> DataFrame:
    """One formatted conversation for each of the ``n_branches`` best branches of every tree.

    ``messages`` has ``conv_id, msg_id, parent_id, role, text, score``. Returns ``conv_id,
    branch, leaf_id, branch_score, formatted, loss_spans``: the text starts with ``<s>``;
    a user turn is ``[INST] text [/INST]``, a system turn ``[SYS] text [/SYS]``, an assistant
    turn a space, the text and ``</s>``, any other ``[ROLE]role[TEXT]text[/ROLE]``. Control
    strings in texts and roles are escaped reversibly. ``loss_spans`` are the (start, end)
    code points of assistant texts. A null text or role is empty. One conversation is one
    row, so a path must fit a row; that is the only thing that is gathered.
    """
    text, role = escaped(F.col("text")), F.coalesce(F.col("role"), F.lit(""))
    before = F.when(role == "user", "[INST] ").when(role == "system", "[SYS] ").when(role == "assistant", " ").otherwise(F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[TEXT]")))
    after = F.when(role == "user", " [/INST]").when(role == "system", " [/SYS]").when(role == "assistant", "</s>").otherwise("[/ROLE]")
    turns = messages.select("conv_id", "msg_id", before.alias("before"), text.alias("body"), after.alias("after"), (role == "assistant").alias("learn"))
    rows = _joined(branches(messages, n_branches), turns, _KEY)
    path = F.array_sort(F.collect_list(F.struct("depth", "before", "body", "after", "learn")))
    whole = rows.groupBy("conv_id", "leaf_id", "branch", "branch_score").agg(path.alias("path"))
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform("path", lambda t: F.concat(t["before"], t["body"], t["after"])), ""))
    start = F.struct(F.lit(3).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.char_length(t["before"])
        end = begin + F.char_length(t["body"])
        spans = F.when(t["learn"], F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct((end + F.char_length(t["after"])).alias("at"), spans.alias("spans"))

    return whole.select("conv_id", "branch", "leaf_id", "branch_score", formatted.alias("formatted"), F.aggregate("path", start, step, lambda s: s["spans"]).alias("loss_spans"))


def turn_chain(conversations: DataFrame) -> DataFrame:
    """Flat conversations as reply trees: each turn answers the one before it.

    Rows order by turn (null first), ties by role and text; scores are 0.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    place = F.row_number().over(order).cast("long")
    placed = conversations.select("conv_id", "role", "text", place.alias("msg_id"))
    return placed.select(
        "conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a formatted conversation says when it is parsed again."""

    def make():
        def handle(convs, texts, spans):
            out = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv, text, parts in zip(convs, texts, spans, strict=True):
                turns = parse_conversation(text)
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                learned = "".join(unescaped(text[p["start"] : p["end"]]) for p in parts)
                for k, v in zip(out, (conv, len(turns), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)), strict=True):
                    out[k].append(v)
            return out

        return handle

    return arrow_rows(formatted, ["conv_id", "formatted", "loss_spans"], make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
