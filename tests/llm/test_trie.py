"""The prefix trie against dictionaries of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from costweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns by conversation; equal turn numbers in these tables carry equal rows."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in said.items()}


def plain_graft(said):
    out = {}
    for c, own in said.items():
        if c is None:
            out[c] = own
            continue
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = said.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def total(node):
        leaves, saved = (0 if children[node] else 1), (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for child in children[node]:
            more = total(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    least = lambda node: min((c for c in members[node] if c is not None), default=None)
    out = []
    for node, who in members.items():
        ends = sorted((c for c in who if len(convs[c]) == len(node)), key=lambda c: (c is not None, c or 0))
        sha = hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()
        out.append((least(node), len(node), least(node[:-1]) if node else None, len(who), len(children[node]), *total(node), sha))
    return out


def key(row):
    return tuple((x is not None, x) if not isinstance(x, str) else (True, x) for x in row)


def check(frame, want):
    got = [tuple(r[:-1]) for r in frame.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


ROWS = (
    [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c % 3}" if t > 1 else "hello ✓") for c in range(-30, 260, 7) for t in range(abs(c) % 9)]
    + [(100, t, "user", f"base {t}") for t in range(4)]
    + [(200, 5, "user", "only one"), (300, None, None, None), (300, 1, "user", ""), (300, 0, "", None)]
    + [(301, 1, "user", "x")] * 3
    + [(None, 1, "user", "hello ✓"), (None, None, "user", "none")]
    + [(799, 0, "user", "gone")]
    + [(c, 0, "system", "shared") for c in range(1000, 1090)]
)


@pytest.mark.parametrize("segment", [4096, 3])
def test_grafted_trie(spark, monkeypatch, segment):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    check(trie.prefix_trie(trie.grafted(rows)), plain_trie(plain_graft(ordered(ROWS))))


def test_conversations_as_they_are(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    check(trie.prefix_trie(trie.sequences(rows)), plain_trie(ordered(ROWS)))


@pytest.mark.parametrize("depth", [1, 4, 5, 37])
def test_depths_around_powers_of_two(spark, monkeypatch, depth):
    monkeypatch.setattr(trie, "SEGMENT", 10)
    rows = [(c, t, "user", "a" * (1 + (t * c) % 5 if t >= depth - c else 7)) for c in range(4) for t in range(depth)]
    check(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA))), plain_trie(ordered(rows)))


def test_role_and_text_do_not_run_together(spark):
    rows = [(1, 0, "us", "er"), (2, 0, "user", ""), (3, 0, "", "user"), (4, 0, "u", "ser")]
    assert trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA))).count() == 5


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.grafted(none)).collect() == []
    clashing = spark.createDataFrame([(1, 0, "user", "x", 9, "y", 3, None), (1, 1, "user", "z", 9, "y", 3, None)], SCHEMA + ", place int, hi string, conv int, none string")
    check(trie.prefix_trie(trie.sequences(clashing)), plain_trie(ordered([(1, 0, "user", "x"), (1, 1, "user", "z")])))


def test_ties_of_unlike_turns_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in "abcdef"] + [(2, 0, "user", t) for t in "fedcba"]
    made = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()
    assert len(made) == 7 and {r.n_convs for r in made} == {2}


def test_a_hot_conversation_is_cut(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 50)
    rows = spark.range(2000).selectExpr("5 AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    made = trie.prefix_trie(trie.sequences(rows)).collect()
    assert len(made) == 2001 and {r.n_leaves for r in made} == {1} and max(r.depth for r in made) == 2000
