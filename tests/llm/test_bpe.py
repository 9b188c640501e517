"""Byte-level BPE against the tiktoken library on the same ranks."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from costweave.llm import bpe

from .conftest import SCHEMA, row

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_ranks(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lists(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_perfect_hash_is_minimal_and_exact(vocabulary):
    table = vocabulary.hash
    assert len(table.values) == table.n == 50_256 and sorted(table.values.tolist()) == list(range(50_256))
    rng = random.Random(2)
    keys = [k for k, _ in table.items()]
    others = [k + b"\x01" for k in keys[:3000]] + [bytes(rng.randrange(256) for _ in range(rng.randrange(200))) for _ in range(3000)] + [b"", b"q" * 5000]
    known = dict(table.items())
    asked = keys + others
    data, bounds = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)])
    assert table.find(data, bounds).tolist() == [known.get(k, -1) for k in asked]


@pytest.mark.parametrize("keys", [[], [b""], [b"a"], [b"", b"a", b"ab", b"b" * 300], [bytes([a, b]) for a in range(40) for b in range(40)]])
def test_small_tables(keys):
    table = bpe.PerfectHash(keys, list(range(5, 5 + len(keys))))
    asked = [*keys, b"zz\x00", b"c"]
    got = table.find(np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)]))
    assert got.tolist() == [*range(5, 5 + len(keys)), -1, -1] and len(table.values) == len(keys)


def test_repeated_keys_and_missing_bytes_are_refused():
    with pytest.raises(ValueError, match="repeat"):
        bpe.PerfectHash([b"a", b"a"], [1, 2])
    with pytest.raises(ValueError, match="without a rank"):
        bpe.Vocabulary({b"a": 0}, ".")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="ab' \n\tst1é漢", max_size=80), max_size=5))
def test_any_text(vocabulary, library, texts):
    ids, bounds = bpe.encoder(vocabulary)(pa.array(texts, pa.string()))
    assert lists(ids, bounds) == [library.encode_ordinary(t) for t in texts]


def test_long_runs_blocks_and_nulls(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "_BLOCK", 50)
    monkeypatch.setattr(bpe, "_LONG", 400)
    texts = ["x" * 20_000, None, "", "漢字" * 3000, " " * 500 + "a", "it's we'll <|endoftext|> 'S " * 60, "é𝄞́" * 200, "ab" * 40 + "  \u0085end"]
    ids, bounds = bpe.encoder(vocabulary)(pa.array(texts))
    assert lists(ids, bounds) == [library.encode_ordinary(t or "") for t in texts]


def test_tables(spark, vocabulary, library, docs, empty):
    made = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert len(made) == docs.count()
    for r in made:
        want = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) == (len(want), want, (r.text or "").encode())
    listed = bpe.decode(bpe.encode(docs, vocabulary, packed=False), vocabulary).collect()
    assert sorted((r.n_tokens, sum(r.ids), bytes(r.decoded)) for r in listed) == sorted((r.n_tokens, int(np.frombuffer(r.ids, "<u4").sum()), bytes(r.decoded)) for r in made)
    assert bpe.decode(bpe.encode(empty, vocabulary), vocabulary).count() == 0
    with pytest.raises(ValueError, match="there already"):
        bpe.encode(bpe.encode(docs, vocabulary), vocabulary)


def test_ids_that_are_none(spark, vocabulary):
    rows = [(1, [50_256]), (2, [-1]), (3, None), (4, []), (5, [15, None]), (6, [0, 1])]
    got = {r.i: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "i int, ids array<int>"), vocabulary).collect()}
    assert [got[k] for k in (1, 2, 5)] == [None] * 3 and got[3] == got[4] == b"" and len(got[6]) == 2
    packed = [(1, b"\x01"), (2, None), (3, b"\xff\xff\xff\xff"), (4, b"\x00\x00\x00\x00")]
    got = {r.i: r.decoded for r in bpe.decode(spark.createDataFrame(packed, "i int, ids binary"), vocabulary).collect()}
    assert got[1] is None and got[3] is None and got[2] == b"" and len(got[4]) == 1


def test_clashing_names_pass_through(spark, vocabulary):
    table = spark.createDataFrame([row(1, "some text")], SCHEMA)
    assert bpe.encode(table, vocabulary).columns == [*table.columns, "n_tokens", "ids"]


def test_short_pieces_are_merged_side_by_side_as_by_the_heap(vocabulary, monkeypatch):
    ranks = dict(vocabulary.hash.items())
    merges, abreast = bpe.Merges(ranks, vocabulary.hash.width), bpe.ShortMerges(ranks)
    monkeypatch.setattr(bpe, "_ABREAST", 100)
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "e", "th", "er", "zu", "ñ", "ß", "0", " "]) for _ in range(rng.randrange(1, 30))).encode()[:64] for _ in range(3000)]
    pieces = [*made, *(bytes([97]) * n for n in range(1, 65)), *(bytes(rng.randrange(256) for _ in range(n)) for n in range(1, 65))]
    data, bounds = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])
    got = {}
    for some, ids in abreast(data, bounds[:-1], np.diff(bounds)):
        got |= zip(some.tolist(), ids.tolist(), strict=True)
    assert [got[i] for i in range(len(pieces))] == [merges(p) for p in pieces]
