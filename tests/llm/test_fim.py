"""Fill-in-the-middle against a plain reading of single texts."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from costweave.llm import buffers, fim

from .conftest import row

TEXTS = ["", None, "abc", "a b", "<P>", "x<S>y", "<M", "<", "<P", "é", "éa漢ß x", "a\n\nb\x00c", "ab" * 3000 + " ç" * 900, "<S<S", "> <M> <", "𝄞𝄞", "<x>a<y>"]


def plain_cut(text, key, seed=1):
    """One text by the definition, with slices of a token list."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_all_rows(spark):
    rows = [row(i, TEXTS[i % len(TEXTS)]) for i in range(400)] + [row(None, "one two three"), row(None, None), row(3, "a b c"), row(3, "a b c")]
    from .conftest import SCHEMA

    made = fim.restore(fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA).drop("n"))).collect()
    assert len(made) == len(rows)
    for r in made:
        assert (r["n"], r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.text, r.doc_id) and r.restored == (r.text or "")
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_clashing_column_and_empty_table(spark, docs, empty):
    with pytest.raises(ValueError, match="there already"):
        fim.fill_in_middle(docs)
    got = fim.fill_in_middle(docs.select("doc_id", "text", docs.score.alias("fim_h0"), docs.key.alias("fim_key")))
    assert got.columns == ["doc_id", "text", "fim_h0", "fim_key", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.restore(fim.fill_in_middle(empty.drop("n"))).count() == 0 and {r.fim_h0 for r in got.collect()} == {0.5, None}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ <>PSM\n\x00é漢𝄞")), max_size=30), max_size=12), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.booleans())
def test_kernels_on_any_batch(texts, h1, h2, spm):
    size = len(texts)
    held = pa.array(["skipped", *texts], pa.string()).slice(1)  # a batch that begins inside its buffer
    numbers = lambda v: pa.array([v] * size, pa.int64())
    flags = lambda v: pa.array([v] * size, pa.bool_())
    made = fim.rearranged(held, numbers(h1), numbers(h2), flags(False), flags(spm))
    assert fim.rebuilt(made["output"], made["form"])["restored"].to_pylist() == texts
    for text, n, prefix, middle in zip(texts, *(made[c].to_pylist() for c in ("n", "prefix_chars", "middle_chars")), strict=True):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert n == len(units) and prefix in (None, len("".join(units[:a]))) and middle in (None, len("".join(units[a:b])))


def test_broken_outputs_give_null():
    outputs = ["<P>a<S>b", "a<S>b<M>c", "<S>a<P>b<M>c", "<P>a<M>b<S>c", None, "", "x"]
    forms = ["psm", "psm", "spm", "psm", "psm", "plain", "other"]
    assert fim.rebuilt(pa.array(outputs), pa.array(forms))["restored"].to_pylist() == [None, None, "bca", None, None, "", None]


def test_gather_over_blocks(monkeypatch):
    monkeypatch.setattr(buffers, "_BLOCK", 7)
    rng = np.random.default_rng(3)
    source = rng.integers(0, 256, 500).astype(np.uint8)
    starts, lengths = rng.integers(0, 400, 60), rng.integers(0, 40, 60) * rng.integers(0, 2, 60)
    want = b"".join(source[a : a + n].tobytes() for a, n in zip(starts, lengths, strict=True))
    assert buffers.gather(source, starts, lengths).tobytes() == want


def test_slices_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * k for k in (0, 5, 9000, 1, 300, 70000, 2)]), pa.array(range(7))], names=["t", "i"])
    parts = list(buffers.slices(batch, 4096))
    assert [i for p in parts for i in p.column(1).to_pylist()] == list(range(7)) and len(parts) == 3
    assert list(buffers.slices(batch.slice(0, 0), 4096)) == []
