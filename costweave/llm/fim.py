"""Fill-in-the-middle: texts cut at token borders and rearranged, all rows of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm.buffers import as_strings, bounds_of, bytes_of, gather, with_kernel
from costweave.llm.common import fresh

#: What stands before the three pieces of a rearranged text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Byte classes: ASCII letters, other bytes that begin a code point, and those that continue one.
_LETTER, _OTHER, _CONTINUES = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_CLASS[0x80:0xC0] = _CONTINUES


def token_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mask of the bytes that begin a token: a run of ASCII letters or any other single code point.

    A letter begins one unless the byte before it, of the same row, is a letter too.
    """
    kind = _CLASS[data]
    starts = kind != _CONTINUES
    letter = kind == _LETTER
    starts[1:] &= ~(letter[1:] & letter[:-1])
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[heads] = True
    return starts


def _marked(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that hold one of the three markers."""
    found = np.zeros(len(bounds) - 1, bool)
    if len(data) >= 3:
        at = np.flatnonzero((data[:-2] == 0x3C) & (data[2:] == 0x3E) & np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8)))
        row = np.searchsorted(bounds, at, "right") - 1
        found[row[at + 3 <= bounds[row + 1]]] = True
    return found


def _pieces(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose pieces (one line of ``at`` and ``lengths`` a row) are joined, and their bounds."""
    return gather(data, at.ravel(), lengths.ravel()), bounds_of(lengths.sum(axis=1))


def rearranged(text: pa.Array, h1: pa.Array, h2: pa.Array, plain: pa.Array, spm: pa.Array) -> dict[str, pa.Array]:
    """Kernel of :func:`fill_in_middle` over one batch."""
    data, bounds = bytes_of(text)
    h1, h2, plain, spm = (x.to_numpy(zero_copy_only=False) for x in (h1, h2, plain, spm))
    # running counts of token starts and of code points; a row's own count is the difference to its begin
    count = np.int32 if len(data) < 2**31 else np.int64
    tokens = np.cumsum(token_starts(data, bounds), dtype=count)
    chars = np.cumsum(_CLASS[data] != _CONTINUES, dtype=count)
    upto = lambda running, place: np.where(place > 0, np.append(running, 0)[place - 1], 0).astype(np.int64)
    before = upto(tokens, bounds)
    n = np.diff(before)
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    # the token with k tokens of its row before it begins where the running count first passes them
    cut = [np.where(k == n, bounds[1:], np.searchsorted(tokens, (before[:-1] + k + 1).astype(count))) for k in (low, high)]
    begin, end = bounds[:-1], bounds[1:]
    plain = plain | (n == 0) | _marked(data, bounds)
    spm = spm & ~plain
    marks = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
    size = len(data)
    p, s, m = (np.full(len(n), size + 3 * k) for k in range(3))
    three = np.full(len(n), 3)
    parts = {"prefix": (begin, cut[0] - begin), "middle": (cut[0], cut[1] - cut[0]), "suffix": (cut[1], end - cut[1])}
    # psm: marker, prefix, marker, suffix, marker, middle; spm has the first two pairs exchanged; plain is one piece
    first = np.where(spm, 1, 0)
    choose = lambda a, b: np.where(first == 1, b, a)
    at = [choose(p, s), choose(parts["prefix"][0], parts["suffix"][0]), choose(s, p), choose(parts["suffix"][0], parts["prefix"][0]), m, parts["middle"][0]]
    lengths = [three, choose(parts["prefix"][1], parts["suffix"][1]), three, choose(parts["suffix"][1], parts["prefix"][1]), three, parts["middle"][1]]
    for k in range(6):
        at[k] = np.where(plain, begin, at[k])
        lengths[k] = np.where(plain, end - begin if k == 0 else 0, lengths[k])
    out, out_bounds = _pieces(np.concatenate([data, marks]), np.stack(at, 1), np.stack(lengths, 1))
    span = lambda a, b: pa.array(upto(chars, b) - upto(chars, a), pa.int64(), mask=plain)
    return {
        "n": pa.array(n, pa.int64()),
        "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
        "prefix_chars": span(begin, cut[0]),
        "middle_chars": span(cut[0], cut[1]),
        "output": as_strings(out, out_bounds, pa.string()),
    }


def rebuilt(output: pa.Array, form: pa.Array) -> dict[str, pa.Array]:
    """Kernel of :func:`restore` over one batch: pieces found again by the first marker of each kind."""
    data, bounds = bytes_of(output)
    kinds = form.to_numpy(zero_copy_only=False)
    plain, spm = kinds == "plain", kinds == "spm"
    begin, end = bounds[:-1], bounds[1:]
    at = np.flatnonzero((data[:-2] == 0x3C) & (data[2:] == 0x3E)) if len(data) >= 3 else np.zeros(0, np.int64)

    def first(letter: str) -> np.ndarray:
        """Place of the first such marker of each row, its end where there is none."""
        own = at[data[at + 1] == ord(letter)]
        k = np.searchsorted(own, begin)
        place = np.append(own, len(data))[k]
        return np.where(place + 3 <= end, place, end)

    p, s, m = first("P"), first("S"), first("M")
    second = np.where(spm, p, s)
    opened = begin + 3
    # prefix, middle, suffix in their order; psm holds the prefix first, spm the suffix
    piece_1, piece_2, piece_3 = (opened, second - opened), (second + 3, m - second - 3), (m + 3, end - m - 3)
    lengths = [np.where(spm, piece_2[1], piece_1[1]), piece_3[1], np.where(spm, piece_1[1], piece_2[1])]
    starts = [np.where(spm, piece_2[0], piece_1[0]), piece_3[0], np.where(spm, piece_1[0], piece_2[0])]
    known = plain | (((kinds == "psm") | spm) & (np.where(spm, s, p) == begin) & (np.minimum.reduce(lengths) >= 0))
    for k in range(3):
        starts[k] = np.where(plain, begin, starts[k])
        lengths[k] = np.where(plain, end - begin if k == 0 else 0, np.where(known, lengths[k], 0))
    text, text_bounds = _pieces(data, np.stack(starts, 1), np.stack(lengths, 1))
    return {"restored": as_strings(text, text_bounds, pa.string(), known)}


def fill_in_middle(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", plain_share: int = 10, spm_share: int = 20, seed: int = 1) -> DataFrame:
    """Texts as prefix, suffix and middle behind their markers, to learn filling gaps.

    Adds ``n`` (tokens: runs of ASCII letters, any other code point alone), ``form``, ``prefix_chars`` and
    ``middle_chars`` (code points, null if plain) and ``output``. All chance comes from the SHA-256 of
    ``seed:id``, whose first four groups of 32 bits give both cuts, whether the text stays plain
    (``plain_share`` percent) and whether the suffix goes first (``spm_share`` percent of the rest),
    so reruns agree and rows of one id are cut alike. Texts that hold a marker, and empty ones, stay plain.

    A null text counts as empty, a null id as the empty string; repeated rows stay; other columns pass
    through, and where one has the name of an added column a ValueError says so. No shuffle: every text is handled where it is read.
    """
    key = fresh(df, "fim_key")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(F.col(key), 8 * k + 1, 8), 16, 10).cast("long")
    h = [fresh(df, f"fim_h{k}") for k in range(4)]
    drawn = df.withColumn(key, digest).select(
        *(F.col(f"`{c}`") for c in df.columns), group(0).alias(h[0]), group(1).alias(h[1]),
        (group(2) % 100 >= 100 - plain_share).alias(h[2]), (group(3) % 100 < spm_share).alias(h[3]),
    )
    added = "n long, form string, prefix_chars long, middle_chars long, output string"
    return with_kernel(drawn, [text_col, *h], lambda: rearranged, added).drop(*h)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Adds ``restored``, the text that an output and its form came from.

    No text with a marker is rearranged and no marker can arise at a border, so the first of
    each kind is the one set. A null output counts as empty; a form that is not known, or an output
    without its markers, gives null. Other columns pass through.
    """
    return with_kernel(df, [output_col, form_col], lambda: rebuilt, "restored string")

