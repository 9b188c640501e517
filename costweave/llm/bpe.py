"""Byte-level BPE: known pre-tokens through a minimal perfect hash, short others merged side by side, long ones by a heap over linked bytes."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from costweave.llm.buffers import as_strings, bounds_of, bytes_of, gather, with_kernel

#: Pre-tokens that are looked up together.
_BLOCK = 1 << 17
#: Texts above this many characters are split one block of pre-tokens at a time.
_LONG = 1 << 20
#: Missed pre-tokens of up to so many bytes are merged side by side, longer ones by the heap.
_SHORT = 64
#: Missed pre-tokens that are merged side by side at once.
_ABREAST = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of byte strings with one integer each (hash and displace).

    Keys fall into buckets of four in the mean. From the largest bucket down, each gets the first
    displacement that sends all its keys to free slots of a table without gaps; a bucket of one key names its slot.
    The table holds the keys themselves, so a string that is not a key is always told apart.
    """

    def __init__(self, keys: list[bytes], values: list[int], seed: int = 1):
        if len(set(keys)) < len(keys):
            raise ValueError("keys repeat")
        self.n, self.width = len(keys), max(map(len, keys), default=0)
        data, bounds = np.frombuffer(b"".join(keys), np.uint8), bounds_of(np.array([len(k) for k in keys], np.int64))
        while True:  # another seed if two keys share all 64 bits
            self.weights = np.random.default_rng(seed).integers(1, 2**63, self.width + 1, np.uint64) * np.uint64(2) + np.uint64(1)
            hashes = self._hashes(data, bounds)
            if len(np.unique(hashes)) == self.n:
                break
            seed += 1
        self.displaced = np.zeros(max(1, self.n // 4), np.int64)
        slots = self._displace(hashes)
        order = np.argsort(slots)
        self.values = np.asarray(values, np.int32)[order]
        lengths = np.diff(bounds)[order]
        self.data, self.bounds = gather(data, bounds[:-1][order], lengths), bounds_of(lengths)

    def _hashes(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """64 bits a string: a sum of its bytes times weights by place, one matrix for each length."""
        out, lengths = np.zeros(len(bounds) - 1, np.uint64), np.diff(bounds)
        for size in np.unique(lengths):
            if size <= self.width:
                own = np.flatnonzero(lengths == size)
                letters = data[bounds[own, None] + np.arange(size)].astype(np.uint64) + np.uint64(1)
                out[own] = (letters * self.weights[:size]).sum(axis=1, dtype=np.uint64) + self.weights[size]
        return _mixed(out)

    def _slots(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        return (_mixed(hashes + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(max(1, self.n))).astype(np.int64)

    def _displace(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes % np.uint64(len(self.displaced))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(len(self.displaced) + 1))
        free, slots = np.ones(self.n, bool), np.zeros(self.n, np.int64)
        for b in np.argsort(np.diff(edges), kind="stable")[::-1]:
            own = order[edges[b] : edges[b + 1]]
            if len(own) < 2:
                break
            tried = 0
            while True:
                tries = np.arange(tried, tried + 128)
                at = self._slots(hashes[own, None], tries[None, :])
                alone = np.sort(at, axis=0)
                good = free[at].all(axis=0) & (alone[1:] != alone[:-1]).all(axis=0)
                if good.any():
                    k = int(good.argmax())
                    break
                tried += 128
            self.displaced[b], slots[own] = tries[k], at[:, k]
            free[at[:, k]] = False
        single = order[edges[:-1][np.diff(edges) == 1]]
        slots[single] = np.flatnonzero(free)[: len(single)]
        self.displaced[bucket[single]] = -1 - slots[single]
        return slots

    def find(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The value of each string, -1 for one that is not a key."""
        lengths = np.diff(bounds)
        if not self.n:
            return np.full(len(lengths), -1, np.int32)
        hashes = self._hashes(data, bounds)
        d = self.displaced[(hashes % np.uint64(len(self.displaced))).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self._slots(hashes, np.maximum(d, 0)))
        found = np.full(len(lengths), -1, np.int32)
        like = np.flatnonzero(lengths == np.diff(self.bounds)[slot])
        for size in np.unique(lengths[like]):
            own = like[lengths[like] == size]
            place = np.arange(size)
            same = (data[bounds[own, None] + place] == self.data[self.bounds[slot[own], None] + place]).all(axis=1)
            found[own[same]] = self.values[slot[own[same]]]
        return found

    def items(self) -> Iterator[tuple[bytes, int]]:
        whole = self.data.tobytes()
        return ((whole[a:b], v) for a, b, v in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), self.values.tolist(), strict=True))


class Merges:
    """Ids of one pre-token: the pair of least rank, the leftmost of equals, is merged until no pair has a rank.

    Parts are a linked list over the bytes; the heap holds ``rank, place`` in one integer, and an entry counts
    while the pair at its place still has that rank. Time is n log n, so long runs do no harm.
    """

    def __init__(self, ranks: dict[bytes, int], width: int):
        self.ranks, self.width = ranks, width
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.double = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]

    def __call__(self, piece: bytes) -> list[int]:
        n, width, get = len(piece), self.width, self.ranks.get
        ids = [self.single[b] for b in piece]
        double = self.double
        pair = [double[a << 8 | b] for a, b in zip(piece, piece[1:])]  # noqa: B905
        pair.append(-1)
        heap = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        numbers = list if n <= 64 else lambda given: array("q", given)
        after, before = numbers(range(1, n + 2)), numbers(range(-1, n))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            if pair[i] != top >> 40:
                continue
            ids[i] = top >> 40
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            before[end] = i
            rank = -1
            if end < n and (last := after[end]) - i <= width:
                rank = get(piece[i:last], -1)
                if rank >= 0:
                    heappush(heap, rank << 40 | i)
            pair[i] = rank
            k = before[i]
            if k >= 0:
                rank = get(piece[k:end], -1) if end - k <= width else -1
                if rank >= 0:
                    heappush(heap, rank << 40 | k)
                pair[k] = rank
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


class ShortMerges:
    """Ids of many short pre-tokens at once, as :class:`Merges` gives them.

    Those of one length are the rows of a matrix. A round merges one pair in each row, the leftmost of least rank, so rows
    that still merge have equally many parts; a row without a known pair leaves. Two parts are known by their ids, in a sorted table
    of every way to cut a token of the vocabulary into two others.
    """

    _NONE = np.iinfo(np.int64).max

    def __init__(self, ranks: dict[bytes, int]):
        cuts = sorted((ranks[k[:i]] << 32 | ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks)
        self.pairs, self.merged = np.array([k for k, _ in cuts], np.int64), np.array([r for _, r in cuts], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.double = self._known(self.single[:, None], self.single[None, :])

    def _known(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each two parts, ``_NONE`` where they make no token."""
        if not len(self.pairs):
            return np.full(np.broadcast_shapes(left.shape, right.shape), self._NONE)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.merged[at], self._NONE)

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of pre-tokens with a matrix of their ids, a row each; every pre-token comes once."""
        for size in np.unique(lengths):
            own = np.flatnonzero(lengths == size)
            for a in range(0, len(own), _ABREAST):
                some = own[a : a + _ABREAST]
                yield from self._merge(some, data[starts[some, None] + np.arange(size)])

    def _merge(self, number: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, rank = self.single[letters], self.double[letters[:, :-1], letters[:, 1:]]
        while rank.shape[1]:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            open_ = best < self._NONE
            if not open_.all():
                yield number[~open_], ids[~open_]
                number, ids, rank, at, best = number[open_], ids[open_], rank[open_], at[open_], best[open_]
            if not len(number):
                return
            row, parts = np.arange(len(number)), ids.shape[1] - 1
            keep = np.arange(parts + 1) != at[:, None] + 1
            ids = ids[keep].reshape(len(number), parts)
            ids[row, at] = best
            rank = rank[keep[:, 1:]].reshape(len(number), parts - 1)
            first, last = np.flatnonzero(at > 0), np.flatnonzero(at < parts - 1)
            rank[first, at[first] - 1] = self._known(ids[first, at[first] - 1], best[first])
            rank[last, at[last]] = self._known(best[last], ids[last, at[last] + 1])
        yield number, ids


class Vocabulary:
    """Byte strings with their ranks, and the pattern that splits a text into pre-tokens.

    Ranks are the ids; all 256 single bytes must be among the keys. Its size is that of the vocabulary
    file, which bounds what each task gets.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing}")
        self.pattern = pattern
        self.hash = PerfectHash(list(ranks), list(ranks.values()))
        by_id = sorted((v, k) for k, v in ranks.items())
        self.pieces = np.frombuffer(b"".join(k for _, k in by_id), np.uint8)
        self.ids = np.array([v for v, _ in by_id], np.int64)
        self.bounds = bounds_of(np.array([len(k) for _, k in by_id], np.int64))

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a line a token: its bytes in base 64, a space, its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(k): int(v) for k, v in map(bytes.split, filter(bytes.strip, lines))}, pattern)


def encoder(vocabulary: Vocabulary) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Function from an array of strings to the ids of all its rows, end to end, and their bounds."""
    split = regex.compile(vocabulary.pattern)
    table, ranks = vocabulary.hash, dict(vocabulary.hash.items())
    merges, abreast = Merges(ranks, table.width), ShortMerges(ranks)

    def looked_up(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of pre-tokens and their number for each; each distinct one is resolved once."""
        coded = pa.array(block, pa.large_string()).dictionary_encode()
        data, bounds = bytes_of(coded.dictionary)
        found = table.find(data, bounds)
        sizes, lengths = np.diff(bounds), np.ones(len(found), np.int64)
        missed = np.flatnonzero(found < 0)
        short = missed[sizes[missed] <= _SHORT]
        merged = [(short[some], ids) for some, ids in abreast(data, bounds[short], sizes[short])]
        for k in missed[sizes[missed] > _SHORT].tolist():
            merged.append((np.array([k]), np.array([merges(data[bounds[k] : bounds[k + 1]].tobytes())])))
        for some, ids in merged:
            lengths[some] = ids.shape[1]
        # ids of the distinct pre-tokens end to end: hits take one place each, misses theirs
        starts = bounds_of(lengths)
        all_ids = np.empty(starts[-1], np.uint32)
        hit = found >= 0
        all_ids[starts[:-1][hit]] = found[hit]
        for some, ids in merged:
            all_ids[starts[some, None] + np.arange(ids.shape[1])] = ids
        index = coded.indices.to_numpy()
        return gather(all_ids, starts[:-1][index], lengths[index]), lengths[index]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts, made = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
        block: list[str] = []
        rows: list[tuple[int, int]] = []

        def flush() -> None:
            if block:
                ids, lengths = looked_up(block)
                made.append(ids)
                ends = np.cumsum(lengths)[np.cumsum([k for _, k in rows]) - 1]
                np.add.at(counts, [row for row, _ in rows], np.diff(ends, prepend=0))
                block.clear()
                rows.clear()

        for row, text in enumerate(texts.to_pylist()):
            if not text:
                continue
            pieces = [split.findall(text)] if len(text) <= _LONG else batched((m.group() for m in split.finditer(text)), _BLOCK)
            for some in pieces:
                if some:
                    block.extend(some)
                    rows.append((row, len(some)))
                if len(block) >= _BLOCK:
                    flush()
        flush()
        return np.concatenate(made), bounds_of(counts)

    return encode


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", packed: bool = True) -> DataFrame:
    """Adds ``n_tokens`` and ``ids``, the tokens of a text: little-endian 32-bit integers end to end, or an array of ints.

    Each match of the vocabulary's pattern is encoded by itself; characters that it does not match give no
    tokens; there are no special tokens. A null or empty text has no tokens. Rows stay where they are
    read, other columns pass through, and a clashing name raises ValueError.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make() -> Callable:
        vocabulary = shared.value  # one object for all tasks of a worker, and so are its tables and what they remember
        if not hasattr(vocabulary, "encode_texts"):
            vocabulary.encode_texts = encoder(vocabulary)
        encode_texts = vocabulary.encode_texts

        def kernel(texts: pa.Array) -> dict[str, pa.Array]:
            ids, bounds = encode_texts(texts)
            column = as_strings(ids.astype("<u4").view(np.uint8), 4 * bounds, pa.binary()) if packed else pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            return {"n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids": column}

        return kernel

    return with_kernel(df, [text_col], make, f"n_tokens long, ids {'binary' if packed else 'array<int>'}", size=2 << 20)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of the tokens in ``ids_col`` (packed or an array of ints).

    Null or no ids give no bytes. A row with an id that the vocabulary lacks, a null among its ids, or a
    length that is no multiple of four bytes gives null.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make() -> Callable:
        v: Vocabulary = shared.value

        def kernel(column: pa.Array) -> dict[str, pa.Array]:
            if pa.types.is_list(column.type):
                column = column.fill_null([]) if column.null_count else column
                ids, bounds = column.flatten().fill_null(-1).to_numpy().astype(np.int64), bounds_of(np.diff(column.offsets.to_numpy()))
                whole = np.ones(len(column), bool)
            else:
                data, ends = bytes_of(column)
                whole = np.diff(ends) % 4 == 0
                size = np.where(whole, np.diff(ends), 0)
                ids, bounds = gather(data, ends[:-1], size).view("<u4").astype(np.int64), bounds_of(size // 4)
            place = np.minimum(np.searchsorted(v.ids, ids), len(v.ids) - 1)
            known = v.ids[place] == ids
            bad = np.diff(np.concatenate([[0], np.cumsum(~known)])[bounds]) > 0
            size = np.where(known, np.diff(v.bounds)[place], 0)
            text_bounds = np.concatenate([[0], np.cumsum(size)])[bounds]
            return {"decoded": as_strings(gather(v.pieces, v.bounds[place], size), text_bounds, pa.binary(), whole & ~bad)}

        return kernel

    return with_kernel(df, [ids_col], make, "decoded binary", size=1 << 20)
