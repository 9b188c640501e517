"""Language ID of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm.common import arrow_rows, dropped, fold, fresh, staged, with_columns_from

_RUN = re.compile(r"[^\W\d_]+")
_WIDTH = 24
_BUCKETS = 1 << 15
_BLOCK = 64
UNDETERMINED = "und"
_RESULT = "lang_pred string, score double, languages array<struct<lang:string,words:long,mean:double>>"


@dataclass
class Model:
    """Languages, lexicon (word to the numbers of the languages it marks), feature weights and transitions."""

    languages: list[str]
    lexicon: dict[str, tuple[int, ...]]
    weights: np.ndarray  # (_BUCKETS + languages) by languages; the last rows are the lexicon's
    start: np.ndarray
    moves: np.ndarray


def _words(text: str | None) -> list[str]:
    """Runs of letters, in lower case; signs that only count (superscripts, fractions) are no letters."""
    found = _RUN.findall((text or "").lower())
    if not found or "".join(found).isalpha():
        return found
    return [part for w in found for part in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else [w])]


def _mixed(kind: int, *columns: np.ndarray) -> np.ndarray:
    """Hashed feature rows of a kind of feature and its characters."""
    mul = np.uint64(0x9E3779B97F4A7C15)
    h = np.full(columns[0].shape, kind + 1, np.uint64)
    for c in columns:
        h = (h ^ c) * mul
        h ^= h >> np.uint64(29)
    return (h % np.uint64(_BUCKETS)).astype(np.int32)


def _of_one_width(words: list[str], width: int, lexicon: dict[str, tuple[int, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from xxhash import xxh64_intdigest

    n = len(words)
    plain = np.array(words, f"U{width}").view(np.uint32).reshape(n, width)
    size = (plain > 0).sum(axis=1)
    chars, at = np.zeros((n, width + 2), np.uint64), np.arange(n)
    chars[:, 1:-1] = plain
    chars[:, 0] = 2
    chars[at, size + 1] = 3
    rows = [_mixed(0, np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, n))]
    for m in (1, 2, 3):
        rows.append(_mixed(m, *(chars[:, min(1 + i, width + 1)] for i in range(m))))
    for m in (1, 2, 3, 4):
        rows.append(_mixed(10 + m, *(chars[at, np.maximum(size - i, 0)] for i in range(m))))
    grams = _mixed(20, chars[:, :-2], chars[:, 1:-1], chars[:, 2:])
    marks = np.zeros((n, k), bool)
    for i, w in enumerate(words):
        for j in lexicon.get(w, ()):
            marks[i, j] = True
    index = np.concatenate([np.stack(rows, axis=1), grams, np.broadcast_to(_BUCKETS + np.arange(k, dtype=np.int32), (n, k))], axis=1)
    inside = np.concatenate([np.ones((n, len(rows)), bool), np.arange(width) < size[:, None], marks], axis=1)
    strength = np.ones(index.shape, np.float32)
    strength[:, len(rows) : len(rows) + width] = (2.0 / np.maximum(size, 1))[:, None]
    return index[inside], strength[inside], inside.sum(axis=1)


def _places(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the features of the words ``rows``, where word i has those from ``first[i]`` to ``first[i + 1]``."""
    counts = first[rows + 1] - first[rows]
    return np.repeat(first[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def word_features(words: list[str], lexicon: dict[str, tuple[int, ...]], n_languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows and their strengths, word after word, and where each word's begin (one place more than words).

    The word, its first 1 to 3 and last 1 to 4 characters, and all its character trigrams with word
    ends, hashed; trigrams share a strength of 2. One row for each language whose lexicon has the
    word. Words of any length are read whole; those over 24 characters are taken one by one.
    """
    short = [i for i, w in enumerate(words) if len(w) <= _WIDTH]
    long = [i for i, w in enumerate(words) if len(w) > _WIDTH]
    parts = [_of_one_width([words[i] for i in short], _WIDTH, lexicon, n_languages)] if short else []
    parts += [_of_one_width([words[i]], len(words[i]), lexicon, n_languages) for i in long]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64)
    index, strength, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
    if long:
        place = np.argsort(np.array(short + long))
        first = np.concatenate([[0], np.cumsum(counts)])
        at = _places(first, place)
        index, strength, counts = index[at], strength[at], counts[place]
    return index, strength, np.concatenate([[0], np.cumsum(counts)])


def _emissions(words: list[str], model: Model) -> np.ndarray:
    k = len(model.languages)
    out, columns = np.zeros((len(words), max(1, k)), np.float32), np.ascontiguousarray(model.weights.T)
    for at in range(0, len(words), 8192):
        index, strength, first = word_features(words[at : at + 8192], model.lexicon, k)
        for j in range(k):
            out[at : at + 8192, j] = np.add.reduceat(columns[j][index] * strength, first[:-1])
    return out


def _sweeps(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward and backward messages and potentials at every word, and the moves' potentials.

    ``scores`` holds the sequences one after the other. Each is cut into blocks of 64 words that
    advance together: a first sweep multiplies every block's transfer matrix, those chain the
    blocks of a sequence, and two more sweeps fill in the words. That is exact for any length.
    """
    k = scores.shape[1]
    blocks = -(-lengths // _BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(lengths)), blocks)
    offset = np.concatenate([[0], np.cumsum(lengths)])
    nth = np.arange(first[-1]) - first[owner]
    begin = offset[owner] + nth * _BLOCK
    places = np.minimum(begin[:, None] + np.arange(_BLOCK), len(scores) - 1)
    valid = np.arange(_BLOCK) < (offset[owner + 1] - begin)[:, None]
    emit = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), 1e-30).astype(np.float64)[places]
    m, opening = np.exp(moves - moves.max()), np.exp(start - start.max())
    first_block = (nth == 0)[:, None]

    transfer = np.where(first_block[:, :, None], opening, m) * emit[:, 0, None, :]
    for t in range(1, _BLOCK):
        step = (transfer @ m) * emit[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        transfer = np.where(valid[:, t, None, None], step, transfer)
    enter, leave = np.full((len(begin), k), 1 / k), np.ones((len(begin), k))
    most = int(blocks.max(initial=0))
    for i in range(1, most):
        now = np.flatnonzero(nth == i)
        v = np.einsum("bi,bij->bj", enter[now - 1], transfer[now - 1])
        enter[now] = v / v.sum(axis=1, keepdims=True)
    more = nth + 1 < blocks[owner]
    for i in range(most - 2, -1, -1):
        now = np.flatnonzero((nth == i) & more)
        v = np.einsum("bij,bj->bi", transfer[now + 1], leave[now + 1])
        leave[now] = v / v.sum(axis=1, keepdims=True)

    forward, backward = np.empty(emit.shape), np.empty(emit.shape)
    state = enter
    for t in range(_BLOCK):
        moved = np.where(first_block, opening, state @ m) if t == 0 else state @ m
        moved = moved * emit[:, t]
        state = np.where(valid[:, t, None], moved / moved.sum(axis=1, keepdims=True), state)
        forward[:, t] = state
    state = leave
    for t in range(_BLOCK - 1, -1, -1):
        backward[:, t] = state
        moved = (state * emit[:, t]) @ m.T
        state = np.where(valid[:, t, None], moved / moved.sum(axis=1, keepdims=True), state)
    return forward[valid], backward[valid], emit[valid], m


def marginals(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior of every label at every word; (words, labels)."""
    if not len(scores):
        return np.zeros(scores.shape)
    forward, backward, _, _ = _sweeps(scores, lengths, start, moves)
    both = forward * backward
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300)


def lexicon(df: DataFrame, min_share: float = 0.8, min_count: int = 5, min_rate: float = 2e-6) -> tuple[list[str], dict[str, tuple[int, ...]]]:
    """Languages of ``df`` (``text``, ``lang``), all of them, and the words that mark each one.

    Every word of every row is counted. A word marks a language that has ``min_share`` of its
    uses, where these are ``min_count`` and ``min_rate`` of the language's words at least. So a
    language has at most 1 / ``min_rate`` such words however large the table is; they come to the driver.
    """
    languages = [r.lang for r in df.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]

    def make():
        def handle(texts, langs):
            counts: dict[str, Counter] = {}
            for text, lang in zip(texts, langs, strict=True):
                counts.setdefault(lang, Counter()).update(_words(text))
            rows = [(w, lang, n) for lang, c in counts.items() for w, n in c.items()]
            return dict(zip(("word", "lang", "n"), zip(*rows, strict=True), strict=True)) if rows else {"word": [], "lang": [], "n": []}

        return handle

    counts = arrow_rows(df, ["text", "lang"], make, "word string, lang string, n long")
    uses = staged(counts.groupBy("word", "lang").agg(F.sum("n").alias("n")), "word-uses")
    words_of = {r.lang: r.n for r in uses.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    by_word = uses.groupBy("word").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("uses")).where(F.col("total") >= min_count)
    marks = by_word.select("word", "total", F.inline("uses")).where(F.col("n") >= min_share * F.col("total"))
    number = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, tuple[int, ...]] = {}
    for r in marks.where(F.col("n") >= min_rate * min(words_of.values(), default=0)).select("word", "lang", "n").toLocalIterator():
        if r.n >= max(min_count * min_share, min_rate * words_of[r.lang]):
            words[r.word] = (*words.get(r.word, ()), number[r.lang])
    dropped(uses)
    return languages, words


def _training_blocks(rows: DataFrame, counts: dict[str, int], docs_per_language: int, blocks_per_doc: int) -> list:
    """(lang, hash of the text, number, words) of blocks of 64 words drawn by hashes from the whole texts, in a fixed order.

    ``rows`` has ``text, lang, key`` and ``counts`` the number of distinct keys of each language. A text that repeats is
    brought to one row by Spark before its words go anywhere; the keys that repeat in the sample, no more than it has texts, are broadcast.
    """
    cuts = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 53, (docs_per_language << 53) // n))))
    picked = rows.where(F.pmod("key", F.lit(1 << 53)) < cuts[F.col("lang")])
    repeated = [r[0] for r in picked.groupBy("key").count().where("count > 1").select("key").collect()]
    if repeated:
        again = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in sorted(repeated)], "key long"))
        picked = picked.join(again, "key", "left_anti").unionByName(picked.join(again, "key", "left_semi").dropDuplicates(["key"]))

    def make():
        from xxhash import xxh32_intdigest

        def handle(texts, langs, keys):
            out = {"lang": [], "key": [], "block": [], "words": []}
            for text, lang, key in zip(texts, langs, keys, strict=True):
                found = _words(text)
                n = -(-len(found) // _BLOCK)
                for b in range(n):
                    if n <= blocks_per_doc or xxh32_intdigest(f"{key} {b}") < (blocks_per_doc << 32) // n:
                        for name, v in zip(out, (lang, key, b, found[_BLOCK * b : _BLOCK * (b + 1)]), strict=True):
                            out[name].append(v)
            return out

        return handle

    got = arrow_rows(picked, ["text", "lang", "key"], make, "lang string, key long, block long, words array<string>")
    return sorted({(r.lang, r.key, r.block): r.words for r in got.toLocalIterator()}.items())


def train(df: DataFrame, id_col: str = "doc_id", docs_per_language: int = 400, blocks_per_doc: int = 16, epochs: int = 3, seed: int = 7) -> Model:
    """Fit on rows with ``text`` and a non-null ``lang`` outside fold 0.

    The lexicon counts all of them. The weights learn from about ``docs_per_language`` texts of each
    language, chosen by a hash (a text that repeats counts once, under one id or many), and from about
    ``blocks_per_doc`` sequences of 64 words of each, drawn by hash from the whole text; in a
    third of the sequences the tail is replaced by words of another language, which is where
    the transitions learn to switch. The likelihood gradient comes from forward-backward; steps
    follow AdaGrad. Languages may have any names; they are told apart by their exact strings.
    """
    rows = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold(F.col(id_col)) != 0)
    rows = rows.select("text", "lang", F.xxhash64(F.lit("crf"), "lang", "text").alias("key"))
    languages, words = lexicon(rows.select("text", "lang"))
    k = len(languages)
    rng = np.random.default_rng(seed)
    model = Model(languages, words, np.zeros((_BUCKETS + k, max(k, 1)), np.float32), np.zeros(max(k, 1)), np.full((max(k, 1), max(k, 1)), -2.0))
    np.fill_diagonal(model.moves, 0.0)
    if k < 2:
        return model
    counts = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.01).alias("n")).collect()}
    blocks = _training_blocks(rows, counts, docs_per_language, blocks_per_doc)
    number = {lang: i for i, lang in enumerate(languages)}
    sequences = [found for _, found in blocks]
    labels = [np.full(len(found), number[lang]) for (lang, _, _), found in blocks]
    order = rng.permutation(len(sequences))
    for i in order[: len(order) // 3]:
        j = int(rng.integers(len(sequences)))
        cut = int(rng.integers(0, len(sequences[i]) + 1))
        tail = sequences[j][cut:] if j != i else sequences[i][cut:]
        sequences[i] = sequences[i][:cut] + tail
        labels[i] = np.concatenate([labels[i][:cut], labels[j][cut : cut + len(tail)]])
    vocabulary = list(dict.fromkeys(w for s in sequences for w in s))
    number_of = {w: i for i, w in enumerate(vocabulary)}
    parts = [word_features(vocabulary[a : a + 8192], words, k) for a in range(0, len(vocabulary), 8192)]
    if not parts:
        return model
    index, strength, sizes = (np.concatenate(x) for x in zip(*((i, s, np.diff(first)) for i, s, first in parts), strict=True))
    first = np.concatenate([[0], np.cumsum(sizes)])
    sum_w, sum_s, sum_m = np.full(model.weights.shape, 1e-2, np.float32), np.full(k, 1e-2), np.full((k, k), 1e-2)
    sequences = [np.array([number_of[w] for w in s], np.int64) for s in sequences]
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), 256):
            batch = [i for i in order[at : at + 256] if len(sequences[i])]
            gold = np.concatenate([labels[i] for i in batch])
            lengths = np.array([len(sequences[i]) for i in batch])
            uniq, back = np.unique(np.concatenate([sequences[i] for i in batch]), return_inverse=True)
            places, own = _places(first, uniq), sizes[uniq]
            ix, st, heads = index[places], strength[places], np.cumsum(own) - own
            emit = np.stack([np.add.reduceat(model.weights[:, j][ix] * st, heads) for j in range(k)], axis=1)[back]
            forward, backward, potentials, m = _sweeps(emit, lengths, model.start, model.moves)
            post = forward * backward
            post /= post.sum(axis=1, keepdims=True)
            error, scale = np.eye(k)[gold] - post, 1.0 / len(batch)
            for j in range(k):
                by_word = np.bincount(back, error[:, j], len(uniq))
                g = np.bincount(ix, st * np.repeat(by_word, own), len(model.weights)).astype(np.float32) * scale
                sum_w[:, j] += g * g
                model.weights[:, j] += 0.2 * g / np.sqrt(sum_w[:, j])
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            here = np.setdiff1d(np.arange(len(gold)), np.cumsum(lengths) - 1)
            pairs = forward[here][:, :, None] * m * (potentials * backward)[here + 1][:, None, :]
            g = -(pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(g, (gold[here], gold[here + 1]), 1.0)
            sum_m += (g * scale) ** 2
            model.moves += 0.1 * g * scale / np.sqrt(sum_m)
            g = error[begins].sum(axis=0) * scale
            sum_s += g * g
            model.start += 0.1 * g / np.sqrt(sum_s)
    return model


def _labeller(shared):
    """A task's function from texts to lists of predicted language, score, languages in the mix and confidence."""
    m = Model(**shared.value)
    k = max(1, len(m.languages))
    cache: dict[str, int] = {}
    table = np.zeros((0, k), np.float32)

    def emissions(words: list[list[str]]) -> np.ndarray:
        nonlocal table
        if len(cache) * k > 1_200_000:
            cache.clear()
            table = table[:0]
        fresh = list(dict.fromkeys(w for ws in words for w in ws if w not in cache))
        cache.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
        table = np.concatenate([table, _emissions(fresh, m)])
        return table[np.fromiter((cache[w] for ws in words for w in ws), np.int64)]

    def summary(p: np.ndarray) -> tuple[str, float, list[dict], float]:
        if not len(p) or not m.languages:
            return UNDETERMINED, 0.0, [], 0.0
        mean, best = p.mean(axis=0), p.argmax(axis=1)
        top = int(mean.argmax())
        mixed = [{"lang": m.languages[j], "words": int((best == j).sum()), "mean": float(mean[j])} for j in np.unique(best)]
        return m.languages[top], float(min(1.0, mean[top])), mixed, float(p.max(axis=1).mean())

    def label(texts):
        rows, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append(_words(text))
            size += len(held[-1])
            if size > 60_000 or i == len(texts) - 1:
                lengths = np.array([len(w) for w in held])
                post = marginals(emissions(held), lengths, m.start, m.moves)
                rows += [summary(p) for p in np.split(post, np.cumsum(lengths)[:-1])]
                held, size = [], 0
        return {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "languages": [r[2] for r in rows], "confidence": [r[3] for r in rows]}

    return label


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` and ``languages`` of every whole text.

    ``languages`` holds, for each language that some word most likely has, its number of words and
    mean posterior; ``lang_pred`` has the largest sum of posteriors over all words and
    ``score`` is its mean. A null text, or one without letters, is ``und`` with score 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        label = _labeller(shared)
        return lambda ids, texts: {"doc_id": ids} | label(texts)

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_rows(source, ["doc_id", "text"], make, f"doc_id long, {_RESULT}")


def keep_known(df: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """The rows of ``df`` whose text has letters and whose words are labelled with ``min_score`` or more.

    That is the mean over words of the highest posterior at each word, so a text that mixes
    languages stays, however many they are, where its words are sure. A model without languages rejects only texts without letters.
    """
    shared, learned = df.sparkSession.sparkContext.broadcast(vars(model)), bool(model.languages)

    def make():
        label = _labeller(shared)

        def handle(texts):
            got = label(texts)
            known = [c > 0 and c >= min_score for c in got["confidence"]] if learned else [bool(_words(t)) for t in texts]
            return {added: known}

        return handle

    added = fresh(df, "known")
    return with_columns_from(df, [text_col], make, f"{added} boolean").where(added).drop(added)
