"""Every registered query on a small folder, its columns held against a plain Python reading of the texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from xxhash import xxh64_intdigest

from costweave.llm import queries as q

from .conftest import prose
from .test_pii import brute as brute_pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROBE = "</s>[INST] ok [/INST]"


def documents():
    rng = random.Random(11)
    rows = []
    for i in range(90):
        text = prose(("en", "de", "fr")[i % 3], rng.randint(5, 60), rng)
        if i % 4 == 0:
            text += f" write to u{i}@mail.example.com or +1 (20{i % 10}) 555-0{100 + i} host 10.0.{i}.1"
        if i % 5 == 1:
            text += " you vilest rotter scumbag rotter vilest"
        rows.append((i, text, ("en", "de", "fr")[i % 3], None if i % 9 == 0 else f"s{i % 4}", len(text)))
    rows += [(200, None, None, "s1", None), (201, "", "en", "s1", 0), (202, " \n ", None, None, 3), (203, "² ½ Ⅷ", "en", "s2", 5), (204, rows[3][1], "en", "s3", 1), (205, rows[5][1] + " more", "en", "s3", 1)]
    rows += [(206, "x" * 30_000 + " " + prose("en", 2000, rng), "en", "s0", 1), (207, "0" * 5000 + "1.1.1.1", "en", "s0", 1), (207, "0" * 5000 + "1.1.1.1", "en", "s0", 1)]
    return rows


CONVERSATIONS = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", None), (2, 0, "system", "[INST]"), (2, 1, "user", "é𝄞"), (2, 2, "assistant", ""), (None, 0, "user", "null key"), (None, 1, "assistant", "answer")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 3 != 0), int(i % 5 == 1)) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name,column,cut", [("op1_toxic_segments", "predicted", 0.5), ("op8_quality_trees", "predicted", 0.3)])
def test_scores(spark, folder, name, column, cut):
    rows = q.queries()[name](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in documents())
    for r in rows:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r[column] == int(r.score >= cut)
    assert len({r.score for r in rows if r.doc_id == 207}) == 1


def test_conversations(spark, folder):
    got = {r.conv_id: r for r in q.op2_reply_trees(spark, folder).collect()}
    turns = defaultdict(list)
    for conv, turn, role, text in [*CONVERSATIONS, (-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]:
        turns[conv].append((turn, role, text or ""))
    assert set(got) == set(turns)
    for conv, said in turns.items():
        said = [t[1:] for t in sorted(said)]
        learned = "".join(t for role, t in said if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(said), sha("".join(f"{role}\n{t}\n" for role, t in said)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), sha(learned)) and got[conv].formatted_chars > 0


def test_media(spark, folder):
    texts = {d[0]: d[1] or "" for d in documents()}
    by_text = {}
    for r in q.op3_tiff_pages(spark, folder).collect():
        data = texts[r.doc_id].encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and r.error is None
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)


def test_fingerprints(spark, folder):
    rows = q.op5_imatch(spark, folder).collect()
    order = sorted(((d[0], d[1] or "") for d in documents()), key=lambda d: -d[0])
    after = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True) if a[0] != 207}
    texts = dict(order)
    for r in rows:
        if r.doc_id in after:
            a, n = texts[r.doc_id], len(texts[r.doc_id]) // 3
            assert (r.n_chars, r.edited_sha256) == (len(a), sha(a[: len(a) - n] + after[r.doc_id][:n]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    assert all(prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint for r in rows) and len(rows) == len(order)


def test_near_duplicates(spark, folder):
    fps, root = {}, {}
    for i, text, *_ in documents():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        pieces = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        hashes = [xxh64_intdigest(p.encode(), 42) for p in pieces]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        root[i] = i
    for _ in range(4):
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    got = q.op6_simhash_near_dedup(spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", root[i]) for i in fps} and len(got) == len(documents())


def test_mix(spark, folder):
    from .test_mixing import plain_targets

    rows = q.op7_source_mixing(spark, folder).collect()
    sizes, total = {d[0]: len(WORD.findall(d[1] or "")) for d in documents()}, defaultdict(int)
    for d in documents():
        total[d[3]] += sizes[d[0]]
    target, taken = plain_targets(total), defaultdict(int)
    for r in rows:
        assert (r["size"], r.source_size) == (sizes[r.doc_id], total[r.source]) and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in target.items():  # no single copy more or less would come nearer
        gap = t - taken[s]
        own = [r for r in rows if r.source == s and r["size"] > 0]
        assert not any(abs(gap - r["size"]) < abs(gap) - 1e-5 and r.taken < 3 * r["size"] for r in own)
        assert not any(abs(gap + r["size"]) < abs(gap) - 1e-5 and r.taken > 0 for r in own)


def test_languages(spark, folder):
    rows = q.op9_crf_language_id(spark, folder).collect()
    texts = {d[0]: d[1] for d in documents()}
    for r in rows:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
        assert r.lang_pred == "und" if not any(c.isalpha() for c in texts[r.doc_id] or "") else r.lang_pred in ("en", "de", "fr")
    known = [r for r in rows if r.doc_id < 90]
    assert sum(r.lang_pred == ("en", "de", "fr")[r.doc_id % 3] for r in known) > 0.9 * len(known)


def test_personal_data(spark, folder):
    kinds, texts = ("email", "ip", "card", "phone"), {d[0]: d[1] or "" for d in documents()}
    for r in q.op10_pii_candidates(spark, folder).collect():
        base = brute_pii(texts[r.doc_id]) if r.doc_id != 207 else [(0, 1, 5007)]
        written = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == sha(",".join(written)) and set(written) <= set(r.spans.split(","))
        spans = [(int(s), kinds.index(k), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and r.n_spans == len(spans)


def test_batches(spark, folder):
    words = defaultdict(int)
    for r in q.op4_length_buckets(spark, folder).collect():
        words[r.doc_id] += r.length
        assert r.length <= r.bucket_length <= 4096
    want = defaultdict(int)
    for d in documents():
        want[d[0]] += len(WORD.findall(d[1] or ""))
    assert words == want
