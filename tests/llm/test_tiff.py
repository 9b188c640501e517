import itertools
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from costweave.llm import tiff


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_codecs_round_trip(data, repeat):
    data = data * repeat
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_unpack(tiff.lzw_pack(data), len(data)) == data


def test_lzw_over_full_tables():
    data = np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_unpack(tiff.lzw_pack(data), len(data)) == data
    assert tiff.lzw_unpack(tiff.lzw_pack(b"a" * 100_000), 100_000) == b"a" * 100_000


def test_known_encodings():
    # A published PackBits example.
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa".replace(" ", ""))
    plain = bytes.fromhex("aa aa aa 80 00 2a aa aa aa aa 80 00 2a 22 aa aa aa aa aa aa aa aa aa aa".replace(" ", ""))
    assert tiff.unpack_bits(packed, len(plain)) == plain


@pytest.mark.parametrize("compression,predictor,tile", list(itertools.product([1, 5, 8, 32773], [1, 2], [None, (16, 32)])))
def test_pages_round_trip(spark, compression, predictor, tile):
    rng = np.random.default_rng(compression)
    pages = [rng.integers(0, 4, s, dtype=np.uint8) for s in ((50, 70), (7, 3, 3), (1, 1))]
    media = tiff.write_tiff(pages, compression, predictor, rows_per_strip=16, tile=tile, description=b"d")
    rows = sorted(tiff.tiff_pages(spark.createDataFrame([(1, media)], "doc_id long, media binary")).collect(), key=lambda r: r.page)
    assert [bytes(r.pixels) for r in rows] == [p.tobytes() for p in pages]
    assert [(r.width, r.height, r.samples, r.compression, r.error) for r in rows] == [(70, 50, 1, compression, None), (3, 7, 3, compression, None), (1, 1, 1, compression, None)]


def test_big_endian_and_broken_media(spark):
    body = b"MM" + struct.pack(">HI", 42, 8) + struct.pack(">H", 5)
    tags = [(256, 3, 1, 2 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 8 << 16), (273, 4, 1, 74), (279, 4, 1, 4)]
    body += b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", 0) + b"abcd"
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8)])
    rows = [(1, body), (2, None), (3, b""), (4, b"not a tiff at all"), (5, good[:-40]), (6, good.replace(b"\x78", b"\x00", 1)), (7, good[:6])]
    got = {r.doc_id: r for r in tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert bytes(got[1].pixels) == b"abcd" and set(got) == set(range(1, 8))
    assert all(got[i].error and got[i].pixels is None for i in range(2, 8)) and got[3].page is None


def test_texts_are_stored_without_loss(docs, empty):
    pages = {}
    for r in tiff.tiff_pages(tiff.store_texts(docs)).collect():
        pages.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        data = (d.text or "").encode()
        r = pages[d.doc_id][0]
        assert bytes(r.pixels) == data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0") and r.description == f"n_bytes={len(data)}"
    assert tiff.tiff_pages(tiff.store_texts(empty)).count() == 0
