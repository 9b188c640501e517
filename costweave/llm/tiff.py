"""TIFF media columns: a writer and a reader that emits one row a page."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm.common import arrow_rows

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: What a broken file may raise while it is read.
_BROKEN = (ValueError, TypeError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error)
#: Times its own size that the values or segments of a file may add up to.
_REREADS = 16


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as repeats, the rest as literals of 128 bytes at most."""
    values = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(values)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(values)]])
    out, plain = bytearray(), 0

    def literals(upto: int) -> None:
        for at in range(plain, upto, 128):
            piece = data[at : min(at + 128, upto)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for i in np.flatnonzero(ends - starts >= 3) if data else ():
        begin, end = int(starts[i]), int(ends[i])
        literals(begin)
        for at in range(begin, end, 128):
            n = min(128, end - at)
            out += bytes([0, data[at]]) if n == 1 else bytes([257 - n, data[at]])
        plain = end
    literals(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_pack(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one code early."""
    out, acc, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    put(256, 9)
    table, width, known = {bytes([i]): i for i in range(256)}, 9, b""
    after = 258
    for i in range(len(data)):
        longer = known + data[i : i + 1]
        if longer in table:
            known = longer
            continue
        put(table[known], width)
        table[longer] = after
        after += 1
        known = data[i : i + 1]
        if after == 4095:
            put(table[known], width)
            put(256, 12)
            table, width, known, after = {bytes([i]): i for i in range(256)}, 9, b"", 258
        elif after == (1 << width):
            width += 1
    if known:
        put(table[known], width)
        after += 1
        if after == (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def lzw_unpack(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    out, table, width, last = bytearray(), list(first), 9, b""
    acc = bits = at = 0
    while len(out) < size:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            acc, bits, at = acc << 8 | data[at], bits + 8, at + 1
        bits -= width
        code, acc = acc >> bits, acc & (1 << bits) - 1
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code == 257:
            break
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code without an entry")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def _stored(data: bytes, compression: int, level: int) -> bytes:
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_pack(data)
    if compression == PACKBITS:
        return pack_bits(data)
    return zlib.compress(data, level)


def _loaded(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        got = data
    elif compression == LZW:
        got = lzw_unpack(data, size)
    elif compression == PACKBITS:
        got = unpack_bits(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression} is not read")
    if len(got) < size:
        raise ValueError(f"a segment has {len(got)} of {size} bytes")
    return got[:size]


def _differences(part: np.ndarray, predictor: int) -> bytes:
    """The bytes of (rows, width, samples) pixels as a predictor stores them."""
    if predictor == 2:
        whole = part.view(f"{part.dtype.byteorder}u{part.dtype.itemsize}")
        return np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1).astype(whole.dtype).tobytes()
    if predictor == 3:
        rows, width, samples = part.shape
        wide = part.astype(part.dtype.newbyteorder(">")).reshape(rows, width * samples)
        planes = wide.view(np.uint8).reshape(rows, width * samples, -1).transpose(0, 2, 1).reshape(rows, -1, samples)
        return np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).tobytes()
    return part.tobytes()


def _samples(raw: bytes, shape: tuple[int, int, int], kind: np.dtype, predictor: int) -> np.ndarray:
    """The pixels that :func:`_differences` made bytes of."""
    rows, width, samples = shape
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, kind.itemsize, width * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(kind.newbyteorder(">")).reshape(shape)
    part = np.frombuffer(raw, kind).reshape(shape)
    if predictor == 2:
        whole = part.view(f"{kind.byteorder}u{kind.itemsize}")
        part = np.cumsum(whole, axis=1, dtype=f"=u{kind.itemsize}").view(kind.newbyteorder("="))
    return part


def write_tiff(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 128, tile: tuple[int, int] | None = None,
    description: bytes = b"", level: int = 1, planar: bool = False, order: str = "<",
) -> bytes:
    """TIFF of pages, (height, width) or (height, width, samples), in byte order ``order`` (``<`` or ``>``).

    The samples may be integers of 8 to 64 bits, floats of 32 or 64, or bool (bilevel, packed
    eight to a byte). Pages are cut into strips, or into ``tile`` = (height, width) tiles padded
    with zeros; ``planar`` stores each sample by itself. ``predictor`` 2 stores integers as their
    differences from the pixel to the left, 3 floats as differences of their byte planes; bilevel pages take none.
    """
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        page = page.reshape(page.shape[0], page.shape[1], -1)
        height, width, samples = page.shape
        bilevel = page.dtype == bool
        if predictor == 3 and page.dtype.kind != "f" or predictor == 2 and page.dtype.kind not in "biu":
            raise ValueError("predictor 2 is for integers, 3 for floats")
        own_predictor = 1 if bilevel else predictor
        stored = page if bilevel else page.astype(page.dtype.newbyteorder(order))
        size = tile or (min(rows_per_strip, height), width)
        segments = []
        for plane in np.split(stored, samples, axis=2) if planar else [stored]:
            for top in range(0, height, size[0]):
                for left in range(0, width, size[1]):
                    part = plane[top : top + size[0], left : left + size[1]]
                    if tile:
                        part = np.pad(part, ((0, size[0] - part.shape[0]), (0, size[1] - part.shape[1]), (0, 0)))
                    part = np.ascontiguousarray(part)
                    raw = np.packbits(part.reshape(len(part), -1), axis=1).tobytes() if bilevel else _differences(part, own_predictor)
                    segments.append(_stored(raw, compression, level))
        places = []
        for s in segments:
            places.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        tags = {
            256: (4, [width]), 257: (4, [height]), 258: (3, [1 if bilevel else 8 * page.dtype.itemsize] * samples), 259: (3, [compression]), 262: (3, [2 if samples >= 3 else 1]),
            277: (3, [samples]), 284: (3, [2 if planar else 1]), 317: (3, [own_predictor]), 339: (3, [{"i": 2, "f": 3}.get(page.dtype.kind, 1)] * samples),
        }
        if description:
            tags[270] = (2, description + b"\0")
        if tile:
            tags |= {322: (4, [tile[1]]), 323: (4, [tile[0]]), 324: (4, places), 325: (4, [len(s) for s in segments])}
        else:
            tags |= {273: (4, places), 278: (4, [size[0]]), 279: (4, [len(s) for s in segments])}
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = bytes(values) if kind == 2 else struct.pack(f"{order}{len(values)}{_TYPES[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(f"{order}I", where)
            entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack(f"{order}I", len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes):
    """The tags of every image directory, in order; a directory met twice ends the walk.

    A tag is a tuple of numbers, or bytes. Directories that overlap, or values that add up to many
    times the file, are an error, so the walk costs no more than a few readings of the file.
    """
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF byte order mark")
    e = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(f"{e}HI", data, 2)
    if magic != 42:
        raise ValueError("no TIFF")
    seen, used, held = set(), 0, 0
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(f"{e}H", data, at)
        used += 6 + 12 * n
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{e}HHI", data, at + 2 + 12 * i)
            code = _TYPES.get(kind)
            if not code:
                continue
            size = struct.calcsize(f"={code}") * count
            where = at + 10 + 12 * i
            if size > 4:
                (where,) = struct.unpack_from(f"{e}I", data, where)
            held += size
            if where + size > len(data):
                raise ValueError(f"tag {tag} lies outside the file")
            if used > len(data) or held > _REREADS * len(data):
                raise ValueError("directories or values overlap")
            tags[tag] = data[where : where + size] if code == "s" else struct.unpack_from(f"{e}{count * len(code)}{code[0]}", data, where)
        yield tags
        (at,) = struct.unpack_from(f"{e}I", data, at + 2 + 12 * n)


def _numbers(tags: dict, tag: int, default: tuple[int, ...] | None = None) -> tuple[int, ...]:
    values = tags.get(tag, default)
    if not isinstance(values, tuple) or not values or not all(isinstance(v, int) and v >= 0 for v in values):
        raise ValueError(f"tag {tag} has no whole numbers")
    return values


def _first(tags: dict, tag: int, default: int | None = None) -> int | None:
    """The first number of a tag; ``default`` where the tag is missing, null where it has no number."""
    values = tags.get(tag, (default,))
    return values[0] if isinstance(values, tuple) and values and isinstance(values[0], int) else None


def _pixels(data: bytes, tags: dict, max_bytes: int) -> np.ndarray:
    """(height, width, samples) of one page; ``max_bytes`` bounds what a page or a segment takes in memory."""
    (width, *_), (height, *_), (samples, *_) = _numbers(tags, 256), _numbers(tags, 257), _numbers(tags, 277, (1,))
    (compression, *_), (predictor, *_), (planar, *_) = _numbers(tags, 259, (1,)), _numbers(tags, 317, (1,)), _numbers(tags, 284, (1,))
    bits, formats = set(_numbers(tags, 258, (1,))), set(_numbers(tags, 339, (1,)))
    if len(bits) > 1 or len(formats) > 1:
        raise ValueError("samples of different kinds are not read")
    (depth,), (form,) = bits, formats
    if not width or not height or not samples or planar not in (1, 2):
        raise ValueError("an empty page, or samples in an unknown order")
    bilevel = depth == 1
    letter = {1: "u", 2: "i", 3: "f"}.get(form)
    if not bilevel and (depth not in (8, 16, 32, 64) or not letter or letter == "f" and depth < 32):
        raise ValueError(f"samples of {depth} bits and format {form} are not read")
    kind = np.dtype(np.uint8) if bilevel else np.dtype(f"{'<' if data[:2] == b'II' else '>'}{letter}{depth // 8}")
    if predictor not in (1, 2, 3) or predictor > 1 and bilevel or (predictor == 3) != (predictor > 1 and kind.kind == "f"):
        raise ValueError(f"predictor {predictor} is not read for these samples")
    tiled = 324 in tags
    seg_w, seg_h = (_numbers(tags, 322)[0], _numbers(tags, 323)[0]) if tiled else (width, min(_numbers(tags, 278, (height,))[0], height))
    places, lengths = (_numbers(tags, 324), _numbers(tags, 325)) if tiled else (_numbers(tags, 273), _numbers(tags, 279))
    if not seg_w or not seg_h:
        raise ValueError("empty segments")
    together = 1 if planar == 2 else samples
    row_bytes = -(-seg_w * together * depth // 8)
    whole = height * width * samples * kind.itemsize
    if whole > max_bytes or seg_h * row_bytes > max_bytes:
        raise ValueError(f"a page of {whole} bytes in segments of {seg_h * row_bytes} is over {max_bytes}")
    n = (samples // together) * -(-height // seg_h) * -(-width // seg_w)
    if len(places) < n or len(lengths) < n:
        raise ValueError(f"{min(len(places), len(lengths))} of {n} segments")
    if sum(lengths[:n]) > _REREADS * len(data):
        raise ValueError("segments overlap")
    out, k = np.zeros((height, width, samples), kind.newbyteorder("=")), 0
    for plane in range(samples // together):
        for top in range(0, height, seg_h):
            for left in range(0, width, seg_w):
                rows = seg_h if tiled else min(seg_h, height - top)
                raw = _loaded(data[places[k] : places[k] + lengths[k]], compression, rows * row_bytes)
                if bilevel:
                    part = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, row_bytes), axis=1)[:, : seg_w * together].reshape(rows, seg_w, together)
                else:
                    part = _samples(raw, (rows, seg_w, together), kind, predictor)
                out[top : top + rows, left : left + seg_w, plane : plane + together] = part[: height - top, : width - left]
                k += 1
    return out


def page_feature(pixels: np.ndarray) -> str:
    """Mean, deviation and a 64-bit difference hash of an 8 by 9 grid of block means."""
    flat = np.nan_to_num(pixels.reshape(pixels.shape[0], -1).astype(np.float32))
    rows = np.array_split(flat, 8, axis=0)
    grid = np.array([[c.mean() if c.size else 0.0 for c in np.array_split(r, 9, axis=1)] for r in rows])
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).reshape(-1)).tobytes().hex()
    return f"{float(flat.mean()):.4f}:{float(flat.std()):.4f}:{bits}"


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", max_bytes: int = 1 << 28) -> DataFrame:
    """One row for each page of each TIFF in a binary column.

    Returns ``doc_id, page`` (from 0), ``width, height, samples, bits, compression, description,
    media_bytes, media_sha256, pixels`` (interleaved little-endian samples; bilevel pages one byte a
    sample), ``feature`` and ``error``. Strips and tiles, both byte orders, no compression,
    PackBits, LZW and deflate, integers of 8 to 64 bits, floats, bilevel pages, interleaved and
    planar samples, and predictors 2 and 3 are read. A page that cannot be read, or whose pixels
    take more than ``max_bytes`` (of a whole medium), has ``error`` and no pixels; a null or empty
    medium, or one that is no TIFF, is one row with a null page and ``error``.
    """
    fields = ("doc_id", "page", "width", "height", "samples", "bits", "compression", "description", "media_bytes", "media_sha256", "pixels", "feature", "error")

    def make():
        def handle(ids, media):
            rows = []
            for i, data in zip(ids, media, strict=True):
                data = bytes(data or b"")
                stored, left = (len(data), hashlib.sha256(data).hexdigest()), max_bytes
                try:
                    if not data:
                        raise ValueError("no medium")
                    for page, tags in enumerate(_directories(data)):
                        about = tags.get(270)
                        about = about.rstrip(b"\0").decode("utf-8", "replace") or None if isinstance(about, bytes) else None
                        head = (i, page, *(_first(tags, t, d) for t, d in ((256, None), (257, None), (277, 1), (258, 1), (259, 1))), about, *stored)
                        try:
                            pixels = _pixels(data, tags, left)
                            left -= pixels.nbytes
                            rows.append((*head, pixels.astype(pixels.dtype.newbyteorder("<")).tobytes(), page_feature(pixels), None))
                        except _BROKEN as e:
                            rows.append((*head, None, None, f"{type(e).__name__}: {e}"))
                except _BROKEN as e:
                    rows.append((i, *(None,) * 7, *stored, None, None, f"{type(e).__name__}: {e}"))
            return dict(zip(fields, zip(*rows, strict=True), strict=True)) if rows else {f: [] for f in fields}

        return handle

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return arrow_rows(
        source, ["doc_id", "media"], make,
        "doc_id long, page int, width long, height long, samples long, bits long, compression long, description string, media_bytes long, media_sha256 string, pixels binary, feature string, error string",
    )


def store_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, compression: int = DEFLATE, predictor: int = 2
) -> DataFrame:
    """Every text as one TIFF page: its UTF-8 bytes, zeros up to whole rows, ``width`` pixels a row.

    Returns ``doc_id, media``; the number of bytes stands in the image description. A null
    text is an empty one: one row of zeros.
    """

    def make():
        def handle(ids, texts):
            media = []
            for text in texts:
                data = (text or "").encode()
                page = np.frombuffer(data.ljust(max(1, -(-len(data) // width)) * width, b"\0"), np.uint8).reshape(-1, width)
                media.append(write_tiff([page], compression, predictor, description=b"n_bytes=%d" % len(data)))
            return {"doc_id": ids, "media": media}

        return handle

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_rows(source, ["doc_id", "text"], make, "doc_id long, media binary")
