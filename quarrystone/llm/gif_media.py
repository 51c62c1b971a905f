"""Media columns: GIF streams as binary columns, decoded to timed frames with colour histograms.

The decoder is general: it reads any GIF87a/89a stream with global or local palettes,
LZW code streams with or without deferred clear codes, interlacing, delays, the four disposal
rules and transparent indexes, and gives the canvas after each frame. The encoder stores a
byte payload without loss, one byte a pixel, under a grey palette in which index i has the
colour (i, i, i), so that the colours on the canvas give the bytes back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

#: Bytes of a pixel row and rows of a frame; a payload is a positive multiple of ROW bytes.
ROW, FRAME_ROWS, PAD = 192, 64, 32
#: Hundredths of a second that a frame stays.
DELAY_CS = 4
#: Bins of a histogram, for each of red, green and blue.
BINS = 16
_CLEAR, _END, _FIRST, _FULL = 256, 257, 258, 4096
_RUN = _FULL - _FIRST + 1  # codes between two clear codes when the table fills up, the clear included


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray  # height x width x 4 of the whole screen, after this frame


def _widths(n: int, bits: int = 9) -> np.ndarray:
    """Bits of the first n codes after a clear code."""
    free = (1 << (bits - 1)) + 2 + np.maximum(0, np.arange(n) - 1)
    return np.clip(np.ceil(np.log2(free + 1)).astype(np.int64), bits, 12)


_SCHEDULE = _widths(_RUN)
_GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


@lru_cache(maxsize=16)
def _places(n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the first n codes after a clear code and the bits before each."""
    w = _widths(n, bits)
    return w, np.cumsum(w) - w


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples; a clear code whenever the table is full."""
    codes, table, free = [_CLEAR], {}, _FIRST
    put, get = codes.append, table.get
    have = data[0]
    for b in data[1:]:
        code = get(key := have << 8 | b)
        if code is not None:
            have = code
            continue
        put(have)
        table[key] = free
        free += 1
        have = b
        if free == _FULL:
            put(_CLEAR)
            table.clear()
            free = _FIRST
    codes += (have, _END)
    v = np.array(codes, np.uint32)
    w = np.concatenate([[9], np.resize(_SCHEDULE, len(v) - 1)])
    at = np.cumsum(w) - w
    v <<= (at & 7).astype(np.uint32)
    out = np.zeros(int(at[-1] + w[-1] + 7) // 8 + 3, np.uint8)
    for k in range(3):
        np.bitwise_or.at(out, (at >> 3) + k, (v >> (8 * k) & 255).astype(np.uint8))
    return out[:-3].tobytes()


def _strings(codes: np.ndarray, roots: int) -> bytes:
    """What the codes between two clear codes stand for.

    The entry made after code m is the output from that code's first sample to the next
    code's first sample, so a code stands for a copy of earlier output. Lengths and sources
    follow their chains by doubling, all codes at once.
    """
    n = len(codes)
    if not n:
        return b""
    parent = codes - (roots + 2)  # the code whose entry this is
    leaf = codes < roots
    if (parent >= np.arange(n)).any() or ((parent < 0) & ~leaf).any():
        raise ValueError("LZW code beyond the table")
    up = np.append(np.where(leaf, n, parent), n)
    length = np.append(np.ones(n, np.int64), 0)
    while (up[:n] < n).any():
        length, up = length + length[up], up[up]
    length = length[:n]
    start = np.cumsum(length) - length
    shift = np.where(leaf, 0, start[np.where(leaf, 0, parent)] - start)
    source = np.arange(int(start[-1] + length[-1])) + np.repeat(shift, length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    samples = np.zeros(len(source), np.uint8)
    samples[start[leaf]] = codes[leaf]
    return samples[source].tobytes()


def lzw_decode(data: bytes, bits: int) -> bytes:
    """Samples of a code stream whose roots have ``bits`` bits; ends at the end code or the data's end."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out, at, total = [], 0, 8 * len(data)
    if total > bits and int(raw[0] | raw[1] << 8) & ((2 << bits) - 1) == clear:
        at = bits + 1
    while at + bits < total:
        n = (total - at) // (bits + 1)
        run = _FULL
        while True:  # codes of this run, as far as they are needed
            w, before = _places(run, bits + 1)
            fit = int(np.searchsorted(before + w, total - at, "right"))
            w, o = w[:fit], at + before[:fit]
            codes = (raw[o >> 3] | raw[(o >> 3) + 1] << 8 | raw[(o >> 3) + 2] << 16) >> (o & 7) & ((1 << w) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or run >= n:
                break
            run *= 8
        stop = int(stops[0]) if len(stops) else len(codes)
        out.append(_strings(codes[:stop].astype(np.int64), clear))
        if not len(stops) or codes[stop] == end:
            break
        at = int(o[stop] + w[stop])
    return b"".join(out)


def encode_gif(payload: bytes) -> bytes:
    """A GIF89a whose pixels are the payload's bytes, ROW a line, FRAME_ROWS lines a frame."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload must be a positive multiple of {ROW} bytes")
    rows = len(payload) // ROW
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * ROW : (top + FRAME_ROWS) * ROW]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, ROW, len(part) // ROW, 0) + b"\x08")
        stream = lzw_encode(part)
        out += [bytes([len(s)]) + s for i in range(0, len(stream), 255) if (s := stream[i : i + 255])]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The data sub-blocks from ``at`` on, joined, and the place behind them."""
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << ((flags & 7) + 1)
    rgb = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
    return np.hstack([rgb, np.full((len(rgb), 1), 255, np.uint8)]), at + n


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames in order. Broken streams raise ValueError."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    clear_index = None
    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, cs, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear_index = cs * 10, packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = common
        if flags & 0x80:
            palette, at = _palette(data, at, flags)
        if palette is None:
            raise ValueError("no palette")
        bits = data[at]
        if not 1 <= bits <= 8:
            raise ValueError("code size out of range")
        body, at = _blocks(data, at + 1)
        index = np.frombuffer(lzw_decode(body, bits)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:  # interlaced: four passes
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            index = index[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        room = canvas[top : top + h, left : left + w]
        part = index[: room.shape[0], : room.shape[1]]
        colours = palette[np.minimum(part, len(palette) - 1)]
        if clear_index is None:
            room[...] = colours
        else:
            np.copyto(room, colours, where=(part != clear_index)[..., None])
        yield Frame(left, top, w, h, delay, disposal, clear_index, canvas)
        if disposal == 2:
            canvas = canvas.copy()
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        else:
            canvas = canvas.copy()
        delay, disposal, clear_index = 0, 0, None


def histogram(canvas: np.ndarray) -> list[int]:
    """BINS counts each of red, green and blue over the pixels that aren't transparent."""
    seen = canvas if canvas[..., 3].all() else canvas[canvas[..., 3] > 0]
    flat = seen.reshape(-1, 4)[:, :3] // (256 // BINS) + np.arange(3, dtype=np.uint8) * BINS
    return np.bincount(flat.ravel(), minlength=3 * BINS).tolist()


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FRAME = pa.struct([(k, pa.int32()) for k in ("left", "top", "width", "height", "delay_ms", "disposal", "transparent")] + [("histogram", pa.list_(pa.int32()))])
_READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
     ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.list_(_FRAME))]
)
_READ_DDL = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames array<struct<left:int,top:int,width:int,height:int,delay_ms:int,disposal:int,transparent:int,histogram:array<int>>>"
)
#: Rows and bytes of media that leave a worker at once; a single stream may be larger.
_OUT_ROWS, _OUT_BYTES = 256, 16 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches that end at _OUT_ROWS rows or _OUT_BYTES of media, whose bytes are in column ``size`` or are its length."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += row[size] if isinstance(row[size], int) else len(row[size])
        if len(held) >= _OUT_ROWS or total >= _OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                size = max(ROW, -(-len(body) // ROW) * ROW)
                yield key.as_py(), len(body), encode_gif(body.ljust(size, bytes([PAD])))

    return _batches(rows(), _STORED, 2)


def read_media(media: bytes) -> tuple[bytes, list[dict], str]:
    """Payload, frames and feature string of one stored stream."""
    parts, frames, colours = [], [], np.zeros(3 * BINS, np.int64)
    for f in decode_gif(media):
        counts = histogram(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width])
        colours += counts
        parts.append(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
        frames.append({"left": f.left, "top": f.top, "width": f.width, "height": f.height, "delay_ms": f.delay_ms, "disposal": f.disposal, "transparent": f.transparent, "histogram": counts})
    feature = f"frames={len(frames)};ms={sum(x['delay_ms'] for x in frames)};red={','.join(map(str, colours[:BINS]))}"
    return b"".join(parts), frames, feature


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for key, n, one in zip(*(b.column(i) for i in range(3)), strict=True):
                media = one.as_py()
                payload, frames, feature = read_media(media)
                yield key.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames

    return _batches(rows(), _READ, 5)


def gif_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column of GIF streams, one for each row of ``docs``: doc_id, n_bytes, media.

    Null and empty texts become one row of padding. Null ids, repeated rows and ties: a row
    each. Empty table: no rows. Other columns are neither read nor returned.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def gif_features(media: DataFrame) -> DataFrame:
    """Decodes a media column: digests, feature string and ``frames``, the timed frames with their colour histograms."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, _READ_DDL)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Stores the media column as a table in the shared folder and decodes what it reads back."""
    return gif_features(written(gif_columns(docs), "gif"))
