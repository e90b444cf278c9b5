"""GIF media columns: LZW streams, palettes, disposal and transparency, timed frames with colour histograms.

Defined results. Null or undecodable media give no frames and a message. A frame's canvas is what a viewer shows: its
opaque pixels over what the frames before it left (disposal 0 and 1 leave the frame, 2 clears its rectangle, 3 restores
what stood there). Missing trailers and truncated codes keep the rows that were read, padded with index 0.

Texts are stored losslessly as 8-bit samples: UTF-8 bytes, zero-padded to a positive multiple of 64, as rows of 64
pixels in frames of at most FRAME_ROWS rows with a grey palette. Null counts as empty; repeated rows are stored each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meridia.llm.common import chunks, table

CLEAR_AT, WIDTH, FRAME_ROWS, DELAY_CS = 4096, 64, 1024, 4
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


@dataclass
class Frame:
    """One image of a GIF: its place, timing and rules, its samples, and the canvas shown (RGBA) after drawing it."""

    samples: np.ndarray
    x: int = 0
    y: int = 0
    delay_cs: int = 0
    disposal: int = 0
    transparent: int = -1
    palette: np.ndarray | None = None
    canvas: np.ndarray | None = field(default=None, repr=False)


@lru_cache(32)
def _widths(bits: int, n: int) -> np.ndarray:
    """The width of the i-th code after a clear code, for the first n."""
    clear = 1 << bits
    last = clear + 1 + np.maximum(np.arange(n), 1)
    return np.minimum(12, np.maximum(bits + 1, np.frexp(last.astype(np.float64))[1]))


@lru_cache(32)
def _places(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and first bits of the codes after a clear code."""
    widths = _widths(bits, n)
    return widths, np.cumsum(widths) - widths


@lru_cache(8)
def _alphabet(clear: int) -> list[bytes]:
    return [bytes([i]) for i in range(clear)] + [b"", b""]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A GIF code stream of samples below 2**bits."""
    clear = 1 << bits
    runs, codes, known, free = [], [], {}, clear + 2
    prefix = -1
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        key = prefix << 8 | c
        code = known.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        known[key] = free
        free += 1
        prefix = c
        if free == CLEAR_AT:
            codes.append(clear)
            runs.append(codes)
            codes, known, free = [], {}, clear + 2
    codes += ([prefix] if prefix >= 0 else []) + [clear + 1]
    runs.append(codes)
    all_codes = np.concatenate([np.array(r, np.uint16) for r in ([clear], *runs)])
    widths = np.concatenate([[bits + 1], *(_widths(bits, 4200)[: len(r)] for r in runs)])
    flags = np.unpackbits(all_codes.view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(flags[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def _expand(codes: np.ndarray, clear: int) -> bytes:
    """The samples of the codes between two clear codes.

    The entry that code i adds is the output from code i's start, one sample longer than code i; so every code but a
    literal copies earlier output. Lengths follow the chain of entries, and samples the chain of copies, by jumps.
    """
    of = codes.astype(np.int64) - (clear + 2)
    wrong = np.flatnonzero((of >= np.arange(len(of))) | (of == -1) | (of == -2))
    if len(wrong):  # a code that can't be: keep what was read
        of = of[: wrong[0]]
    if not len(of):
        return b""
    lengths: list[int] = []
    add = lengths.append
    for p in of.tolist():
        add(lengths[p] + 1 if p >= 0 else 1)
    n = np.array(lengths)
    ends = np.cumsum(n)
    starts = ends - n
    shift = np.where(of >= 0, starts[np.maximum(of, 0)] - starts, 0)
    source = np.arange(ends[-1]) + np.repeat(shift, n)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    literal = np.zeros(ends[-1], np.uint8)
    literal[starts[of < 0]] = codes[: len(of)][of < 0]
    return literal[source].tobytes()


def lzw_decode(stream: bytes, bits: int) -> bytes:
    """The samples of a GIF code stream; codes are cut out by whole arrays between clear codes."""
    clear, at, total = 1 << bits, 0, len(stream) * 8
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    out, size = [], 4200
    while at + bits < total:
        widths, starts = _places(bits, size)
        most = (total - at) // (bits + 1) + 1
        widths, starts = widths[:most], starts[:most] + at
        n = int(np.searchsorted(starts + widths, total, side="right"))
        if not n:
            break
        starts, byte = starts[:n], starts[:n] >> 3
        codes = ((data[byte] | data[byte + 1] << np.uint32(8) | data[byte + 2] << np.uint32(16)) >> (starts & 7).astype(np.uint32)) & ((np.uint32(1) << widths[:n].astype(np.uint32)) - np.uint32(1))
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stop) and n == size:
            size *= 2  # no clear code yet: take a longer stretch
            continue
        end = int(stop[0]) if len(stop) else n
        out.append(_expand(codes[:end], clear))
        if not len(stop) or codes[end] == clear + 1:
            break
        at, size = int(starts[end] + widths[end]), 4200
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def gif_encode(frames: list[Frame], width: int, height: int, palette: np.ndarray = GREY) -> bytes:
    """A GIF89a of 8-bit frames; a frame's own palette, if any, is stored with it."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent >= 0)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay_cs, max(f.transparent, 0)) + b"\0")
        h, w = f.samples.shape
        out.append(b"\x2c" + struct.pack("<HHHHB", f.x, f.y, w, h, 0x87 if f.palette is not None else 0))
        if f.palette is not None:
            out.append(f.palette.astype(np.uint8).tobytes())
        out.append(b"\x08" + _blocks(lzw_encode(f.samples.tobytes())))
    return b"".join([*out, b"\x3b"])


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    found = np.zeros((256, 3), np.uint8)
    found[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return found, at + 3 * n


def gif_decode(data: bytes) -> list[Frame]:
    """The frames of a GIF with their canvases. ValueError where it isn't one, is cut off or asks for too much."""
    return list(gif_stream(data))


def gif_stream(data: bytes) -> Iterator[Frame]:
    """gif_decode() frame by frame: what comes before a fault is read."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError(f"a screen of {width} x {height} is larger than {MOST_PIXELS} pixels")
    common, at = _colours(data, 13, flags)
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, clear_index = 0, 0, -1
    try:
        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                body, end = _joined(data, at + 2)
                if data[at + 1] == 0xF9 and len(body) >= 4:
                    delay, disposal = body[1] | body[2] << 8, body[0] >> 2 & 7
                    clear_index = body[3] if body[0] & 1 else -1
                at = end
            elif data[at] == 0x2C:
                x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
                own, at = _colours(data, at + 10, flags)
                bits = data[at]
                if not 2 <= bits <= 8:
                    raise ValueError(f"a code size of {bits}")
                if w * h > MOST_PIXELS:
                    raise ValueError(f"a frame of {w} x {h} is larger than {MOST_PIXELS} pixels")
                stream, at = _joined(data, at + 1)
                flat = np.frombuffer(lzw_decode(stream, bits)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
                if flags & 0x40:  # interlaced: rows came in four passes
                    rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                    samples = np.empty_like(flat)
                    samples[rows] = flat
                else:
                    samples = flat
                frame = Frame(samples, x, y, delay, disposal, clear_index, own)
                canvas = _draw(canvas, frame, own if own is not None else common if common is not None else GREY)
                yield frame
                delay, disposal, clear_index = 0, 0, -1
            else:
                raise ValueError(f"unknown block {data[at]}")
    except (IndexError, struct.error) as e:
        raise ValueError("a cut-off GIF") from e


def _draw(canvas: np.ndarray, frame: Frame, palette: np.ndarray) -> np.ndarray:
    """Sets frame.canvas, and returns what the next frame is drawn over. Canvases are RGBA bytes seen as one integer."""
    h, w = frame.samples.shape
    colours = np.concatenate([palette, np.full((256, 1), 255, np.uint8)], 1).view(np.uint32)[:, 0]
    shown = canvas.copy()
    place = shown[frame.y : frame.y + h, frame.x : frame.x + w]
    seen = frame.samples[: place.shape[0], : place.shape[1]]
    np.copyto(place, colours[seen], where=True if frame.transparent < 0 else seen != frame.transparent)
    frame.canvas = shown.view(np.uint8).reshape(*shown.shape, 4)
    if frame.disposal == 3:
        return canvas
    if frame.disposal == 2:
        left = shown.copy()
        left[frame.y : frame.y + h, frame.x : frame.x + w] = 0
        return left
    return shown


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of each of 64 colours (two bits a channel); transparent ones count nowhere."""
    r, g, b, a = (canvas.reshape(-1, 4)[:, i] for i in range(4))
    code = r >> 6 << 4 | g >> 6 << 2 | b >> 6
    return np.bincount(np.where(a > 0, code, np.uint8(64)), minlength=65)[:64]


#: Pixels of a screen or a frame; files that ask for more are refused, whatever their size.
MOST_PIXELS = 1 << 26
FRAMES = "media_id long, frame int, at_ms long, delay_ms long, x int, y int, width int, height int, disposal int, samples binary, canvas binary, histogram array<long>, error string"


def gif_frames(media: DataFrame) -> DataFrame:
    """The timed frames of media (media_id long, media binary), one row each; then a row with `error` where a fault ends them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in FRAMES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        for b in chunks(batches, "media"):
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    at = 0
                    for k, f in enumerate(gif_stream(data or b"")):
                        h, w = f.samples.shape
                        rows.append((key, k, at, f.delay_cs * 10, f.x, f.y, w, h, f.disposal, f.samples.tobytes(), f.canvas.tobytes(), histogram(f.canvas).tolist(), None))
                        at += f.delay_cs * 10
                except ValueError as e:
                    rows.append((key, *[None] * 11, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("media_id", "media").mapInArrow(run, FRAMES)


def text_to_gif(raw: bytes) -> bytes:
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(rows[i : i + FRAME_ROWS], delay_cs=DELAY_CS, disposal=1) for i in range(0, len(rows), FRAME_ROWS)]
    return gif_encode(frames, WIDTH, min(len(rows), FRAME_ROWS))


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> media_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(text_to_gif, raw), pa.binary())], ["media_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "media_id long, n_bytes long, media binary")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "media"):
        rows = []
        for key, n, media in zip(*(c.to_pylist() for c in b.columns), strict=True):
            frames = gif_decode(media)
            payload = b"".join(f.samples.tobytes() for f in frames)
            colours = sum(histogram(f.canvas) for f in frames)
            feature = f"{len(frames)} frames {sum(f.delay_cs for f in frames) * 10} ms " + ",".join(f"{i}:{c}" for i, c in enumerate(colours.tolist()) if c)
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split(" ")[0] for c in SUMMARY.split(", ")])


SUMMARY = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents")).mapInArrow(_summary, SUMMARY)
