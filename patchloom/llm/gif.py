"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

`decode` turns the bytes of a GIF into timed frames; `frames` does so for a
DataFrame column; `encode` stores samples losslessly as an 8-bit GIF.

Defined results: a null or broken stream gives no frames and an `error`; a
stream that ends early gives the frames that are whole; an empty text is stored
as one row of 192 spaces; rows that repeat give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from patchloom.llm.common import only

WIDTH = 192
#: Points of a canvas or frame; a header of a few bytes may claim 4,000 million, which no task could hold.
MAX_POINTS = 1 << 24
FRAME_ROWS = 256
DELAY_CS = 10
MAX_CODES = 4096
GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: Frame rows of an interlaced image, as (first row, step).
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def _schedule(bits: int) -> np.ndarray:
    """Code widths by position after a clear code."""
    first = (1 << bits) + 2
    size = first + np.maximum(np.arange(MAX_CODES) - 1, 0)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(size)).astype(np.int64) + 1))


_SCHEDULES = {b: _schedule(b) for b in range(2, 9)}
_STARTS = {b: np.concatenate([[0], np.cumsum(w)]) for b, w in _SCHEDULES.items()}
_LANES = np.arange(12, dtype=np.uint16)


def _pack(codes: list[int], bits: int) -> np.ndarray:
    """The bits of one run of codes after a clear code, lowest bit first."""
    a = np.array(codes, dtype=np.uint16)
    spread = ((a[:, None] >> _LANES) & 1).astype(np.uint8)
    return spread[_LANES < _SCHEDULES[bits][: len(a), None]]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A GIF code stream of the samples; the table is cleared whenever it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    full = MAX_CODES - clear - 2
    # The leading clear code is as wide as the first code of a run.
    parts = [np.array([(clear >> i) & 1 for i in range(bits + 1)], dtype=np.uint8)]
    codes: list[int] = []
    append, known = codes.append, {}
    get, step = known.get, iter(data)
    prefix = next(step, None)
    if prefix is not None:
        for sample in step:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            append(prefix)
            prefix = sample
            known[key] = clear + 2 + len(known)
            if len(known) == full:
                append(clear)
                parts.append(_pack(codes, bits))
                codes.clear()
                known.clear()
        append(prefix)
    append(end)
    parts.append(_pack(codes, bits))
    return np.packbits(np.concatenate(parts), bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, wanted: int) -> bytes:
    """The samples of a code stream, `wanted` at most; raises ValueError where a code cannot occur."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    total, at, got = 8 * len(stream), 0, 0
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    widths, starts = _SCHEDULES[bits], _STARTS[bits]
    table, previous, place = singles[:], None, 0
    out: list[bytes] = []

    while got < wanted:
        # Widths follow from the position alone, so a whole run of codes is read at once.
        if place < MAX_CODES - 1:
            w = widths[place:]
            spots = at + starts[place:-1] - starts[place]
        else:
            w = np.full(MAX_CODES, 12)
            spots = at + 12 * np.arange(MAX_CODES)
        fits = spots + w <= total
        spots, w = spots[fits], w[fits]
        if not len(spots):
            break
        k = spots >> 3
        codes = ((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (spots & 7).astype(np.uint32)) & ((1 << w) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        run = codes[:n].tolist()
        if run and previous is None:
            if run[0] >= clear:
                raise ValueError("first code is not a sample")
            previous = table[run[0]]
            out.append(previous)
            got += len(previous)
            todo = run[1:]
        else:
            todo = run
        size = len(table)
        for code in todo:
            if code < size:
                entry = table[code]
            elif code == size and size < MAX_CODES:
                entry = previous + previous[:1]
            else:
                raise ValueError("code beyond the table")
            if size < MAX_CODES:
                table.append(previous + entry[:1])
                size += 1
            out.append(entry)
            got += len(entry)
            previous = entry
        place += n
        at = int(spots[n - 1] + w[n - 1]) if n else at
        if len(stops):
            if codes[n] == end:
                break
            at = int(spots[n] + w[n])
            table, previous, place = singles[:], None, 0
    return b"".join(out)[:wanted]


def _blocks(parts: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(parts), 255):
        piece = parts[i : i + 255]
        out.append(len(piece))
        out += piece
    out.append(0)
    return bytes(out)


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """An 8-bit GIF with a grey palette whose frames hold the samples row by row, `frame_rows` rows a frame."""
    rows = len(samples) // width
    if not rows or rows * width != len(samples):
        raise ValueError("samples must fill whole rows")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), GRAY]
    for top in range(0, rows, frame_rows):
        part = samples[top * width : (top + frame_rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(_blocks(lzw_encode(part)))
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    """One timed frame: its own samples, and the canvas (packed 0xAARRGGBB) once it is drawn."""

    number: int
    start_cs: int
    delay_cs: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    samples: np.ndarray
    canvas: np.ndarray


def _palette(raw: bytes) -> np.ndarray:
    rgb = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.uint32)
    full = np.full(256, 0xFF000000, dtype=np.uint32)
    full[: len(rgb)] = 0xFF000000 | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    return full


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order, drawn by the rules of disposal and transparency."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MAX_POINTS:
        raise ValueError("canvas too large")
    at = 13
    shared = None
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        shared = _palette(data[at : at + n])
        at += n
    canvas = np.zeros((height, width), dtype=np.uint32)
    number = clock = delay = disposal = 0
    transparent = None

    def chunks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(data):
                raise ValueError("ends within a block")
            n = data[at]
            at += 1
            if not n:
                return b"".join(parts), at
            parts.append(data[at : at + n])
            at += n

    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = chunks(at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                delay = struct.unpack_from("<H", body, 1)[0]
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        if w * h > MAX_POINTS:
            raise ValueError("frame too large")
        colours = shared
        if flags & 0x80:
            n = 3 * (2 << (flags & 7))
            colours = _palette(data[at : at + n])
            at += n
        if colours is None:
            colours = _palette(GRAY)
        bits = data[at]
        if not 2 <= bits <= 8:
            raise ValueError("bad code size")
        stream, at = chunks(at + 1)
        flat = lzw_decode(stream, bits, w * h)
        if len(flat) < w * h:
            raise ValueError("ends within a frame")
        samples = np.frombuffer(flat, dtype=np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in PASSES])
            woven = np.empty_like(samples)
            woven[order] = samples
            samples = woven
        before = canvas.copy() if disposal == 3 else None
        shown = samples[: max(0, height - top), : max(0, width - left)]
        area = canvas[top : top + shown.shape[0], left : left + shown.shape[1]]
        if transparent is None:
            area[...] = colours[shown]
        else:
            np.copyto(area, colours[shown], where=shown != transparent)
        yield Frame(number, clock, delay, disposal, transparent, left, top, samples, canvas.copy())
        clock += delay
        number += 1
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        delay = disposal = 0
        transparent = None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of 64 colours, two bits each of red, green and blue; clear points do not count."""
    c = canvas.ravel()
    bins = (c >> 22 & 3) << 4 | (c >> 14 & 3) << 2 | (c >> 6 & 3)
    return np.bincount(bins[c >= 0x01000000], minlength=64)


def frames(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per frame of the GIFs in `media`: key, frame, start_ms, duration_ms, disposal, width, height, rgba, histogram, error.

    A stream that is null, breaks off or claims more than MAX_POINTS points gives one
    row with `error` and a null frame after its whole frames.
    """
    names = ("frame", "start_ms", "duration_ms", "disposal", "width", "height")
    kind = df.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, {', '.join(n + ' int' for n in names)}, rgba binary, histogram array<long>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = []

                def flush(rows: list, k: pa.Scalar = k) -> pa.RecordBatch:
                    cols = list(zip(*rows, strict=True))
                    ints = [pa.array(c, pa.int32()) for c in cols[:6]]
                    keys = pa.array([k.as_py()] * len(rows), batch.schema.field(0).type)
                    rest = [pa.array(cols[6], pa.binary()), pa.array(cols[7], pa.list_(pa.int64())), pa.array(cols[8], pa.string())]
                    return pa.RecordBatch.from_arrays([keys, *ints, *rest], [key, *names, "rgba", "histogram", "error"])

                try:
                    for f in decode(data or b""):
                        h, w = f.canvas.shape
                        rgba = ((f.canvas << 8) | (f.canvas >> 24)).astype(">u4").tobytes()
                        rows.append((f.number, f.start_cs * 10, f.delay_cs * 10, f.disposal, w, h, rgba, histogram(f.canvas).tolist(), None))
                        if len(rows) >= 16 or len(rows) * len(rgba) > 1 << 26:
                            yield flush(rows)
                            rows.clear()
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, None, None, None, None, str(e)))
                if rows:
                    yield flush(rows)

    return only(df, key, media).mapInArrow(run, schema)


def digest(text: str | None) -> tuple:
    """Stores a text as a GIF, reads the stored bytes back and describes them."""
    body = (text or "").encode("utf-8", "surrogatepass")
    stored = encode(body + b" " * ((-len(body)) % WIDTH or (0 if body else WIDTH)))
    sha, size, tail = hashlib.sha256(), 0, b""
    colours, frames_n, end_cs = np.zeros(64, dtype=np.int64), 0, 0
    for f in decode(stored):
        back = f.samples.tobytes()
        sha.update(back)
        size += len(back)
        tail = (tail + back)[-16:]
        colours += histogram(f.canvas[f.top : f.top + f.samples.shape[0]])
        frames_n, end_cs = frames_n + 1, f.start_cs + f.delay_cs
    feature = f"frames={frames_n};ms={end_cs * 10};size={WIDTH}x{min(size // WIDTH, FRAME_ROWS)};colours=" + ",".join(f"{i}:{n}" for i, n in enumerate(colours.tolist()) if n)
    return len(body), size, sha.hexdigest(), zlib.crc32(tail), len(stored), hashlib.sha256(stored).hexdigest(), feature


def store_and_describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text counts as empty. Texts are stored whole whatever their length: longer ones take more frames.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kinds = ["long", "long", "string", "long", "long", "string", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                cols = list(zip(*map(digest, part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [key, *names])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return only(docs, key, text).mapInArrow(run, schema)
