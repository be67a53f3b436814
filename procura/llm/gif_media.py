"""GIF media columns: LZW code streams, palettes, disposal, transparency and timed frames.

`decode` reads any GIF87a/89a file into timed RGBA frames. `frames` turns a binary column into one
row per frame with a colour histogram. `encode` writes 8-bit samples losslessly as timed frames: one after
the other shows the next FRAME_ROWS rows, and samples that are as in the frame before are transparent.
`text_media` is the round trip over whole texts.

Defined results: a null text counts as empty; an empty text stores 64 zero bytes; repeated rows give
repeated results; other columns of the input are not read; an empty table gives an empty table. In
`frames` a null or broken file gives one row with frame_index null and the reason in `error`; a canvas of
more than MAX_PIXELS counts as broken, before anything is allocated for it.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_slices

WIDTH = 64
#: Rows of a frame, and frames after which the canvas is cleared and drawn anew.
FRAME_ROWS = 64
KEY_FRAMES = 8
#: Largest canvas that is decoded, 128 MB as RGBA.
MAX_PIXELS = 1 << 25
#: The sample that can mean transparency; it stands in no UTF-8 text.
CLEAR_SAMPLE = 255
TABLE = 4096
GREYS = bytes(v for i in range(256) for v in (i, i, i))


@functools.lru_cache(None)
def code_widths(min_size: int) -> np.ndarray:
    """Bits of the m-th code after a clear code, until the table is full."""
    first = (1 << min_size) + 1
    ends = np.arange(TABLE - first + 1) + first
    ends[0] = first + 1  # no entry is added after the first code
    return np.minimum(np.floor(np.log2(ends)).astype(np.int64) + 1, 12)


def lzw_codes(data: bytes, min_size: int = 8) -> list[int]:
    """Codes of the samples with clear codes where the table fills, ended by the end code."""
    clear, out = 1 << min_size, [1 << min_size]
    table: dict[int, int] = {}
    get, put, free = table.get, out.append, clear + 2
    stream = iter(data)
    prefix = next(stream, None)
    if prefix is not None:
        for sample in stream:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            prefix = sample
            if free < TABLE:
                table[key] = free
                free += 1
            else:
                put(clear)
                table.clear()
                free = clear + 2
        put(prefix)
    put(clear + 1)
    return out


def pack_codes(codes: list[int], min_size: int = 8) -> bytes:
    """Codes as bits, the lowest first, each with the width of its place after the last clear code."""
    values = np.array(codes, dtype="<u2")
    widths = code_widths(min_size)
    starts = np.flatnonzero(values == 1 << min_size)[1:] + 1
    if len(starts):
        lengths = np.diff(np.concatenate([[1], starts, [len(values)]]))
        width = np.concatenate([widths[:1], *(widths[:n] for n in lengths)])
    else:
        width = np.concatenate([widths[:1], widths[: len(values) - 1]])
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


@functools.lru_cache(None)
def code_layout(min_size: int) -> tuple[int, list[tuple[int, int, int, np.ndarray]], np.ndarray]:
    """Bits until the table is full, runs of codes of one width with their bit values, and the bit at which each code ends."""
    widths = code_widths(min_size)
    ends = np.concatenate([[0], np.cumsum(widths)])
    runs = [(int(w), *(int(x) for x in np.searchsorted(widths, [w, w + 1])), 1 << np.arange(w, dtype=np.int32)) for w in np.unique(widths)]
    return int(ends[-1]), runs, ends


def read_codes(data: bytes, min_size: int) -> Iterator[list[int]]:
    """The codes between two clear codes, one list after the other."""
    clear = 1 << min_size
    full, runs, ends = code_layout(min_size)
    at, total, fresh = 0, len(data) * 8, True
    while True:
        if fresh:
            span, layout = full, runs
        else:  # the table is full: codes of 12 bits go on until a clear code
            span, layout = 12 * TABLE, [(12, 0, TABLE, runs[-1][3])]
        room = min(span, total - at)
        raw = np.frombuffer(data, np.uint8, count=min(len(data) - at // 8, (span + 7) // 8 + 1), offset=at // 8)
        bits = np.unpackbits(raw, bitorder="little")[at % 8 :]
        parts, pos = [], 0
        for w, lo, hi, worth in layout:
            n = min(hi - lo, max(0, room - pos) // w)
            if not n:
                break
            parts.append(bits[pos : pos + n * w].reshape(n, w) @ worth)
            pos += n * w
        if not parts:
            return
        codes = np.concatenate(parts)
        stops = ((codes == clear) | (codes == clear + 1)).nonzero()[0]
        if len(stops):
            stop = int(stops[0])
            yield codes[:stop].tolist() if fresh else [-1, *codes[:stop].tolist()]
            if codes[stop] == clear + 1:
                return
            at += int(ends[stop + 1]) if fresh else 12 * (stop + 1)
            fresh = True
        else:
            yield codes.tolist() if fresh else [-1, *codes.tolist()]
            if pos < span:
                return
            at, fresh = at + span, False


def lzw_decode(data: bytes, min_size: int, limit: int | None = None) -> bytes:
    """Samples of a code stream; a list that begins with -1 goes on with the table before it. Reading ends after the list that reaches a limit."""
    base = [bytes((i,)) for i in range(1 << min_size)] + [b"", b""]
    out: list[bytes] = []
    put = out.append
    table, last = list(base), b""
    made, counted = 0, 0
    for codes in read_codes(data, min_size):
        if limit is not None:
            made, counted = made + sum(map(len, out[counted:])), len(out)
            if made >= limit:
                break
        if not codes:
            table, last = list(base), b""
            continue
        if codes[0] == -1:
            rest = codes[1:]
        else:
            table = list(base)
            if codes[0] >= len(base):
                raise ValueError("the first code is not a sample")
            last = table[codes[0]]
            put(last)
            rest = codes[1:]
        grow, size = table.append, len(table)
        for code in rest:
            if code < size:
                entry = table[code]
                if size < TABLE:
                    grow(last + entry[:1])
                    size += 1
            elif code == size and size < TABLE:
                entry = last + last[:1]
                grow(entry)
                size += 1
            else:
                raise ValueError("a code is beyond the table")
            put(entry)
            last = entry
    return b"".join(out)


def blocks(data: bytes) -> bytes:
    """A data stream as sub-blocks of at most 255 bytes."""
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(samples: bytes, width: int = WIDTH, delay_cs: int = 10, frame_rows: int = FRAME_ROWS) -> bytes:
    """Samples (a multiple of width) as a grey GIF of timed frames, drawn one over the other.

    A sample that the frame before has at the same place is written as transparent, unless a frame holds CLEAR_SAMPLE itself.
    The last frame before a key frame is disposed of to the background, others stay.
    """
    size = frame_rows * width
    n = max(1, -(-len(samples) // size))
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(len(samples) // width, frame_rows), 0xF7, 0, 0), GREYS]
    shown = b""
    for index in range(n):
        part = samples[index * size : (index + 1) * size]
        disposal = 2 if index % KEY_FRAMES == KEY_FRAMES - 1 else 1
        delta = bool(index % KEY_FRAMES) and CLEAR_SAMPLE not in part
        drawn = part
        if delta:
            now, before = (np.frombuffer(x, np.uint8, count=len(part)) for x in (part, shown))
            drawn = np.where(now == before, CLEAR_SAMPLE, now).astype(np.uint8).tobytes()
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | delta, delay_cs, CLEAR_SAMPLE if delta else 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(blocks(pack_codes(lzw_codes(drawn))))
        shown = part + shown[len(part) :]
    return b"".join([*out, b"\x3b"])


def sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def row_order(height: int) -> np.ndarray:
    """Rows of an interlaced image in the order in which they are stored."""
    return np.concatenate([np.arange(lo, height, step) for lo, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[dict]:
    """Timed frames as shown: rgba of the whole canvas, delay in ms, disposal and the frame's own rectangle."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared = 13, None
    if flags & 0x80:
        size = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, count=3 * size, offset=at).reshape(-1, 3)
        at += 3 * size
    if width * height > MAX_PIXELS:
        raise ValueError("the canvas is too large")
    canvas: np.ndarray | None = None
    disposal, delay, clear_index, index = 0, 0, -1, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, clear_at = struct.unpack("<BHB", data[at + 3 : at + 7])
                disposal, clear_index = packed >> 2 & 7, clear_at if packed & 1 else -1
            _, at = sub_blocks(data, at + 2)
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if packed & 0x80:
            size = 2 << (packed & 7)
            palette = np.frombuffer(data, np.uint8, count=3 * size, offset=at).reshape(-1, 3)
            at += 3 * size
        if palette is None:
            raise ValueError("no palette")
        stream, end = sub_blocks(data, at + 1)
        if left + w > width or top + h > height:
            raise ValueError("the image does not fit its canvas")
        samples = np.frombuffer(lzw_decode(stream, data[at], w * h), np.uint8)
        at = end
        if len(samples) < w * h:
            raise ValueError("the image does not fill its rectangle")
        if canvas is None:
            canvas = np.zeros((height, width, 4), np.uint8)
        pixels = samples[: w * h].reshape(h, w)
        if packed & 0x40:
            straight = np.empty_like(pixels)
            straight[row_order(h)] = pixels
            pixels = straight
        if len(palette) < 256 and pixels.size and pixels.max() >= len(palette):
            raise ValueError("a sample is beyond the palette")
        before = canvas.copy() if disposal == 3 else None
        spot = canvas[top : top + h, left : left + w]
        if clear_index < 0:
            spot[..., :3] = palette[pixels]
            spot[..., 3] = 255
        else:
            seen = pixels != clear_index
            spot[seen, :3] = palette[pixels[seen]]
            spot[seen, 3] = 255
        yield {"frame_index": index, "delay_ms": delay * 10, "disposal": disposal, "left": left, "top": top, "width": w, "height": h, "rgba": canvas}
        if disposal == 2:
            spot[...] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear_index, index = 0, 0, -1, index + 1
    raise ValueError("no trailer")


def histogram(rgba: np.ndarray, bins: int = 4) -> list[int]:
    """Counts of the visible pixels by colour, bins to each of red, green and blue."""
    flat = rgba.reshape(-1, 4)
    level = flat[:, :3].astype(np.int64) * bins >> 8
    code = (level[:, 0] * bins + level[:, 1]) * bins + level[:, 2]
    return np.bincount(code[flat[:, 3] > 0], minlength=bins**3).tolist()


FRAME_SCHEMA = "media_id bigint, frame_index int, at_ms long, delay_ms long, disposal int, width int, height int, rgba binary, histogram array<long>, error string"


def frames(df: DataFrame, id_col: str = "media_id", gif_col: str = "gif", bins: int = 4) -> DataFrame:
    """One row per shown frame of each GIF, with its time, pixels and colour histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, gif in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, error = 0, None
                try:
                    for f in decode(gif or b""):
                        canvas = f["rgba"]
                        row = {"media_id": key, "frame_index": f["frame_index"], "at_ms": start, "delay_ms": f["delay_ms"], "disposal": f["disposal"], "width": canvas.shape[1], "height": canvas.shape[0], "rgba": canvas.tobytes(), "histogram": histogram(canvas, bins), "error": None}
                        start += f["delay_ms"]
                        yield pa.RecordBatch.from_pylist([row], schema=FRAME_ARROW)
                except (ValueError, IndexError, struct.error) as e:
                    error = str(e) or type(e).__name__
                if error:
                    yield pa.RecordBatch.from_pylist([{"media_id": key, "error": error}], schema=FRAME_ARROW)

    return df.select(F.col(id_col).cast("bigint").alias("media_id"), F.col(gif_col).cast("binary").alias("gif")).mapInArrow(run, FRAME_SCHEMA)


FRAME_ARROW = pa.schema([("media_id", pa.int64()), ("frame_index", pa.int32()), ("at_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])

MEDIA_SCHEMA = "doc_id bigint, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long, frames array<struct<at_ms:bigint,delay_ms:bigint,disposal:int,rows:int,histogram:array<bigint>>>"
MEDIA_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "payload_bytes")), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("duration_ms", pa.int64()), ("frames", pa.list_(pa.struct([("at_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("rows", pa.int32()), ("histogram", pa.list_(pa.int64()))])))])


def text_record(data: bytes) -> tuple:
    """Stores a text's padded bytes as a GIF, reads them back from the canvas of each timed frame, and describes them."""
    gif = encode(data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data)))
    digest, tail, total, counts, time, shown = hashlib.sha256(), b"", 0, np.zeros(16, np.int64), 0, []
    for f in decode(gif):
        part = np.ascontiguousarray(f["rgba"][: f["height"], : f["width"], 0])
        colours = np.bincount(part.ravel() >> 4, minlength=16)
        counts += colours
        raw = part.tobytes()
        digest.update(raw)
        shown.append({"at_ms": time, "delay_ms": f["delay_ms"], "disposal": f["disposal"], "rows": f["height"], "histogram": colours})
        tail, total, time = raw[-64:], total + len(raw), time + f["delay_ms"]
    feature = f"{WIDTH}x{total // WIDTH};" + ",".join(map(str, counts.tolist()))
    return len(data), total, digest.hexdigest(), zlib.crc32(tail), len(gif), hashlib.sha256(gif).hexdigest(), feature, len(shown), time, shown


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored form of every whole text and what is read back from it; no shuffle, one pass."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").cast(pa.binary()).to_pylist()
        columns = zip(*map(text_record, texts), strict=True)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t.type) for c, t in zip(columns, list(MEDIA_ARROW)[1:], strict=True))], schema=MEDIA_ARROW)

    return map_slices(documents(df, id_col, text_col), run, MEDIA_SCHEMA)
