"""GIF: byte-exact round trips, a plain LZW reader beside the one in use, and the rules of frames."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from fixtures import frame, rows

from procura.llm import gif_media as g


def plain_lzw(data: bytes, min_size: int) -> bytes:
    """Bit by bit, as the format is described."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, at, out = 1 << min_size, 0, b""
    table: list[bytes] = []
    last, width = b"", min_size + 1
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, last, width = [bytes([i]) for i in range(clear)] + [b"", b""], b"", min_size + 1
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code < len(table) else last + last[:1]
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, last = out + entry, entry


@pytest.mark.parametrize("data", [b"\0" * 64, bytes(range(256)) * 40, b"abcabcabc" * 500, random.Random(1).randbytes(9000), "très ünï".encode() * 800])
def test_streams_are_what_the_format_says(data):
    packed = g.pack_codes(g.lzw_codes(data))
    assert plain_lzw(packed, 8) == data == g.lzw_decode(packed, 8)


def test_a_full_table_is_used_until_the_next_clear_code():
    """A stream without clear codes after the first: the table stays at 4096 entries."""
    data = random.Random(2).randbytes(12_000)
    table, codes, prefix = {bytes([i]): i for i in range(256)}, [256], b""
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        codes.append(table[prefix])
        if len(table) < 4096 - 2:
            table[prefix + bytes([b])] = len(table) + 2
        prefix = bytes([b])
    codes += [table[prefix], 257]
    width, free, bits = 9, 258, ""
    for i, c in enumerate(codes):
        bits += f"{c:0{width}b}"[::-1]
        if i > 1 and free < 4096:
            free += 1
            width = min(12, max(width, free.bit_length()))
    bits += "0" * (-len(bits) % 8)
    packed = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert g.lzw_decode(packed, 8) == data


def image(samples: bytes, left: int, top: int, w: int, h: int, control: bytes = b"", flags: int = 0, palette: bytes = b"") -> bytes:
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + palette + b"\x02" + g.blocks(g.pack_codes(g.lzw_codes(samples, 2), 2))


def control(disposal: int, delay: int, clear: int | None = None) -> bytes:
    return b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
HEAD = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + PALETTE


def shown(gif: bytes) -> list[list]:
    return [f["rgba"].reshape(-1, 4).tolist() for f in g.decode(gif)]


def test_disposal_and_transparency():
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    full = image(bytes([1] * 4), 0, 0, 2, 2, control(1, 5))
    restore = image(bytes([2, 0]), 0, 0, 2, 1, control(3, 7, clear=0))
    clear = image(bytes([3]), 1, 1, 1, 1, control(2, 0))
    after = image(bytes([2]), 0, 1, 1, 1, control(0, 9))
    got = shown(HEAD + full + restore + clear + after + b"\x3b")
    assert got == [[red] * 4, [green, red, red, red], [red, red, red, blue], [red, red, green, none]]


def test_interlace_and_own_palette():
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 9, 0, 0, 0)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    values = [i % 4 for i in range(9)]
    data = image(bytes(values[i] for i in order), 0, 0, 1, 9, flags=0xC1, palette=PALETTE)
    (frame_,) = g.decode(head + data + b"\x3b")
    assert [PALETTE[3 * v : 3 * v + 3] for v in values] == [bytes(p[:3]) for p in frame_["rgba"].reshape(-1, 4).tolist()]


def test_frames_over_rows(spark):
    gif = HEAD + image(bytes([1] * 4), 0, 0, 2, 2, control(1, 5)) + image(bytes([2]), 0, 0, 1, 1, control(1, 7)) + b"\x3b"
    df = spark.createDataFrame([(1, gif), (2, None), (3, b"GIF89a broken"), (4, gif[:40])], "media_id bigint, gif binary")
    got = sorted(g.frames(df).select("media_id", "frame_index", "at_ms", "delay_ms", "histogram", "error").collect(), key=lambda x: (x[0], x[1] or 0))
    assert [(r[0], r[1], r[2], r[3]) for r in got if r[5] is None] == [(1, 0, 0, 50), (1, 1, 50, 70)]
    assert [sum(r[4]) for r in got if r[5] is None] == [4, 4]
    assert {r[0] for r in got if r[5] is not None} == {2, 3, 4}
    assert g.frames(df.where("media_id > 9")).collect() == []


def test_documents(spark):
    got = {}
    for r in g.text_media(frame(spark)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows())
    for doc_id, text, *_ in rows():
        data = (text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        want = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert any((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want for r in got[doc_id])
        stored = g.encode(payload)
        assert any(r["media_sha256"] == hashlib.sha256(stored).hexdigest() and r["media_bytes"] == len(stored) for r in got[doc_id])
        assert np.frombuffer(b"".join(f["rgba"][: f["height"], :, 0].tobytes() for f in g.decode(stored)), np.uint8).tobytes() == payload
        want_frames = [payload[i : i + 4096] for i in range(0, len(payload), 4096)]
        for r in got[doc_id]:
            if r["payload_sha256"] != want[2]:
                continue
            counts = [sum(x >> 4 == c for x in payload) for c in range(16)]
            assert r["feature"] == f"64x{len(payload) // 64};" + ",".join(map(str, counts))
            assert [(f["at_ms"], f["delay_ms"], f["disposal"], f["rows"], sum(f["histogram"])) for f in r["frames"]] == [(100 * i, 100, 2 if i % 8 == 7 else 1, len(x) // 64, len(x)) for i, x in enumerate(want_frames)]
            assert [sum(f["histogram"][c] for f in r["frames"]) for c in range(16)] == counts and r["n_frames"] == len(want_frames) and r["duration_ms"] == 100 * len(want_frames)
    assert g.text_media(frame(spark).limit(0)).collect() == []


def test_frames_are_drawn_over_each_other():
    """What is as before is transparent; a frame with the clear sample itself is drawn whole."""
    a, b = bytes(range(200)) * 21, bytes(range(200)) * 21
    payload = (a[:4096] + b[:4000] + bytes(96) + bytes([255] * 4096) + a[:640] + bytes(4096) * 9)
    gif = g.encode(payload)
    shown = [(f["disposal"], f["rgba"][: f["height"], :, 0].tobytes()) for f in g.decode(gif)]
    assert b"".join(x for _, x in shown) == payload and [d for d, _ in shown] == [1] * 7 + [2] + [1] * (len(shown) - 8)
    assert len(g.encode(a[:4096] * 7)) < 2 * len(g.encode(a[:4096]))
    controls = [gif[i + 3] for i in range(len(gif)) if gif[i : i + 3] == b"\x21\xf9\x04"]
    assert controls[:3] == [1 << 2, 1 << 2 | 1, 1 << 2]


def test_hostile_files():
    """Sizes that are only claimed cost no memory."""
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x81, 0, 0) + PALETTE + b"\x3b"
    wide = b"GIF89a" + struct.pack("<HHBBB", 5000, 5000, 0x81, 0, 0) + PALETTE + image(bytes(4), 0, 0, 5000, 5000) + b"\x3b"
    bomb = HEAD + image(bytes(30_000_000), 0, 0, 2, 2) + b"\x3b"
    for gif, reason in ((huge, "too large"), (wide, "does not fill")):
        with pytest.raises(ValueError, match=reason):
            list(g.decode(gif))
    assert len(list(g.decode(bomb))) == 1
