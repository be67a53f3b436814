"""Front-coded sorted suffix runs and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: A removed byte is covered by a repeated string of this length.
WINDOW = 100
#: Suffixes are taken where an anchor of this length begins; each window holds one.
ANCHOR = 32
SPREAD = WINDOW - ANCHOR
#: A key: its kind, the anchor and what follows, what stands before it backwards, and how much of both there is.
WIDTH = 1 + WINDOW + SPREAD + 2
NORMAL, HOT = 0, 1
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: in each window the leftmost of the least hashes.

    The choice depends on the window's bytes alone, so equal windows have their anchor at the same place.
    """
    found = [stretch(data[at : at + STRETCH + WINDOW - 1], at) for at in range(0, max(1, len(data) - WINDOW + 1), STRETCH)] if len(data) >= WINDOW else []
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(found) == 1:
        return found[0]
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def stretch(data: bytes, offset: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    power, size = ODD, 1
    while size < ANCHOR:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power & MASK, 2 * size
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h & np.uint64(MASK ^ 0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    size, span = 1, SPREAD + 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))]
    return at + offset, h[at]


def contexts(data: bytes, at: np.ndarray) -> np.ndarray:
    """Keys of the suffixes at these anchors, one row each."""
    raw = np.frombuffer(data, np.uint8)
    padded = np.concatenate([np.zeros(SPREAD, np.uint8), raw, np.zeros(SPREAD, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + SPREAD)[at]
    out = np.empty((len(at), WIDTH), np.uint8)
    out[:, 0] = NORMAL
    out[:, 1 : 1 + WINDOW] = around[:, SPREAD:]
    out[:, 1 + WINDOW : -2] = around[:, SPREAD - 1 :: -1][:, :SPREAD]
    out[:, -2] = 1 + np.minimum(at, SPREAD)
    out[:, -1] = 1 + np.minimum(len(raw) - at - ANCHOR, SPREAD)
    return out


def hot_windows(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and starts of every single window that holds one of these anchors."""
    starts = np.unique((at[:, None] - np.arange(SPREAD + 1)).ravel())
    starts = starts[(starts >= 0) & (starts <= len(data) - WINDOW)]
    out = np.zeros((len(starts), WIDTH), np.uint8)
    out[:, 0] = HOT
    out[:, 1 : 1 + WINDOW] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), WINDOW)[starts]
    out[:, -2:] = 1
    return out, starts


def planes(values: np.ndarray) -> bytes:
    """Integers by their bytes' places, compressed."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def join(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def split(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{n}I", data, 4)
    out, at = [], 4 + 4 * n
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def front_coded(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted rows, the length of the prefix shared with the row before, and the rest of each row."""
    shared = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return shared, keys[np.arange(keys.shape[1]) >= shared[:, None]].tobytes()


def rows(shared: np.ndarray, rest: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared, key) of every row of a front-coded run."""
    now, at = b"", 0
    for n in shared.tolist():
        size = WIDTH - n
        now = now[:n] + rest[at : at + size]
        at += size
        yield n, now


def common(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix; the first `at` bytes are known to be equal and are not looked at."""
    size = len(x)
    while at < size and x[at : at + 16] == y[at : at + 16]:
        at += 16
    while at < size and x[at] == y[at]:
        at += 1
    return min(at, size)


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """(prefix shared with the row before, key, run) of all rows of sorted runs, in order.

    Each run's head carries the prefix it shares with the last row given out. Of two heads the one that
    shares more is smaller, unseen; if they share the same, bytes are compared from there on only.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[bytes] = [b""] * width
    shared = [-1] * width
    iterators = [*runs, *[iter(())] * (width - len(runs))]

    def advance(run: int) -> None:
        head = next(iterators[run], None)
        shared[run], heads[run] = head if head else (-1, b"")

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then carries the prefix that it shares with the winner."""
        if shared[a] > shared[b]:
            return a, b
        if shared[a] < shared[b]:
            return b, a
        if shared[a] < 0:
            return a, b
        x, y = heads[a], heads[b]
        n = common(x, y, shared[a])
        if n == len(x) or x[n] < y[n]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * width

    def build(node: int) -> int:
        if node >= width:
            advance(node - width)
            shared[node - width] = min(shared[node - width], 0)
            return node - width
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while shared[winner] >= 0:
        yield shared[winner], heads[winner], winner
        advance(winner)
        node = (winner + width) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1
