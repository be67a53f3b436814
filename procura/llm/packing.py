"""Hierarchical multi-length packing of documents into token sequences.

Every document's ids (and an end id) are routed to the smallest context-size tier that holds them;
longer ones give whole windows of the largest tier and a rest that is routed. Each tier is packed by
best fit, longest piece first; gaps of long windows are filled with whole pieces of the same or of
shorter tiers and, if none fits, with a cut from one. Sequences of one tier are put into step groups of
equal tokens. Work stays in the task that reads the texts: nothing is shuffled, a pool of bounded
tokens is held at a time and what is left of it goes on into the next pool.

Defined results: a null text counts as empty and packs the end id alone; rows with the same doc_id are
packed separately; other columns are not read; an empty table gives an empty table. Only a task's last
sequence can be padded.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Words, byte_letters, default_path
from .common import documents, held, slices

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that are packed together, and tokens of a step group.
POOL = 1 << 22
#: What a waiting piece counts besides its tokens, for its memory.
PIECE = 64
STEP = 8 * 2048

SCHEMA = "doc_id bigint, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("tier", pa.int32()), ("step_group", pa.int64())])


class Tokens:
    """Ids by the tokenizers library: its model is asked for new words of the byte-level pattern, the whole of it for texts with special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters, model = {b: c for c, b in byte_letters().items()}, self.library.model

        def ids(piece: str) -> bytes:
            found = model.tokenize(piece.encode().decode("latin-1").translate(letters))
            return array("I", [t.id for t in found]).tobytes()

        self.words = Words(ids)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.words(text)


def tokens(path: str) -> Tokens:
    return held("library tokens", path, make=lambda: Tokens(path))


class Packer:
    """Packs pieces (length, order, doc, start) of one task. A doc is (doc_id, ids as bytes, number of ids, number of them before these)."""

    def __init__(self, tiers: tuple[int, ...], step: int, first_id: int):
        self.tiers, self.step = tuple(sorted(tiers)), step
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.held = self.pieces = 0
        self.sequence = self.group = first_id
        self.groups: dict[int, list[int]] = {}
        self.rows: list[tuple] = []

    def piece(self, doc: tuple, start: int, length: int) -> tuple:
        self.pieces += 1
        return length, self.pieces, doc, start

    def route(self, piece: tuple) -> None:
        """Keeps the pieces of a tier in order of their lengths."""
        insort(self.waiting[next(t for t in self.tiers if t >= piece[0])], piece)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        top, doc = self.tiers[-1], (doc_id, ids, len(ids) // 4, 0)
        whole = doc[2] // top * top
        for start in range(0, whole, top):
            self.emit([self.piece(doc, start, top)], top)
        if doc[2] > whole:
            # what waits keeps the ids of the rest alone
            self.route(self.piece((doc_id, ids[4 * whole :], doc[2], whole), whole, doc[2] - whole))
            self.held += doc[2] - whole + PIECE

    def emit(self, window: list, tier: int) -> None:
        """Writes a sequence and gives it to the open step group of its tier."""
        group = self.groups.setdefault(tier, [self.group, 0])
        self.group += group[0] == self.group
        at = 0
        for length, _, (doc_id, ids, n, base), start in window:
            self.rows.append((doc_id, start, length, zlib.crc32(ids[4 * (start - base) : 4 * (start - base + length)]), n, self.sequence, at, tier, group[0]))
            at += length
        self.sequence += 1
        group[1] += tier
        if group[1] >= self.step:
            del self.groups[tier]

    def best_fit(self, pieces: list, tier: int) -> list[list]:
        """[room, pieces] of windows by best fit, longest piece first; the fullest come first."""
        rooms: dict[int, list] = {}
        order: list[int] = []
        for piece in reversed(pieces):
            at = bisect_left(order, piece[0])
            if at < len(order):
                room = order[at]
                window = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, window = tier, []
            window.append(piece)
            left = room - piece[0]
            if left not in rooms:
                rooms[left] = []
                insort(order, left)
            rooms[left].append(window)
        return [[room, w] for room in order for w in rooms[room]]

    def cut(self, piece: tuple, length: int) -> tuple[tuple, tuple]:
        return self.piece(piece[2], piece[3], length), self.piece(piece[2], piece[3] + length, piece[0] - length)

    def from_shorter(self, room: int, tier: int) -> tuple | None:
        """The longest piece of a shorter tier that fits, else a part of the shortest there is."""
        shorter = [t for t in self.tiers if t < tier and self.waiting[t]]
        for t in reversed(shorter):
            if at := bisect_left(self.waiting[t], (room + 1,)):
                return self.waiting[t].pop(at - 1)
        if not shorter:
            return None
        part, rest = self.cut(self.waiting[shorter[0]].pop(0), room)
        self.route(rest)
        return part

    def pack(self, last: bool) -> None:
        """Packs what waits, from the longest tier to the shortest; less than the shortest tier can stay."""
        for tier in reversed(self.tiers):
            pieces, self.waiting[tier] = self.waiting[tier], []
            gaps = []
            for room, window in self.best_fit(pieces, tier):
                while room and (piece := self.from_shorter(room, tier)):
                    window.append(piece)
                    room -= piece[0]
                if room:
                    gaps.append((room, window))
                else:
                    self.emit(window, tier)
            # no shorter pieces are left: the emptiest windows are taken apart for the fullest
            loose: list[tuple] = []
            while gaps:
                room, window = gaps.pop(0)
                while room and (loose or gaps):
                    if not loose:
                        loose = gaps.pop()[1]
                    piece = loose.pop()
                    if piece[0] > room:
                        piece, rest = self.cut(piece, room)
                        loose.append(rest)
                    window.append(piece)
                    room -= piece[0]
                if room:
                    loose = window
                else:
                    self.emit(window, tier)
            if tier != self.tiers[0]:
                for piece in loose:
                    self.route_below(piece, tier)
            elif last and loose:
                self.emit(loose, tier)
            else:
                self.waiting[tier] = sorted(loose)
        self.held = sum(p[0] for p in self.waiting[self.tiers[0]])

    def route_below(self, piece: tuple, tier: int) -> None:
        """A rest of a tier goes to the shorter ones, cut to their sizes where it is too long."""
        below = max(t for t in self.tiers if t < tier)
        while piece[0] > below:
            part, piece = self.cut(piece, below)
            self.route(part)
        self.route(piece)


def pack(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """One row per piece, with its sequence, its place in it, the sequence's tier and its step group."""
    path = path or default_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, step, TaskContext.get().partitionId() << 33)
        t = tokens(path)

        def rows() -> pa.RecordBatch:
            made, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packer.add(doc_id, t.encode(text) + end)
                    if packer.held >= POOL:
                        packer.pack(last=False)
                if len(packer.rows) >= 20_000:
                    yield rows()
        packer.pack(last=True)
        if packer.rows:
            yield rows()

    return documents(df, id_col, text_col).mapInArrow(run, SCHEMA)
