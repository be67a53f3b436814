"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

A byte-pair encoding has one last token for every prefix of a piece. A suffix automaton over the
vocabulary lists the tokens that end at each byte; the one that is compatible with the last token of
the prefix before it is stored, and following these back-pointers from the end gives the ids. Two
tokens are compatible if merging by rank never joins bytes across their border. Pieces (words of the
byte-level pattern) repeat, so their ids are remembered in a cache of bounded size.

Defined results: a null text counts as empty and has no tokens; special tokens written in a text get
their own id, as the library does by default; repeated rows give repeated results; other columns of
the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, held, map_slices

#: Fixed value: the word pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of that pattern before a blank: such a blank is inside a run and no place to cut.
RUNS = tuple(c + " " for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
CUT = regex.compile(r"(?<!\s) ")
#: Signs that are a piece of their own after letters, in the pattern.
SIGNS = frozenset(".,;:!?)")
#: Pieces that a worker remembers (twice as many at most), and the longest one it does.
CACHE = 1 << 19
LONGEST = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def blank_separated(text: str) -> list[str]:
    """A text cut at blanks after anything but white space; the pattern joins nothing across the place before such a blank."""
    return CUT.split(text) if any(run in text for run in RUNS) else text.split(" ")


class Pieces(dict):
    """Ids of pieces as little-endian 32-bit bytes; a new piece is encoded. When full, what was used since the last time stays."""

    def __init__(self, encode, size: int = CACHE):
        super().__init__()
        self.encode, self.size = encode, size
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class WordIds(Pieces):
    """Ids of words after a blank. Letters are one piece, and so is a sign after them: such words are put together from what is remembered."""

    def __init__(self, encode, signs: dict[str, bytes]):
        super().__init__(encode)
        self.signs = signs

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in SIGNS and word[:-1].isalpha():
            return self[word[:-1]] + self.signs[word[-1]]
        return super().__missing__(word)


class Words:
    """Ids of whole texts from those of pieces. Blank-separated words are remembered too, so that the pattern runs over new ones only."""

    def __init__(self, encode):
        self.pieces = Pieces(encode)
        self.find = regex.compile(PATTERN).findall
        self.words = WordIds(lambda word: encode(" " + word) if word.isalpha() else self.cut(" " + word), self.pieces)

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def __call__(self, text: str) -> bytes:
        first, *others = blank_separated(text)
        return self.cut(first) + b"".join(map(self.words.__getitem__, others))


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        ids = {t: i for i, t in self.token.items() if i not in self.special.values()}
        self.size = max(self.token) + 1
        self.length = [len(self.token.get(i, b"")) for i in range(self.size)]
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        # merges by rank; ranks, not ids, say which merge comes first
        self.merged: dict[int, tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = [-1] * self.size
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (ids[bytes(letters[c] for c in x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids[self.token[left] + self.token[right]]
            self.merged[left * self.size + right] = (rank, whole)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
        self.fits: dict[int, bool] = {}
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = Words(self.piece_ids)

    def compatible(self, left: int, right: int) -> bool:
        """Whether bytes of two neighbouring tokens stay on their sides of the border.

        The merges that built the two tokens are undone from the last one on. If, with the halves
        that then meet at the border, a merge of earlier rank than the one just undone exists, it
        would have come first and crossed the border.
        """
        key = left * self.size + right
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, parts, merged = self.rank, self.parts, self.merged
        a, b, bound, bound_from_left = left, right, len(merged), False
        fits = True
        while True:
            across = merged.get(a * self.size + b)
            # a crossing merge goes before the undone one if its rank is smaller, and, at the same rank, if it stands further left
            if across is not None and (across[0] < bound or (across[0] == bound and not bound_from_left)):
                fits = False
                break
            if rank[a] < 0 and rank[b] < 0:
                break
            # at one rank the left merge was made first, so the right one is undone first
            if rank[a] > rank[b]:
                bound, bound_from_left, a = rank[a], True, parts[a][1]
            else:
                bound, bound_from_left, b = rank[b], False, parts[b][0]
        if len(self.fits) >= CACHE:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def piece_ids(self, piece: str) -> bytes:
        """The stored last token of every prefix, then the way back from the end."""
        text = piece.encode().decode("latin-1")
        n = len(text)
        last = [-1] * (n + 1)
        length, compatible = self.length, self.compatible
        for at, token in self.automaton.iter(text):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end] = token
        ids = []
        while n:
            ids.append(last[n])
            n -= length[last[n]]
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit bytes."""
        if not any(s in text for s in self.special):
            return self.words(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.words(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.words(text[at:])])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    return held("encoder", path, make=lambda: Encoder(path))


ENCODED = "doc_id bigint, ids array<int>"
DIGEST = "doc_id bigint, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids of every whole text."""
    path = path or default_path()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        ids = [np.frombuffer(e.encode(t), "<i4") for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_slices(documents(df, id_col, text_col), run, ENCODED)


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each list of ids (null: empty)."""
    path = path or default_path()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([e.decode(i or ()) for i in part.column(1).to_pylist()])], names=["doc_id", "text"])

    return map_slices(df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{ids_col}` ids"), run, "doc_id bigint, text string")


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of tokens and digests of its ids and of the text decoded from them."""
    path = path or default_path()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        e, rows = encoder(path), []
        for text in part.column("text").to_pylist():
            packed = e.encode(text)
            back = e.decode(np.frombuffer(packed, "<u4").tolist())
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        n, ids, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(documents(df, id_col, text_col), run, DIGEST)
