"""Phrase collocations mined by Apriori passes, one for each phrase length.

Pass k counts the phrases of k words whose two overlapping parts of k - 1 words are both frequent. The
frequent parts are broadcast as bits of their hashes: 16 bits a part, 2 ** MAX_BITS (32 MB) at most whatever
their number. A bit that is set by chance lets a rarer phrase through, which its exact count then drops, so
no result rests on the hashes. Phrases are counted by their words, in a task first and then in Spark.
Cuts are scored from the tables of all lengths by joins, in decimals, and so are phrases inside longer ones.

Words are what blanks part, lower-cased in A-Z alone; `[.,;:!?]` and line ends part pieces, and no phrase
crosses them. Everything is per language.

Defined results: a null text counts as empty; a null language is `und`, together with one so named; rows
are counted as often as they occur, whatever their ids; texts of any length are read whole; ties of cuts go
to the smallest first part, ties of rank to the smaller phrase by its bytes; other columns are not read;
an empty table, or one without frequent phrases, gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import slices, written

#: The contract's: longest phrase, least count, share of a longer phrase, phrases of a language.
WORDS = 4
LEAST = 30
INSIDE = 80
TOP = 2000
MAX_BITS = 28
#: Tokens that a task gathers before it gives its counts.
FLUSH = 4_000_000
#: Bytes that are parted into words at once.
WINDOW = 4 << 20

#: 0xFF stands in no UTF-8 text: it marks the end of a piece.
END = b"\xff"
BYTES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
GAP = re.compile(rb"[ \xff]")
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
#: Bits of one of Spark's bitmaps.
BITMAP = 32768


class Vocabulary(dict):
    """Numbers of words in the order met; 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({END: 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def hashed(self) -> np.ndarray:
        """xxhash64(lang, word) of every word, as Spark has it."""
        new = list(self)[len(self.hashes) :]
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w, self.seed) for w in new], np.uint64)])
        return self.hashes


def numbered(data: bytes, words: Vocabulary) -> Iterator[np.ndarray]:
    """Numbers of the words and piece ends of a text, in windows that end at a gap."""
    data = data.translate(BYTES)
    at = 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            gap = GAP.search(data, end)
            end = gap.start() if gap else len(data)
        tokens = data[at:end].replace(END, b" \xff ").split()
        yield np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))
        at = end


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words: each word turns what came before by 13 bits."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = ((out << np.uint64(13)) | (out >> np.uint64(51))) ^ hashes[j : n + j]
    return out


def gram_hash(lang: Column, phrase: Column) -> Column:
    """The same in Spark."""
    return F.aggregate(F.split(phrase, " "), F.lit(0).cast("bigint"), lambda h, w: F.shiftleft(h, 13).bitwiseOR(F.shiftrightunsigned(h, 51)).bitwiseXOR(F.xxhash64(lang, w)))


def places(ids: np.ndarray, words: Vocabulary, k: int, bits: np.ndarray | None) -> np.ndarray:
    """Where a phrase of k words starts of which both parts of k - 1 words may be frequent."""
    if k == 1:
        return np.flatnonzero(ids)
    part = rolled(words.hashed()[ids], k - 1)
    at = (part & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    good = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    for j in range(k - 1):
        good &= ids[j : len(good) + j] > 0
    return np.flatnonzero(good[:-1] & good[1:])


def counted(ids: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(one start of each distinct phrase, its count), exact: equal numbers of words are equal words."""
    key = ids[start].astype(np.int64)
    for j in range(1, k):
        if j > 1:  # what came before as one number again
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key << 32 | ids[start + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return start[first], n


def batches_of(lang: str, words: Vocabulary, ids: np.ndarray, k: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if k == 1:  # the row of the empty phrase counts all words
        yield pa.RecordBatch.from_pydict({"lang": [lang], "phrase": [""], "f": [int(np.count_nonzero(ids))]}, schema=COUNTS)
    start, n = counted(ids, places(ids, words, k, bits), k)
    spelled = pa.array([b"", *list(words)[1:]], pa.binary()).cast(pa.string())
    for at in range(0, len(start), 500_000):
        here = start[at : at + 500_000]
        parts = [spelled.take(pa.array(ids[here + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(here)), phrase, pa.array(n[at : at + 500_000])], schema=COUNTS)


def frequent(docs: DataFrame, k: int, bits: bytes | None, least: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of k words with f >= least, and for k = 1 each language's number of words under the empty phrase."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if held.value is None else np.frombuffer(held.value, np.uint8)
        words: dict[str, Vocabulary] = {}
        gathered: dict[str, list[np.ndarray]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for lang, parts in gathered.items():
                yield from batches_of(lang, words[lang], np.concatenate(parts), k, known)
            gathered.clear()
            words.clear()

        for batch in batches:
            for part in slices(batch):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    own = words.get(lang)
                    if own is None:
                        own = words[lang] = Vocabulary(lang)
                    for ids in numbered(END.join([*texts, b""]), own):
                        gathered.setdefault(lang, []).append(ids)
                        size += len(ids)
                if size >= FLUSH:
                    yield from given()
                    size = 0
        yield from given()

    counts = docs.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return written(counts.where((F.col("f") >= least) | (F.col("phrase") == "")))


def bits_of(level: DataFrame) -> bytes | None:
    """The hashes of a level's phrases as bits; None if it has none. 8192 bitmaps of 4 KB at most reach the driver."""
    n = level.count()
    if not n:
        return None
    size = 1 << min(max((16 * n - 1).bit_length(), 15), MAX_BITS)
    at = gram_hash(F.col("lang"), F.col("phrase")).bitwiseAND(size - 1) + 1
    maps = level.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(size // 8)
    for row in maps.collect():
        begin = (row["bucket"] - 1) * BITMAP // 8
        out[begin : begin + BITMAP // 8] = row["bits"]
    return bytes(out)


def levels(df: DataFrame, text_col: str, lang_col: str, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and the table of each phrase length, as far as there are frequent phrases."""
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = frequent(docs, 1, None, least)
    found = [words.where("phrase != ''")]
    while len(found) < longest and (bits := bits_of(found[-1])):
        found.append(frequent(docs, len(found) + 1, bits, least))
    return words.where("phrase = ''").select("lang", F.col("f").alias("n")), found


def run_of(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def inner(words: Column, k: int) -> Column:
    """All runs of 2 to k - 1 of k words."""
    return F.array(*(run_of(words, i + 1, size) for size in range(2, k) for i in range(k - size + 1)))


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = WORDS, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """The first phrases of each language by the score of their weakest cut."""
    n, found = levels(df, text_col, lang_col, longest, least)
    counts = found[0]
    for level in found[1:]:
        counts = counts.unionByName(level)
    words = F.split("phrase", " ")
    cuts = [level.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), run_of(words, 1, c).alias("left"), run_of(words, c + 1, k - c).alias("right")) for c in range(1, k)))).alias("c")) for k, level in enumerate(found, 1) if k > 1]
    result = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    if not cuts:
        empty = F.lit(None).cast("bigint")
        return n.where("false").select("lang", empty.alias("rank"), F.lit("").alias("phrase"), *(empty.alias(c) for c in "alr"), "n", empty.alias("score")).select(*result)
    cut = cuts[0]
    for more in cuts[1:]:
        cut = cut.unionByName(more)
    cut = cut.select("lang", "phrase", "a", "c.*")
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))
    longer = [level.select("lang", F.explode(inner(words, k)).alias("phrase"), "f") for k, level in enumerate(found, 1) if k > 2]
    if longer:
        held = longer[0]
        for more in longer[1:]:
            held = held.unionByName(more)
        held = held.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
        scored = scored.join(held, ["lang", "phrase"], "left").where(f"held IS NULL OR cast(100 as decimal(10,0)) * cast(held as decimal(20,0)) < cast({inside} as decimal(10,0)) * cast(a as decimal(20,0))")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase"))
    first = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))
