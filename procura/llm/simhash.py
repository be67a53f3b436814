"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of distinct value are dealt out by the blocks of their bits: of radius + 1 blocks, two
fingerprints within the radius share one, so no link is lost. Inside a block they are sorted by their
population counts and compared tile against tile with exclusive-or and bit counts; tile pairs whose
counts differ by more than the radius are skipped. Blocks with many fingerprints are split into pairs
of chunks. A task gives only links that join two of its groups, so links stay in proportion to rows.

Defined results: a null text counts as empty and has fingerprint zero, which is linked like any other;
fewer words than a shingle make one shingle; rows with equal doc_id get the result of their own text;
a null doc_id is never the smallest one, unless all of a group are null; other columns are not read;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, groups, map_slices, partitions, written
from .graph import components

WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a chunk of one block, and of a tile.
CHUNK = 16384
TILE = 256

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words: int = WORDS) -> int:
    """The majority of the bits of all shingles' hashes. bytes.split() parts at 0x20 and 0x09-0x0D."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and its 64 bits as a signed number; one pass, no shuffle."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return map_slices(documents(df, id_col, text_col), run, "doc_id bigint, fp bigint")


def tile_links(prints: np.ndarray, radius: int, tile: int = TILE) -> tuple[list[int], list[int]]:
    """Links between distinct fingerprints that join two groups, by tiles in order of population count."""
    ones = np.bitwise_count(prints)
    order = np.argsort(ones, kind="stable")
    prints, ones = prints[order], ones[order].astype(np.int64)
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left: list[int] = []
    right: list[int] = []
    for i in range(0, len(prints), tile):
        a, top = prints[i : i + tile], ones[min(i + tile, len(prints)) - 1]
        for j in range(i, len(prints), tile):
            if ones[j] - top > radius:
                break  # so are all tiles after it
            near = np.bitwise_count(a[:, None] ^ prints[None, j : j + tile]) <= radius
            for x, y in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
                p, q = root(i + x), root(j + y)
                if p != q:
                    parent[p] = q
                    left.append(i + x)
                    right.append(j + y)
    signed = prints.view(np.int64)
    return signed[left].tolist(), signed[right].tolist()


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within the radius."""
    spark = prints.sparkSession
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(-1 if hi - lo == 64 else (1 << (hi - lo)) - 1).alias("bits")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.block", "k.bits", "fp")
    # at most (radius + 1) * 2 ** ceil(64 / (radius + 1)) rows: 40,960 for a radius of 4
    many = dealt.groupBy("block", "bits").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("n"))
    dealt = dealt.join(F.broadcast(many) if radius >= 3 else many, ["block", "bits"])
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    partner = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda x: x != own))
    dealt = dealt.select("block", "bits", "fp", own.alias("own"), F.explode(partner).alias("other"))
    cell = ["block", "bits", "i", "j"]
    dealt = dealt.select("block", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []
        for _, rows in groups(batches, cell):
            if rows.num_rows > 1:
                a, b = tile_links(rows.column("fp").to_numpy().view(np.uint64), radius)
                left += a
                right += b
            if len(left) >= 50_000:
                yield pa.RecordBatch.from_pydict({"a": left, "b": right}, schema=LINK)
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_pydict({"a": left, "b": right}, schema=LINK)

    return dealt.repartition(partitions(spark), *cell).sortWithinPartitions(*cell).mapInArrow(run, "a bigint, b bigint")


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def classes(prints: DataFrame, radius: int, chunk: int) -> DataFrame:
    """(fp, root) of a table with column fp: fingerprints of one root can reach each other."""
    distinct = written(prints.select("fp").distinct())
    roots = components(links(distinct, radius, chunk))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Per document its fingerprint and the smallest doc_id that can be reached by links."""
    prints = written(fingerprints(df, id_col, text_col, words))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = written(classes(prints, radius, chunk).join(least, "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """The rows and columns of one document of each class: that of the smallest doc_id, a null id last.

    Of rows that agree in doc_id and text one stays.
    """
    key = "__simhash_key"
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    keyed = df.withColumn(key, mark)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(prints.view(np.int64))], names=["doc_id", "key", "fp"])

    texts = keyed.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(key).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    prints = written(map_slices(texts, run, "doc_id bigint, key string, fp bigint"))
    # the first of each fingerprint, then of each class: neither gathers a class
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first"))
    chosen = classes(prints, radius, chunk).join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = chosen.select(F.col("first.key").alias(key))
    return keyed.join(kept, key).dropDuplicates([key]).select(*df.columns)
