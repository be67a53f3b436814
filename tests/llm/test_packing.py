"""Pieces: every id once, gapless places, ids of the library, little padding."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import frame, rows
from tokenizers import Tokenizer

from procura.llm import packing


def check(pieces: list, top: int, tasks: int, texts: list[tuple[int | None, str]], library) -> None:
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        documents[p["doc_id"]].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= top and s[0]["tier"] <= top
    used = {k: sum(p["length"] for p in s) for k, s in sequences.items()}
    short = sum(v < s[0]["tier"] for (k, v), s in zip(used.items(), sequences.values()))
    assert short <= tasks
    assert {v & v - 1 for k, v in used.items() if v == sequences[k][0]["tier"]} <= {0}
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in documents[doc_id] if p["doc_tokens"] == len(ids)), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) % len(ids) == 0 and own
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            if sum(1 for k, _ in texts if k == doc_id) == 1:
                assert p["ids_crc32"] == zlib.crc32(part)
        if sum(1 for k, _ in texts if k == doc_id) == 1:
            at = 0
            for p in own:
                assert p["start"] == at
                at += p["length"]
            assert at == len(ids)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("tiers", [packing.TIERS, (8, 32)])
def test_documents(spark, library, tiers):
    df = frame(spark, partitions=3)
    check(packing.pack(df, tiers=tiers).collect(), max(tiers), 3, [(k, t) for k, t, *_ in rows()], library)
    assert packing.pack(df.limit(0)).collect() == []


def test_pools_go_on_in_the_next(library):
    """The packer by itself, packed often; step groups hold equal tokens of one tier."""
    r = random.Random(8)
    packer = packing.Packer((8, 16, 64), 128, 0)
    sizes = {}
    for doc in range(3000):
        n = sizes[doc] = r.choice([1, 3, 7, 8, 15, 16, 40, 64, 65, 300])
        packer.add(doc, np.arange(n, dtype="<u4").tobytes())
        if packer.held >= 700:
            packer.pack(last=False)
    packer.pack(last=True)
    covered = defaultdict(int)
    filled, tier, groups = defaultdict(int), {}, defaultdict(set)
    for doc, start, length, crc, n, sequence, at, t, group in packer.rows:
        assert crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes()) and n == sizes[doc]
        covered[doc] += length
        filled[sequence] += length
        tier[sequence] = t
        groups[group].add(sequence)
    assert covered == sizes
    assert sum(filled[s] < tier[s] for s in tier) <= 1
    for members in groups.values():
        assert len({tier[s] for s in members}) == 1 and sum(tier[s] for s in members) <= 128


def test_rests_of_long_documents_keep_their_own_ids_alone():
    packer = packing.Packer(packing.TIERS, packing.STEP, 0)
    for doc in range(200):
        packer.add(doc, bytes(4 * 204_801))
        packer.rows.clear()
    assert sum(len(p[2][1]) for waiting in packer.waiting.values() for p in waiting) == 200 * 4
    for doc in range(100_000):  # very short documents fill a pool, too
        packer.add(doc, bytes(4))
    assert packer.held >= packing.POOL


def test_words_at_odd_blanks(library):
    own, r = packing.tokens(packing.default_path()), random.Random(3)
    blanks = [" ", "  ", "   ", "\n", "\n ", " \n  ", "\u3000 ", "\xa0 ", "\x1c ", "\x85 ", "\t"]
    for _ in range(3000):
        text = "".join(r.choice(blanks) + r.choice(["word", "Ünï", "漢字", "it's", "9", "...", "", "x\x1cy"]) for _ in range(r.randint(0, 9)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_whole_table(spark, library, sf_dir):
    from procura.llm.queries import queries

    df = queries()["op6_hierarchical_packing"](spark, sf_dir)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(df.collect(), 2048, df.rdd.getNumPartitions(), docs, library)
