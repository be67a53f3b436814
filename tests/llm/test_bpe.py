"""Ids and texts against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from fixtures import frame, rows
from tokenizers import Tokenizer

from procura.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts() -> list[str]:
    r = random.Random(4)
    pools = ["abc ", "aeiou th'srd ", " \n\t ", "0123456789.,", "漢字かな", "🎉👩‍👩‍👧é́", "!?#-_=", "ABCabc'S'LL ", "‍﻿\x00\x7f"]
    made = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    return made + ["a" * 5000, " " * 3000, "ab" * 2000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endo", "===" * 700]


def test_ids_and_texts(library):
    own = bpe.encoder(PATH)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), "<u4").tolist()
        assert got == ids, text
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_broken_bytes_decode_alike(library):
    own, r = bpe.encoder(PATH), random.Random(9)
    for _ in range(2000):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 6))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    want = []
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    df = frame(spark)
    assert sorted(map(tuple, bpe.round_trip(df).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(df.limit(0)).collect() == []
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((k, t or "") for k, t, *_ in rows()), key=repr)


def test_whole_table(spark, library, sf_dir):
    from procura.llm.queries import queries

    got = {r["doc_id"]: r for r in queries()["op9_bpe_round_trip"](spark, sf_dir).collect()}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
