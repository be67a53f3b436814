"""Collocations against counting all phrases in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import SCHEMA, frame, rows
from pyspark.sql import functions as F

from procura.llm import collocations
from procura.llm.collocations import Vocabulary, numbered


def plain(data, least: int, top: int = 2000, inside: int = 80) -> Counter:
    f: dict[str, Counter] = {}
    total: Counter = Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out: Counter = Counter()
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in wanted.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in wanted.items()):
                continue
            score, _, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out[lang, rank, phrase.decode(), -a, left, right, total[lang], -score] += 1
    return out


def found(df) -> Counter:
    return Counter(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed: int, n: int = 200):
    r = random.Random(seed)
    vocabulary = ["New", "york", "New\tYork city", "état", "ÉTAT", "a", "b", "c", "d", "the", "of", "漢字", "x\xa0y", "\x00", "end.", "so,", "why?", "line\nbreak", "\x0b", "\x0c", "\r\n", "\x1c", "\x85", "word;"]
    return [(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und", "en", "en"])) for _ in range(n)]


def table(spark, data, partitions: int = 5):
    return frame(spark, [(i % 50, t, lang, "s", 1, "k", 1, 1, None) for i, (t, lang) in enumerate(data)], partitions)


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (12, 15)])
def test_against_counting(spark, least, top):
    data = texts(1) + [(None, "en"), ("", None), ("alone", "fr")] * 3 + [("copied words stand here again and again", "en")] * 40
    assert found(collocations.mine(table(spark, data), least=least, top=top)) == plain(data, least, top)


def test_small_windows_and_flushes(spark, monkeypatch):
    """Texts longer than a window, and tasks that give their counts after every text."""
    monkeypatch.setattr(collocations, "FLUSH", 10)
    data = texts(2) + [("one two three four. " * 3000, "en"), ("longword" * 5000, "en")]
    assert found(collocations.mine(table(spark, data), least=20)) == plain(data, 20)
    whole = list(np.concatenate(list(numbered(data[-2][0].encode(), Vocabulary("en")))))
    monkeypatch.setattr(collocations, "WINDOW", 7)
    assert list(np.concatenate(list(numbered(data[-2][0].encode(), Vocabulary("en"))))) == whole


def test_crowded_bits_change_nothing(spark, monkeypatch):
    """A bit table far too small lets rare phrases through; their counts drop them."""
    data = texts(3, 400)
    monkeypatch.setattr(collocations, "MAX_BITS", 15)
    monkeypatch.setattr(collocations, "bits_of", lambda level: b"\xff" * 4096 if level.count() else None)
    assert found(collocations.mine(table(spark, data), least=6)) == plain(data, 6)


def test_hash_is_sparks(spark):
    words = ["été", "", "a", "漢字 x y"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64(F.lit("en"), "w")).collect()]
    assert [g % 2**64 for g in got] == [xxhash.xxh64_intdigest(w.encode(), xxhash.xxh64_intdigest(b"en", 42)) for w in words]


def test_empty_and_rare(spark):
    assert collocations.mine(frame(spark).limit(0)).collect() == []
    got = collocations.mine(frame(spark))
    assert found(got) == plain([(t, lang) for _, t, lang, *_ in rows()], 30)
    few = spark.createDataFrame([(1, "only a few words", "en", "s", 1, "k", 1, 1, None)], SCHEMA)
    assert [n for n, _ in collocations.mine(few).dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and collocations.mine(few).count() == 0
