"""Rows that every operator over documents has to take: nulls, empty, long and repeated texts, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, fp bigint, t bigint, `doc id` string"


def words(r: random.Random, n: int, letters: str = "abcdefghijklmnop") -> str:
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def rows(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    texts: list[tuple] = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "no id here at all"), (6, "\0 control \x01 é 漢字 🎉   end"), (7, words(r, 30_000))]
    base = words(r, 60)
    texts += [(10 + i, base if i < 3 else base[: -i]) for i in range(6)]
    texts += [(100 + i, words(r, r.randint(1, 200))) for i in range(30)]
    return [(k, t, "en", f"src{i % 3}", None if t is None else len(t), "x", i, i, None) for i, (k, t) in enumerate(texts)]


def frame(spark, data=None, partitions: int = 5):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(partitions)
