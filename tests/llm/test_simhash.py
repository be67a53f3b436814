"""Fingerprints against a plain restatement; classes against all pairs."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from fixtures import frame, rows, words

from procura.llm import simhash


def plain_print(text: str | None) -> int:
    parts = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(prints: list[tuple], radius: int) -> dict[int, int | None]:
    """Of each fingerprint the smallest doc_id it can reach."""
    left, out = set(p for _, p in prints), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            now = todo.pop()
            seen.add(now)
            near = {x for x in left if (x ^ now).bit_count() <= radius}
            left -= near
            todo += near
        ids = [i for i, p in prints if p in seen and i is not None]
        out |= dict.fromkeys(seen, min(ids, default=None))
    return out


def corpus() -> list[tuple]:
    r = random.Random(3)
    data = rows()
    for k in range(12):
        base = words(r, 150).split()
        for j in range(8):
            changed = list(base)
            for _ in range(r.randint(0, 2)):
                changed[r.randrange(len(changed))] = "x" * r.randint(1, 5)
            data.append((1000 + 10 * k + j, " ".join(changed), "en", "s", 1, "k", 1, 1, None))
    return data


@pytest.mark.parametrize(("radius", "chunk"), [(4, 16384), (4, 6), (2, 16384), (0, 3)])
def test_classes_equal_all_pairs(spark, radius, chunk):
    data = corpus()
    prints = [(d[0], plain_print(d[1])) for d in data]
    roots = plain_classes(prints, radius)
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, data), radius=radius, chunk=chunk).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == sorted(((i, f"{p:016x}", roots[p]) for i, p in prints), key=repr)


def test_one_of_each_class_stays(spark):
    data = corpus()
    prints = [(d[0], plain_print(d[1])) for d in data]
    roots = plain_classes(prints, 4)
    df = frame(spark, data)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(set(roots.values()), key=repr)
    assert simhash.keep_first(df.limit(0)).collect() == [] and simhash.near_duplicates(df.limit(0)).collect() == []
