"""Periodic runs against the definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from siftwell.llm import periodic


def runs_of(words, least=12):
    """(start, end, period) by trying every distance."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def sample(draw):
    kind, n = draw.randrange(4), draw.randrange(160)
    if kind == 0:
        return draw.choices("ab", k=n)
    if kind == 1:
        root = draw.choices("abcdefgh", k=draw.randrange(1, 40))
        return draw.choices("xyzab", k=draw.randrange(20)) + (root * 12)[:n] + draw.choices("xyzab", k=draw.randrange(20))
    if kind == 2:
        return ["a"] * n
    return [w for _ in range(6) for w in (draw.choices("abc", k=draw.randrange(1, 9)) * 9)[: draw.randrange(1, 40)]]


@pytest.mark.parametrize("seed", range(60))
def test_runs_are_those_of_the_definition(seed):
    draw = random.Random(seed)
    documents = [sample(draw) for _ in range(draw.randrange(1, 6))]
    least = draw.choice([12, 12, 20])
    assert periodic.runs_of_all(documents, least) == [runs_of(w, least) for w in documents]


def test_runs_with_nested_and_long_periods():
    inner = ("a b " * 8 + "c ").split()
    long = [f"w{i}" for i in range(700)]
    documents = [inner * 3, long * 3 + long[:5], ["x"] * 5000, [], list("abcabcabcab"), list("abcabcabcabc")]
    assert periodic.runs_of_all(documents) == [runs_of(w) for w in documents]


def test_transform_goes_back():
    rows = np.random.default_rng(1).integers(0, periodic.PRIME, (3, 64), np.uint64)
    assert (periodic.inverse(periodic.transform(rows.copy())) == rows).all()


def test_copies_are_all_found():
    draw = np.random.default_rng(2)
    x = draw.integers(0, 2, 400).astype(np.uint64)
    places = np.arange(0, 300, 5)
    at, distance = periodic.copies(x, places, 5, 9, 18)
    want = [(p, d) for p in places.tolist() for d in range(9, 19) if (x[p : p + 5] == x[p + d : p + d + 5]).all()]
    assert sorted(zip(at.tolist(), distance.tolist())) == want


def rewritten(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_of_odd_rows(odd, tmp_path, spark):
    extra = [(1000 + i, " ".join(f"t{i}w{j}" for j in range(5 + 7 * i)), "en", "z") for i in range(60)]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want, planted = [], 0
    for row in docs.collect():
        before = (row.text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
        before = [w for w in before if w]
        words = rewritten(row.doc_id, before)
        planted += words != before
        runs = runs_of(words)
        gone = {i for s, e, p in runs for i in range(s + p, e)}
        best = max(((e - s, -s, -p) for s, e, p in runs), default=None)
        length, start, period = (best[0], -best[1], -best[2]) if best else (None,) * 3
        milli = 1000 * length // period if best else None
        lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((row.doc_id, len(runs), start, length, period, milli, sha(lines), sha(kept)))
    assert planted > 3
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
