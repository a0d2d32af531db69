"""Spelling variants against the definition."""

import random
import re
import zlib
from collections import Counter

import pytest

from siftwell.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n):
    """word: (form, root, n, near words, form's n) by comparing all words."""
    found = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        found[w] = [form, n[w], len(others), n.get(form)]

    def root(w):
        return root(found[w][0]) if found[w][0] else w

    return {w: (form, root(w), *rest) for w, (form, *rest) in found.items()}


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def vocabulary():
    draw, words = random.Random(4), {"a" * 7, "a" * 8, "a" * 9, "a" * 300, "a" * 301, "aaaaaaab", "abaaaaa", "×÷ÀÿÀÿÀ"}
    for _ in range(70):
        w = "".join(draw.choices("abcé", k=draw.randrange(7, 12)))
        words.add(w)
        for _ in range(6):
            k = draw.randrange(len(w))
            words.add(draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice("abz") + w[k:], w[:k] + "z" + w[k + 1 :]]))
    return {w: draw.choice([2, 3, 20, 30, 400, 5000]) for w in sorted(words) if len(w) >= 7}


@pytest.mark.parametrize("limit", [4096, 25, 3])
def test_variants_are_those_of_the_definition(spark, vocabulary, limit):
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(vocabulary.items())] + [(None, None), (-1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = variants(vocabulary)
    assert sum(v[0] is not None for v in want.values()) > 50
    assert any(v[1] not in (w, v[0]) for w, v in want.items())
    assert collected(spelling.spelling_variants(docs, limit=limit)) == want


def test_a_common_head_is_dealt_until_groups_are_small(spark):
    draw = random.Random(9)
    words = {"commonhead" + "".join(draw.choices("abcdefgh", k=8)) for _ in range(3000)}
    words |= {w[:-1] for w in list(words)[:200]}
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    from siftwell.llm.shared import shared_folder

    folder = shared_folder(spark)
    groups = spelling.word_groups(vocabulary, 7, 100, folder)
    sizes = groups.groupBy("base", "path", "key").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 100
    got = {r.word: r.n_near for r in spelling.near_counts(groups).collect()}
    rest = {}
    for w in words:
        for i in range(len(w)):
            rest.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    want = Counter()
    for (i, cut), members in rest.items():
        for w in members:
            want[w] += len(members) - 1
    for w in words:
        for cut in {w[:i] + w[i + 1 :] for i in range(len(w))} & words:
            want[w] += 1
            want[cut] += 1
    assert got == {w: n for w, n in want.items() if n}


def test_query_of_odd_rows(odd, tmp_path, spark, vocabulary):
    draw, names = random.Random(3), list(vocabulary)
    texts = [(5000 + i, " ".join(x.upper() if draw.random() < 0.1 else x for x in draw.choices(names, k=400)), "en", "z") for i in range(40)]
    docs = odd.unionByName(spark.createDataFrame(texts, odd.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    count, deleted = Counter(), 0
    for row in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{row.doc_id}:{run}".encode())
            if row.doc_id is not None and h % 31 == 0:
                run, deleted = run[: h % len(run)] + run[h % len(run) + 1 :], deleted + 1
            count[run] += 1
    want = variants({w: n for w, n in count.items() if len(w) >= 7 and n >= 2})
    assert deleted > 50 and len(want) > 200
    assert collected(spelling.op11_spelling_variants(spark, str(tmp_path))) == want


def test_empty_tables_and_other_columns(odd, clashing, nothing):
    assert collected(spelling.spelling_variants(nothing)) == {}
    plain = collected(spelling.spelling_variants(odd, min_chars=3))
    assert plain and collected(spelling.spelling_variants(clashing, min_chars=3)) == plain
