"""SetSketch groups and the pipeline's SimHash stage against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import setsketch, simhash

from .samples import words


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows, share):
    """(id, size of the set, component id, kept) by the definition."""
    sets, group, holders = [shingles(t) for _, t in rows], list(range(len(rows))), {}
    for i, mine in enumerate(sets):
        for j, common in Counter(j for x in mine for j in holders.get(x, ())).items():
            if 100 * common >= share * len(mine | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
        for x in mine:
            holders.setdefault(x, []).append(i)
    low = {}
    for g, (i, _) in zip(group, rows):
        low[g] = min((x for x in (low.get(g), i) if x is not None), default=None)
    return sorted(((i, len(s), low[g], i == low[g]) for (i, _), s, g in zip(rows, sets, group)), key=repr)


def sketched(docs, share):
    found = setsketch.sketched_groups(docs, share=share).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr)


def versions(seed, count, length):
    """Texts that drift: each is an earlier one with a few words changed."""
    draw = random.Random(seed)
    texts = [words(seed, length, 10**6)]
    while len(texts) < count:
        text = draw.choice(texts[-8:]).split()
        for _ in range(draw.randrange(1, 4)):
            text[draw.randrange(len(text))] = f"v{draw.randrange(10**6)}"
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("hub, tile, set_tile", [(64, 2048, 1 << 20), (2, 3, 700)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, hub, tile, set_tile):
    for name, value in (("HUB", hub), ("TILE", tile), ("SET_TILE", set_tile)):
        monkeypatch.setattr(setsketch, name, value)
    texts = [t for seed in range(6) for t in versions(seed, 20, 60 + 40 * seed)]
    texts += [None, "", " \n ", "one two", "one  TWO", "one two three", texts[0], texts[30]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, words(99, 50)), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = groups(rows, 85)
    assert len({w[2] for w in want}) > 20 and sum(not w[3] for w in want) > 20
    assert sketched(docs, 85) == want


#: Similarity in percent: number of shingles, changed words (five shingles each).
PLANTED = {75: (70, 2), 80: (90, 2), 85: (185, 3), 90: (95, 1)}


@pytest.mark.parametrize("share", [80, 85])
def test_pairs_at_the_limit_are_linked_and_those_below_are_not(spark, share):
    rows, alike = [], {}
    for part, (percent, (n, changed)) in enumerate(PLANTED.items()):
        for k in range(60):
            one = words(1000 * part + k, n + 4, 10**6).split()
            other = list(one)
            for c in range(changed):
                other[10 + c * (n - 20) // max(1, changed - 1)] = f"new{c}"
            first = 1000 * part + 2 * k
            rows += [(first, " ".join(one)), (first + 1, " ".join(other))]
            alike[first + 1] = percent
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 100 * len(a & b) == 75 * len(a | b)
    found = {r[0]: r[2] for r in sketched(spark.createDataFrame(rows, "doc_id bigint, text string"), share)}
    assert all((found[i] == i - 1) == (percent >= share) for i, percent in alike.items())


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 2**64, (2, 500), np.uint64)
    assert (setsketch.sketch(np.r_[a, b]) == setsketch.merged(setsketch.sketch(a), setsketch.sketch(b))).all()
    assert not setsketch.sketch(a[:0]).any()
    for common, likely in ((490, True), (460, True), (300, False), (0, False)):
        other = np.r_[a[:common], b[common:]]
        x, y, n = setsketch.sketch(a), setsketch.sketch(other), np.array([500])
        assert setsketch.likely(np.array([(x > y).sum()]), np.array([(x < y).sum()]), n, n, 85)[0] == likely
    n, m = np.array([100]), np.array([120])  # no two sets of these sizes are similar enough
    assert not setsketch.likely(np.array([0]), np.array([0]), n, m, 85)[0]


@pytest.mark.parametrize("seed", range(8))
def test_links_join_what_is_similar(seed):
    draw = np.random.default_rng(seed)
    base = [np.unique(draw.integers(0, 4000, 60).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.r_[b[draw.random(len(b)) < 0.97], draw.integers(0, 4000, 2).astype(np.uint64)]) for b in base for _ in range(5)]
    group = np.arange(len(sets))
    group[1] = group[0]
    i, j = setsketch.links(sets, group, 80)
    got, want = group.tolist(), group.tolist()
    for pairs, names in ((zip(i, j), got), (((a, b) for a in range(len(sets)) for b in range(a)), want)):
        for a, b in pairs:
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                old, new = names[a], names[b]
                names[:] = [new if g == old else g for g in names]
    same = lambda names: {tuple(k for k, g in enumerate(names) if g == name) for name in names}
    assert same(got) == same(want)
