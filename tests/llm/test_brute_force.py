"""Operators that SQL cannot express, against plain Python."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash

from siftwell.llm import classifier, packing, simhash, suffix_dedup, suffix_sort, token_counts
from siftwell.llm.tokens import Tokenizer

from .samples import words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    model = tokenizers.Tokenizer.from_file(WORD_BPE)
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    random_ = np.random.default_rng(seed)
    t = np.r_[random_.integers(1, 2 + seed % 4, 1 + seed * 3), 0].astype(np.uint16)
    assert suffix_sort.suffix_array(t, 10**6).tolist() == sorted(range(len(t)), key=lambda i: tuple(t[i:]))


@pytest.mark.parametrize("seed", range(40))
def test_repeated_windows(seed):
    draw, size = random.Random(seed), 1 + seed % 7
    strings = [bytes(draw.choices(b"ab\0", k=draw.randint(1, 40))) for _ in range(1 + seed % 9)]
    seen = collections.Counter(s[i : i + size] for s in strings for i in range(len(s) - size + 1))
    want = [[seen[s[i : i + size]] > 1 for i in range(len(s) - size + 1)] for s in strings]
    assert [x.tolist() for x in suffix_sort.repeated_windows(strings, size)] == want


@pytest.mark.parametrize("hot", [1, 3, 20_000])
def test_removed_bytes(odd, hot):
    rows = odd.select("doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((r.doc_id, len(t), int(gone.sum()), kept))
    got = suffix_dedup.remove_repeats(odd, hot=hot, shard_bytes=2000).collect()
    mine = [(r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), bytes(r.kept)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert any(0 < w[2] < w[1] for w in want) and any(w[2] == w[1] > 0 for w in want)


def test_hot_passages_are_dealt_by_places_of_their_anchor(spark, monkeypatch):
    """A passage in many texts, its edges shared by some of them for a few bytes more."""
    draw, passage = random.Random(6), words(1, 150)
    left, right = words(2, 40), words(3, 40)
    texts = []
    for i in range(60):
        k = draw.randrange(0, 260)
        tail = right[:k] if i % 2 else ""
        head = left[len(left) - draw.randrange(0, 260) :] if i % 3 else ""
        texts.append(f"{words(100 + i, 30)}{head}{passage}{tail}{words(300 + i, 30)}")
    texts += texts[:5] + [passage, passage[:199], passage[3:203]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    data = [t.encode() for t in texts]
    seen = collections.Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    want = {}
    for n, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want[n] = bytes(b for b, g in zip(t, gone) if not g)
    levels = []
    in_cells = suffix_dedup.in_cells
    monkeypatch.setattr(suffix_dedup, "in_cells", lambda rows, cell, *rest: levels.append(cell) or in_cells(rows, cell, *rest))
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, hot=5, shard_bytes=3000).collect()}
    assert got == want and levels == [64, 16, 4, 1]


def test_long_texts_in_chunks():
    text = words(9, 90_000).encode()
    found = suffix_dedup.stretches(text, 200, 50)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(found["start"], found["count"])])
    assert sorted(covered.tolist()) == list(range(len(text) - 199))


def test_packing(odd, library):
    got = packing.best_fit_packing(odd, WORD_BPE, size=256).collect()
    want = collections.Counter()
    for r in odd.collect():
        ids = [*library(r.text), 1]
        for k in range(0, len(ids), 256):
            part = np.array(ids[k : k + 256], "<u4")
            want[(r.doc_id, k // 256, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.02 * total / 256 + 2


def one_by_one(lengths, size):
    """Sequences that best fit uses when it takes piece by piece, longest first."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        gap = min(fits, default=size)
        if fits:
            gaps.remove(gap)
        gaps.append(gap - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_tight_and_whole(seed):
    random_ = np.random.default_rng(seed)
    lengths = np.unique(random_.integers(1, 129, 40))
    counts = random_.integers(1, 60, len(lengths))
    p = packing.plan(lengths, counts, 128)
    assert {x: int(p["n"][p["length"] == x].sum()) for x in lengths} == dict(zip(lengths, counts))
    filled = collections.Counter()
    for length, n, first, offset in zip(p["length"], p["n"], p["first"], p["offset"]):
        for s in range(first, first + n):
            filled[s] += length
            assert offset + length <= 128
    assert max(filled.values()) <= 128
    assert len(filled) <= 1.02 * one_by_one(np.repeat(lengths, counts).tolist(), 128) + 1


def test_ranks_across_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    rows = spark.range(1000).selectExpr("id AS uid", "CAST(1 + id % 3 AS bigint) AS length")
    ranks = collections.defaultdict(list)
    for r in packing.ranked(rows, 1000).collect():
        ranks[r.length].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_groups(odd):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = odd.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            group[i] = min(group[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4)
    ids = collections.defaultdict(list)
    for g, r in zip(group, rows):
        ids[g] += [r.doc_id] if r.doc_id is not None else []
    want = [(r.doc_id, f"{p:016x}", min(ids[g], default=None)) for r, p, g in zip(rows, prints, group)]
    for tile in (2, 2048):
        got = simhash.near_duplicate_groups(odd, words=4, tile=tile).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_links_connect_what_is_near():
    random_ = np.random.default_rng(3)
    base = random_.integers(0, 2**64, 30, np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(6)])[:, None]
    i, j = simhash.links(fps, np.zeros(len(fps), np.int64), 4)
    assert len(i) == 150 and (simhash.bits_apart(fps[i], fps[j]) <= 4).all()


def test_near_copies_go_and_others_stay(spark):
    rows = [(i, words(i, 200, 5000)) for i in range(60)]
    near = [(100 + i, " ".join(rows[i][1].split()[:150] + ["new"] + rows[i][1].split()[151:])) for i in range(20)]
    docs = spark.createDataFrame(rows + near + [(200, rows[3][1]), (200, rows[3][1])], "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one_per_group(docs).collect())
    groups = simhash.near_duplicate_groups(docs).collect()
    assert kept == sorted({r.component_id for r in groups})
    assert [x for x in kept if x < 100] == list(range(60)) and len(kept) < 75 and 200 not in kept


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_chunks_give_the_counts_of_whole_texts(name, odd):
    model = Tokenizer(public_tokenizers.path(name))
    for r in odd.collect():
        if r.text:
            for chunk, overlap in ((50, 5), (700, 40)):
                assert token_counts.chunked_count(model, r.text, chunk, overlap) == len(model.ids(r.text))


def test_words_give_the_ids_of_the_library(library):
    texts = ["don't, it's. A'b,'s x", "a<|endoftext|>b", "Á,b Ñ! 3.14,5", "İx Σ.", "ẖH̱.", "ab\x85cd e.\xa0f", "東京,x", "\U0001f600ok"]
    model = Tokenizer(WORD_BPE)
    assert [model.ids(t).tolist() for t in texts] == [library(t) for t in texts]


def test_pairs_are_those_of_the_double_sum():
    machine = classifier.Machine(features=50, factors=3)
    index, value = np.array([3, 7, 7, 20]), np.array([0.5, 1, 0.25, 2], np.float32)
    w, v = machine.w[:, 0], machine.w[:, 1:]
    pairs = sum(v[index[a]] @ v[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    logit, _ = machine.logits(index, value, np.array([0]))
    assert logit[0] == pytest.approx((w[index] * value).sum() + pairs, abs=1e-6)


def test_classifier_on_rows_it_has_not_seen(spark):
    good = [(i, words(i, 80, 3000) + ".", 1) for i in range(300)]
    bad = [(1000 + i, " ".join(x + "$$$" for x in words(i, 60, 3000).split()), 0) for i in range(120)]
    table = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    held = classifier.in_fold("doc_id", 5, 0)
    machine = classifier.train(table.drop("quality"), table.where(~held).select("doc_id", "quality"))
    out = classifier.scored(table.where(held), machine, name="p").collect()
    assert sum((r.p >= 0.5) == (r.quality == 1) for r in out) >= 0.97 * len(out) > 50


def test_without_labels_every_score_is_one_half(odd, nothing):
    labels = nothing.selectExpr("doc_id", "1 AS quality")
    out = classifier.scored(odd.select("doc_id", "text"), classifier.train(odd, labels), name="p")
    assert {r.p for r in out.collect()} == {0.5}
