"""Plain Python re-computation of every search mode, for small fixtures."""

import hashlib
import math
import re
from collections import Counter

import numpy


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def h(token, mod):
    """md5 as one big-endian number, modulo ``mod``."""
    return int.from_bytes(hashlib.md5(token.encode()).digest(), "big") % mod


def sign(token):
    return 1 - 2 * h(token + "#sign", 2)


def unit(values):
    """The vector divided by its length; zeros stay."""
    v = numpy.asarray(values, dtype=float)
    length = numpy.linalg.norm(v)
    return (v / length if length else v).tolist()


def dense(text, dim):
    words = tokens(text)
    out = numpy.zeros(dim)
    numpy.add.at(out, [h(w, dim) for w in words], [sign(w) for w in words])
    return unit(out)


def term_counts(text):
    return Counter(h(t, 2**31) for t in tokens(text))


def sparse(text):
    return {i: 1.0 + math.log(n) for i, n in term_counts(text).items()}


def cosine(a, b):
    return float(numpy.dot(unit(a), unit(b)))


def idf(documents):
    df = Counter(i for d in documents for i in sparse(d["text"]))
    n = len(documents)
    return {i: math.log(1 + (n - c + 0.5) / (c + 0.5)) for i, c in df.items()}


def allowed(d, q):
    get = q.get if isinstance(q, dict) else q.asDict().get
    if d["tenant_id"] is None or d["tenant_id"] != q["tenant_id"]:
        return False
    cat, lo, hi = get("category_filter"), get("created_after"), get("created_before")
    return (
        (cat is None or d["category"] == cat)
        and (lo is None or d["created_at"] >= lo)
        and (hi is None or d["created_at"] <= hi)
    )


def dense_hits(documents, q, k, dim):
    qv = dense(q["text"], dim)
    scored = [
        (round(cosine(qv, dense(d["text"], dim)), 9), d["id"]) for d in documents if allowed(d, q)
    ]
    return [(i, s) for s, i in sorted(scored, reverse=True)[:k]]


def sparse_hits(documents, q, k, weights=None):
    weights = weights if weights is not None else idf(documents)
    terms = sparse(q["text"])
    scored = []
    for d in documents:
        if allowed(d, q):
            w = sparse(d["text"])
            shared = set(w) & set(terms)
            if shared:
                scored.append((-round(sum(terms[i] * w[i] * weights[i] for i in shared), 9), d["id"]))
    return [(i, -s) for s, i in sorted(scored)[:k]]


def hybrid_hits(documents, q, k, dim, prefetch=50, k0=60):
    fused = Counter()
    for branch in (dense_hits(documents, q, prefetch, dim), sparse_hits(documents, q, prefetch)):
        for rank, (i, _) in enumerate(branch, 1):
            fused[i] += 1.0 / (k0 + rank)
    return sorted(fused.items(), key=lambda x: (-x[1], x[0]))[:k]


def ranked(rows):
    """{query_id: [(id, score)]} of collected hits, checking the rank numbering."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        hits = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(hits) + 1
        hits.append((r["id"], r["score"]))
    return out


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got, want))
