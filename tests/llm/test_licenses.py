"""Licence scans against the definition."""

import random
import re

import duckdb
import pytest

from siftwell.llm import licenses

from .samples import words


def scanned_by_hand(text):
    split = re.findall(licenses.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    labels, places, score, base_labels = set(), [], 0.0, set()
    for phrase, label in licenses.BASE.items():
        phrase = phrase.split()
        here = [i for i in range(len(split)) if split[i : i + len(phrase)] == phrase]
        places += here
        base_labels |= {label} if here else set()
    for t in licenses.TEMPLATES:
        low, high = t.key
        for start in range(-len(t.words), len(split)):
            stands = [0 <= start + j < len(split) and split[start + j] == w for j, w in enumerate(t.words)]
            if all(stands[low:high]) and sum(stands) >= t.need(licenses.SHARE):
                labels.add(t.label)
                score = max(score, sum(stands) / len(t.words))
    score = max(score, 0.5 if places else 0.0)
    first, last = (min(places), max(places)) if places else (None, None)
    join = lambda x: ",".join(sorted(x))
    return len(split), len(places), first, last, join(base_labels), join(labels | base_labels), score


def worn(draw, template, misses, other):
    """A template with words replaced outside its key phrase."""
    text, (low, high) = list(template.words), template.key
    for j in draw.sample([j for j in range(len(text)) if not low <= j < high], misses):
        text[j] = draw.choice(other)
    return " ".join(text)


@pytest.fixture(scope="module")
def texts():
    draw, out = random.Random(2), [None, "", " . ", "MIT License", "the CC-BY or cc by, GNU general public LICENSE"]
    for t in licenses.TEMPLATES:
        allowed = min(len(t.words) - t.need(licenses.SHARE), len(t.words) - (t.key[1] - t.key[0]))
        for misses in {0, allowed, min(allowed + 1, len(t.words) - (t.key[1] - t.key[0]))}:
            # Words of the template elsewhere in the text must not lead the scan astray.
            loose = t.words[:]
            draw.shuffle(loose)
            body = worn(draw, t, misses, ["foo", "bar", *loose])
            out.append(f"{words(len(out), 30)} {body.capitalize()}. {' '.join(loose)} {words(5, 10)}")
            out.append(body)
        out.append(" ".join(t.words[1:]))  # begins inside the template
    return out


def rows(df):
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_labels_are_those_of_the_definition(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = sorted((i, *scanned_by_hand(t)) for i, t in enumerate(texts))
    assert rows(licenses.scan_licenses(docs)) == want
    assert len({label for w in want for label in w[6].split(",")}) >= 17


def test_replaced_words_that_stand_elsewhere(spark):
    grant = next(t for t in licenses.TEMPLATES if t.name == "mit-grant")
    text = list(grant.words)
    for j in (13, 17, 18):
        text[j] = "other"
    text = " ".join(text)
    docs = [(1, text), (2, f"{text} obtaining copy software associated documentation files person")]
    found = rows(licenses.scan_licenses(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert [r[6] for r in found] == ["mit", "mit"] and [r[7] for r in found] == [0.85, 0.85]


def test_sql_is_the_definition(spark, texts):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    found = con.execute(f"select {', '.join(names)} from ({licenses.OP2_SQL})").fetchall()
    assert sorted(found) == sorted((i, *scanned_by_hand(t)) for i, t in enumerate(texts))


def test_places_to_look_up_are_enough():
    for t in licenses.TEMPLATES:
        places, agree = licenses.looked_up(t, {}, licenses.SHARE)
        assert agree >= 1 and len(places) - agree == len(t.words) - t.need(licenses.SHARE)
