"""The pipeline and each of its stages against brute force, with odd rows and clashing columns."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import classifier, mixing, stages
from siftwell.llm.shared import shared_folder, table, written

SF = "/root/testdata/sf0.01"
OTHER = ("n_lines", "n_dropped", "quality_score", "fp", "key", "turn", "size", "copies", "_k", "_set", "id")
BLANK = " \t\n\x0b\x0c\r"


def split_words(text):
    return (text or "").encode().lower().split()


def by_quality(rows, machine):
    features = classifier.Features()
    score = lambda text: machine.score([features.row(text or "")])[0]
    return [r for r in rows if score(r[1]) >= classifier.THRESHOLD]


def lowered(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def without_lines(rows):
    held = Counter(key for _, text, *_ in rows for key in {lowered(x) for x in (text or "").split("\n")} if key)
    out = []
    for i, text, *rest in rows:
        out.append((i, "\n".join(x for x in (text or "").split("\n") if held[lowered(x)] < 10), *rest))
    return out


def fingerprint(text):
    w = split_words(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_of_each_group(rows):
    prints = [fingerprint(r[1]) for r in rows]
    points = np.array(sorted(set(prints)), np.uint64)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    group = np.arange(len(points))
    while (now := np.where(near, group[None, :], len(points)).min(axis=1)).tolist() != group.tolist():
        group = now
    name = dict(zip(points.tolist(), group.tolist()))
    first = {}
    for r, p in zip(rows, prints):
        signed = p - 2**64 if p >= 2**63 else p
        place = (r[0] is None, r[0] if r[0] is not None else 0, signed)
        if name[p] not in first or place < first[name[p]][0]:
            first[name[p]] = (place, r)
    return [r for _, r in first.values()]


def mixed(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1], r[2]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    out = Counter()
    sources = defaultdict(list)
    for r in rows:
        sources[r[0], len(split_words(r[1]))].append(r)
    for doc_id, size, taken in con.execute(f"select doc_id, size, taken from ({mixing.OP6_SQL})").fetchall():
        out[doc_id, size] += taken // size if size else 0
    return out


def contents(df):
    return [(r.doc_id, r.text, r.source, r.marks) for r in df.collect()]


def same(got, want):
    assert Counter(got) == Counter(want)


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = table(spark, SF, "documents")
    extra = odd.withColumn("n_chars", F.length("text").cast("int"))
    rows = docs.unionByName(extra.select(F.col("doc_id") + 100_000, "text", "lang", "source", "n_chars").toDF(*docs.columns))
    mark = F.concat(F.lit("mark "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    rows.withColumns({name: mark for name in OTHER}).withColumn("marks", mark).write.parquet(f"{folder}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_every_stage_is_the_definition(spark, tables):
    docs, folder = table(spark, tables, "documents"), shared_folder(spark)
    machine = classifier.train(docs, table(spark, tables, "labels"))
    whole, columns = contents(docs), docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]

    kept = written(stages.quality(spark, docs, tables), folder, "one")
    same(contents(kept), by_quality(whole, machine))
    assert kept.columns == columns and 0 < kept.count() < len(whole)

    cut = written(stages.lines(spark, kept, tables), folder, "two")
    same(contents(cut), without_lines(contents(kept)))
    assert cut.columns == columns and cut.where("n_chars != length(text)").isEmpty()

    single = written(stages.near_duplicates(spark, cut, tables), folder, "three")
    want, got = one_of_each_group(contents(cut)), contents(single)
    same([(r[0], fingerprint(r[1]), r[3]) for r in got], [(r[0], fingerprint(r[1]), r[3]) for r in want])
    assert single.columns == columns and set(got) <= set(contents(cut)) and len(got) < cut.count()

    mix = written(stages.mix(spark, single, tables), folder, "four")
    taken = Counter((r[0], len(split_words(r[1]))) for r in contents(mix))
    assert taken == +mixed(contents(single)) and mix.columns == columns
    assert set(contents(mix)) <= set(got)

    for step in (kept, cut, single, mix):  # other columns come through every stage
        wrong = [F.col(name) != F.col("marks") for name in OTHER]
        assert step.where(sum(w.cast("int") for w in wrong) > 0).isEmpty()

    pieces = stages.pack(spark, mix, tables).collect()
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in contents(mix):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        placed.sort()
        assert [a for a, _ in placed] == np.cumsum([0, *(n for _, n in placed)])[:-1].tolist()
        assert sum(n for _, n in placed) <= 4096
    assert len(sequences) <= -(-sum(r.length for r in pieces) // 4096) + 2

    ran = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in ran) == want


def test_stages_of_empty_tables(spark, tables):
    nothing = table(spark, tables, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, nothing, tables)
        assert result.collect() == []
        assert name == "pack" or result.columns == nothing.columns


def test_repeated_ids_of_different_texts_stay(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f"), (None, "m n o p q r"), (None, "a b c d e f"), (2, "g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in stages.near_duplicates(spark, docs, "").collect()]
    assert Counter(kept) == Counter([(1, "a b c d e f"), (1, "g h i j k l"), (None, "m n o p q r")])
