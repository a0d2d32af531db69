"""Every operator on odd rows: the same rows whatever else the table holds, none for none."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftwell.llm import (
    classifier, licenses, lines, mixing, packing, periodic, quality_rules, setsketch, simhash, suffix_dedup, token_counts,
    topk,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def classified(docs):
    machine = classifier.Machine()
    return classifier.scored(docs.select("doc_id", "text"), machine, name="quality_score")


OPERATORS = {
    "quality": quality_rules.quality_rules,
    "licenses": licenses.scan_licenses,
    "suffix": suffix_dedup.remove_repeats,
    "packing": lambda d: packing.best_fit_packing(d, WORD_BPE).drop("sequence_id", "offset"),
    "simhash": simhash.near_duplicate_groups,
    "mixing": mixing.mix_sources,
    "classifier": classified,
    "lines": lambda d: lines.drop_frequent_lines(d).select("doc_id", "text", "n_lines", "n_dropped"),
    "setsketch": setsketch.sketched_groups,
    "periodic": lambda d: periodic.periodic_runs(d).select("doc_id", "text", "n_words", "runs", "collapsed"),
    "tokens": lambda d: token_counts.token_counts(d, WORD_BPE),
}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_other_columns_change_nothing(name, odd, clashing):
    plain = rows(OPERATORS[name](odd))
    assert plain and rows(OPERATORS[name](clashing)) == plain


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(name, nothing):
    assert OPERATORS[name](nothing).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "packing"])
def test_every_row_has_a_result(name, odd):
    assert OPERATORS[name](odd).count() == odd.count()


def test_row_stages_keep_all_columns(clashing):
    for result in (lines.drop_frequent_lines(clashing), simhash.keep_one_per_group(clashing), mixing.taken_documents(clashing)):
        assert set(clashing.columns) <= set(result.columns)
        assert result.where(F.col("kept") == "other").count() == result.count() > 0


def test_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, score string, rank string"
    nan, inf = float("nan"), float("inf")
    data = [(i, [float(i % 7) / 8, -0.5 + (i % 3), 0.25], "x", "y") for i in range(120)]
    data += [(200, None, "", ""), (250, [nan, 1.0, 1.0], "", ""), (300, [1.0, None, 0.0], "", "")]
    data += [(350, [inf, 0.0, 0.0], "", ""), (None, [1.0, 1.0, 1.0], "", ""), data[50], data[51]]
    table = spark.createDataFrame(data, schema)
    queries = table.where(F.col("vec_id") % 50 == 0)
    got = topk.exact_topk(table, queries, k=4, slice_rows=2, block_rows=16).collect()
    ok = {r[0]: [int(256 * x // 1) for x in r[1]] for r in data[:120]}
    for q in (0, 50, 100):
        scores = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:4]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(i + 1, c, -s) for i, (s, c) in enumerate(scores)]
    assert len(got) == 12
    assert topk.exact_topk(table.limit(0), queries.limit(0)).collect() == []
