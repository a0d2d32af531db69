"""Stages of the corpus pipeline: decisions of the operators applied to documents.

Every stage takes ``(spark, docs, sf_dir)`` and works on all of ``docs``. All
but ``pack`` return the columns of ``docs``. Null texts, repeated rows and empty
tables are treated as by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwell.llm.classifier import THRESHOLD, scored, train
from siftwell.llm.lines import drop_frequent_lines
from siftwell.llm.mixing import taken_documents
from siftwell.llm.packing import best_fit_packing
from siftwell.llm.shared import table
from siftwell.llm.simhash import keep_one_per_group

#: Contract of the SimHash operator: words of a shingle, bits that may differ.
SHINGLE, BITS = 4, 4


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns of these names renamed, and the way back."""
    moved, taken = {}, set(docs.columns)
    for name in names:
        if name in taken:
            free = f"{name}_"
            while free in taken:
                free += "_"
            moved[free] = name
            taken.add(free)
    return docs.withColumnsRenamed({old: new for new, old in moved.items()}), moved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the tables, does not reject."""
    machine = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows, moved = _aside(docs, "quality_score")
    kept = scored(rows, machine, name="quality_score").where(F.col("quality_score") >= THRESHOLD)
    return kept.drop("quality_score").withColumnsRenamed(moved).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents have; ``n_chars`` follows the text."""
    rows, moved = _aside(docs, "n_lines", "n_dropped")
    out = drop_frequent_lines(rows).drop("n_lines", "n_dropped").withColumnsRenamed(moved)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHash near-duplicates stays."""
    return keep_one_per_group(docs, words=SHINGLE, max_bits=BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeats are rows, those not taken go."""
    return taken_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))
