"""The corpus pipeline: stages that each call one operator of the ``llm`` subpackage."""

from __future__ import annotations

from siftwell.llm import stages
from siftwell.llm.shared import shared_folder, table, written

STAGES = [
    ("quality", stages.quality),
    ("lines", stages.lines),
    ("near_duplicates", stages.near_duplicates),
    ("mix", stages.mix),
    ("pack", stages.pack),
]

#: The classifier is trained, so SQL cannot express the rows; tests/llm/test_pipeline.py holds run() and every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), folder, f"{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
