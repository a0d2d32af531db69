"""Token counts; huge documents are encoded in overlapping chunks and spliced.

A chunk is encoded with offsets. Neighbours overlap, and they are spliced at a
place of the overlap where both have a token start and white space makes the
cut safe: tokenizers of words drop it, sentencepiece starts a piece with it,
so no token, normalisation or special string reaches across. If an overlap
has no such place, it is widened to twice its length, at last over the whole
rest, and tried again. Only one chunk is held at a time.

Null text counts as empty (0 bytes, 0 tokens). Each row is counted by itself:
repeated rows give equal results, an empty table gives an empty one, and other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftwell.llm.shared import bounded_batches, table, text_or_empty
from siftwell.llm.tokens import Tokenizer, tokenizer

CHUNK = 60_000
OVERLAP = 400
LIMIT = 2048


def _stable(model: Tokenizer, text: str, starts: np.ndarray, low: int) -> np.ndarray:
    """Those token starts above ``low`` (absolute) at which the text may be cut."""
    starts = starts[starts > low + 1]
    if model.words:
        keep = [text[x - 1] in " \t\n\r" and not text[x].isspace() for x in starts]
    else:
        keep = [text[x : x + 1] == " " and not text[x - 1].isspace() for x in starts]
    return starts[np.asarray(keep, bool)]


def chunked_count(model: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoded in chunks of ``chunk`` characters (at least 1)."""
    total, begin = 0, 0  # every token before ``begin`` is counted, and a token starts there
    if not model.words and not model.path.endswith(".model"):
        return model.count(text)  # no place of a cut is proven
    left = model.spans(text[:chunk])
    end = min(chunk, len(text))
    while end < len(text):
        wide = overlap
        while True:
            start = max(begin, end - wide)
            stop = min(start + max(chunk, 2 * wide), len(text))
            right = start + model.spans(text[start:stop])
            here = _stable(model, text, left[left < end], start)
            # The last word of the left chunk may be cut, the first of the right one too.
            common = np.intersect1d(here, _stable(model, text, right, start))
            if len(common):
                cut = int(common[len(common) // 2])
                total += int(np.count_nonzero((left >= begin) & (left < cut)))
                begin, left, end = cut, right[right >= cut], stop
                break
            if start == begin:  # the whole rest of the left chunk overlaps: encode further
                if stop == len(text):
                    return total + int(np.count_nonzero(right >= begin))
                end, left = stop, right
                wide = end - begin
            wide *= 2
    return total + int(np.count_nonzero(left >= begin))


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every document."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(tokenizer_path)
        for batch in batches:
            counts = []
            for value in batch.column(1):
                text = value.as_py()
                huge = len(text) > chunk
                counts.append(chunked_count(model, text, chunk, overlap) if huge else model.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.compute.binary_length(batch.column(1)).cast(pa.int64()),
                 pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
