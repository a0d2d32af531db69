"""Quality classifier: a factorisation machine over words and structure.

A document is a sparse row: hashed words (weight by count, scaled to length one
together), then measures of its structure, cut into ranges so that each value
is an indicator. The score is ``sigmoid(w0 + sum w_i x_i + pairs)`` with

    pairs = 1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which is linear in the number of features. It is fitted on the driver by
mini-batch AdaGrad on at most ``sample`` labelled rows, those with the smallest
hash of their id; every document is scored by its whole text.

Null text is scored as an empty one. Labelled rows with a null id, a null label
or no document are not learned from; an id with several labels or documents
gives a row for each pair. With no labelled row at all every score is 0.5. An
empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftwell.llm.shared import bounded_batches, shared_folder, table, text_or_empty, written

WORD_BITS = 15
RANGES = 16
SAMPLE = 6000
FACTORS = 4
EPOCHS = 6
BATCH = 64
RATE = 0.1
THRESHOLD = 0.3

#: Measures of structure, in the order of ``structure``.
MEASURES = (
    "words", "word_length", "symbols", "marks", "capitals", "bars", "digits", "repeated_words",
    "repeated_lines", "echoes", "line_length", "short_lines",
)
_OFFSET = 1 << WORD_BITS
FEATURES = _OFFSET + RANGES * len(MEASURES)
_ALNUM = re.compile(rb"[^0-9A-Za-z\x80-\xff]+")
_MEMORY = 300_000


def structure(data: bytes, words: list[bytes]) -> list[float]:
    n, size = max(1, len(words)), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = sum(map(bytes.isupper, words))
    signs = data.translate(None, b"#*$%&<>~^@=+_{}[]\\")
    return [
        np.log2(1 + len(words)) / 20,
        min(1.0, size / n / 16),
        min(1.0, (len(data) - len(signs)) / n),
        min(1.0, data.count(b"!") / n),
        upper / n,
        min(1.0, data.count(b"|") / n),
        min(1.0, 4 * (len(data) - len(data.translate(None, b"0123456789"))) / size),
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        min(1.0, size / max(1, len(lines)) / 1024),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
    ]


class Features:
    """Turns texts into sparse rows; remembers the place of a word, within a bound."""

    def __init__(self):
        self._memory: dict[bytes, int] = {}

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode()
        words = data.split()
        counts = Counter(words)
        memory = self._memory
        if len(memory) > _MEMORY:
            memory.clear()
        places = []
        for word in counts:
            place = memory.get(word)
            if place is None:
                place = zlib.crc32(_ALNUM.sub(b"", word).lower()) & (_OFFSET - 1)
                memory[word] = place
            places.append(place)
        weight = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        weight /= max(1e-9, np.sqrt((weight * weight).sum()))
        values = np.array(structure(data, words))
        cell = np.minimum((np.sqrt(np.clip(values, 0, 1)) * RANGES).astype(np.int64), RANGES - 1)
        index = np.r_[np.array(places, np.int64), _OFFSET + np.arange(len(MEASURES)) * RANGES + cell]
        return index, np.r_[weight, np.ones(len(MEASURES))].astype(np.float32)


class Machine:
    """Weights of a factorisation machine and its gradient steps."""

    def __init__(self, features: int = FEATURES, factors: int = FACTORS, seed: int = 11):
        random = np.random.default_rng(seed)
        self.w = np.zeros((features, factors + 1), np.float32)  # column 0: linear weights
        self.w[:, 1:] = random.normal(0, 0.02, (features, factors))
        self.w0 = 0.0

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
        """Logits of rows stored one after the other, and their factor sums."""
        xv = self.w[index] * value[:, None]
        sums = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat(xv[:, 1:] ** 2, starts, axis=0).sum(1)
        return self.w0 + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares), sums

    def fit(self, rows: list, labels: np.ndarray, epochs: int, batch: int, rate: float) -> None:
        random = np.random.default_rng(5)
        history = np.full_like(self.w, 1e-2)
        bias_history = 1e-2
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                index = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                sizes = np.array([len(rows[i][0]) for i in part])
                logits, sums = self.logits(index, value, np.cumsum(sizes) - sizes)
                error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[part]) / len(part)
                each = np.repeat(error, sizes).astype(np.float32) * value
                inner = np.repeat(sums, sizes, axis=0)
                grad = np.empty((len(index), self.w.shape[1]), np.float32)
                grad[:, 0] = each
                grad[:, 1:] = each[:, None] * (inner[:, 1:] - self.w[index, 1:] * value[:, None])
                used, place = np.unique(index, return_inverse=True)
                total = np.zeros((len(used), self.w.shape[1]), np.float32)
                np.add.at(total, place, grad)
                total += 1e-6 * self.w[used]
                history[used] += total * total
                self.w[used] -= rate * total / np.sqrt(history[used])
                bias_history += float(error.sum()) ** 2
                self.w0 -= rate * float(error.sum()) / np.sqrt(bias_history)

    def score(self, rows: list) -> np.ndarray:
        if not rows:
            return np.empty(0)
        sizes = np.array([len(r[0]) for r in rows])
        logits, _ = self.logits(
            np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]),
            np.cumsum(sizes) - sizes,
        )
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


def in_fold(id_column: str, folds: int, fold: int):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
    epochs: int = EPOCHS,
    factors: int = FACTORS,
) -> Machine:
    """Fit on at most ``sample`` labelled rows."""
    bounded_batches(docs.sparkSession)
    folder = shared_folder(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull())
    chosen = written(known.orderBy(F.xxhash64("id"), "id", "y").limit(sample), folder, "sample")
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("t"))
    # ``chosen`` has at most ``sample`` rows: the documents need no shuffle to find theirs.
    texts = texts.join(F.broadcast(chosen), "id").select("id", "y", "t")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features.row(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()),
                 pa.array([r[1].tobytes() for r in rows], pa.binary())],
                ["id", "y", "i", "x"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    sparse = texts.mapInArrow(featurize, f"id {kind}, y int, i binary, x binary")
    # Repeated documents may give more rows than labels: the bound is set again.
    got = sparse.orderBy(F.xxhash64("id"), "id", "y", "i", "x").limit(sample).collect()
    rows = [(np.frombuffer(r.i, "<i4"), np.frombuffer(r.x, np.float32)) for r in got]
    machine = Machine(factors=factors)
    if rows:
        machine.fit(rows, np.array([r.y for r in got], np.float32), epochs, BATCH, RATE)
    else:
        machine.w[:] = 0
    return machine


def scored(docs: DataFrame, machine: Machine, text_column: str = "text", name: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1 (an input column of that name is replaced)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine))  # plain arrays
    docs = docs.drop(name)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), Machine.__new__(Machine)
        vars(model).update(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            scores = [model.score([features.row(t.as_py() or "")])[0] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name]
            )

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields]).add(name, T.DoubleType()))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 5, 0))
    result = scored(docs, train(docs, labels))
    return result.select(
        "doc_id",
        in_fold("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
