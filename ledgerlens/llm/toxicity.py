"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features: the words (ASCII case folded, cut at anything but letters, digits and non-ASCII characters), pairs of neighbours, and pairs with one
word between; each is hashed to 2**BITS slots, and a slot that occurs has value 1. FTRL-proximal keeps for every coordinate the sum of squared gradients,
which sets the coordinate's own learning rate, and L1 sets the weights of most slots to exactly 0; the rest is a compact table whose size is
bounded by the number of slots, so it is broadcast.

Training reads at most TRAIN_ROWS labelled rows, those whose doc_id hashes lowest among the rows that aren't held out (crc32 of the doc_id as
text modulo 5 isn't 0), in one task, for EPOCHS passes; of rows that repeat an id, the one with the smallest text hash. What comes to that task are the rows' slots and no texts, all
slots of each row, at most 2**BITS; the task holds HELD_BYTES of them and reads the others from a file of its own in every pass. Scoring reads every whole text.

Defined results: null and empty texts have no features and get the score of the bias alone; repeated rows get equal scores; labels without
a document, with a null label or null doc_id aren't used; without any training row, or with one class only, the scores are near that class' share (0.5 without rows); a null doc_id isn't
held out; a text is read as a whole, however long, one batch of a few MB at a time; labels that contradict each other both count; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import sys
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, slices, tidied

BITS = 20
TRAIN_ROWS = 20_000
HELD_BYTES = 256 << 20
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 15.0, 1.0

#: ASCII letters to small letters, digits and bytes of non-ASCII characters as they are, all else to spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slots(text: bytes | None) -> np.ndarray:
    """The different slots of a text's features, sorted."""
    crc = zlib.crc32
    words = np.array([crc(w) for w in (text or b"").translate(FOLD).split()], dtype=np.uint64)
    mix, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    kinds = [words * mix]
    for gap, salt in ((1, np.uint64(0x51_7C_C1_B7)), (2, np.uint64(0x2545_F491))):
        if len(words) > gap:
            kinds.append(((words[:-gap] << np.uint64(32)) + words[gap:] + salt) * mix)
    return np.unique(np.concatenate(kinds) >> turn).astype(np.int32)


def train(rows, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (slots, label) rows: the weights and the bias, which is the last coordinate and isn't regularised."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zs) <= L1] = 0.0
        return w

    bias = size - 1
    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            b = -z[bias] / ((BETA + np.sqrt(n[bias])) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - label
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            g = p - label
            z[bias] += g - (np.sqrt(n[bias] + g * g) - np.sqrt(n[bias])) / ALPHA * b
            n[bias] += g * g
    every = np.arange(bias)
    return weights(every), float(-z[bias] / ((BETA + np.sqrt(n[bias])) / ALPHA))


def _slot_rows(batches):
    """Each text's slots, as four bytes each."""
    for whole in batches:
        for batch in slices(whole, 1):
            found = [slots(text).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "slots", "label", "hash"])


class Rows:
    """(slots, label) of each row, as often as asked: so many bytes in memory, the rest in a file that ends with the object."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, float]] = []
        self.bytes, self.file, self.more = 0, None, []

    def add(self, data: bytes, label: float) -> None:
        if self.file is None and self.bytes + len(data) <= HELD_BYTES:
            self.held.append((np.frombuffer(data, np.int32), label))
            self.bytes += len(data)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.more.append((len(data), label))

    def __iter__(self):
        yield from self.held
        if self.file is not None:
            self.file.seek(0)
            for size, label in self.more:
                yield np.frombuffer(self.file.read(size), np.int32), label


def _train_task(batches):
    rows = Rows()
    for batch in batches:
        for held, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            rows.add(held.as_py(), float(label))
    w, b = train(rows)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(w[at], b))], names=["slot", "weight"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(slot, weight): the non-zero weights, and the bias under slot -1."""
    order = F.xxhash64("doc_id")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    chosen = usable.distinct().orderBy(order, "doc_id", "label").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    some = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", F.xxhash64("text").alias("hash"))  # at most `rows` ids
    known = some.mapInArrow(tidied(_slot_rows), "doc_id long, slots binary, label int, hash long")
    first = F.min_by(F.col("slots"), F.col("hash")).alias("slots")
    sample = known.groupBy("doc_id", "label").agg(first)
    return (
        sample.repartition(1)
        .sortWithinPartitions(order, "doc_id", "label")
        .select("slots", "label")
        .mapInArrow(tidied(_train_task), "slot long, weight double")
    )


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text."""
    spark = docs.sparkSession
    found = model.collect()  # at most 2**BITS + 1 rows
    at = np.array([r[0] for r in found if r[0] >= 0], dtype=np.int64)
    kept = spark.sparkContext.broadcast(
        (at, np.array([r[1] for r in found if r[0] >= 0], dtype=np.float64), next((r[1] for r in found if r[0] < 0), 0.0))
    )

    def scores(batches):
        at, values, bias = kept.value
        weights = np.zeros(1 << BITS)
        weights[at] = values
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for text in batch.column(1).to_pylist():
                own = slots(text)
                total = weights[own].sum() + bias
                out.append(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(tidied(scores), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
