"""SimHash near-duplicates with pigeonring candidate filtering.

A text's words (ASCII case folded, split at ASCII white space) make three-word shingles; each shingle's 64-bit hash votes on every bit.
Fingerprints that differ in at most 3 bits are linked, and a document's component is the smallest doc_id that links reach.

Candidates. The 64 bits stand in a ring of four segments of 16. If two fingerprints differ in at most 3 bits, then by the pigeonring
principle some segment starts a chain whose every prefix of length l has at most floor(3 * l / 4) differences: none in the first
segment, at most 1 in the first two, at most 2 in the first three. The first two conditions become an equality join: one side carries the
start segment with its exact successor, the other side the start segment with the successor and all its one-bit variants. The third condition and
then the full Hamming distance are checked on what the join gives.

Exact copies. Documents with one fingerprint are one row in all of this; they come back in the last join.

Defined results: null and blank texts have no shingle and fingerprint 0, which links like any other; fewer than three words make one
shingle; rows that repeat a doc_id each get a row; null doc_id counts as an id of its own and is larger than all others; a text is read as a
whole, however long, its hashes in blocks; ties of a bit count as unset, and of rows with one id and fingerprint `keep_one` keeps the smallest text; an empty table gives an empty
result; further columns are ignored, or kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BROADCAST_BYTES, column, free_name, join_hot_aware, slices, tidied, written
from ledgerlens.llm.components import components

#: A-Z to a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingle hashes per numpy block when bits are counted: 64 bytes each.
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """64 bits: bit b is set if over half of the shingle hashes have it."""
    words = (text or b"").translate(FOLD).split()
    if not words:
        return 0
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b"%b %b %b" % three, 42) for three in zip(words, words[1:], words[2:])]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = np.array(hashes[at : at + BLOCK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")



def _fingerprints(batches):
    for whole in batches:
        for batch in slices(whole, 1):
            found = [fingerprint(x) for x in batch.column(1).to_pylist()]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long): the fingerprint's 64 bits as a signed number."""
    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(tidied(_fingerprints), "doc_id long, fp long")


def links(classes: DataFrame) -> DataFrame:
    """(a, b): all pairs of different fingerprints with at most 3 differing bits, a < b; some pairs come more than once.

    classes has one row per fingerprint, in column fp. A fingerprint makes 8 rows: for each of the four start segments, the segment
    with either half of its successor. At most one difference in the successor leaves one half equal, so the key (start,
    segment, half) holds 24 equal bits, and the chain's budgets and the Hamming distance are conditions of the join itself.
    """
    turned = F.expr("explode(array(0, 1, 2, 3))").alias("start")
    ring = classes.select("fp", turned).withColumn(
        "turn", F.expr("case when start = 0 then fp else shiftleft(fp, 16 * start) | shiftrightunsigned(fp, 64 - 16 * start) end")
    )
    halves = F.expr(
        """explode(array(
            shiftleft(cast(start as bigint), 40) | shiftleft(shiftrightunsigned(turn, 48), 8) | (shiftrightunsigned(turn, 40) & 255),
            shiftleft(cast(start + 4 as bigint), 40) | shiftleft(shiftrightunsigned(turn, 48), 8) | (shiftrightunsigned(turn, 32) & 255)))"""
    ).alias("bucket")
    keyed = ring.select("fp", "turn", halves)
    a, b = keyed.alias("a"), keyed.alias("b")
    differ = F.expr("a.turn ^ b.turn")
    chain = (F.bit_count(F.shiftrightunsigned(differ, 32)) <= 1) & (F.bit_count(F.shiftrightunsigned(differ, 16)) <= 2)
    near = F.bit_count(differ) <= 3
    return a.join(
        b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.fp") < F.col("b.fp")) & chain & near
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, component_id, root), a row per row of docs; root is a fingerprint that stands for the component."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    roots = components(links(classes), "a", "b")
    of_class = classes.join(roots, classes["fp"] == roots["vertex"], "left").select("fp", "least", "n", "root")
    of_root = of_class.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component"))
    known = of_class.join(of_root, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"), "n")
    return join_hot_aware(marked, known, "fp", "n", total, "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of docs."""
    return _components(docs, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay if one row of each component does: that with the smallest doc_id; of rows that repeat the id, that with the smallest fingerprint and text."""
    near = written(_components(docs, id_col, text_col).select("doc_id", "fp", "component_id", "root"), "near")
    found = near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_stays")).agg(F.count("*").alias("n"))
    stay = written(found, "stay")
    held = stay.agg(F.count("*").alias("ids"), F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
    side = stay.select("_stays")
    if held["ids"] * 64 <= BROADCAST_BYTES:
        side = F.broadcast(side)
    kept = docs.join(side, column(id_col).cast("long").eqNullSafe(side["_stays"]), "left_semi")
    if held["most"] == 1:  # no id that stays is repeated
        return kept
    at = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    rows = written(near.groupBy("root").agg(F.min(at).alias("at")).select(F.col("at.doc_id").alias("_stays"), F.col("at.fp").alias("_fp")), "rows")
    marker = F.udf(lambda t: fingerprint(t) - (1 << 64) * (fingerprint(t) >> 63), "long", useArrow=True)
    print_col = free_name(docs, "_print")
    printed = kept.withColumn(print_col, marker(column(text_col).cast("string").cast("binary")))
    side = F.broadcast(rows) if rows.count() * 64 <= BROADCAST_BYTES else rows
    ours = printed.join(side, (F.col(print_col) == side["_fp"]) & column(id_col).cast("long").eqNullSafe(side["_stays"]), "left_semi")
    row = F.min_by(F.struct(*map(column, docs.columns)), F.coalesce(column(text_col).cast("string"), F.lit(""))).alias("row")
    return ours.groupBy(column(id_col).alias("_id"), F.col(print_col).alias("_fp")).agg(row).select("row.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
