"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame expressions only.

Texts are folded from A-Z to a-z and cut into runs of digits, small letters and non-ASCII characters. An item's windows are its runs of 13
consecutive words, or the whole item if it is shorter. A window must be contained in full, so the prefix filter needs one token of it: its
rarest word, by the number of times that the benchmark's words occur in the corpus. The words of the documents are joined with
those prefix words; a match fixes where the window would have to stand, which must lie within the document (positional and length
bounds), and the words there are compared with the window's. Common words are never joined.

The benchmark's side is broadcast up to a measured size. Beyond it, words that can't be prefix words are screened out by a bitmap of fixed size where
they stand, what passes is shuffled without its text, and texts are fetched once, for documents that still have a candidate.

Defined results: a text is read as a whole, however long; of equally rare words of a window the smallest is its prefix;  null texts, and texts without words, have no words and no hits; items without words or without an id have no windows;
rows that repeat a doc_id are judged each by its own text; an item counts once however many of its windows or rows occur; an empty
benchmark leaves all documents clean; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, free_name, lower_ascii, written

WINDOW = 13
#: A benchmark side is broadcast up to this many bytes, and shuffled beyond.
BROADCAST_BYTES = 64 << 20
#: The bitmap of prefix words has two to so many bits, 8 MB; with ten million of them a seventh of all other words pass it.
SCREEN_BITS = 26

_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same without A-Z, for counting words without folding.
_BREAKS_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _BREAKS), "")


def _held(df: DataFrame, size: Column) -> int:
    """Bytes that df takes, by size for each row."""
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def _side(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if its measured size is within the bound."""
    return F.broadcast(df) if _held(df, size) <= BROADCAST_BYTES else df


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(item_id, window): the different windows of every item."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(
        F.col("item_id").isNotNull() & (F.size("w") > 0)
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    return (
        w.select("item_id", "w", F.explode(starts).alias("i"))
        .select("item_id", F.slice("w", F.col("i"), F.lit(length)).alias("window"))
        .distinct()
    )


def prefixes(docs: DataFrame, items: DataFrame, text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """(token, offset, window, item_id): each window with its rarest word in the corpus and where that stands in it."""
    wins = written(windows(items, length), "windows")
    vocabulary = written(wins.select(F.explode("window").alias("token")).distinct(), "vocabulary")
    spoken = docs.select(F.explode(words(column(text_col))).alias("token"))
    size = F.octet_length("token") + 64
    if _held(vocabulary, size) <= BROADCAST_BYTES:
        spoken = spoken.join(F.broadcast(vocabulary), "token")
        rarity = spoken.groupBy("token").agg(F.count("*").alias("times"))
    else:  # counted before they are shuffled
        rarity = spoken.groupBy("token").agg(F.count("*").alias("times")).join(vocabulary, "token", "left_semi")
    rarity = written(rarity, "rarity")
    placed = wins.select("item_id", "window", F.posexplode("window").alias("offset", "token"))
    ranked = placed.join(_side(rarity, size), "token")  # a window with a word that no document has can't occur
    return written(
        ranked.groupBy("item_id", "window").agg(
            F.min(F.struct("times", "token", "offset")).alias("r"), F.count("*").alias("found")
        )
        .where(F.col("found") == F.size("window"))
        .select(F.col("r.token").alias("token"), F.col("r.offset").alias("offset"), "window", "item_id"),
        "prefixes",
    )


def _screened(spread: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of spread whose token's hash is set in a bitmap of the tokens' hashes: all rows with one of tokens, and few others.

    The bitmap has 2 ** SCREEN_BITS bits in rows of 4 kB, so what is broadcast is bounded however many tokens there are.
    """
    slot = F.xxhash64("token").bitwiseAND(F.lit((1 << SCREEN_BITS) - 1)) + 1
    bits = tokens.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits")
    )
    near = spread.withColumn("_slot", slot).join(F.broadcast(bits), F.bitmap_bucket_number("_slot") == F.col("_bucket"))
    place = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_place & 7 as int)) & 1") == 1
    return near.withColumn("_byte", byte).withColumn("_place", place).where(is_set).select(*spread.columns)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, n_words, item_id, start, len): every occurrence of a window."""
    rare = prefixes(docs, items, text_col, length)
    text = column(text_col)
    whole = docs.select(column(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    start = F.col("at") - F.col("offset")
    size = F.size("window")
    if _held(rare, F.octet_length(F.array_join("window", " ")) + 16 * size + 128) <= BROADCAST_BYTES:
        spread = whole.select("doc_id", "text_hash", "w", F.posexplode("w").alias("at", "token"))
        there = spread.join(F.broadcast(rare), "token").where((start >= 0) & (start + size <= F.size("w")))
        there = there.withColumn("start", start)
    else:
        spread = whole.select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode("w").alias("at", "token"))
        could = _screened(spread, rare.select("token").distinct()).join(rare, "token")
        could = could.where((start >= 0) & (start + size <= F.col("n"))).select("doc_id", "text_hash", start.alias("start"), "window", "item_id")
        could = written(could, "candidates")
        asked = written(could.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "asked")
        same_doc = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        bare = docs.select(column(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("string").alias("text"))
        fetched = bare.join(_side(asked, F.lit(96)), same_doc, "left_semi").distinct()
        texts = fetched.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "text")
        there = could.join(texts, same_doc).withColumn("w", words(F.col("text")))
    same = there.where(F.slice("w", F.col("start") + 1, size) == F.col("window"))
    return written(
        same.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "item_id", "start", size.alias("len")).distinct(),
        "matches",
    )


def summaries(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items): per document with matches, the words in any of them and the items, sorted."""
    key = ["doc_id", "text_hash", "n_words"]
    spans = found.select(*key, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.max("end").over(W.partitionBy(*key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = spans.withColumn("new", new).groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    named = found.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    on = [hit[c].eqNullSafe(named[c]) for c in key]
    return hit.join(named, on).select(*[hit[c] for c in key], "n_hit", "items")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, words in windows, items, and whether it is contaminated (a twentieth of its words or more)."""
    found = summaries(matches(docs, items, id_col, text_col)).drop("n_words")
    text = column(text_col).cast("string")
    base = docs.select(
        column(id_col).alias("doc_id"),
        F.xxhash64(column(text_col)).alias("_hash"),
        F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAKS_ANY_CASE), "")).cast("long").alias("n_words"),
    )
    both = base.join(
        found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left"
    )
    none = F.array().cast("array<string>")
    full = both.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", none))
    return full.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated."""
    bad = summaries(matches(docs, items, id_col, text_col)).where(is_contaminated()).select("doc_id", "text_hash")
    bad = written(bad, "contaminated")
    key, digest = (free_name(docs, n) for n in ("_id", "_hash"))
    bad = _side(bad.toDF(key, digest), F.lit(96))
    return docs.join(bad, column(id_col).eqNullSafe(bad[key]) & (F.xxhash64(column(text_col)) == bad[digest]), "left_anti")
