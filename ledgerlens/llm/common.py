"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys can be hot, whatever the data.
HOT_SHARE = 64

#: Rows of a record batch that goes to a Python worker; a batch stands in the executor's memory twice, beside its heap and in the worker.
BATCH_ROWS = 500

#: A side whose measured size is within this is broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of just that name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes to be none of df's columns, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1 and so on, so that columns put beside them can't clash with any."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> str:
    """What numbered(df) calls the column name: that of just this name, or else of this name in other case."""
    names = df.columns if name in df.columns else [c.lower() for c in df.columns]
    return f"_{names.index(name if name in df.columns else name.lower())}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a new temporary folder for it; on a cluster that is an error, since each executor would write to a
    folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and lost executors cost no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column, separators: str = " \t\n\x0b\f\r") -> Column:
    """Array of the words of text, split at ASCII white space; null and blank text have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(separators))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0b\\f\\r]+"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same, and faster, if no other upper-case letter is there."""
    return F.when(~text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def join_hot_aware(left: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key and in column size the number of left's rows with that key.

    Keys with more than total/HOT_SHARE rows, at most HOT_SHARE of them, are broadcast; the others are shuffled. Rows of left with a
    hot key, or with none, are shuffled by a digest of the whole row, so that no task gets them together; the digest is the same if a task is run again. size isn't in the result.
    """
    fields = [c for c in right.columns if c not in (key, size)]
    limit = max(1, total // HOT_SHARE)
    packed = right.select(F.col(key), F.col(size), F.struct(*fields).alias("_side"))
    hot = packed.where(F.col(size) > limit).select(F.col(key).alias("_hot"), F.col("_side").alias("_hot_side"))
    cold = packed.where(F.col(size) <= limit).select(F.xxhash64(key).alias("_there"), F.col(key).alias("_cold"), F.col("_side").alias("_cold_side"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_at", F.when(alone, F.xxhash64(*left.columns)).otherwise(F.xxhash64(key)))
    out = out.join(cold, (F.col("_at") == F.col("_there")) & (F.col(key) == F.col("_cold")), "left")
    out = out.withColumn("_side", F.coalesce("_hot_side", "_cold_side"))
    if how == "inner":
        out = out.where(F.col("_side").isNotNull())
    return out.select(*left.columns, *[F.col(f"_side.{c}").alias(c) for c in fields])


def join_salted(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int, salts: int = 32, how: str = "inner") -> DataFrame:
    """left joined with right, which has few rows per key; sizes (key, n) has the number of left's rows per key, total rows in all.

    Rows of right whose key is hot, at most HOT_SHARE of them, are dealt out so many times, and left's rows with that key among the
    copies. Only the hot keys themselves are broadcast, so right's rows may be of any width.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(sizes.where(F.col("n") > limit).select(F.col(key).alias("_hot")))
    is_hot = F.col("_hot").isNotNull()
    spread = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return spread.drop("_hot").join(dealt, [key, "_salt"], how).drop("_salt")


def slices(batch, column: int, most_bytes: int = 4 << 20):
    """A record batch in pieces of at least one row and, but for single rows, at most so many bytes in the column; bounds what a Python worker holds."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)


def small_batches(spark: SparkSession) -> None:
    """Record batches hold BATCH_ROWS rows, unless the session was given a number of its own; Spark's 10,000 rows are tens of MB of texts, or more, for each running task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the machine. Workers are kept for later tasks, and what they hold on to counts against the executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim is not None:
        trim(0)


def tidied(run):
    """run, a function from record batches to record batches, which gives memory back when a task is over."""

    def worker(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return worker
