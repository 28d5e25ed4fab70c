"""A content-addressed web archive: payload bytes once per SHA-256, exact record headers apart, records rebuilt by a join.

`write_archive` makes two tables in a folder: `payloads` (digest, payload), a row per different payload, and `headers` (page_id,
digest, block), a row per record with the bytes of its WARC/1.1 header up to the blank line. Of the records with equal payloads of at least
`SMALLEST` bytes, that with the smallest page_id is the response and the others are revisits of it; smaller payloads are all responses.
`rebuild` joins them to the records' exact bytes and the payload that each stands for. Payloads are joined in copies where very many records share one,
and only the digests of those are broadcast. `read_archive` parses the rebuilt records: header lines end with CR LF and nothing
else, and it fails on a record whose payload isn't there, or isn't of the digest or length that its header says.

A url that holds control characters or line separators is written in form encoding, and a field `ESCAPED` says so, which makes it come back as it was.

Defined results: a null html is an empty payload; a null url has no target field, an empty one an empty field; rows that repeat a page_id each have a
record, and if they share the payload, each is the response if it has the smallest id; null page_ids are larger than all others and written
as an empty id; ties don't occur, since equal ids are all response; a payload may be as long as a row of Spark, it is hashed and compared as a whole;
an empty table gives an empty archive; further columns are ignored, whatever their names.

The archive is the result: whoever asks for it deletes its folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import join_hot_aware, join_salted

SMALLEST = 100
END = "\r\n"
#: The pages' table has no time of capture, so all records take this one unless write_archive is told another.
DATE = "1970-01-01T00:00:00Z"
ESCAPED = "X-Target-URI-Escaped: form"
#: Control characters, and what some readers take for the end of a line.
BREAKING = "[\\p{Cc}\\u2028\\u2029]"


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """One shuffle of the payloads: each task hands on one copy of every payload that it meets, so copies cost nothing further."""
    raw = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    known = raw.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    known.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    slim = known.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    total = pages.count()
    firsts = join_hot_aware(slim, first, "digest", "n", total, "left")
    is_revisit = (F.col("bytes") >= SMALLEST) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    breaks = F.col("url").rlike(BREAKING)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.when(breaks, F.url_encode("url")).otherwise(F.col("url"))),
        F.when(breaks, ESCAPED),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.lower(F.hex("digest"))),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(is_revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    block = F.concat(F.concat_ws(END, *lines), F.lit(END + END)).cast("binary")
    firsts.select("page_id", "digest", block.alias("block")).write.parquet(f"{path}/headers")


def field(head: Column, name: str) -> Column:
    """The value of a header field, null if there is none. Lines end with CR LF only, and values hold neither."""
    found = F.filter(F.split(head, END), lambda line: line.startswith(f"{name}: "))
    return F.substring(F.get(found, F.lit(0)), F.lit(len(name) + 3), F.lit(1 << 30))


def _id(value: Column) -> Column:
    return F.regexp_extract(value, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, record, payload): each record's exact bytes, and the payload that it stands for.

    A payload isn't joined unless its bytes have the digest under which it is stored, and a record without a payload is an error.
    """
    heads = spark.read.schema("page_id long, digest binary, block binary").parquet(f"{path}/headers")
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    bodies = stored.where(F.col("digest") == F.unhex(F.sha2("payload", 256)))
    sizes = heads.groupBy("digest").agg(F.count("*").alias("n"))
    both = join_salted(heads, bodies, "digest", sizes, heads.count(), how="left")
    kind = field(F.substring_index(F.col("block").cast("string"), END + END, 1), "WARC-Type")
    payload = F.coalesce("payload", F.raise_error(F.lit("no payload of a record's digest")).cast("binary"))
    end = F.lit((END + END).encode())
    whole = both.select("page_id", kind.alias("record_type"), "block", payload.alias("payload"))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("page_id", "record_type", F.concat("block", body, end).alias("record"), "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record, read from its rebuilt bytes."""
    head = F.substring_index(F.col("record").cast("string"), END + END, 1)
    parts = rebuild(spark, path).select("record", "payload", head.alias("head"))
    at = F.octet_length("head") + 2 * len(END)
    told = field(F.col("head"), "Content-Length").cast("int")
    named = parts.select(
        _id(field(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        field(F.col("head"), "WARC-Type").alias("record_type"),
        _id(field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        field(F.col("head"), "WARC-Payload-Digest").alias("told"),
        field(F.col("head"), "WARC-Target-URI").alias("target"),
        F.col("head").contains(END + ESCAPED).alias("escaped"),
        F.octet_length("record").alias("size"),
        (at + told + 2 * len(END)).alias("told_size"),
        F.expr(f"substring(record, octet_length(head) + {2 * len(END) + 1}, octet_length(record) - octet_length(head) - {4 * len(END)})").alias("body"),
        "payload",
    )
    payload = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("body"))
    read = named.withColumn("bytes", payload).withColumn("digest", F.sha2("bytes", 256))
    fits = (F.concat(F.lit("sha256:"), "digest") == F.col("told")) & (F.col("size") == F.col("told_size"))
    return read.select(
        "page_id",
        F.octet_length("bytes").cast("long").alias("payload_bytes"),
        F.when(fits, F.col("digest")).otherwise(F.raise_error(F.lit("a record isn't what its header says"))).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.when(F.col("escaped"), F.url_decode("target")).otherwise(F.col("target")).alias("url"),
    )
