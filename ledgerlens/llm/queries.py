"""The queries over the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chat, decontaminate, licenses, pages, quality, simhash, substring, toxicity, warc
from ledgerlens.llm.common import shared_dir, table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_formatting(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or vocabulary("byte_bpe_50k.json")
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes, members = chat.build(given.unionByName(more), path)
    return chat.digests(nodes, members, path)


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree /source/lang/thousand/: those with ids that end in 000 are the directory's licence file, in 500 that of /source/lang."""
    part = F.pmod("doc_id", F.lit(1000))
    top = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))
    inner = F.concat(top, F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"))
    path = F.when(part == 0, F.concat(inner, F.lit("LICENSE"))).when(part == 500, F.concat(top, F.lit("/LICENSE")))
    return docs.select(F.col("doc_id").alias("id"), path.otherwise(F.concat(inner, F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(document_files(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id").withColumn("cosine", F.round("cosine", 4))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.metrics(docs, quality.order_rules(docs))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ledgerlens/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).drop("url")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or vocabulary("word_bpe_49k.json")
    coded = bpe.there_and_back(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_license_scan": op2_license_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_html_extraction": op6_html_extraction,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
}
