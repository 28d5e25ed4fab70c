"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, benchmark passages, encoding.

Each stage takes what its predecessor kept and returns it with its decisions applied; stages are joined by Parquet tables in the shared folder,
so a lost executor costs the stage at hand and nothing before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, quality, simhash, substring
from ledgerlens.llm.common import column, free_name, shared_dir, table
from ledgerlens.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules."""
    verdict = free_name(docs, "rejected_by")
    judged = quality.cascade(docs, quality.order_rules(docs), out=verdict)
    return judged.where(F.col(verdict).isNull()).select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that earlier ones have too."""
    return substring.cut(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256)."""
    path = vocabulary("word_bpe_49k.json")
    coded = bpe.there_and_back(docs, path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("bpe_encoding", encoding),
]

#: SQL has no near-duplicate fingerprints, chains or merges; tests hold stages against brute-force versions, and of the whole pipeline the ids that stay on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/ledgerlens/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
