"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session on one machine without one gets a temporary folder; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Columns beyond which a table's expressions are not made one method.
WIDE = 30


@contextmanager
def small_methods(spark: SparkSession):
    """Runs what lies within without generated methods of more than 8,000 bytes, which the JVM only interprets; Spark then takes several smaller ones."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: what follows reads it instead of computing it anew, and a lost executor costs no rerun.

    Results may read it as long as they live, so whoever owns the folder empties it; nothing here deletes it.
    """
    path = f"{shared_folder(df.sparkSession)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    if len(df.columns) > WIDE:
        with small_methods(df.sparkSession):
            df.write.parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
