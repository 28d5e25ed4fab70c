"""CSV files whose form isn't known: reading, inspecting, first lines.

Nothing is read by the driver itself; samples come through Spark's readers, so any path that Spark can read will do.
"""

from __future__ import annotations

import csv
import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlens.operators.convert import FORMATS

#: Fixed value: texts that count as missing, in whatever case.
MISSING = ("", "na", "n/a", "nan", "null", "none", "?", "-", "--")
_ZERO_WIDTH = "[​-‍﻿]"


def head_lines(spark: SparkSession, path: str, n: int = 250, encoding: str = "utf-8") -> DataFrame:
    """(line): the first lines of a file."""
    line = F.col("value") if encoding.lower() in ("utf-8", "utf8") else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.text(path).limit(n).select(line.alias("line"))


def sniff(spark: SparkSession, path: str, delimiters: str = ";,\t|", fallback: str = ";", chars: int = 4096, encoding: str = "utf-8") -> str:
    """The delimiter, from the first few thousand characters."""
    lines = [r[0] for r in head_lines(spark, path, 50, encoding).collect()]
    text = "\n".join(lines)[:chars]
    try:
        return csv.Sniffer().sniff(text, delimiters).delimiter
    except csv.Error:
        counts = {d: lines[0].count(d) if lines else 0 for d in delimiters}
        best = max(counts, key=counts.get)
        return best if counts[best] else fallback


def breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value of the file holds a line break: some line has an odd number of quotes. One pass that can be split, unlike parsing such a file."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of just that name: headers may hold dots."""
    return F.col(_quoted(name))


def unique_names(header: list[str]) -> list[str]:
    """Repeated names get .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in header:
        n = seen.get(name, 0)
        out.append(f"{name}.{n}" if n else name)
        seen[name] = n + 1
    return out


def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def normal_id(x: Column) -> Column:
    """Without zero-width characters, in compatibility form, trimmed. ASCII values don't go through Python."""
    bare = F.regexp_replace(x, _ZERO_WIDTH, "")
    return F.trim(F.when(bare.rlike("[^\\x00-\\x7F]"), F.pandas_udf(_nfkc, StringType())(bare)).otherwise(bare))


def _raw(spark: SparkSession, path: str, sep: str, encoding: str, multi_line: bool | None = None) -> tuple[DataFrame, list[str]]:
    """All columns as text, with _fields, the number of values that a line has; short lines are filled with nulls, long ones cut.

    A value that is there and empty is the empty text. multi_line says that quoted values hold line breaks; None finds out.
    """
    first = head_lines(spark, path, 1, encoding).collect()
    header = unique_names(next(csv.reader([first[0][0].lstrip("﻿")], delimiter=sep))) if first else []
    broken = breaks_lines(spark, path) if multi_line is None else multi_line
    schema = ", ".join([f"{_quoted(h)} string" for h in header] + ["_corrupt string"])
    reader = spark.read.schema(schema).option("sep", sep).option("header", True).option("encoding", encoding).option("multiLine", broken).option("escape", '"')
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).option("columnPruning", False).option("emptyValue", "").csv(path)
    # Only lines of another width are kept as they are; what is in quotes can't hold a delimiter that counts.
    bare = F.regexp_replace("_corrupt", '"(?:[^"]|"")*"', "")
    fields = F.when(F.col("_corrupt").isNull(), len(header)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1)
    # A query over the corrupt lines alone, such as a count, isn't allowed; the first column is looked at as well, though it never decides.
    head = column(header[0]) if header else F.lit("")
    given = df.withColumn("_fields", F.coalesce(fields, F.length(head)).cast("int"))
    return given.select(*[F.when(F.col("_fields") > k, F.coalesce(column(h), F.lit(""))).alias(h) for k, h in enumerate(header)], "_fields"), header


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns in which any value is a number become numbers, all others of theirs null; first as they are, with a decimal comma or point, then without spaces."""
    def plain(c):
        return F.replace(column(c), F.lit(","), F.lit(".")).try_cast("double")

    def tight(c):
        return F.regexp_replace(F.replace(column(c), F.lit(","), F.lit(".")), "[   ]", "").try_cast("double")

    if not columns:
        return df
    row = df.agg(*[F.struct(F.count(plain(c)).alias("a"), F.count(tight(c)).alias("b")).alias(c) for c in columns]).first()
    out = []
    for c in df.columns:
        if c in columns and row[c]["a"]:
            out.append(plain(c).alias(c))
        elif c in columns and row[c]["b"]:
            out.append(tight(c).alias(c))
        else:
            out.append(column(c))
    return df.select(*out)


def datetimes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of which half the rows or more are times become texts like 2022-09-01 00:20:00, the others of theirs null."""
    def parsed(c):
        return F.coalesce(*[F.try_to_timestamp(column(c), F.lit(f)) for f in FORMATS])

    if not columns:
        return df
    row = df.agg(F.count("*").alias("_n"), *[F.count(parsed(c)).alias(c) for c in columns]).first()
    hit = {c for c in columns if row[c] and row[c] >= 0.5 * row["_n"]}
    return df.select(*[F.date_format(parsed(c), "yyyy-MM-dd HH:mm:ss").alias(c) if c in hit else column(c) for c in df.columns])


ACCOUNTS = ("Account", "Account.1")


def read_csv(
    spark: SparkSession, path: str, nrows: int | None = None, sep: str | None = None, account_columns: tuple[str, ...] = ACCOUNTS, encoding: str = "utf-8", multi_line: bool | None = None
) -> DataFrame:
    """A robust scan: the delimiter is found if not given, account columns are normalised text, other columns become numbers or times by what they hold.

    Lines with too few values are filled with nulls; those with too many are left out, and wide_lines counts them. Quoted values may hold line breaks.
    """
    df, header = _raw(spark, path, sep or sniff(spark, path, encoding=encoding), encoding, multi_line)
    df = df.where(F.col("_fields") <= len(header)).drop("_fields")
    if nrows is not None:
        df = df.limit(nrows)
    df = df.select(*[normal_id(column(c)).alias(c) if c in account_columns else column(c) for c in header])
    texts = [c for c in header if c not in account_columns]
    df = numbers(df, texts)
    return datetimes(df, [c for c, kind in df.dtypes if kind == "string" and c in texts])


def wide_lines(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8", multi_line: bool | None = None) -> int:
    """Lines with more values than the header has, which read_csv leaves out."""
    df, header = _raw(spark, path, sep or sniff(spark, path, encoding=encoding), encoding, multi_line)
    return df.where(F.col("_fields") > len(header)).count()


def read_account(
    spark: SparkSession, path: str, account: str, source: str = "Account", target: str = "Account.1", timestamp: str = "Timestamp", sep: str = ";", encoding: str = "utf-8"
) -> tuple[DataFrame, DataFrame]:
    """The file's rows, all as text, in which the normalised account sends or receives; and one row (total_rows, rows_for_account, dataset_min_date, dataset_max_date).

    A column that the file lacks is null in all rows, and so never the account.
    """
    df, header = _raw(spark, path, sep, encoding)
    df = df.where(F.col("_fields") <= len(header)).drop("_fields")
    for c in (source, target):
        df = df.withColumn(c, normal_id(column(c)) if c in header else F.lit(None).cast("string"))
    probe = normal_id(F.lit(account))
    is_theirs = F.coalesce((column(source) == probe) | (column(target) == probe), F.lit(False))
    when = F.coalesce(*[F.try_to_timestamp(column(timestamp), F.lit(f)) for f in FORMATS]).cast("timestamp_ntz") if timestamp in header else F.lit(None).cast("timestamp_ntz")
    stats = df.agg(F.count("*").alias("total_rows"), F.count_if(is_theirs).alias("rows_for_account"), F.min(when).alias("dataset_min_date"), F.max(when).alias("dataset_max_date"))
    return df.where(is_theirs), stats


def read_numeric_column(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One column of a semicolon file as numbers, spaces dropped and commas as points."""
    df, _ = _raw(spark, path, ";", "utf-8")
    return df.select(F.replace(F.replace(column(name), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double").alias(name))


def inline_table(spark: SparkSession, text: str, sep: str = ";", account_columns: tuple[str, ...] = ACCOUNTS) -> DataFrame:
    """A table that stands in the program's text, its first line the header: account columns as they are, others as numbers if they hold any."""
    lines = [row for row in csv.reader(text.strip().splitlines(), delimiter=sep) if row]
    header = unique_names(lines[0])
    rows = [tuple((row + [None] * len(header))[: len(header)]) for row in lines[1:]]
    df = spark.createDataFrame(rows, ", ".join(f"{_quoted(h)} string" for h in header))
    return numbers(df, [c for c in header if c not in account_columns])


_INT, _FLOAT = r"^[+-]?\d+$", r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"
#: Fixed value: what counts as a time.
_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"
#: Fixed value: texts that count as truth values, in whatever case.
_BOOLS = ("true", "false", "1", "0", "yes", "no", "y", "n", "t", "f")


def column_profile(df: DataFrame, columns: list[str], missing: tuple[str, ...] = MISSING) -> DataFrame:
    """(column, missing_count, missing_pct, non_null_count, inferred_dtype) of text columns: the narrowest of bool, int, float, datetime, string that all given values fit."""
    def facts(c):
        v = F.trim(column(c))
        gone = v.isNull() | F.lower(v).isin(*missing)
        given = F.when(~gone, v)
        kind = (
            F.when(F.count(given) == 0, F.lit("string"))
            .when(F.bool_and(F.lower(given).isin(*_BOOLS)), "bool")
            .when(F.bool_and(given.rlike(_INT)), "int")
            .when(F.bool_and(given.rlike(_FLOAT)), "float")
            .when(F.bool_and(given.rlike(_DATE)), "datetime")
            .otherwise("string")
        )
        return F.struct(
            F.lit(c).alias("column"),
            F.count_if(gone).alias("missing_count"),
            F.round(F.coalesce(F.try_divide(F.count_if(gone) * 100.0, F.count("*")), F.lit(0.0)), 4).alias("missing_pct"),
            F.count(given).alias("non_null_count"),
            kind.alias("inferred_dtype"),
        )

    return df.agg(F.array(*[facts(c) for c in columns]).alias("all")).select(F.explode("all").alias("r")).select("r.*")


def inspect_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8", strict: bool = False) -> dict:
    """Delimiter, lines, columns, rows of another width, and the profile of every column. strict raises on such rows."""
    sep = sep or sniff(spark, path, encoding=encoding)
    df, header = _raw(spark, path, sep, encoding)
    row = df.agg(F.count("_fields").alias("n"), F.count_if(F.col("_fields") != len(header)).alias("bad")).first() if header else {"n": 0, "bad": 0}
    if strict and row["bad"]:
        raise ValueError(f"{row['bad']} rows of another width")
    profile = column_profile(df, header).collect() if header else []
    return {
        "line_count": row["n"] + bool(header),
        "separator": {",": "comma (,)", ";": "semicolon (;)", "\t": "tab (\\t)"}.get(sep, repr(sep)),
        "delimiter": sep,
        "num_columns": len(header),
        "columns": header,
        "data_rows": row["n"],
        "malformed_rows": row["bad"],
        "columns_info": {r["column"]: {k: r[k] for k in ("missing_count", "missing_pct", "non_null_count", "inferred_dtype")} for r in profile},
    }


def snake(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
