"""Writers for tables, graph files, reports and the data dictionary."""

from __future__ import annotations

import io
import json
import math
import zipfile
from dataclasses import dataclass, field
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw headers of the snake-case names.
RAW_NAMES = {
    "ts": "Timestamp",
    "from_bank": "From Bank",
    "account": "Account",
    "to_bank": "To Bank",
    "account_1": "Account.1",
    "amount_received": "Amount Received",
    "receiving_currency": "Receiving Currency",
    "amount_paid": "Amount Paid",
    "payment_currency": "Payment Currency",
    "payment_format": "Payment Format",
    "is_laundering": "Is Laundering",
}


def column(name: str) -> Column:
    """The column of just that name: raw headers may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def write_csv(df: DataFrame, path: str, sep: str = ",", single: bool = False) -> None:
    """single makes one file, for reports of a few rows."""
    flat = df.select(*[(F.to_json(column(c)) if kind.startswith(("map", "array", "struct")) else column(c)).alias(c) for c, kind in df.dtypes])
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges with the headers that graph tools expect."""
    def titled(df):
        return df.select(*[column(c).alias("_".join(w.capitalize() for w in c.split("_"))) for c in df.columns])

    write_csv(titled(nodes), f"{path}/nodes")
    write_csv(titled(edges), f"{path}/edges")


def write_features(tables: dict[str, DataFrame], path: str, as_csv: bool = False) -> None:
    """Feature tables as Parquet, and as semicolon files if asked for."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        if as_csv:
            write_csv(df, f"{path}/csv/{name}", ";")


def run_folder(spark: SparkSession, base: str, name: str) -> str:
    """base/name, made if it isn't there, in whatever file system it lies."""
    path = f"{base.rstrip('/')}/{name}"
    _file_system(spark, path).mkdirs(_path(spark, path))
    return path


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file of a few bytes, through Spark's file systems."""
    out = _file_system(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


#: The sheets of an account's workbook, in order.
SHEETS = ("Stats", "DailySeries", "PaymentFormatDist", "PaymentCurrencyDist")
#: A sheet can't have more rows than this; longer tables are an error, not cut.
SHEET_ROWS = 1_048_576


def _sheet(df: DataFrame) -> str:
    rows = [tuple(df.columns), *df.limit(SHEET_ROWS).collect()]
    if len(rows) > SHEET_ROWS:
        raise ValueError("too many rows for a sheet")
    cells = []
    for row in rows:
        line = []
        for v in row:
            if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) and math.isfinite(v):
                line.append(f"<c><v>{v}</v></c>")
            elif v is None:
                line.append("<c/>")
            else:
                line.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        cells.append(f"<row>{''.join(line)}</row>")
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>{"".join(cells)}</sheetData></worksheet>'


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def workbook(tables: dict[str, DataFrame]) -> bytes:
    """A spreadsheet file with a sheet for each table, in order. For reports: its tables come to the driver, of at most SHEET_ROWS rows each."""
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    numbers = range(1, len(tables) + 1)
    named = "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(numbers, tables, strict=True))
    links = "".join(f'<Relationship Id="rId{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_KIND}.worksheet+xml"/>' for k in numbers)
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN}" xmlns:r="{_DOC}"><sheets>{named}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
    }
    for k, df in zip(numbers, tables.values(), strict=True):
        files[f"xl/worksheets/sheet{k}.xml"] = _sheet(df)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def write_account_report(spark: SparkSession, account: str, tables: dict[str, DataFrame], path: str) -> str:
    """The four sheets of an account's deep dive as one workbook, and each as a small table beside it; the workbook's path."""
    if tuple(tables) != SHEETS:
        raise ValueError(f"the sheets are {', '.join(SHEETS)}")
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}", single=True)
    file = f"{path}/account_{account}_summary.xlsx"
    write_bytes(spark, file, workbook(tables))
    return file


def write_ensemble(scored: DataFrame, report: DataFrame, features: DataFrame, top: DataFrame, path: str) -> None:
    """A detector run's four outputs as semicolon files: all scored rows, the top consensus rows, the report on groups, the report on features."""
    write_csv(scored, f"{path}/full", ";")
    write_csv(top, f"{path}/top", ";")
    write_csv(report, f"{path}/aggregate", ";", single=True)
    write_csv(features, f"{path}/features", ";", single=True)


#: (pattern kind, pattern, description), the first that fits a name.
DICTIONARY = (
    ("endswith", "_missing", "1 where the value was missing"),
    ("contains", "entropy", "Shannon entropy of binned amounts, bits"),
    ("contains", "hhi", "concentration of transactions over partners"),
    ("contains", "total_", "total of a direction"),
    ("contains", "max_", "largest amount of a direction"),
    ("contains", "net_flow", "paid minus received"),
    ("startswith", "PF_", "payment format, one-hot"),
    ("startswith", "PC_", "payment currency, one-hot"),
    ("endswith", "_s", "sender's account feature"),
    ("endswith", "_r", "receiver's account feature"),
)
SOURCES = {"account": "account aggregation", "transaction": "transaction, sender, receiver"}


def data_dictionary(spark: SparkSession, levels: dict[str, list[str]]) -> DataFrame:
    """(feature_name, level, source, description) of the columns of each level, sorted by level and name."""
    rows = [(c, level, SOURCES.get(level, level)) for level, columns in levels.items() for c in columns]
    df = spark.createDataFrame(rows, "feature_name string, level string, source string")
    name, text = F.col("feature_name"), F.lit("numeric feature")
    for kind, pattern, said in reversed(DICTIONARY):
        text = F.when(getattr(name, kind)(pattern), said).otherwise(text)
    return df.select("feature_name", "level", "source", text.alias("description")).orderBy("level", "feature_name")


#: What a feature build's folders hold.
FOLDERS = {
    "account_features": "features of accounts: totals, largest amounts, entropy, concentration, net flow; not scaled, for reading",
    "tx_features": "features of transactions, one-hot formats and currencies",
    "tx_with_context": "transactions with the features of sender (_s) and receiver (_r), for reading",
    "account_matrix": "numbers only, gaps filled, heavy tails as logs, scaled by quartiles: for detectors over accounts",
    "tx_matrix": "the same for transactions with both accounts' features",
}


def write_readme(spark: SparkSession, tables: dict[str, DataFrame], path: str, made_on: str) -> None:
    """A text beside a feature build's tables that says what each holds."""
    lines = [f"Feature tables, made on {made_on}", "", *[f"{name}: {FOLDERS.get(name, 'a table')} ({len(df.columns)} columns)" for name, df in tables.items()]]
    lines += ["", "Columns that end in _missing are 1 where a value was missing. The label is kept out of what the matrices are made of."]
    write_bytes(spark, f"{path}/README.txt", "\n".join(lines).encode())


@dataclass
class StepResult:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def write_step(name: str, result: StepResult, path: str) -> None:
    for table, df in result.tables.items():
        write_csv(df, f"{path}/{name}/{table}", single=True)


def write_summary(spark: SparkSession, results: dict[str, StepResult], path: str) -> None:
    """One JSON line with every step's metrics, notes and warnings."""
    text = json.dumps({k: {"metrics": r.metrics, "notes": r.notes, "warnings": r.warnings, "tables": sorted(r.tables)} for k, r in results.items()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
