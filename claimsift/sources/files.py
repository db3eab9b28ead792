"""Claim files in, exports out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from claimsift.functions.text import strip_symbols
from claimsift.functions.values import finite_or_null, missing_to_null
from claimsift.operators.features import typed_claims
from claimsift.schema import CLAIM_TYPES

BOM = "﻿"


# A column of a line that has more or fewer cells than the header.
LINE = "(line)"


def csv_cells(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """A CSV file's cells as text, missing ones NULL, with ``_line`` where the number of cells is wrong."""
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    names = spark.read.csv(path, **options).columns
    layout = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_line"]])
    reader = spark.read.schema(layout).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    # Lines are only checked as wholes: a reader that skips columns finds none wrong.
    raw = reader.option("columnPruning", False).csv(path)
    return raw.select(*[missing_to_null(F.col(f"`{c}`")).alias(c.lstrip(BOM)) for c in names], "_line", F.col("_metadata.file_name").alias("_file"))


def read_claims_csv(spark: SparkSession, path: str, profile: str = "app", multi_line: bool = False) -> DataFrame:
    """A CSV file with a header, in any column order, in claim types.

    Cells are read as text, texts that mean "missing" become NULL, and known
    columns are cast; a cell that does not fit its type is NULL, and is found
    in the rejects of ``check_claims_csv``. ``multi_line`` allows line breaks
    in quoted cells, at the price of one task per file.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    clean = raw.select(*[missing_to_null(F.col(f"`{c}`")).alias(c.lstrip(BOM)) for c in raw.columns])
    return typed_claims(clean, profile)


@dataclass(frozen=True)
class CheckedClaims:
    """Claims of a file, what of it did not come in, and the sums of both.

    ``rejects`` has (file, row, column_name, cell): each cell that does not fit
    its column's type, with its row's cells as JSON, and each line whose number
    of cells is wrong, as a cell of the column ``(line)``; its other cells come in.
    ``report`` has (column_name, cells, accepted, rejected) of the typed columns
    and of the lines; accepted and rejected add up to the cells that hold something.
    """

    claims: DataFrame
    rejects: DataFrame
    report: DataFrame


def check_claims_csv(spark: SparkSession, path: str, profile: str = "app", multi_line: bool = False) -> CheckedClaims:
    """A CSV file as ``read_claims_csv`` reads it, with what was lost on the way.

    All three are read off the same lines; time columns are looked through once
    for their layouts, and nothing else is computed here.
    """
    cells = csv_cells(spark, path, multi_line)
    names = [c for c in cells.columns if c not in ("_line", "_file")]
    held = cells.withColumn("_raw", F.struct(*[F.col(f"`{c}`") for c in names]))
    typed = typed_claims(held, profile)
    checked = [c for c in names if c in CLAIM_TYPES and typed.schema[c].dataType != T.StringType()]
    given = {c: F.col(f"_raw.`{c}`") for c in checked}
    misfits = [F.when(given[c].isNotNull() & F.col(f"`{c}`").isNull(), F.struct(F.lit(c).alias("column_name"), given[c].alias("cell"))) for c in checked]
    lines = F.when(F.col("_line").isNotNull(), F.struct(F.lit(LINE).alias("column_name"), F.col("_line").alias("cell")))
    found = F.filter(F.array(*misfits, lines), lambda x: x.isNotNull())
    rejects = typed.select(F.col("_file").alias("file"), F.to_json("_raw").alias("row"), F.inline(found))
    counts = []
    for c in checked:
        counts += [F.struct(F.lit(c).alias("column_name"), F.count(given[c]).alias("cells"), F.count(F.when(given[c].isNotNull(), F.col(f"`{c}`"))).alias("accepted"))]
    counts += [F.struct(F.lit(LINE).alias("column_name"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col("_line").isNull()).alias("accepted"))]
    report = typed.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))
    report = report.withColumn("rejected", F.col("cells") - F.col("accepted"))
    return CheckedClaims(typed.drop("_raw", "_line", "_file"), rejects, report)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load_first_nonempty(sources: list) -> DataFrame | None:
    """The first source that yields rows; unreadable ones are passed over.

    Each source is a function without arguments that returns a frame.
    """
    for source in sources:
        try:
            df = source()
            if df is not None and not df.isEmpty():
                return df
        except PySparkException:
            continue
    return None


def sanitize_for_sink(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, NaN and infinities as NULL."""

    def clean(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            return F.when(F.date_format(column, "SSSSSS") == "000000", whole).otherwise(
                F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            )
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return finite_or_null(column)
        return column

    return df.select(*[clean(f).alias(f.name) for f in df.schema.fields])


def export_ready(df: DataFrame) -> DataFrame:
    """Symbols dropped from every text column."""
    texts = {f.name: strip_symbols(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(texts) if texts else df


def export_audit_csv(df: DataFrame, folder: str, as_of: datetime, bom: bool = False) -> str:
    """A folder of UTF-8 CSV parts with a header, named after the minute.

    With ``bom`` the first header cell of each part starts with a byte-order mark.
    """
    path = f"{folder.rstrip('/')}/Fraud_Audit_Export_{as_of:%Y%m%d_%H%M}.csv"
    ready = export_ready(df)
    if bom and ready.columns:
        ready = ready.withColumnRenamed(ready.columns[0], BOM + ready.columns[0])
    ready.write.csv(
        path, header=True, encoding="UTF-8", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path
