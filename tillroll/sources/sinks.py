"""Writers: JSON lines, CSV with nested values as JSON, Markdown, and a manifest of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Columns in order of name; nested values as JSON."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)}
    made = df.select(*[(F.to_json(c) if c in nested else F.col(c)).alias(c) for c in sorted(df.columns)])
    made.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """These columns in this order, a missing one empty, as one CSV file with a header; for tables of summary rows."""
    made = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
    made.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One row as one JSON document, indented."""
    made = df.limit(1).select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    made.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def markdown_table(df: DataFrame) -> list[str]:
    """A small table's head, rule and rows."""
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *[r["line"] for r in markdown(df).collect()]]


def markdown(df: DataFrame) -> DataFrame:
    """Rows of a Markdown table as line, with bars escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
