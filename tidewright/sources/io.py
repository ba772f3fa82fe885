"""Readers and writers: CSV, Parquet, JSON and ORC in; tables and JSON results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import nan_to_null

_READERS = {"csv": "csv", "txt": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc"}


def trim_header(df: DataFrame) -> DataFrame:
    """Column names without white space around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8, or ISO-8859-1 if a line of the text is no UTF-8: one distributed scan, which ends at the first such line."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def read_table(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """The table at path, by its suffix; CSV has a header line and is read as text. An unknown suffix is refused.

    encoding: of CSV; "auto" finds out whether it is UTF-8 or Latin-1, which reads the file once more.
    multi_line: quoted CSV fields may hold line breaks; such a file can't be split, so that one task reads it whole.
    """
    kind = _READERS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"{path}: csv, txt, parquet, json, jsonl and orc can be read")
    reader = spark.read
    if kind == "csv":
        encoding = encoding_of(spark, path) if encoding == "auto" else encoding
        reader = reader.options(header=True, encoding=encoding, multiLine=multi_line, escape='"')
    return nan_to_null(trim_header(reader.format(kind).load(path)))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", one_part: bool = True) -> None:
    """Results as JSON lines; missing values stay null. one_part: small aggregated ones, as one part."""
    (df.coalesce(1) if one_part else df).write.mode(mode).option("ignoreNullFields", False).json(path)
