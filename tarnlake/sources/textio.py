"""Delimited text: a record a line, every cell followed by ``|``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tarnlake.functions.expr import SPARK_TYPES, Kind

_REST = "_after_last_delimiter"


def read_text(spark: SparkSession, path: str, schema: Mapping[str, Kind]) -> DataFrame:
    """Typed rows of text files; a bad number or boolean fails the read, an empty text cell is the empty text."""
    fields = [T.StructField(n, SPARK_TYPES[k]) for n, k in schema.items()]
    raw = (
        spark.read.schema(T.StructType([*fields, T.StructField(_REST, T.StringType())]))
        .option("sep", "|")
        .option("quote", "")
        .option("escape", "\u0000")
        .option("mode", "FAILFAST")
        .csv(path)
        .drop(_REST)
    )
    texts = [n for n, k in schema.items() if k is Kind.STRING]
    return raw.fillna("", subset=texts) if texts else raw


def cell(c: Column, data_type: T.DataType) -> Column:
    """A cell's text: doubles with six decimals, booleans as true and false."""
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.format_string("%.6f", c.cast("double"))
    return c.cast("string")


def lines(df: DataFrame) -> DataFrame:
    """One text column, every cell followed by ``|``."""
    cells = [F.concat(F.coalesce(cell(F.col(f"`{f.name}`"), f.dataType), F.lit("")), F.lit("|")) for f in df.schema.fields]
    return df.select(F.concat(*cells).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    """The rows as text files, a folder of them written in parallel."""
    lines(df).write.mode("overwrite").text(path)
