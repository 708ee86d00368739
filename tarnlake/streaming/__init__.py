"""Continuous loading: files of delimited text as a stream into a table.

Tables are otherwise loaded by batches, so this is the text loader over Structured Streaming and nothing more.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from tarnlake.functions.expr import SPARK_TYPES, Kind


def text_stream(spark: SparkSession, folder: str, schema: Mapping[str, Kind]) -> DataFrame:
    """Rows of text files as they come into a folder."""
    fields = [T.StructField(n, SPARK_TYPES[k]) for n, k in schema.items()]
    raw = spark.readStream.schema(T.StructType([*fields, T.StructField("_rest", T.StringType())])).option("sep", "|").option("quote", "").option("mode", "FAILFAST").csv(folder)
    return raw.drop("_rest")


def load_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all files there are, each once however often it is called, to a Parquet table."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
