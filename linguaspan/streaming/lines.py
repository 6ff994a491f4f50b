"""The stateless operators on streams of lines: the same column expressions over readStream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of files as they come into a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "text")


def through(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """operator applied to every row of the stream, appended to Parquet; start() it, or use trigger(availableNow=True) first."""
    return operator(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
