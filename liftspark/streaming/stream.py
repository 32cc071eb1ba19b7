"""Lowered functions over Structured Streaming.

A deferred call resolves to an ordinary column, so the operations of
liftspark.ops work on streaming frames as they are; these helpers add the
reading and writing around them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Appends everything that is there to files and ends; started again with the same checkpoint it goes on where it was."""
    return df.writeStream.format(format).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def through(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Runs new files of a folder through a transformation, each exactly once."""
    write_stream(transform(read_stream(spark, source, schema)), target, checkpoint).awaitTermination()
