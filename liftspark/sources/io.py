"""Reading and writing tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "orc", "text", "noop")


def read_parquet(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Files by path, folder or glob; files without rows keep the schema."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line, under a given schema, so that nothing is scanned to guess one."""
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", column)


def from_pydict(spark: SparkSession, columns: dict[str, list], schema: T.StructType | str | None = None) -> DataFrame:
    """Columns held by the caller."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    if schema is None:
        import pyarrow as pa

        return spark.createDataFrame(pa.table(columns))
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def write(df: DataFrame, path: str | None, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    if format not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    writer = df.write.format(format).mode("append" if format == "noop" else mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path that all executors see: below spark.checkpoint.dir, or a temporary folder where all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tables-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def plan_digest(df: DataFrame) -> str:
    """Digest of a frame's analysed plan, without the ids that differ between sessions."""
    import re

    text = df._jdf.queryExecution().analyzed().toString()
    return hashlib.sha256(re.sub(r"#\d+L?", "", text).encode()).hexdigest()
