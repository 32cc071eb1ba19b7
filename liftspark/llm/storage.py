"""Shared storage: tables that cut lineage, and files that workers map.

Everything lies below the folder that ``spark.checkpoint.dir`` names, which
all executors share, so a lost executor loses nothing that was written.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of keys (8 to 48 bytes each) is broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
BATCH_BYTES = "4m"


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Sets the bytes of an Arrow batch to BATCH_BYTES where the session has no setting of its own: an executor holds
    several copies of a batch, in the JVM and in each worker, and no operator here gains from large ones."""
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where there is none and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or (d.get() if (d := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined() else None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile are deleted at the end, but for ``lasting`` ones, which go with the scratch around this one if there is any.
    Nothing that is read later may depend on them: what outlives them is written itself."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for path in made:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(spark: SparkSession, name: str, lasting: bool = False) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if len(_scratch) > lasting:
        _scratch[-1 - lasting].append(path)
    return path


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again: each later read starts from these files."""
    path = fresh(df.sparkSession, name, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in(docs: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    names, on = docs.columns, [on] if isinstance(on, str) else on
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    keys = keys.toDF(*(f"{c}_of_keys_" for c in keys.columns))
    same = [docs[f"`{c}`"].eqNullSafe(keys[f"{c}_of_keys_"]) if len(on) > 1 else docs[f"`{c}`"] == keys[f"{c}_of_keys_"] for c in on]
    return docs.join(keys, same, how).select(*[F.col(f"`{c}`") for c in names])


def without(docs: DataFrame, drop: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of docs whose key isn't in drop (of the key's columns, already written). Rows with a null as their one key stay."""
    return _in(docs, drop, on, "left_anti")


def only(docs: DataFrame, keep: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of docs whose key is in keep (of the key's columns, already written). Among several, null equals null."""
    return _in(docs, keep, on, "left_semi")


def first_of_each(docs: DataFrame, on: list[str]) -> DataFrame:
    """Of rows with one key, that whose columns, as JSON, have the smallest SHA-256: the same one whatever the order of rows.
    Minima are pre-aggregated, so a key may have any number of rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    best = docs.groupBy(*on).agg(F.min_by(row, F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)).alias("first_of_key_"))
    return best.select(*[F.col("first_of_key_").getField(c).alias(c) for c in docs.columns])


def _local(uri: str) -> str | None:
    p = urlparse(uri)
    return p.path if p.scheme in ("", "file") else None


def put_file(uri: str, data: bytes) -> None:
    """Writes one file whole, so that a repeated task leaves the same."""
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def local_file(uri: str) -> str:
    """A path that can be memory-mapped: the file itself where the folder is mounted, else a copy beside the worker."""
    if (path := _local(uri)) is not None:
        return path
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    own = os.path.join(tempfile.gettempdir(), "mapped", path.strip("/").replace("/", "_"))
    if not os.path.exists(own):
        os.makedirs(os.path.dirname(own), exist_ok=True)
        part = f"{own}.{os.getpid()}"
        with store.open_input_stream(path) as src, open(part, "wb") as out:
            while chunk := src.read(1 << 22):
                out.write(chunk)
        os.replace(part, own)
    return own
