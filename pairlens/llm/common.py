"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space (fixed pattern).
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of UTF-8 text; none for null.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is what the pattern asks for.
    """
    return text.lower().split() if text else []


def remainder(key: str | Column, m: int) -> Column:
    """crc32 of the key as text, modulo m; null for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def utf8(array: pa.Array) -> list[bytes | None]:
    """The bytes of a string column, without decoding them."""
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine (tests) a folder of our own where none is set, on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pairlens-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for a stage table in the shared folder, below the application's own folder."""
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path, writer = stage_path(df.sparkSession, name), df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_hashes(docs: DataFrame) -> list[Column]:
    """128 bits that name a row by all its columns: h1, h2."""
    if {"__h1", "__h2"} <= set(docs.columns):
        return [F.col("__h1").alias("h1"), F.col("__h2").alias("h2")]
    return [F.xxhash64(*docs.columns).alias("h1"), F.xxhash64(F.lit("row"), *docs.columns).alias("h2")]


def smallest(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    """k rows that do not depend on how the input is dealt out: the first by the keys."""
    return df.orderBy(*keys).limit(k)
