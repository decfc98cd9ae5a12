"""What several corpus operators need: tables, materialisation, keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, gone_at_exit, shared_folder

#: Characters that the contracts call white space: space and 0x09-0x0D.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest(df: DataFrame) -> DataFrame:
    """df, whose session sends texts to Python in batches of at most 8 MB where nothing else has been asked for."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(conf.get(name)).rstrip("b") == str(64 << 20):
        conf.set(name, "8m")
    return df


def documents(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, text (null: empty), row_key (a hash of the text) and extras; other columns go, so names can't clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return modest(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_key"), *extra)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder; it goes when the application ends."""
    return checkpointed(df)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held(modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` is 2; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 2, F.lit(False))


def written(df: DataFrame) -> DataFrame:
    """Like ``stored``, as a compressed Parquet table in the same shared folder; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """work, after which the Python worker gives freed memory back to the system, as workers live on between stages."""

    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return run
