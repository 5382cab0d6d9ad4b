"""Shared helpers: the shared scratch folder, materialised tables, Arrow blocks, salted joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.scratch import LOCAL_CHECKPOINTS, drop_path, materialise, release_shuffles, scratch_path, scratch_root

__all__ = ["LOCAL_CHECKPOINTS", "batch", "drop_path", "materialise", "release_shuffles", "salted_lookup", "scratch_path", "scratch_root", "shards", "sliced", "tasks_for", "text_table", "trim"]


def shards(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tasks_for(docs: DataFrame, each: int, column: str = "text") -> int:
    """Tasks of about `each` bytes of text, so that a task's share does not grow with the table; enough for the cores."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first().n
    return max(1, -(-total // each), min(docs.sparkSession.sparkContext.defaultParallelism, total >> 20))


def text_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text only (extra columns never clash); a null text is empty."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 8, how: str = "left") -> DataFrame:
    """left join of rows to a table that has one row for each key. A key that holds a large share of left's rows
    is spread over `salts` tasks by a hash of column `by`; right is repeated that often."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(by)), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")


def sliced(batches, rows: int = 2048):
    """Record batches of at most that many rows: what a task makes of a batch is held at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Give freed memory back: a Python worker lives on after its task, and what it keeps is lost to the others."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
