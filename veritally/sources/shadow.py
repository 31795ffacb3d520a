"""A large import in resumable steps beside the table in use, and the cut-over to it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbook import write_bytes

#: Rows of a batch.
BATCH_ROWS = 100_000


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(spark: SparkSession, folder: str, identity: str) -> DataFrame | None:
    """The rows of an import so far; None before its first step."""
    try:
        return spark.read.parquet(f"{folder}/shadow={identity}")
    except AnalysisException:
        return None


def advance(spark: SparkSession, rows: DataFrame, folder: str, identity: str, most: int | None = None, size: int = BATCH_ROWS) -> int:
    """Write the next batches, at most ``most`` of them, and tell how many are left.

    ``rows`` has (line, …) with lines from 1 on. A batch is ``size`` lines; a step is one job whose output shows as a whole or not
    at all, so that a lost step is written again and no batch twice.
    """
    numbered = rows.withColumn("batch", F.floor((F.col("line") - 1) / size).cast("long"))
    last = rows.agg(F.max("line").alias("n")).first().n
    batches = 0 if last is None else -(-last // size)
    own = written(spark, folder, identity)
    done = -1 if own is None else own.agg(F.max("batch").alias("b")).first().b
    stop = batches if most is None else min(batches, done + 1 + most)
    if stop > done + 1:
        numbered.where((F.col("batch") > done) & (F.col("batch") < stop)).write.mode("append").partitionBy("batch").parquet(f"{folder}/shadow={identity}")
    return batches - stop


def discard(spark: SparkSession, folder: str, identity: str) -> None:
    """Remove an import that is not in use."""
    if pointed(spark, folder) == identity:
        raise ValueError("the import is in use")
    system, where = _path(spark, f"{folder}/shadow={identity}")
    system.delete(where, True)


def pointed(spark: SparkSession, folder: str) -> str | None:
    """The identity of the import in use."""
    system, where = _path(spark, f"{folder}/CURRENT")
    return spark.read.text(f"{folder}/CURRENT").first().value if system.exists(where) else None


def cut_over(spark: SparkSession, folder: str, identity: str, expected: int) -> None:
    """Point readers to a complete import; one with another number of rows, or repeated lines, stays aside."""
    own = written(spark, folder, identity)
    told = None if own is None else own.agg(F.count("*").alias("n"), F.count_distinct("line").alias("lines")).first()
    if told is None or told.n != expected or told.lines != expected:
        raise ValueError("the import is not complete")
    write_bytes(spark, f"{folder}/CURRENT", identity.encode())


def in_use(spark: SparkSession, folder: str) -> DataFrame | None:
    identity = pointed(spark, folder)
    return None if identity is None else written(spark, folder, identity).drop("batch")
