"""The work queue as a stream: latest revisions win, exported invoices never come in twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.ledger import latest

#: Steps of a job, and those that a crash interrupts.
STATES = ("queued", "processing", "review", "ready", "error", "exported")
IN_FLIGHT = ("queued", "processing")
AT_ONCE = 20


def incoming(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json", at_once: int = AT_ONCE) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).format(kind).load(path)


def merged(current: DataFrame | None, batch: DataFrame, key: str = "id", revision: str = "revision") -> DataFrame:
    """Current rows and a batch's, the highest revision of each key; an older revision changes nothing."""
    own = batch if current is None else current.unionByName(batch, allowMissingColumns=True)
    return latest(own, key, revision)


def fresh(batch: DataFrame, ledger: DataFrame, key: str = "invoice_key") -> DataFrame:
    """A batch's rows whose key the ledger lacks, each once: of equal keys the first row in order."""
    columns = [c for c in batch.columns if c != key]
    single = batch.groupBy(key).agg(F.min(F.struct(*columns)).alias("_row")).select(key, "_row.*") if columns else batch.distinct()
    return single.join(ledger.select(key).distinct(), key, "left_anti")


def interrupted(jobs: DataFrame) -> DataFrame:
    """After a crash, steps in flight become errors and are never resumed silently."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*IN_FLIGHT), "error").otherwise(F.col("status")))


def stale(rows: DataFrame, signature: str) -> DataFrame:
    return rows.where(~F.col("signature").eqNullSafe(F.lit(signature)))


#: Buckets of a kept table: a batch rewrites those that its keys fall into, and no others.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def kept(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The state: of each bucket its newest version, up to one before a batch if that is named; None if nothing is written."""
    try:
        own = spark.read.option("basePath", folder).parquet(folder)
    except AnalysisException:
        return None
    own = own if before is None else own.where(F.col("version") < before)
    newest = own.groupBy("bucket").agg(F.max("version").alias("version"))
    return own.join(F.broadcast(newest), ["bucket", "version"]).drop("version", "bucket")


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, key: str = "id", revision: str = "revision", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest revision of each key in buckets of a table; a replayed batch writes the same versions again.

    Batches are the table's only writer. Batch n writes ``folder/version=n/bucket=k`` for the buckets of its keys alone; the
    state of a bucket is its newest version (``kept``).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn("bucket", _bucket(key, buckets)).persist()
        touched = [r.bucket for r in marked.select("bucket").distinct().collect()]
        before = kept(spark, folder, number)
        old = None if before is None else before.withColumn("bucket", _bucket(key, buckets)).where(F.col("bucket").isin(touched))
        merged(old, marked, key, revision).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={number}")
        marked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Audit events by type and window of event time; rows later than the watermark are left out."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), "event").agg(F.count("*").alias("n"))
