"""Catalog archives: gzip NDJSON with a manifest, validated and published as a version behind a pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import violations
from ..operators.catalog import duplicate_sources, envelope_violations, reconcile, record_id, roles_of, terms

ROW = "kind string, source_hash string, source_sheet string, source_row int, keys array<string>, data map<string,string>, flags array<string>, _corrupt string"
LONGEST_LINE = 2_000_000


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest, through Spark's reader so that any store will do; missing parts are refused."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    manifest = json.loads(text)
    for part in ("manifest_version", "expected_counts", "sources"):
        if part not in manifest:
            raise ValueError(f"the manifest lacks {part}")
    if sum(v for k, v in manifest["expected_counts"].items() if k != "total") != manifest["expected_counts"].get("total"):
        raise ValueError("the manifest's counts don't add up")
    return manifest


def declared_roles(spark: SparkSession, manifest: dict) -> DataFrame:
    """(kind, role, header) of the manifest's column mapping."""
    rows = [(kind, role, header) for kind, roles in manifest.get("columns", {}).items() for role, headers in roles.items() for header in headers]
    return spark.createDataFrame(rows, "kind string, role string, header string")


def expected_counts(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(s["hash"], s.get("kind", "item"), int(s["count"])) for s in manifest["sources"]]
    return spark.createDataFrame(rows, "source_hash string, kind string, count long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows with an id, list cells and their violations. Gzip files can't be split, so rows are dealt out at once."""
    raw = spark.read.schema(ROW).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    dealt = raw.repartition(spark.sparkContext.defaultParallelism)
    named = dealt.withColumnRenamed("source_sheet", "sheet").withColumnRenamed("source_row", "row_number")
    tests = envelope_violations(["kind", "source_hash", "sheet", "row_number", "data"]) | {"line is corrupt": F.col("_corrupt").isNotNull(), "line is too long": F.length("_corrupt") > LONGEST_LINE}
    cells = F.transform_values("data", lambda _, v: F.coalesce(F.from_json(v, "array<string>", {"mode": "PERMISSIVE"}), F.array(v)))
    return named.withColumn("violations", violations(tests)).withColumn("data", cells).withColumn("id", record_id(F.col("source_hash"), F.col("sheet"), F.col("row_number"))).drop("_corrupt")


def publish(spark: SparkSession, rows: DataFrame, manifest: dict, folder: str) -> str:
    """Write rows and terms as a new version, check what was written, then let the pointer name it.

    Any violation, wrong count or repeated source leaves the old version in place. The pointer is itself a version of
    a one-row table, so readers see either the old name or the new one.
    """
    version = uuid.uuid4().hex
    target = f"{folder}/version={version}"
    rows.write.parquet(f"{target}/rows")
    written = spark.read.parquet(f"{target}/rows")
    bad = written.where(F.size("violations") > 0).select(F.explode("violations").alias("v")).groupBy("v").count().collect()
    if bad:
        raise ValueError(f"rows are refused: {sorted((r.v, r['count']) for r in bad)}")
    if not reconcile(written, expected_counts(spark, manifest)).isEmpty():
        raise ValueError("counts by source differ from the manifest's")
    if not duplicate_sources(written).isEmpty():
        raise ValueError("a source row is repeated")
    index = terms(roles_of(written.select("id", "kind", "data"), declared_roles(spark, manifest)))
    index.repartitionByRange("kind", "term").sortWithinPartitions("kind", "term", "id").write.partitionBy("kind").option("maxRecordsPerFile", 5_000_000).parquet(f"{target}/terms")
    pointer = spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return version


def current(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, terms) of the version that the pointer names, resolved once."""
    version = spark.read.parquet(f"{folder}/pointer").orderBy(F.desc("at")).first().version
    target = f"{folder}/version={version}"
    return spark.read.parquet(f"{target}/rows"), spark.read.parquet(f"{target}/terms")
