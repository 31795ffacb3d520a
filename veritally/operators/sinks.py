"""What goes out: approved invoices and drafts as sheets, mappings as a file, and who may write or wait."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_prefix
from ..sources.workbook import write_bytes
from .target import IDENTIFIER, LOCATION_TYPES

#: Uploads that may be in flight, those worked on at once, and the answer beyond.
IN_FLIGHT, AT_ONCE, BUSY = 20, 2, 429
#: What a draft's properties say.
DRAFT = "DRAFT_UNVALIDATED"


def identifier(value: Column) -> Column:
    """A cell of an identifier: ``n:`` before one that is written as a number, ``s:`` before any other text."""
    own = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(own.rlike(IDENTIFIER), F.concat(F.lit("n:"), own)).otherwise(F.concat(F.lit("s:"), own))


def text(value: Column) -> Column:
    return F.concat(F.lit("s:"), F.coalesce(value.cast("string"), F.lit("")))


def number(value: Column) -> Column:
    return F.concat(F.lit("n:"), value.cast("string"))


def _sheets(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """(export, sheet, transaction, line, cells) of numbered invoices."""
    told = heads.select("export", "doc", "transaction", "taxCode")
    t = number(F.col("transaction"))
    head = F.array(t, text(F.col("number")), identifier(F.col("site")), identifier(F.col("po")), identifier(F.col("location")), text(F.col("location_type")), text(F.col("date")), number(F.col("net")), number(F.col("tax")), *[F.lit("s:")] * 4)
    taxes = F.array(t, text(F.col("taxCode")), number(F.col("net")))
    details = F.array(t, identifier(F.col("item")), text(strip_prefix(F.col("gtin"))), number(F.col("price").cast("decimal(18,4)")), number(F.col("qty").cast("decimal(18,4)")), text(F.col("taxCode")))
    top = heads.select("export", F.explode(F.array(F.struct(F.lit("Header").alias("sheet"), head.alias("cells")), F.struct(F.lit("Tax_Breakdown").alias("sheet"), taxes.alias("cells")))).alias("s"), "transaction")
    below = lines.join(told, ["export", "doc"]).select("export", F.lit("Details").alias("sheet"), "transaction", "line", details.alias("cells"))
    return top.select("export", "s.sheet", "transaction", F.lit(0).alias("line"), "s.cells").unionByName(below)


def batch_sheets(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """The three sheets of an export's invoices, numbered by document. One that is not ready, or of no known location type, stops the export.

    ``heads`` has (export, doc, ready, number, site, po, location, location_type, date, net, tax, taxCode), ``lines`` (export, doc, line,
    item, gtin, price, qty).
    """
    fit = F.when(~F.col("ready"), F.raise_error(F.lit("only validated invoices can be exported"))).when(~F.col("location_type").isin(LOCATION_TYPES), F.raise_error(F.lit("the location type must be a known one"))).otherwise(F.col("number"))
    numbered = heads.withColumn("number", fit).withColumn("transaction", F.row_number().over(Window.partitionBy("export").orderBy("doc")))
    return _sheets(numbered, lines)


def draft_sheets(drafts: DataFrame) -> DataFrame:
    """(doc, sheet, transaction, line, cells, mark) of manual drafts, one workbook each; every sheet says that it is one. ``drafts`` has (doc, payload: JSON)."""
    schema = "header struct<number:string,site:string,po:string,location:string,location_type:string,date:string,net:decimal(18,4),tax:decimal(18,4)>, taxCode string, details array<struct<item:string,gtin:string,price:decimal(18,4),qty:decimal(18,4)>>"
    own = drafts.withColumn("p", F.from_json("payload", schema)).where(F.col("p.header").isNotNull())
    heads = own.select(F.col("doc").alias("export"), "doc", F.lit(1).alias("transaction"), "p.header.*", "p.taxCode")
    lines = own.select(F.col("doc").alias("export"), "doc", F.posexplode("p.details").alias("at", "d")).select("export", "doc", (F.col("at") + 1).alias("line"), "d.*")
    return _sheets(heads, lines).withColumnRenamed("export", "doc").withColumn("mark", F.lit(DRAFT))


def write_config(spark: SparkSession, tables: dict[str, DataFrame], kept: dict, path: str, most: int = 100_000) -> DataFrame:
    """Write mapping tables with a config's other fields as one JSON file; the report has counts and no value.

    Mappings are small by their kind; one with more rows is refused.
    """
    held, told = dict(kept), []
    for name, df in tables.items():
        rows = [r.asDict() for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"{name} has too many rows")
        held[name] = rows
        told.append((name, len(rows), len({json.dumps(r, default=str, sort_keys=True) for r in rows})))
    write_bytes(spark, path, json.dumps(held, default=str).encode())
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).setPermission(where, spark._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    return spark.createDataFrame(told, "name string, rows long, distinct long")


def admitted(uploads: DataFrame, waiting: DataFrame) -> DataFrame:
    """(queue, id, answer, place): uploads in order of arrival while fewer than the most are in flight, else the busy answer.

    ``uploads`` has (queue, id, at), ``waiting`` (queue, n) in flight. The first places are worked on at once.
    """
    place = F.row_number().over(Window.partitionBy("queue").orderBy("at", "id"))
    told = uploads.withColumn("_n", place).join(waiting, "queue", "left").withColumn("place", F.col("_n") + F.coalesce("n", F.lit(0)))
    return told.select("queue", "id", F.when(F.col("place") > IN_FLIGHT, BUSY).otherwise(200).alias("answer"), F.when(F.col("place") <= IN_FLIGHT, F.col("place")).alias("place"))


def committed(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, committed): of requests that read the same revision of a key, the first wins; the others conflict, as one writer would decide.

    ``requests`` has (key, id, at, revision), ``ledger`` (key, revision).
    """
    held = ledger.withColumnRenamed("revision", "_now")
    told = requests.join(held, "key", "left").withColumn("_fresh", F.col("revision") == F.coalesce("_now", F.lit(0)))
    first = told.where("_fresh").groupBy("key").agg(F.min(F.struct("at", "id")).alias("w")).select("key", F.col("w.id").alias("id"), F.lit(True).alias("_won"))
    return told.join(first, ["key", "id"], "left").select("id", F.coalesce("_won", F.lit(False)).alias("committed"))


def page_numbers_of(pages: DataFrame, under: DataFrame) -> DataFrame:
    """(doc, page, numbers): invoice numbers of a page's text, else those below a heading. ``pages`` has (doc, page, text)."""
    from .pages import page_numbers

    below = under.groupBy("doc", "page").agg(F.array_sort(F.collect_set("value")).alias("_below"))
    own = pages.withColumn("_own", page_numbers(F.col("text"))).join(below, ["doc", "page"], "left")
    none = F.array().cast("array<string>")
    return own.select("doc", "page", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.coalesce("_below", none)).alias("numbers"))
