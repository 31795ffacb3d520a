"""Queries for exports, drafts, resumable imports and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sinks as S
from ..operators import spatial as Q
from ..sources import shadow
from .registry import Registry, frame
from .roundtrips import scratch

R = Registry()

HEADS = "SELECT o_custkey AS export, o_orderkey AS doc, true AS ready, concat('N', cast(o_orderkey as string)) AS number, cast(o_custkey as string) AS site, concat('0', cast(o_orderkey as string)) AS po, '7' AS location, 'Store (S)' AS location_type, '2031-01-02' AS date, cast(10 as decimal(18,2)) AS net, cast(1 as decimal(18,2)) AS tax, 'S5' AS taxCode FROM {orders}"
ITEMS = "SELECT o_custkey AS export, o_orderkey AS doc, 1 AS line, cast(o_orderkey as string) AS item, 'ULT_0123' AS gtin, 2 AS price, 5 AS qty FROM {orders}"


@R.add("k06_batch_sheets", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders)
  SELECT o_custkey AS export, 'Header' AS sheet, 'n:' || t || '|s:N' || o_orderkey || '|' || CASE WHEN o_custkey = 0 THEN 's:0' ELSE 'n:' || o_custkey END || '|s:0' || o_orderkey || '|n:7|s:Store (S)|s:2031-01-02|n:10.00|n:1.00|s:|s:|s:|s:' AS cells FROM o
  UNION ALL SELECT o_custkey, 'Tax_Breakdown', 'n:' || t || '|s:S5|n:10.00' FROM o
  UNION ALL SELECT o_custkey, 'Details', 'n:' || t || '|' || CASE WHEN o_orderkey = 0 THEN 's:0' ELSE 'n:' || o_orderkey END || '|s:0123|n:2.0000|n:5.0000|s:S5' FROM o""")
def batch_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated invoices of an export as its three sheets."""
    return S.batch_sheets(frame(spark, sf_dir, HEADS), frame(spark, sf_dir, ITEMS)).select("export", "sheet", F.array_join("cells", "|").alias("cells"))


@R.add("k10_draft_sheets", "SELECT event_id AS doc, unnest(['Header', 'Tax_Breakdown', 'Details']) AS sheet, unnest(['n:1|s:=N|s:|n:5', 'n:1|s:S5|n:10.0000', 'n:1|n:12|s:']) AS cells, 'DRAFT_UNVALIDATED' AS mark FROM events")
def draft_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual draft as sheets; a text that looks like a formula stays text."""
    own = frame(spark, sf_dir, "SELECT event_id AS doc, '{{\"header\": {{\"number\": \"=N\", \"po\": \"5\", \"net\": 10}}, \"taxCode\": \"S5\", \"details\": [{{\"item\": \"12\", \"price\": 1, \"qty\": 2}}]}}' AS payload FROM {events}")
    return S.draft_sheets(own).select("doc", "sheet", F.array_join(F.slice("cells", 1, F.when(F.col("sheet") == "Header", 4).otherwise(3)), "|").alias("cells"), "mark")


@R.add("k14_written_config", "SELECT 'suppliers' AS name, count(*) AS rows, count(*) AS distinct FROM supplier UNION ALL SELECT 'regions', count(*), count(*) FROM region")
def written_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings written to a private file; the report has no value in it."""
    tables = {"suppliers": frame(spark, sf_dir, "SELECT s_suppkey, s_name FROM {supplier}"), "regions": frame(spark, sf_dir, "SELECT r_regionkey, r_name FROM {region}")}
    return S.write_config(spark, tables, {"version": "1"}, f"{scratch(spark)}/config.json")


@R.add("q01_admitted_uploads", "SELECT event_id AS id, CASE WHEN n + 5 > 20 THEN 429 ELSE 200 END AS answer FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def admitted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads while the queue has room."""
    uploads = frame(spark, sf_dir, "SELECT user_id AS queue, event_id AS id, ts AS at FROM {events}")
    return S.admitted(uploads, uploads.select("queue", F.lit(5).alias("n")).distinct()).select("id", "answer")


@R.add("q08_single_writer", "SELECT event_id AS id, event_id = min(event_id) OVER (PARTITION BY user_id) AND user_id % 3 <> 0 AS committed FROM events")
def single_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against one revision of a key: the first wins."""
    requests = frame(spark, sf_dir, "SELECT user_id AS key, event_id AS id, event_id AS at, 4 AS revision FROM {events}")
    return S.committed(requests, frame(spark, sf_dir, "SELECT DISTINCT user_id AS key, CASE WHEN user_id % 3 = 0 THEN 5 ELSE 4 END AS revision FROM {events}"))


@R.add("r13_page_numbers", "SELECT event_id AS doc, 1 AS page, CASE event_id % 3 WHEN 0 THEN 'INV-5' WHEN 1 THEN 'B-77' ELSE '' END AS numbers FROM events")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of pages: beside their label, else below it."""
    pages = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, CASE WHEN event_id % 3 = 0 THEN 'Tax Invoice No: INV-5' ELSE 'Goods' END AS text FROM {events}")
    words = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('n', 1, 'text', 'Invoice', 'x0', 10.0D, 'x1', 50.0D, 'top', 100.0D, 'bottom', 110.0D), named_struct('n', 2, 'text', 'No', 'x0', 55.0D, 'x1', 70.0D, 'top', 100.0D, 'bottom', 110.0D), named_struct('n', 3, 'text', 'B-77', 'x0', 60.0D, 'x1', 90.0D, 'top', 120.0D, 'bottom', 130.0D))) FROM {events} WHERE event_id % 3 < 2")
    return S.page_numbers_of(pages, Q.under_heading(words, 800.0)).withColumn("numbers", F.array_join("numbers", ","))


@R.add("k02_resumed_import", "SELECT count(*) AS rows, 0 AS left_over FROM lineitem")
def resumed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import in steps beside the table in use, resumed and cut over."""
    folder = scratch(spark)
    rows = frame(spark, sf_dir, "SELECT row_number() OVER (PARTITION BY 1 ORDER BY o_orderkey) AS line, o_orderkey AS k FROM {orders}")
    n = rows.count()
    left = shadow.advance(spark, rows, folder, "a", most=2, size=max(n // 5, 1))
    while left > 0:
        left = shadow.advance(spark, rows, folder, "a", most=2, size=max(n // 5, 1))
    shadow.cut_over(spark, folder, "a", n)
    found = shadow.in_use(spark, folder)
    lines = frame(spark, sf_dir, "SELECT l_orderkey AS k FROM {lineitem}")
    return lines.join(found, "k").agg(F.count("*").alias("rows")).withColumn("left_over", F.lit(left))


@R.add("h39_discarded_import", "SELECT count(*) AS rows, true AS kept FROM region")
def discarded_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shadow that is not in use goes, the one in use stays."""
    folder = scratch(spark)
    rows = frame(spark, sf_dir, "SELECT cast(r_regionkey + 1 as int) AS line FROM {region}")
    for identity in ("a", "b"):
        shadow.advance(spark, rows, folder, identity)
    shadow.cut_over(spark, folder, "a", rows.count())
    shadow.discard(spark, folder, "b")
    return shadow.in_use(spark, folder).agg(F.count("*").alias("rows")).withColumn("kept", F.lit(shadow.written(spark, folder, "b") is None))
