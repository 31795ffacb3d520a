"""Queries that write a source or a sink into a shared folder and read it back; and rows of words on pages."""

from __future__ import annotations

import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as Y
from ..operators import target as G
from ..sources import archive, workbook
from .registry import Registry, frame, plain
from .target import DOCS, FIELDS

R = Registry()

HASH = "repeat('ab', 32)"
ARCHIVE = f"SELECT 'item' AS kind, {HASH} AS source_hash, 'Items' AS source_sheet, cast(p_partkey + 1 as int) AS source_row, cast(array() as array<string>) AS keys, map('SKU', concat('K', cast(p_partkey as string)), 'Item description', p_name, 'Supplier', p_brand) AS data, cast(array() as array<string>) AS flags FROM {{part}} WHERE p_partkey >= 0"


def scratch(spark: SparkSession) -> str:
    """A new folder under the one that all executors share; on one machine a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="veritally-")
    return f"{shared}/trip-{uuid.uuid4().hex}"


def _archive(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    rows = frame(spark, sf_dir, ARCHIVE)
    rows.select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(f"{folder}/in")
    return archive.read_archive(spark, f"{folder}/in")


def _manifest(spark: SparkSession, sf_dir: str, folder: str) -> dict:
    n = frame(spark, sf_dir, ARCHIVE).count()
    told = {"manifest_version": "1", "expected_counts": {"item": n, "po": 0, "total": n}, "sources": [{"hash": "ab" * 32, "kind": "item", "count": n}], "columns": {"item": {"sku": ["SKU"], "description": ["Item description", "Name"]}}}
    workbook.write_bytes(spark, f"{folder}/manifest.json", json.dumps(told).encode())
    return archive.read_manifest(spark, f"{folder}/manifest.json")


@R.add("r01_archive_rows", f"SELECT 'item' AS kind, 'Items' AS sheet, CAST(p_partkey + 1 AS INT) AS row_number, sha256(repeat('ab', 32) || chr(0) || 'Items' || chr(0) || (p_partkey + 1)) AS id, p_name AS description, 0 AS violations FROM part WHERE p_partkey >= 0")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzip archive of catalog rows, read and checked."""
    found = _archive(spark, sf_dir, scratch(spark))
    return found.select("kind", "sheet", "row_number", "id", F.element_at(F.col("data")["Item description"], 1).alias("description"), F.size("violations").alias("violations"))


@R.add("r02_manifest_counts", "SELECT repeat('ab', 32) AS source_hash, 'item' AS kind, count(*) AS count FROM part WHERE p_partkey >= 0")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.expected_counts(spark, _manifest(spark, sf_dir, scratch(spark)))


@R.add("r03_declared_roles", "SELECT 'item' AS kind, unnest(['sku', 'description', 'description']) AS role, unnest(['SKU', 'Item description', 'Name']) AS header")
def declared_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.declared_roles(spark, _manifest(spark, sf_dir, scratch(spark)))


def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folder = scratch(spark)
    rows, manifest = _archive(spark, sf_dir, folder), _manifest(spark, sf_dir, folder)
    archive.publish(spark, rows, manifest, f"{folder}/out")
    return archive.current(spark, f"{folder}/out")


@R.add("k01_published_terms", """WITH n AS (SELECT p_partkey AS k, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM part WHERE p_partkey >= 0), t AS (SELECT DISTINCT k, unnest(list_concat(['i:k' || k, 'x:sku:k' || k, 'n:' || name], list_transform(list_filter(string_split(name, ' '), lambda w: length(w) >= 2), lambda w: 't:' || w))) AS term FROM n)
  SELECT sha256(repeat('ab', 32) || chr(0) || 'Items' || chr(0) || (k + 1)) AS id, term FROM t""")
def published_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the version that the pointer names, once rows are validated and counts agree."""
    return _published(spark, sf_dir)[1].select("id", "term")


@R.add("k04_cut_over", "SELECT count(*) AS rows, count(DISTINCT p_partkey) AS distinct_rows FROM part WHERE p_partkey >= 0")
def cut_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind the pointer."""
    return _published(spark, sf_dir)[0].agg(F.count("*").alias("rows"), F.count_distinct("id").alias("distinct_rows"))


@R.add("k03_sorted_terms", "SELECT TRUE AS sorted, TRUE AS bounded")
def sorted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file of the index is in order of its terms."""
    from pyspark.sql import Window

    own = _published(spark, sf_dir)[1].withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    before = F.lag("term").over(Window.partitionBy("file").orderBy("at"))
    return own.withColumn("ok", F.coalesce(before <= F.col("term"), F.lit(True))).agg(F.bool_and("ok").alias("sorted"), (F.count("*") > 0).alias("bounded"))


def _book(spark: SparkSession, sheets: dict[str, list[list]]) -> DataFrame:
    path, data = f"{scratch(spark)}/book.xlsx", io.BytesIO()
    workbook.write_xlsx(sheets, data)
    workbook.write_bytes(spark, path, data.getvalue())
    return workbook.read_workbooks(spark, path)


@R.add("r04_reference_workbook", "SELECT 'Nations' AS sheet, CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INT) AS row_no, CAST(n_nationkey AS VARCHAR) || '|' || n_name AS cells FROM nation UNION ALL SELECT 'Regions', CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS INT), CAST(r_regionkey AS VARCHAR) || '|' || r_name FROM region UNION ALL SELECT 'Nations', 1, 'id|name' UNION ALL SELECT 'Regions', 1, 'id|name'")
def reference_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of reference tables, written and read back."""
    frames = {"Nations": frame(spark, sf_dir, "SELECT n_nationkey AS id, n_name AS name FROM {nation}"), "Regions": frame(spark, sf_dir, "SELECT r_regionkey AS id, r_name AS name FROM {region}")}
    return _book(spark, workbook.sheets_of(frames, {"Nations": ["id"], "Regions": ["id"]})).select("sheet", "row_no", F.array_join("cells", "|").alias("cells"))


def _ods(rows: list[list[tuple[str | None, str | None, int, bool]]]) -> bytes:
    """A small ODS file: cells of (text, stored value, repeats, covered)."""
    import zipfile

    names = "".join(f' xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{p}:1.0"' for p in ("office", "table", "text"))
    told = ""
    for row in rows:
        cells = ""
        for text, value, times, covered in row:
            attributes = (f' office:value="{value}"' if value else "") + (f' table:number-columns-repeated="{times}"' if times > 1 else "")
            tag = "covered-table-cell" if covered else "table-cell"
            cells += f"<table:{tag}{attributes}>{f'<text:p>{text}</text:p>' if text else ''}</table:{tag}>"
        told += f"<table:table-row>{cells}</table:table-row>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("content.xml", f'<office:document-content{names}><office:body><office:spreadsheet><table:table table:name="T">{told}</table:table></office:spreadsheet></office:body></office:document-content>')
    return data.getvalue()


@R.add("r05_ods_rows", "SELECT * FROM (VALUES (1, 'a|-|-|b'), (2, '1250.5|x|x'), (4, 'z')) t(row_no, cells)")
def ods_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats expanded, stored values before formatted ones, merged cells in their places, blank rows left out."""
    path = f"{scratch(spark)}/t.ods"
    workbook.write_bytes(spark, path, _ods([[("a", None, 1, False), (None, None, 2, True), ("b", None, 1, False)], [("1,250.50", "1250.5", 1, False), ("x", None, 2, False)], [(None, None, 3, False)], [("z", None, 1, False)]]))
    return workbook.read_workbooks(spark, path).select("row_no", F.array_join("cells", "|", "-").alias("cells"))


@R.add("r06_mapping_rows", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INT) AS row_no, CAST(n_nationkey AS VARCHAR) AS id, upper(n_name) AS name FROM nation")
def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a mapping sheet by its headings, with their number in the sheet."""
    sheets = workbook.sheets_of({"LOCATIONS": frame(spark, sf_dir, "SELECT n_nationkey AS ` id `, upper(n_name) AS name FROM {nation}")}, {"LOCATIONS": ["` id `"]})
    return workbook.by_headings(_book(spark, sheets), "locations").select("row_no", F.col("data")["ID"].alias("id"), F.col("data")["NAME"].alias("name"))


@R.add("k05_target_workbook", """SELECT 'Header' AS sheet, CAST(row_number() OVER (ORDER BY o_orderkey) + 1 AS INT) AS row_no, o_orderkey || '|N' || o_orderkey || '|' || CASE WHEN o_custkey > 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS cells FROM orders WHERE o_orderkey < 500 UNION ALL SELECT 'Header', 1, 'Transaction Number|Document|Supplier Site'""")
def target_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header sheet as it is written, read back."""
    fields, docs = frame(spark, sf_dir, FIELDS).where("doc < 500"), frame(spark, sf_dir, DOCS).where("doc < 500")
    rows = G.planned_rows(fields, docs).select("`Transaction Number`", "Document", "`Supplier Site`")
    return _book(spark, workbook.sheets_of({"Header": rows}, {"Header": ["`Transaction Number`"]})).select("sheet", "row_no", F.array_join("cells", "|").alias("cells"))


# ------------------------------------------------------------------ words on pages

TILT = "SELECT user_id AS doc, 1 AS page, cast(event_id as string) AS text, event_id AS id, cast(event_id % 40 * 20 as double) AS x0, cast(event_id % 40 * 20 + 10 as double) AS x1, cast(event_id % 7 * 30 + CASE WHEN user_id % 2 = 0 THEN event_id % 40 * 0.2D ELSE 0.0D END as double) AS top, cast(event_id % 7 * 30 + 10 + CASE WHEN user_id % 2 = 0 THEN event_id % 40 * 0.2D ELSE 0.0D END as double) AS bottom FROM {events}"
TILT_DUCK = plain(TILT).replace("0.2D", "0.2::DOUBLE").replace("0.0D", "0.0::DOUBLE")


def _tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, TILT).withColumn("doc", F.col("doc") % 4).withColumn("doc", F.col("doc").cast("long"))


@R.add("a34_page_slopes", f"""WITH w AS (SELECT CAST(doc % 4 AS BIGINT) AS doc, page, (x0 + x1) / 2 AS x, ("top" + bottom) / 2 AS y FROM ({TILT_DUCK.replace('AS top', 'AS "top"')})), b AS (SELECT doc, page, step, round_even((y - step / 1000 * x) / 2, 0) AS band, count(*) AS n FROM w, (SELECT unnest(range(-30, 31)) AS step) GROUP BY ALL),
  s AS (SELECT doc, page, step, sum(n * n) AS score, sum(n) AS words FROM b GROUP BY ALL), m AS (SELECT doc, page, max(score) AS best, max(score) FILTER (step = 0) AS level, max(words) AS words FROM s GROUP BY ALL), t AS (SELECT m.*, (SELECT max(step) FROM s WHERE s.doc = m.doc AND s.page = m.page AND s.score = m.best) / 1000 AS slope FROM m)
  SELECT doc, page, CASE WHEN words >= 40 AND abs(slope) >= 0.003 AND best >= level * 1.15 THEN slope ELSE 0.0 END::DOUBLE AS slope FROM t""")
def page_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a scanned page is tilted."""
    return Y.page_slopes(_tilted(spark, sf_dir))


@R.add("w12_anchored_rows")
def anchored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.anchored_rows(_tilted(spark, sf_dir))


@R.add("w13_tilted_rows")
def tilted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.tilted_rows(_tilted(spark, sf_dir))


HEADS = "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('id', 1, 'text', 'Description', 'x0', 10.0D, 'top', 100.0D, 'bottom', 110.0D), named_struct('id', 2, 'text', CASE WHEN event_id % 2 = 0 THEN 'Qty' ELSE '5' END, 'x0', 80.0D, 'top', 102.0D, 'bottom', 112.0D), named_struct('id', 3, 'text', 'VAT', 'x0', 99.0D, 'top', 300.0D, 'bottom', 310.0D), named_struct('id', 4, 'text', 'Total price', 'x0', 99.0D, 'top', 301.0D, 'bottom', 311.0D), named_struct('id', 5, 'text', CASE WHEN event_id % 3 = 0 THEN 'Price' ELSE 'x' END, 'x0', 120.0D, 'top', 95.0D, 'bottom', 200.0D))) FROM {events}"


@R.add("e13_heading_roles", "SELECT event_id AS doc, 1 AS page, CASE WHEN event_id % 2 = 0 THEN 'description,qty' END AS roles FROM events WHERE event_id % 2 = 0")
def heading_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of the topmost heading on a page; a band of totals is none."""
    own = frame(spark, sf_dir, HEADS).withColumn("text", F.when(F.col("id") == 5, "x").otherwise(F.col("text")))
    return Y.heading_roles(own).withColumn("roles", F.array_join("roles", ","))


@R.add("x28_other_rows", "SELECT event_id AS doc, 1 AS index FROM events WHERE event_id % 3 = 0")
def other_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that were read off another line's row."""
    lines = frame(spark, sf_dir, "SELECT event_id AS doc, inline(array(named_struct('index', 1, 'net_amount', cast(12.5 as decimal(18,2)), 'price', cast(2.5 as decimal(18,2)), 'description', 'Rose Cream'), named_struct('index', 2, 'net_amount', cast(1250 as decimal(18,2)), 'price', cast(7 as decimal(18,2)), 'description', 'Night Lotion'))) FROM {events}")
    words = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('id', 1, 'text', '4006 381-333931', 'x0', 5.0D, 'top', CASE WHEN event_id % 3 = 0 THEN 52.0D ELSE 11.0D END, 'bottom', CASE WHEN event_id % 3 = 0 THEN 62.0D ELSE 21.0D END), named_struct('id', 2, 'text', 'Rose cream 12.50', 'x0', 40.0D, 'top', 10.0D, 'bottom', 20.0D), named_struct('id', 3, 'text', 'night LOTION 1,250.00', 'x0', 40.0D, 'top', 50.0D, 'bottom', 60.0D))) FROM {events}")
    claims = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS index, CASE WHEN event_id % 2 = 0 THEN 1 END AS page, '4006381333931' AS digits FROM {events}")
    return Y.on_other_row(claims, lines, words)


@R.add("e08_paired_totals", "SELECT event_id AS doc, unnest(['net', 'vat']) AS label, unnest(['100', CASE WHEN event_id % 2 = 0 THEN '5' END]) AS amount FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'net', '100' FROM events WHERE event_id % 2 = 1")
def paired_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts to the right of labels, by the height that they share; a tie gives none."""
    labels = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('label', 'net', 'x1', 50.0D, 'top', 10.0D, 'bottom', 20.0D), named_struct('label', 'vat', 'x1', 50.0D, 'top', 30.0D, 'bottom', 40.0D))) FROM {events}")
    amounts = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('amount', '100', 'x0', 90.0D, 'top', 12.0D, 'bottom', 22.0D), named_struct('amount', '5', 'x0', 90.0D, 'top', 31.0D, 'bottom', 41.0D), named_struct('amount', '6', 'x0', CASE WHEN event_id % 2 = 0 THEN 20.0D ELSE 95.0D END, 'top', 29.0D, 'bottom', 39.0D))) FROM {events}")
    return Y.paired_amounts(labels, amounts)
