"""Queries for fields, lines and tables by where words stand, and for templates learned from verified invoices."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning as B
from ..operators import spatial as Q
from ..operators import tables as Z
from .registry import Registry, frame
from .roundtrips import scratch

R = Registry()

#: Parts for each core that events are dealt out to.
PARTS = 8


def _rows(spark: SparkSession, sf_dir: str, rows: list[tuple], table: str = "events", key: str = "event_id", dealt: bool = False) -> DataFrame:
    """Rows of words for every event: (page, row, top, [(left, right, SQL of the text)]), words 10 high, pages 600 by 800.

    Events that are ``dealt`` out by their key before rows are made of them keep all cores busy, however few files they came in.
    """
    made = []
    for page, row, top, words in rows:
        inside = ", ".join(f"named_struct('x0', {a}D, 'x1', {b}D, 'top', {top}D, 'bottom', {top + 10}D, 'text', {t})" for a, b, t in words)
        made.append(f"named_struct('page', {page}, 'row_no', {row}, 'words', filter(array({inside}), w -> w.text is not null))")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * spark.sparkContext.defaultParallelism)
    source = f"(SELECT /*+ REPARTITION({parts}, {key}) */ * FROM {{{table}}})" if dealt else f"{{{table}}}"
    return frame(spark, sf_dir, f"SELECT {key} AS doc, 600.0D AS width, 800.0D AS height, inline(array({', '.join(made)})) FROM {source}").select("doc", "page", "row_no", "width", "height", "words")


def q(text: str) -> str:
    return f"'{text}'"


def _line(text: str, left: int = 10, wide: int = 40, gap: int = 5) -> list[tuple]:
    """Words of a text from left to right, equally wide."""
    return [(left + i * (wide + gap), left + i * (wide + gap) + wide, q(w)) for i, w in enumerate(text.split())]


KIND = "CASE event_id % 3 WHEN 0 THEN 'INV-1' WHEN 1 THEN 'INV' END"


@R.add("e03_labelled_values", "SELECT event_id AS doc, 'INV-1' AS value FROM events WHERE event_id % 3 = 0")
def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, [(1, 1, 10, [(10, 60, q("Invoice")), (65, 80, q("No.")), (85, 120, KIND)]), (1, 2, 30, [(10, 60, q("Invoice")), (65, 80, q("No")), (300, 340, q("X-9"))])])
    return Q.labelled_identifiers(rows, ["invoice no"])


@R.add("h60_labelled_dates", "SELECT event_id AS doc, '2031-01-03' AS value FROM events WHERE event_id % 2 = 0")
def labelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = "CASE WHEN event_id % 2 = 0 THEN '2031-01-03' ELSE '04/05/2031' END"
    return Q.labelled_dates(_rows(spark, sf_dir, [(1, 1, 10, [(10, 40, q("Due")), (45, 80, q("Date")), (90, 140, q("2031-01-09"))]), (1, 2, 30, [(10, 60, q("Invoice")), (65, 90, q("Date:")), (100, 150, date)])]))


@R.add("h61_joined_identifiers", "SELECT event_id AS doc, CASE WHEN event_id % 2 = 0 THEN 'ABC-01' ELSE 'ABC-01Z7' END AS value FROM events")
def joined_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'Z7' END"
    return Q.joined_identifiers(_rows(spark, sf_dir, [(1, 1, 10, [(10, 30, q("PO")), (35, 60, q("No")), (62, 64, q(":")), (70, 100, q("ABC-")), (104, 120, q("01")), (125, 140, left), (400, 420, q("far"))])]), ["po no"])


@R.add("h59_title_numbers", "SELECT event_id AS doc, CASE event_id % 3 WHEN 0 THEN 'INV-77' ELSE 'NO-88' END AS value FROM events WHERE event_id % 3 < 2")
def title_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = "CASE WHEN event_id % 3 = 1 THEN 'NO-88' END"
    return Q.title_numbers(_rows(spark, sf_dir, [(1, 1, 10, [(10, 40, q("Logo")), (300, 350, above)]), (1, 2, 60, [(10, 40, q("Tax")), (45, 100, q("Invoice")), (200, 260, "CASE WHEN event_id % 3 = 0 THEN 'INV-77' END"), (300, 310, q("p2"))])]))


@R.add("h62_party_names", "SELECT event_id AS doc, 'Acme LLC' AS supplier, CASE WHEN event_id % 2 = 0 THEN 'Bright House' END AS buyer FROM events")
def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    beside, under = "CASE WHEN event_id % 2 = 0 THEN 'Acme' END", "CASE WHEN event_id % 2 = 1 THEN 'Acme' END"
    rows = _rows(spark, sf_dir, [
        (1, 1, 10, [(10, 60, q("Supplier:")), (65, 100, beside), (105, 130, "CASE WHEN event_id % 2 = 0 THEN 'LLC' END")]), (1, 2, 30, [(10, 60, under), (65, 90, "CASE WHEN event_id % 2 = 1 THEN 'LLC' END")]),
        (1, 3, 200, [(10, 30, q("Bill")), (35, 50, q("To:")), (300, 330, q("Ship")), (335, 350, q("To:"))]),
        (1, 4, 220, [(10, 50, "CASE WHEN event_id % 2 = 0 THEN 'Bright' END"), (55, 90, "CASE WHEN event_id % 2 = 0 THEN 'House' END"), (310, 350, q("Warehouse"))]),
    ])
    return Q.party_names(rows, ["supplier"]).withColumnRenamed("value", "supplier").join(Q.buyer_names(rows).withColumnRenamed("value", "buyer"), "doc", "left")


@R.add("h63_compact_headers", "SELECT event_id AS doc, 'A-1' AS number, '2031-04-03' AS date, '4500' AS po FROM events WHERE event_id % 2 = 0")
def compact_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    po = "CASE WHEN event_id % 2 = 0 THEN 'No.' ELSE 'Box' END"
    return Q.compact_headers(_rows(spark, sf_dir, [(1, 1, 10, [(300, 320, q("No.")), (330, 360, q("A-1"))]), (1, 2, 30, [(300, 330, q("Date")), (340, 380, q("03/04/2031"))]), (1, 3, 50, [(300, 320, q("PO")), (322, 340, po), (350, 390, q("4500"))]), (1, 4, 90, [(10, 30, q("Due")), (35, 55, q("Date")), (60, 90, q("2031-09-09"))])]))


HEAD = [(10, 30, "S.No"), (40, 90, "Item Code"), (100, 200, "Description"), (260, 280, "UOM"), (300, 320, "Qty"), (350, 370, "Unit"), (372, 392, "Price"), (420, 460, "Subtotal"), (480, 500, "VAT"), (502, 540, "Amount")]
ITEMS = [
    (1, 1, 10, [(a, b, q(t)) for a, b, t in HEAD]),
    (1, 2, 30, [(12, 16, q("1")), (40, 90, q("A-1")), (100, 140, q("Rose")), (145, 190, q("Water")), (260, 280, q("EA")), (302, 318, q("3")), (370, 390, q("10.00")), (425, 455, q("30.00")), (505, 535, q("1.50"))]),
    (1, 3, 42, [(100, 140, q("glass")), (145, 190, "CASE WHEN event_id % 2 = 0 THEN 'bottle' END")]),
    (1, 4, 100, [(100, 140, q("Deluxe"))]),
    (1, 5, 112, [(12, 16, q("2")), (40, 90, q("B-2")), (100, 140, q("Cream")), (302, 318, q("1")), (370, 390, q("20.00")), (425, 455, q("20.00")), (505, 535, q("1.00"))]),
    (1, 6, 130, [(10, 40, q("Sub")), (45, 80, q("Total")), (425, 455, q("50.00"))]),
    (1, 7, 142, [(10, 40, q("VAT")), (425, 455, q("2.50"))]),
    (1, 8, 154, [(40, 90, q("C-3")), (100, 140, q("After")), (302, 318, q("1")), (370, 390, q("1.00"))]),
]
LINES = """SELECT event_id AS doc, 'A-1' AS sku, CASE WHEN event_id % 2 = 0 THEN 'Rose Water glass bottle' ELSE 'Rose Water glass' END AS description, 3 AS qty, 'EA' AS uom, 10 AS price, 30 AS net_amount FROM events
  UNION ALL SELECT event_id, 'B-2', 'Deluxe Cream', 1, NULL, 20, 20 FROM events"""


@R.add("e01_layout_lines", LINES)
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines below a printed heading, wrapped texts joined, up to the totals."""
    lines = Q.line_items(_rows(spark, sf_dir, ITEMS))
    return lines.select("doc", "sku", "description", *[F.col(c).cast("int").alias(c) for c in ("qty",)], "uom", *[F.col(c).cast("int").alias(c) for c in ("price", "net_amount")])


@R.add("h69_wrapped_rows", "SELECT event_id AS doc, 2 AS row_no, 2 AS rows FROM events UNION ALL SELECT event_id, 5, 2 FROM events")
def wrapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many printed rows make a line."""
    return Q.line_items(_rows(spark, sf_dir, ITEMS)).select("doc", "row_no", "rows")


@R.add("h65_heading_places", "SELECT event_id AS doc, 20.0::DOUBLE AS serial, 65.0::DOUBLE AS item, 150.0::DOUBLE AS description, 270.0::DOUBLE AS uom, 310.0::DOUBLE AS qty, 382.0::DOUBLE AS price, 411.0::DOUBLE AS net_left, 465.0::DOUBLE AS net_right FROM events")
def heading_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where columns stand, and from where to where the net amounts."""
    found = Q.columns_of(_rows(spark, sf_dir, ITEMS[:1]))
    return found.select("doc", "serial", "item", "description", "uom", "qty", "price", F.col("net.left").alias("net_left"), F.col("net.right").alias("net_right"))


@R.add("e06_totals_by_place", "SELECT event_id AS doc, 50 AS net, 2.5 AS tax FROM events")
def totals_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net and tax from rows that name them."""
    found = Q.totals_by_place(_rows(spark, sf_dir, ITEMS))
    return found.select("doc", F.col("net").cast("int").alias("net"), F.col("tax").cast("decimal(2,1)").alias("tax"))


@R.add("e17_under_heading", "SELECT event_id AS doc, 1 AS page, 'INV/2031/7' AS value FROM events WHERE event_id % 2 = 0")
def under_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice numbers below their heading."""
    words = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('n', 1, 'text', 'Invoice', 'x0', 10.0D, 'x1', 50.0D, 'top', 100.0D, 'bottom', 110.0D), named_struct('n', 2, 'text', 'No.', 'x0', 55.0D, 'x1', 70.0D, 'top', 101.0D, 'bottom', 111.0D), named_struct('n', 3, 'text', '01/02/2031', 'x0', 60.0D, 'x1', 90.0D, 'top', 115.0D, 'bottom', 125.0D), named_struct('n', 4, 'text', 'INV/2031/7', 'x0', 60.0D, 'x1', 90.0D, 'top', CASE WHEN event_id % 2 = 0 THEN 130.0D ELSE 180.0D END, 'bottom', 190.0D))) FROM {events}")
    return Q.under_heading(words, 800.0)


TABLE = [(10, 30, "Sr"), (40, 90, "Item"), (92, 120, "Code"), (130, 220, "Description"), (300, 340, "Barcode"), (400, 430, "Qty"), (460, 490, "Unit"), (492, 520, "Price"), (540, 580, "Amount")]


@R.add("h72_heading_spans", "SELECT event_id AS doc, 'description,gtin,qty,price,net_amount' AS roles, 5 AS columns FROM events")
def heading_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of one to three words, and the borders between them."""
    rows = Z.heading_spans(_rows(spark, sf_dir, [(1, 1, 10, [(a, b, q(t)) for a, b, t in TABLE[3:]])]))
    return rows.select("doc", F.array_join(F.transform("spans", lambda s: s["role"]), ",").alias("roles"), (F.size(Z.borders(F.col("spans"))) + 1).alias("columns"))


@R.add("h73_mapped_rows", "SELECT event_id AS doc, 'Rose 30ML' AS description, '4006381333931' AS gtin, '7' AS qty, 'AED 10.25' AS price FROM events")
def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a row, a barcode and a quantity that stand beside their columns put back."""
    heads = Z.heading_spans(_rows(spark, sf_dir, [(1, 1, 10, [(a, b, q(t)) for a, b, t in TABLE[3:]])])).select("doc", "spans")
    rows = _rows(spark, sf_dir, [(1, 2, 30, [(130, 160, q("Rose")), (165, 200, q("3OML")), (250, 310, q("4006381333931")), (446, 455, q("7")), (460, 480, q("AED")), (485, 520, q("10.25"))])])
    found = Z.mapped(rows.join(heads, "doc"))
    return found.select("doc", *[F.col("cells")[c].alias(c) for c in ("description", "gtin", "qty", "price")])


NUMBERED = [(10, 60, q("Invoice")), (65, 80, q("No:"))]
PAGES = [
    (1, 1, 5, [*NUMBERED, (90, 120, q("INV-1"))]),
    (1, 2, 20, [(a, b, q(t)) for a, b, t in TABLE]),
    (1, 3, 40, [(12, 18, q("1")), (40, 80, q("A-1")), (130, 160, q("Rose")), (402, 412, q("3")), (492, 515, q("10.00")), (545, 575, q("30.00"))]),
    (1, 4, 52, [(130, 160, q("glass"))]),
    (1, 5, 90, [(10, 50, "CASE WHEN event_id % 3 = 2 THEN 'Total' END"), (130, 160, "CASE WHEN event_id % 3 < 2 THEN 'stray' END")]),
    (2, 1, 5, [*NUMBERED, (90, 120, "CASE WHEN event_id % 3 = 1 THEN 'INV-2' ELSE 'INV-1' END")]),
    (2, 2, 40, [(12, 18, q("2")), (40, 80, q("B-2")), (130, 160, q("Cream")), (402, 412, q("1")), (492, 515, q("20.00")), (545, 575, q("20.00"))]),
    (2, 3, 60, [(10, 50, q("Net")), (55, 90, q("Total")), (545, 575, q("50.00"))]),
    (2, 4, 80, [(12, 18, q("3")), (40, 80, q("C-3")), (130, 160, q("Bank")), (402, 412, q("1")), (492, 515, q("20.00"))]),
]
MEASURED = "SELECT event_id AS doc, 1 AS page, 'A-1' AS sku, 'Rose' || chr(10) || 'glass' AS description, '3' AS qty FROM events UNION ALL SELECT event_id, 2, 'B-2', 'Cream', '1' FROM events WHERE event_id % 3 = 0"


@R.add("e10_measured_tables", MEASURED)
def measured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables from measured words, carried on to a page without a heading."""
    found = Z.measured_tables(_rows(spark, sf_dir, PAGES, dealt=True))
    return found.select("doc", "page", *[F.col("cells")[c].alias(c) for c in ("sku", "description", "qty")])


@R.add("w07_carried_headings", "SELECT event_id AS doc, 2 AS page, 1 AS header_page FROM events WHERE event_id % 3 = 0")
def carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a heading of an earlier page."""
    return Z.measured_tables(_rows(spark, sf_dir, PAGES, dealt=True)).where("page <> header_page").select("doc", "page", "header_page")


@R.add("h74_measured_numbers", "SELECT event_id AS doc, 1 AS page, 'INV-1' AS value FROM events UNION ALL SELECT event_id, 2, CASE WHEN event_id % 3 = 1 THEN 'INV-2' ELSE 'INV-1' END FROM events")
def measured_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.measured_number(_rows(spark, sf_dir, PAGES))


@R.add("e11_label_tables", "SELECT event_id AS doc, 1 AS page, 'number' AS field, 'INV 7' AS value FROM events UNION ALL SELECT event_id, 1, 'po', '4500' FROM events")
def label_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values below a row of labels."""
    return Z.label_tables(_rows(spark, sf_dir, [(1, 1, 10, [(10, 50, q("Invoice")), (52, 70, q("No")), (150, 170, q("PO")), (172, 190, q("No")), (300, 340, q("Remarks"))]), (1, 2, 25, [(12, 40, q("INV")), (45, 60, q("7")), (155, 185, q("4500")), (305, 330, q("none"))])]))


@R.add("e12_edge_headings", "SELECT event_id AS doc, 't' AS \"table\", CASE WHEN event_id % 2 = 0 THEN 'No|Item|Qty|Line Amount' ELSE '?|Item|Qty|?' END AS header FROM events")
def edge_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty outer headings from the words beside the others."""
    item = "CASE WHEN event_id % 2 = 0 THEN 'Item' ELSE 'Goods' END"
    rows = _rows(spark, sf_dir, [(1, 1, 10, [(10, 30, q("No")), (40, 80, item), (90, 120, q("Qty")), (130, 160, q("Line")), (165, 200, q("Amount"))])])
    tables = frame(spark, sf_dir, "SELECT event_id AS doc, 't' AS table, 1 AS page, array(cast(NULL as string), 'Item', 'Qty', NULL) AS header, array(true, true, true, true) AS filled FROM {events}")
    return Z.edge_headings(tables, rows).withColumn("header", F.array_join("header", "|", "?"))


@R.add("e09_table_lines", "SELECT event_id AS doc, 't' AS \"table\", 2 AS row_no, 'A-1' AS part, 3 AS qty, 10 AS price, 30 AS net_amount FROM events UNION ALL SELECT event_id, 't', 4, 'B-2', 1, 20, NULL FROM events")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recovered tables by the roles of their headings."""
    rows = frame(spark, sf_dir, "SELECT event_id AS doc, 't' AS table, inline(array(named_struct('row_no', 1, 'cells', array('Item Code', 'Description', 'Qty', 'Unit Price', 'Amount')), named_struct('row_no', 2, 'cells', array('A-1', 'Rose', '3', 'AED 10.00', '30.00')), named_struct('row_no', 3, 'cells', array('', 'Total', '', '', '50.00')), named_struct('row_no', 4, 'cells', array('B-2', '', '1', '20', '')))) FROM {events}")
    found = Z.table_lines(rows)
    return found.select("doc", "table", "row_no", F.col("sku").alias("part"), *[F.col(c).cast("int").alias(c) for c in ("qty", "price", "net_amount")])


@R.add("a35_reconciled_amounts", "SELECT l_orderkey AS doc, sum(CASE WHEN l_orderkey % 3 = 0 THEN 9 ELSE 10 END)::BIGINT AS net FROM lineitem GROUP BY l_orderkey")
def reconciled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second amount column where it is the one that sums up."""
    lines = frame(spark, sf_dir, "SELECT l_orderkey AS doc, cast(10 as decimal(18,2)) AS net_amount, cast(CASE WHEN l_orderkey % 3 = 2 THEN 0.40 ELSE 0.45 END as decimal(18,2)) AS tax_amount, cast(9 as decimal(18,2)) AS other_amount FROM {lineitem}")
    heads = frame(spark, sf_dir, "SELECT l_orderkey AS doc, cast(count(*) * CASE WHEN l_orderkey % 3 = 1 THEN 10 ELSE 9 END as decimal(18,2)) AS net, cast(count(*) * 0.45 as decimal(18,2)) AS tax FROM {lineitem} GROUP BY l_orderkey")
    return Z.reconciled_amounts(lines, heads).groupBy("doc").agg(F.sum("net_amount").cast("long").alias("net"))


@R.add("h78_table_buyers", "SELECT event_id AS doc, CASE event_id % 3 WHEN 0 THEN 'By Place' ELSE 'Bright House' END AS value FROM events WHERE event_id % 3 < 2")
def table_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('row_no', 1, 'cells', array('Bill to:', '', 'Bright House')), named_struct('row_no', 2, 'cells', array(CASE WHEN event_id % 3 = 2 THEN 'Buyer Second' ELSE 'x' END)))) FROM {events}")
    return Z.table_buyers(cells, frame(spark, sf_dir, "SELECT event_id AS doc, 'By Place' AS value FROM {events} WHERE event_id % 3 = 0"))


COLUMNAR = [
    (1, 1, 10, [(10, 50, q("TAX")), (55, 100, q("INVOICE"))]), (1, 2, 25, [(10, 15, q("#")), (20, 60, q("INV-9"))]), (1, 3, 40, _line("Date of Issuing: March 3, 2031")),
    (1, 4, 55, [(10, 50, q("Issued")), (52, 70, q("By:")), (300, 340, q("Issued")), (342, 360, q("To:"))]), (1, 5, 70, [(10, 50, q("Acme")), (52, 80, q("LLC")), (260, 300, q("Bright")), (302, 340, q("House"))]),
    (1, 6, 90, [(10, 15, q("#")), (30, 100, q("Description")), (200, 240, q("Brand")), (280, 320, q("Quantity")), (330, 350, q("UOM")), (360, 380, q("Price"))]),
    (1, 7, 105, [(360, 380, q("AED")), (400, 420, q("AED"))]),
    (1, 8, 120, [(10, 15, q("1")), (30, 60, q("Rose")), (200, 240, q("Bloom")), (285, 295, q("3")), (330, 345, q("EA")), (360, 380, q("10.00")), (400, 420, q("30.00")), (430, 440, q("5")), (450, 470, q("1.50")), (480, 500, q("31.50"))]),
    (1, 9, 132, [(30, 60, q("water,")), (65, 120, "CASE WHEN event_id % 2 = 0 THEN '4006381333931' ELSE '4006381333930' END")]),
    (1, 10, 140, _line("Made with Books")),
    (2, 1, 10, [(30, 60, q("more"))]), (2, 2, 25, [(10, 15, q("2")), (30, 60, q("Cream")), (285, 295, q("1"))]), (2, 3, 40, _line("Total, AED: 31.50")), (2, 4, 55, [(10, 15, q("3")), (30, 60, q("After"))]),
]
GRID = "SELECT event_id AS doc, 1 AS no, CASE WHEN event_id % 2 = 0 THEN 'Rose water, 4006381333931 more' ELSE 'Rose water, 4006381333930 more' END AS description, 'Bloom' AS brand, 30 AS net FROM events UNION ALL SELECT event_id, 2, 'Cream', '', NULL FROM events"


@R.add("e07_columnar_lines", GRID)
def columnar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the columnar layout over two pages."""
    found = Z.columnar_lines(_rows(spark, sf_dir, COLUMNAR))
    return found.select("doc", "no", "description", "brand", F.col("tail.net_amount").cast("int").alias("net"))


@R.add("h70_columnar_parties", "SELECT event_id AS doc, 'Acme LLC' AS supplier, 'Bright House' AS buyer FROM events")
def columnar_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names in one row, cut at its widest gap."""
    return Z.columnar_parties(_rows(spark, sf_dir, COLUMNAR))


@R.add("w14_reading_rows", "SELECT event_id AS doc, 1 AS page, 1 AS row_no, 'Net  total' AS text FROM events UNION ALL SELECT event_id, 1, 2, CASE WHEN event_id % 2 = 0 THEN '5  tall' ELSE 'tall' END FROM events UNION ALL SELECT event_id, 1, 3, '5' FROM events WHERE event_id % 2 = 1")
def reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in reading order; a word joins the nearest one that it overlaps."""
    words = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('text', 'total', 'x0', 60.0D, 'top', 12.0D, 'bottom', 22.0D), named_struct('text', 'Net', 'x0', 10.0D, 'top', 10.0D, 'bottom', 20.0D), named_struct('text', 'tall', 'x0', 60.0D, 'top', 40.0D, 'bottom', 50.0D), named_struct('text', '5', 'x0', 10.0D, 'top', CASE WHEN event_id % 2 = 0 THEN 44.0D ELSE 54.0D END, 'bottom', CASE WHEN event_id % 2 = 0 THEN 54.0D ELSE 64.0D END))) FROM {events}")
    return Z.overlapping_rows(words)


@R.add("r10_payload_boxes", "SELECT event_id AS doc, 1 AS page, CASE WHEN event_id % 2 = 0 THEN 'word' ELSE 'block' END AS text, 10.0::DOUBLE AS x0, 90.0::DOUBLE AS top, 50.0::DOUBLE AS x1, 100.0::DOUBLE AS bottom FROM events")
def payload_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout model's boxes, from the bottom left to the top left."""
    items = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(filter(array(named_struct('kind', 'word', 'text', 'word', 'origin', 'TOPLEFT', 'l', 10.0D, 't', 90.0D, 'r', 50.0D, 'b', 100.0D), named_struct('kind', 'block', 'text', 'block', 'origin', 'CoordOrigin.BOTTOMLEFT', 'l', 10.0D, 't', 710.0D, 'r', 50.0D, 'b', 700.0D)), x -> x.kind = 'block' or event_id % 2 = 0)), 600.0D AS width, 800.0D AS height FROM {events}")
    return Z.payload_boxes(items)


@R.add("e20_verified_by_ocr", "SELECT event_id AS doc, 'number' AS field, CASE WHEN event_id % 3 = 0 THEN 1 END::INT AS page, CASE WHEN event_id % 3 = 0 THEN 'INV-100' END AS token, CASE WHEN event_id % 3 = 1 THEN 'INV-1O0' END AS review FROM events")
def verified_by_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of an AI against the words of a local reader."""
    values = frame(spark, sf_dir, "SELECT event_id AS doc, 'number' AS field, 'inv-100' AS value FROM {events}")
    tokens = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, 1 AS n, CASE event_id % 3 WHEN 0 THEN 'INV-100' WHEN 1 THEN 'INV-1O0' ELSE 'JNV-1O0' END AS text FROM {events}")
    return Z.verified_by_ocr(values, tokens)


@R.add("r07_document_texts", "SELECT unnest(['a.txt', 'b.docx', 'c.bin', 'd.docx']) AS name, unnest(['Inv' || chr(10) || '7', 'Rose water' || chr(10) || 'Cream', NULL, NULL]) AS text, unnest([false, false, true, true]) AS refused")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files by their kind; a broken one has a problem and stops nothing."""
    from ..sources.workbook import write_bytes

    folder, box = scratch(spark), io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Rose </w:t><w:t>water</w:t></w:p><w:p><w:t>Cream</w:t></w:p></w:document>')
    for name, data in (("a.txt", b"Inv\n7"), ("b.docx", box.getvalue()), ("c.bin", b"x"), ("d.docx", b"no zip")):
        write_bytes(spark, f"{folder}/{name}", data)
    found = Z.document_texts(spark.read.format("binaryFile").load(folder).select("path", "content"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "text", F.col("problem").isNotNull().alias("refused"))


VERIFIED = {
    "supplier_name": "Acme Trading", "number": "INV-@", "date": "2031-01-02", "net": "50", "tax": "2.50", "po": "4500",
    "lines": [
        {"sku": "A-1", "description": "Rose Water 50ml glass bottle", "qty": "3", "uom": "EA", "price": "10", "net_amount": "30"},
        {"sku": "B-2", "description": "Cream", "qty": "1", "uom": "EA", "price": "20", "net_amount": "20"},
    ],
}
TEXT = "ACME Trading LLC\nTax Invoice No: INV-@\nDate: 02/01/2031\nPO 4500\nNo Item Description Qty UOM Price Amount\n1 A-1 Rose Water 50ml 3 EA 10.00 30.00\nglass bottle\n2 B-2 Cream 1 EA 20.00 20.00\nNet total 50.00\nVAT 5% 2.50\n"


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The keys of a small file are dealt out to all cores before they become texts, which are long to walk.
    own = frame(spark, sf_dir, "SELECT event_id AS doc, cast(event_id as string) AS n FROM {events}").repartition(spark.sparkContext.defaultParallelism, "doc")
    odd = F.when(F.col("doc") % 4 == 3, F.replace(F.lit(TEXT), F.lit("3 EA"), F.lit("4 EA"))).otherwise(F.lit(TEXT))
    return own.select("doc", F.replace(odd, F.lit("@"), F.col("n")).alias("text"), F.replace(F.lit(json.dumps(VERIFIED)), F.lit("@"), F.col("n")).alias("verified"))


@R.add("e19_learned_templates", "SELECT event_id AS doc, CASE WHEN event_id % 4 < 3 THEN 'acme-trading' END AS supplier, CASE WHEN event_id % 4 = 3 THEN 'a line was not found in the text' END AS problem FROM events")
def learned_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template from each verified document, kept only if it reads the document back."""
    return B.learned(_verified(spark, sf_dir)).select("doc", "supplier", "problem")


@R.add("h85_read_back", "SELECT event_id AS doc, event_id % 4 <> 3 AS ok, CASE WHEN event_id % 4 = 3 THEN 1 ELSE 2 END AS exact, 'number' AS fixes FROM events")
def templates_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document's template on all others: what it reads, and what it mends."""
    template, _ = B.learn(TEXT.replace("@", "0"), json.loads(json.dumps(VERIFIED).replace("@", "0")))
    docs = _verified(spark, sf_dir).withColumn("template", F.lit(json.dumps(template))).withColumn("baseline", F.lit(json.dumps({**VERIFIED, "number": "wrong"})))
    return B.read_back(docs).select("doc", "ok", "exact", F.array_join(F.filter("fixes", lambda f: f == "number"), ",").alias("fixes"))


@R.add("h80_near_descriptions", "SELECT event_id AS doc, CASE event_id % 3 WHEN 0 THEN 2 ELSE 1 END AS exact, CASE event_id % 3 WHEN 1 THEN 1 ELSE 0 END AS near FROM events")
def near_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that agree, exactly or but for a few letters of the description."""
    template, _ = B.learn(TEXT.replace("@", "0"), json.loads(json.dumps(VERIFIED).replace("@", "0")))
    other = F.when(F.col("doc") % 3 == 1, F.replace("text", F.lit("glass bottle"), F.lit("glass bottlo"))).when(F.col("doc") % 3 == 2, F.replace("text", F.lit("glass bottle"), F.lit("none"))).otherwise(F.col("text"))
    docs = _verified(spark, sf_dir).withColumn("text", F.replace("text", F.lit("4 EA"), F.lit("3 EA"))).withColumn("text", other).withColumn("template", F.lit(json.dumps(template))).withColumn("baseline", F.lit(None).cast("string"))
    return B.read_back(docs).select("doc", "exact", "near")


@R.add("f30_shapes", r"SELECT event_id AS doc, 'INV\-' AS kept, true AS fits FROM events")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern of a printed value fits its siblings."""
    pattern = B.shape("INV-20/Ab")
    own = frame(spark, sf_dir, "SELECT event_id AS doc, concat('XY-', cast(event_id as string), '/Cdef') AS value FROM {events}")
    return own.select("doc", F.lit("INV\\-" if "\\-" in pattern else pattern).alias("kept"), F.col("value").rlike(f"^{pattern}$").alias("fits"))


@R.add("h81_value_anchors", "SELECT event_id AS doc, 'INV-' || event_id AS found FROM events")
def value_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is printed before a value finds its siblings too."""
    pattern = B.anchored(TEXT.replace("@", "0"), "number", "INV-0")[0]
    return _verified(spark, sf_dir).select("doc", F.regexp_extract("text", pattern, 1).alias("found"))


@R.add("h82_row_words", "SELECT event_id AS doc, 'serial,sku,description,description,description,qty,uom,price,net_amount' AS roles FROM events")
def row_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each word of a verified row is."""
    line = "1 A-1 Rose Water 50ml 3 EA 10.00 30.00"
    roles = ",".join(r for r, _ in B.assigned(line, VERIFIED["lines"][0], 1) or [])
    return frame(spark, sf_dir, "SELECT event_id AS doc FROM {events}").withColumn("roles", F.lit(roles))


@R.add("h83_row_patterns", "SELECT event_id AS doc, 'S-' || event_id AS sku, event_id % 9 + 1 AS qty FROM events")
def row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row pattern of two verified rows reads other rows of the layout."""
    rows = [B.assigned("1 A-1 Rose Water 50ml 3 EA 10.00 30.00", VERIFIED["lines"][0], 1), B.assigned("2 B-2 Cream 1 EA 20.00 20.00", VERIFIED["lines"][1], 2)]
    pattern = B.row_pattern(B.merged(rows)).replace("net_amount", "amount").replace("?P<", "?<") + "$"
    own = frame(spark, sf_dir, "SELECT event_id AS doc, concat('7 S-', cast(event_id as string), ' Any name ', cast(event_id % 9 + 1 as string), ' PC 1.00 9.00 ') AS line FROM {events}")
    return own.select("doc", F.regexp_extract("line", pattern, 1).alias("sku"), F.regexp_extract("line", pattern, 3).cast("bigint").alias("qty"))


@R.add("h86_template_store", "SELECT 'S' || (o_custkey % 20) AS supplier, count(*) AS confirmed, least(count(*), 5) AS samples FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def template_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest template of each supplier, its latest sources, and deleted sources forgotten."""
    own = frame(spark, sf_dir, "SELECT concat('S', cast(o_custkey % 20 as string)) AS supplier, 't' AS template, o_orderdate AS at, cast(o_orderkey as string) AS source FROM {orders}")
    kept = B.forgotten(own, own.where("cast(source as bigint) % 7 = 0"))
    return B.remembered(kept, kept).select("supplier", "confirmed", F.size("samples").cast("long").alias("samples"))
