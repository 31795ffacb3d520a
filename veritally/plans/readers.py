"""Queries for parties, payloads, gates and guards of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import check as K
from ..operators import layout as Y
from ..operators import ledger as L
from ..operators import orders as O
from ..operators import readers as D
from ..operators import stores as S
from ..operators import target as G
from ..operators.geometry import joined_tokens
from ..sources import workbook
from .chain import INVOICES, PO, PO_SPARK
from .registry import Registry, frame, plain
from .relational import ORDER
from .target import CHECKED, CHECKS, LINED, PLANNED, _cells

R = Registry()

R.cases("f14_without_buyer_side", lambda x: D.without_buyer_side(F.substring_index(x, "|", 1), F.array(F.substring_index(x, "|", -1))), [("Acme LLC Buyer House|Buyer House Dubai", "Acme LLC"), ("Acme LLC|Other", "Acme LLC"), ("Rosé Co BÜYER|buyer x", "Rosé Co"), ("All Of It|All Of It", ""), ("Acme -|x", "Acme")])
R.cases("h67_clean_description", D.clean_description, [("Cream  EAN: 4006381333931 - ", "Cream"), ("=cmd", None), ("  ", None), ("Rose, 50ml;", "Rose, 50ml")])
R.cases("h77_last_amount", D.last_amount, [("VAT 5% 12.50", 12.5), ("Total (1,000.00)", -1000.0), ("no number", None), ("5 x 3 15.000", 15.0)], "DECIMAL(38, 6)")
R.cases("v07_malformed_row", lambda x: K.malformed(F.substring_index(x, "|", 1), F.substring_index(x, "|", -1)), [("2031-01-02|123456789", False), ("x|123456789", True), ("2031-01-02|", False), ("2031-01-02|12", True)], "BOOLEAN")
R.cases("h30_rules_item", lambda x: F.when(F.substring_index(x, "|", -1) != "", F.substring_index(x, "|", 1)), [("12|Items!3", "12"), ("12|", None)])
R.cases("h31_typed_cells", lambda x: F.when(x.rlike(r"^-?\d+(\.\d+)?$") & ~x.rlike(r"^-?0\d"), "number").otherwise("text"), [("12", "number"), ("-1.5", "number"), ("012", "text"), ("=1", "text"), ("1e5", "text")])
R.cases("h32_draft_filename", lambda x: F.concat(F.lit("draft-"), T.slug(x, 40), F.lit(".xlsx")), [("INV 12/7", "draft-inv-12-7.xlsx"), ("--", "draft-.xlsx")])
R.cases("h84_keywords", lambda x: F.forall(F.array(F.lit("ACME"), F.lit("TRN 1")), lambda k: F.contains(x, k)), [("ACME x TRN 1", True), ("acme TRN 1", False), ("ACME", False)], "BOOLEAN")
R.cases("h52_equal_fields", lambda x: F.regexp_replace(F.lower(F.substring_index(x, "|", 1)), "[^0-9a-z]", "") == F.regexp_replace(F.lower(F.substring_index(x, "|", -1)), "[^0-9a-z]", ""), [("AB-1|ab 1", True), ("AB-1|AB-2", False)], "BOOLEAN")
R.cases("x26_learned_mode", lambda x: D.learned_mode(F.substring(x, 1, 1).cast("int"), F.substring(x, 2, 1) == "s", F.substring(x, 3, 1).cast("int"), F.substring(x, 4, 1) == "r", F.substring(x, 5, 1) == "r"), [("0x0xx", "read"), ("2s1xx", "overlay"), ("2s0xx", None), ("2x0rx", "replace"), ("2x0rr", None)])
R.cases("h54_merged_source", lambda x: D.merged_source(F.filter(F.array(F.substring(x, 1, 1)), lambda v: v == "w"), F.substring(x, 2, 1) == "s", F.filter(F.array(F.substring(x, 3, 1)), lambda v: v == "f")), [("ws-", "ai"), ("wsf", "local"), ("-s-", "local"), ("w--", "local")])
R.cases("h58_recovery_eligible", lambda x: F.forall(F.split(x, ""), lambda c: c == "1"), [("11111", True), ("11011", False), ("00000", False)], "BOOLEAN")
R.cases("h35_cursor_refused", lambda x: F.when(x.rlike("^[0-9a-f]{16}$"), F.lit(True)).otherwise(F.lit(False)), [("0123456789abcdef", True), ("xyz", False)], "BOOLEAN")
R.cases("c05_plain_json", lambda x: F.to_json(F.struct(F.lit("v").alias("kept"), F.array_sort(F.split(x, ",")).alias("set"))), [("b,a", '{"kept":"v","set":["a","b"]}'), ("c", '{"kept":"v","set":["c"]}')])


@R.add("x04_supplier_candidates", """SELECT event_id AS doc, 'Acme Trading' AS name, 1 AS page, 2 AS line, 'top' AS region, 'supplier label' AS method FROM events WHERE event_id % 3 = 0 UNION ALL
  SELECT event_id, 'Rose Est', 1, 5, 'bottom', 'legal-entity name' FROM events WHERE event_id % 3 < 2""")
def supplier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names over all pages, without the buyer's side."""
    pages = frame(spark, sf_dir, "SELECT event_id AS doc, inline(array(named_struct('page', 1, 'text', concat('head', chr(10), CASE WHEN event_id % 3 = 0 THEN 'Vendor: Acme  Trading Buyer House' ELSE 'x' END, chr(10), chr(10), 'Bill to: Buyer House LLC', chr(10), 'y', chr(10), CASE WHEN event_id % 3 < 2 THEN 'Rose Est' ELSE 'z' END)), named_struct('page', 2, 'text', CASE WHEN event_id % 3 < 2 THEN 'ROSE EST' ELSE 'end' END))) FROM {events}")
    return D.supplier_candidates(pages, frame(spark, sf_dir, "SELECT event_id AS doc, array('Buyer House LLC', 'Co. LLC') AS rows FROM {events}"))


@R.add("x05_buyer_party", "SELECT event_id AS doc, 1 AS page, CASE WHEN event_id % 2 = 0 THEN 'Acme|House 5' ELSE 'Acme' END AS rows FROM events WHERE event_id % 5 <> 0")
def buyer_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buyer's side of the party row, by where words stand."""
    words = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('text', 'Issued', 'x', 10.0D, 'top', 10.0D), named_struct('text', 'By', 'x', 30.0D, 'top', 11.0D), named_struct('text', CASE WHEN event_id % 5 = 0 THEN 'Copy' ELSE 'Bill' END, 'x', 200.0D, 'top', 12.0D), named_struct('text', 'To:', 'x', 230.0D, 'top', 10.0D), named_struct('text', 'Acme', 'x', 250.0D, 'top', 10.0D), named_struct('text', 'Seller', 'x', 10.0D, 'top', CASE WHEN event_id % 2 = 0 THEN 90.0D ELSE 30.0D END), named_struct('text', 'House', 'x', 201.0D, 'top', 50.0D), named_struct('text', '5', 'x', 240.0D, 'top', 51.0D))) FROM {events}")
    return D.buyer_party(words).withColumn("rows", F.array_join("rows", "|"))


@R.add("h04_party_labels", "SELECT event_id AS doc, 1 AS page FROM events WHERE event_id % 2 = 0")
def party_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a buyer's label in a row."""
    return D.buyer_party(frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, CASE WHEN event_id % 2 = 0 THEN 'Customer' ELSE 'Custom' END AS text, 5.0D AS x, 5.0D AS top FROM {events}")).select("doc", "page")


@R.add("h06_ocr_reads", "SELECT event_id, event_id % 4 IN (0, 2) AS ocr FROM events")
def ocr_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'paddleocr' WHEN 1 THEN 'docling' WHEN 2 THEN 'p / m' ELSE 'q / m' END AS engine, array(named_struct('method', 'vision_ai', 'engine', 'p'), named_struct('method', 'text', 'engine', 'q')) AS trace FROM {events}")
    return own.select("event_id", D.ocr_read(F.col("engine"), F.col("trace")).alias("ocr"))


GATE_LINES = f"SELECT l_orderkey AS doc, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) as int) AS line, CASE WHEN l_partkey % 30 <> 0 THEN 'c' END AS code, cast(l_quantity as decimal(18,2)) AS qty, 'EA' AS uom, cast(10 as decimal(18,2)) AS price, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE cast(cast(l_quantity as decimal(18,2)) * 10 as decimal(18,2)) END AS net_amount, CASE WHEN l_orderkey % 7 <> 0 THEN cast(1 as decimal(18,2)) END AS tax_amount FROM {{lineitem}}"
GATE_HEADS = "SELECT l_orderkey AS doc, 'n' AS number, CASE WHEN l_orderkey % 11 <> 0 THEN 'AED' END AS currency, cast(q * 10 - CASE WHEN l_orderkey % 4 = 0 THEN 5 ELSE 0 END as decimal(18,2)) AS net, cast(n as decimal(18,2)) AS tax, CASE WHEN l_orderkey % 8 = 0 THEN concat('x', chr(10), 'Discount: AED 5.00') ELSE 'less (5.00)' END AS text FROM (SELECT l_orderkey, sum(cast(l_quantity as decimal(18,2))) AS q, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) t"


@R.add("v18_reconciliation", "SELECT DISTINCT l_orderkey AS doc, CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 4 <> 0 THEN 'printed_line_total' WHEN l_orderkey % 8 = 0 THEN 'explicit_document_discount' END AS reconciles FROM lineitem")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reconciliation(frame(spark, sf_dir, GATE_LINES), frame(spark, sf_dir, GATE_HEADS))


@R.add("v19_arithmetic", "SELECT DISTINCT l_orderkey AS doc, l_orderkey % 13 <> 0 AND l_orderkey % 7 <> 0 AND l_orderkey % 4 <> 0 AS complete FROM lineitem")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arithmetic_complete(frame(spark, sf_dir, GATE_LINES), frame(spark, sf_dir, GATE_HEADS))


@R.add("v17_native_gate", """WITH c AS (SELECT l_orderkey AS doc, count_if(l_partkey % 30 = 0) AS bare, count(*) AS n FROM lineitem GROUP BY l_orderkey)
  SELECT doc, doc % 11 <> 0 AND doc % 13 <> 0 AND (doc % 4 <> 0 OR doc % 8 = 0) AND (bare = 0 OR bare < n AND doc % 7 <> 0 AND doc % 4 <> 0) AS accepted FROM c""")
def native_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.native_gate(frame(spark, sf_dir, GATE_LINES), frame(spark, sf_dir, GATE_HEADS)).select("doc", "accepted")


@R.add("v25_header_guard", """SELECT event_id AS doc, CASE WHEN event_id % 3 = 2 THEN '4410' END AS po, CASE WHEN event_id % 3 < 2 THEN 'a P.O. Box in an address is not a PO number' END AS po_review, CASE WHEN event_id % 4 = 0 THEN 'not_read' WHEN event_id % 4 = 1 THEN 'not_printed' WHEN event_id % 4 = 2 THEN '1 lines inclusive' END AS tax_review FROM events""")
def header_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = frame(spark, sf_dir, "SELECT event_id AS doc, '4410' AS po, CASE WHEN event_id % 3 = 0 THEN 'P.O. Box 4410' END AS po_quote, CASE WHEN event_id % 4 >= 2 THEN cast(1 as decimal(18,2)) END AS tax, concat(CASE WHEN event_id % 3 = 1 THEN 'PO BOX: 4410' ELSE 'PO 4410' END, chr(10), CASE WHEN event_id % 4 = 0 THEN 'VAT 5' ELSE 'Tax Invoice' END) AS text FROM {events}")
    lines = frame(spark, sf_dir, "SELECT event_id AS doc, cast(105 as decimal(18,2)) AS net_amount, CASE WHEN event_id % 4 = 2 THEN cast(5 as decimal(18,2)) ELSE cast(0.37 as decimal(18,2)) END AS tax_amount FROM {events}")
    return D.header_guard(heads, lines)


@R.add("v26_printed_but_empty", "SELECT event_id AS doc, CAST(NULL AS INT) AS line, 'number' AS field FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, 'po' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 1, 'gtin' FROM events WHERE event_id % 5 = 0 AND event_id % 2 = 0")
def printed_but_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = frame(spark, sf_dir, "SELECT event_id AS doc, 's' AS supplier_name, CASE WHEN event_id % 2 <> 0 THEN 'N' END AS number, '2031-01-01' AS date, 5 AS net, cast(NULL as string) AS po, CASE WHEN event_id % 3 = 0 THEN 'LPO 7' ELSE 'PO Box 7' END AS text FROM {events}")
    lines = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS line, 'a' AS sku, cast(NULL as string) AS gtin, '' AS description, 1 AS qty, 2 AS price, cast(NULL as int) AS net_amount, CASE WHEN event_id % 2 <> 0 THEN '12' END AS barcode_unchecked FROM {events}")
    return D.printed_but_empty(heads, lines, frame(spark, sf_dir, "SELECT event_id AS doc, explode(array('gtin', 'qty')) AS column FROM {events} WHERE event_id % 5 = 0"))


@R.add("v29_located_amounts", "SELECT event_id AS doc, 'net' AS key, CASE WHEN event_id % 3 = 0 THEN 'page 2 box 7' WHEN event_id % 3 = 1 THEN 'page 1 text' END AS reference FROM events")
def located_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an amount is printed: boxes first, then pages."""
    amounts = frame(spark, sf_dir, "SELECT event_id AS doc, 'net' AS key, cast(1250.5 as decimal(18,2)) AS value FROM {events}")
    boxes = frame(spark, sf_dir, "SELECT event_id AS doc, 2 AS page, inline(array(named_struct('id', 7, 'text', CASE WHEN event_id % 3 = 0 THEN 'AED 1,250.50' ELSE '1,250.501' END), named_struct('id', 8, 'text', '11250.50'))) FROM {events}")
    pages = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, CASE WHEN event_id % 3 < 2 THEN 'net 1250.50.' ELSE 'net 1250.5.5' END AS text FROM {events}")
    return D.located_amounts(amounts, boxes, pages)


@R.add("c07_spanned_cells", "SELECT event_id AS doc, unnest([0, 0, 1, 1]) AS row, unnest([0, 1, 0, 1]) AS \"column\", unnest(['a', 'a', NULL, CASE WHEN event_id % 2 = 0 THEN 'z' ELSE 'b' END]) AS text FROM events")
def spanned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = frame(spark, sf_dir, "SELECT event_id AS doc, inline(array(named_struct('n', 1, 'row', 0, 'column', 0, 'row_span', 1, 'column_span', 2, 'text', 'a'), named_struct('n', 2, 'row', 1, 'column', 0, 'row_span', 0, 'column_span', 1, 'text', ''), named_struct('n', 3, 'row', 1, 'column', 1, 'row_span', 1, 'column_span', 1, 'text', 'b'), named_struct('n', 4, 'row', CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END, 'column', CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END, 'row_span', 1, 'column_span', 1, 'text', CASE WHEN event_id % 2 = 0 THEN 'z' ELSE 'a' END))) FROM {events}")
    return D.spans_of_cells(cells)


@R.add("h75_row_roles", "SELECT event_id AS doc, 1 AS row, CASE WHEN event_id % 2 = 0 THEN 'description,qty,price' ELSE '-,qty,price' END AS roles, event_id % 2 = 0 AS heading FROM events")
def row_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS row, array(CASE WHEN event_id % 2 = 0 THEN 'Item Name' ELSE 'Colour' END, 'Qty', 'Unit Price') AS cells FROM {events}")
    return D.row_roles(rows).withColumn("roles", F.array_join("roles", ",", "-"))


@R.add("t08_boundary_roles", "SELECT event_id AS doc, CASE WHEN event_id % 2 = 0 THEN 'price,qty,sku' ELSE 'price,qty' END AS roles FROM events")
def boundary_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT event_id AS doc, array(CASE WHEN event_id % 2 = 0 THEN 'Item Code' ELSE 'x' END, 'QTY', 'Price', 'qty') AS cells FROM {events}")
    return D.boundary_roles(rows).withColumn("roles", F.array_join("roles", ","))


@R.add("h66_amount_between", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1250.5 END::DECIMAL(18, 4) AS value FROM events")
def amount_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id, array(named_struct('text', '9', 'x', 5.0D), named_struct('text', '1,250.5', 'x', 50.0D), named_struct('text', CASE WHEN event_id % 3 = 1 THEN '7' ELSE 'AED' END, 'x', 60.0D), named_struct('text', '8', 'x', 99.0D)) AS words, CASE WHEN event_id % 3 = 2 THEN 100.0D ELSE 20.0D END AS left FROM {events}")
    return own.select("event_id", D.amount_between(F.col("words"), F.col("left"), F.lit(90.0)).alias("value"))


@R.add("w15_joined_tokens")
def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a reader split off, put back on their words, page by page."""
    from ..operators.geometry import anchored_rows

    assert joined_tokens([{"text": "a", "x0": 0, "x1": 1, "top": 0, "bottom": 10}]) != []
    words = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('text', 'Net', 'x0', 10.0D, 'x1', 20.0D, 'top', 10.0D, 'bottom', 20.0D), named_struct('text', ':', 'x0', 21.0D, 'x1', 22.0D, 'top', 10.0D, 'bottom', 20.0D), named_struct('text', '1,', 'x0', 40.0D, 'x1', 45.0D, 'top', 10.0D, 'bottom', 20.0D), named_struct('text', '250.50', 'x0', 46.0D, 'x1', 60.0D, 'top', 11.0D, 'bottom', 21.0D))) FROM {events}")
    return anchored_rows(words)


@R.add("h50_open_gaps", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'net' ELSE 'line amounts do not reconcile with net total,net' END AS gaps FROM events")
def open_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id, array('line amounts do not reconcile with net total', 'net') AS gaps, cast(10 as decimal(18,2)) AS product, cast(CASE WHEN event_id % 2 = 0 THEN 10.01 ELSE 10.02 END as decimal(18,2)) AS net FROM {events}")
    return own.select("event_id", F.array_join(D.open_gaps(F.col("gaps"), F.col("product"), F.col("net")), ",").alias("gaps"))


@R.add("h51_usable_reads", "SELECT event_id, event_id % 4 = 3 AS usable FROM events")
def usable_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END AS lines, CASE WHEN event_id % 4 <> 1 THEN 'n' END AS number, 5 AS net, CASE WHEN event_id % 4 = 2 THEN array('line amounts do not reconcile') ELSE array('uom') END AS gaps FROM {events}")
    return own.select("event_id", D.usable(F.col("lines"), F.col("number"), F.col("net"), F.col("gaps")).alias("usable"))


@R.add("h53_reader_map", "SELECT event_id AS doc, 'number' AS field, 'ocr' AS reader FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'net', 'ocr' FROM events")
def reader_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reader_map(frame(spark, sf_dir, "SELECT event_id AS doc, CASE WHEN event_id % 2 = 0 THEN 'n' ELSE '' END AS number, 5 AS net, cast(NULL as string) AS po FROM {events}"), ["number", "net", "po"], "ocr")


@R.add("t06_disagreements", "SELECT event_id AS doc, 'number' AS field, 'AB-1' AS value, 'AB-2' AS other FROM events WHERE event_id % 3 = 0")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = frame(spark, sf_dir, "SELECT event_id AS doc, 'number' AS field, CASE WHEN event_id % 3 < 2 THEN 'AB-1' ELSE '' END AS value FROM {events}")
    return D.disagreements(mine, frame(spark, sf_dir, "SELECT event_id AS doc, 'number' AS field, CASE WHEN event_id % 3 = 0 THEN 'AB-2' ELSE 'ab1' END AS value FROM {events}"))


@R.add("h56_split_answers", "SELECT event_id AS doc, CASE WHEN event_id % 2 = 0 THEN 'N' || event_id END AS number, CASE WHEN event_id % 2 = 0 THEN 5.5 END::DECIMAL(18, 2) AS net, CASE WHEN event_id % 2 = 0 THEN 'net 5.5' END AS quote, CASE WHEN event_id % 2 = 0 THEN 2 END::INT AS page, CASE WHEN event_id % 2 = 1 THEN 'not an answer' END AS problem FROM events")
def split_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id AS doc, CASE WHEN event_id % 2 = 0 THEN to_json(named_struct('invoice', named_struct('number', concat('N', cast(event_id as string)), 'net', '5.5', 'extra', 1), 'evidence', named_struct('header', named_struct('net', named_struct('quote', 'net 5.5', 'page', 2))))) ELSE 'sorry' END AS answer FROM {events}")
    return D.split_answer(own)


@R.add("r12_invoice_json", "SELECT event_id AS doc, unnest([1, 2]) AS line, unnest(['A' || event_id, 'B']) AS sku, unnest([2, 3.5])::DECIMAL(18, 2) AS qty FROM events WHERE event_id % 3 <> 0")
def invoice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured invoices to lines."""
    own = frame(spark, sf_dir, "SELECT event_id AS doc, CASE WHEN event_id % 3 = 0 THEN '[' ELSE to_json(named_struct('number', 'n', 'lines', array(named_struct('sku', concat('A', cast(event_id as string)), 'qty', 2.0), named_struct('sku', 'B', 'qty', 3.5)))) END AS value FROM {events}")
    return D.invoice_json(own)


@R.add("h45_evidence_of", "SELECT event_id AS doc, 'net' AS field, CASE WHEN event_id % 3 = 0 THEN 'located' WHEN event_id % 2 = 0 THEN 'quoted' END AS source, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 9 END::INT AS page FROM events")
def evidence_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id AS doc, 'net' AS field, 1 AS page FROM {events}")
    return D.evidence_of(own.drop("page"), own.where("doc % 3 = 0"), own.where("doc % 2 = 0").withColumn("page", F.lit(9)))


@R.add("h47_filename_review", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey + 1000000 AS VARCHAR), 8, '0') END AS near FROM orders WHERE o_orderkey < 1000000")
def filename_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reading import one_character_off

    own = frame(spark, sf_dir, "SELECT o_orderkey, lpad(cast(o_orderkey as string), 8, '0') AS number, concat('inv-', lpad(cast(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey END as string), 8, '0'), '.pdf') AS name FROM {orders} WHERE o_orderkey < 1000000")
    return own.select("o_orderkey", one_character_off(F.col("number"), F.col("name")).alias("near"))


@R.add("h12_feedback_entries", "SELECT event_id AS id, 'FB-' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 3 AS VARCHAR), 4, '0') AS feedback_id FROM events WHERE event_id % 3 <> 0")
def feedback_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id AS id, user_id AS log, ts AS at, CASE WHEN event_id % 3 <> 0 THEN 'c' ELSE ' ' END AS correction, 'e' AS evidence FROM {events}")
    return D.filed_feedback(own, 3).select("id", "feedback_id")


@R.add("h87_promoted_feedback", "SELECT 'S' || (o_custkey % 5) AS supplier, count(*) AS approved FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1")
def promoted_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = frame(spark, sf_dir, "SELECT concat(' inv', cast(o_orderkey as string), ' / 2') AS invoice_line, CASE WHEN o_orderkey % 3 = 0 THEN 'Approved' ELSE 'Proposed' END AS decision FROM {orders}")
    return D.promoted(feedback, frame(spark, sf_dir, "SELECT concat('Inv', cast(o_orderkey as string)) AS number, concat('S', cast(o_custkey % 5 as string)) AS supplier FROM {orders}"))


@R.add("e14_templates", "SELECT event_id AS doc, CASE WHEN event_id % 2 = 0 THEN 'acme' END AS template, CASE WHEN event_id % 2 = 0 THEN 'N' || event_id END AS number, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END::INT AS lines FROM events")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier templates: keywords, fields, lines."""
    texts = frame(spark, sf_dir, "SELECT event_id AS doc, concat(CASE WHEN event_id % 2 = 0 THEN 'ACME' ELSE 'Other' END, chr(10), 'No N', cast(event_id as string), chr(10), 'Items', chr(10), 'AB 1', chr(10), 'CD 2', chr(10), 'Total 3', chr(10), 'EF 4') AS text FROM {events}")
    template = {"name": "acme", "keywords": ["ACME"], "fields": {"number": r"No (\S+)"}, "lines": {"start": "^Items", "end": "^Total", "line": r"^(?P<sku>[A-Z]+) (?P<qty>\d+)$"}}
    return Y.by_template(texts, [template]).select("doc", "template", F.col("fields")["number"].alias("number"), F.size("lines").alias("lines"))


@R.add("e15_reader_priority", "SELECT event_id AS doc, CASE event_id % 3 WHEN 0 THEN 'template' WHEN 1 THEN 'table' ELSE 'layout' END AS number FROM events")
def reader_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id AS doc, inline(array(named_struct('position', 3, 'number', 'layout'), named_struct('position', 1, 'number', CASE WHEN event_id % 3 = 0 THEN 'template' END), named_struct('position', 2, 'number', CASE WHEN event_id % 3 < 2 THEN 'table' END))) FROM {events}")
    return Y.by_priority(own, ["number"])


@R.add("a03_order_groups", f'SELECT upper(key) AS key, "order", location, count(DISTINCT item) AS items FROM ({plain(PO)}) WHERE regexp_matches(created, \'^\\d{{4}}-\\d\\d-\\d\\d\') GROUP BY ALL')
def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.groups_of(frame(spark, sf_dir, PO_SPARK)).select("key", "order", "location", F.size("items").cast("long").alias("items"))


@R.add("j13_site_names", "SELECT 'S' || l_suppkey AS site, count(DISTINCT l_partkey % 2) AS names FROM lineitem GROUP BY 1")
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names the item master gives a site."""
    own = frame(spark, sf_dir, "SELECT concat('S', cast(l_suppkey as string)) AS site, concat('n', cast(l_partkey % 2 as string)) AS name FROM {lineitem}")
    return own.groupBy("site").agg(F.count_distinct("name").alias("names"))


@R.add("l09_site_rows", "SELECT site, item FROM (SELECT p_brand AS site, p_partkey AS item, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 50")
def site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 item rows of a site, exactly its own."""
    from ..operators.access import SHEET_ROWS, by_key

    rows = frame(spark, sf_dir, "SELECT p_partkey AS item, p_brand AS site FROM {part}")
    probes = rows.select(F.col("site").alias("value"), F.col("site").alias("probe")).distinct()
    return by_key(probes, rows, F.col("site"), ["item"], SHEET_ROWS).select("site", "item")


@R.add("r16_memory_source", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 1)")
def memory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a caller holds, by the same access paths."""
    from ..operators.access import by_supplier_name

    rows = frame(spark, sf_dir, "SELECT cast(p_partkey as string) AS id, p_brand FROM {part}")
    asked = frame(spark, sf_dir, "SELECT 1 AS probe, concat(upper(p_brand), ' ') AS value FROM {part} WHERE p_partkey = 1")
    return by_supplier_name(asked, rows, "p_brand").select("id")


@R.add("k11_checks_sheet", f"WITH {LINED}, {PLANNED}, c AS ({CHECKED}) SELECT sheet, count(*) AS rows FROM (SELECT sheet FROM cells UNION ALL SELECT '(check)' FROM c) GROUP BY sheet")
def checks_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is appended to a written workbook."""
    return G.checks_rows(_cells(spark, sf_dir), frame(spark, sf_dir, CHECKS)).groupBy("sheet").agg(F.count("*").alias("rows"))


@R.add("h21_checked_workbook", "SELECT 'orphan detail' AS problem, 'D' AS key UNION ALL SELECT 'header without tax rows', 'B' UNION ALL SELECT 'header without details', 'B' UNION ALL SELECT 'repeated header', 'A'")
def checked_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins between the sheets of a written workbook."""
    import io

    from .roundtrips import scratch

    data, path = io.BytesIO(), f"{scratch(spark)}/w.xlsx"
    workbook.write_xlsx({"Header": [["key"], ["A"], ["A"], ["B"]], "Tax_Breakdown": [["key"], ["A"]], "Details": [["key"], ["A"], ["D"]]}, data)
    workbook.write_bytes(spark, path, data.getvalue())
    rows = workbook.read_workbooks(spark, path)
    sheet = lambda name: workbook.by_headings(rows, name).select(F.col("data")["KEY"].alias("key"))
    return K.sheet_joins(sheet("Header"), sheet("Tax_Breakdown"), sheet("Details"), "key")


@R.add("k09_extraction_sheet", "SELECT o_orderkey AS \"Document\", CAST(o_totalprice AS DECIMAL(18, 2)) AS \"Net\", CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'not read' END AS \"State\" FROM orders")
def extraction_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as they were read, not validated."""
    return frame(spark, sf_dir, "SELECT o_orderkey AS `Document`, cast(o_totalprice as decimal(18,2)) AS `Net`, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'not read' END AS `State` FROM {orders}")


@R.add("k12_reference_sheets", "SELECT 'POLines' AS sheet, count(*) AS rows FROM lineitem UNION ALL SELECT 'POs', count(*) FROM orders")
def reference_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference tables as sheets; order lines stand in a sheet of their own."""
    orders = frame(spark, sf_dir, "SELECT l_orderkey AS id, collect_list(named_struct('item', l_partkey, 'qty', l_quantity)) AS lines FROM {lineitem} GROUP BY l_orderkey")
    return S.sheet_counts({"POs": frame(spark, sf_dir, "SELECT o_orderkey AS id FROM {orders}"), "POLines": orders.select(F.col("id").alias("po"), F.inline("lines"))})


@R.add("c06_redacted_payloads", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[removed]' ELSE 'J' || (event_id % 3) END AS job FROM events")
def redacted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in which a deleted job's id is blacked out, however deep it stands."""
    own = frame(spark, sf_dir, "SELECT event_id, to_json(named_struct('a', named_struct('job', concat('J', cast(event_id % 3 as string))))) AS payload FROM {events}")
    return own.select("event_id", F.get_json_object(F.regexp_replace("payload", '"J0"', '"[removed]"'), "$.a.job").alias("job"))


@R.add("c08_cursors", "SELECT p_partkey, CAST(p_size AS INT) AS score, CAST(p_partkey AS VARCHAR) AS id FROM part")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors as opaque texts, and what they read back as."""
    own = frame(spark, sf_dir, "SELECT p_partkey, cast(p_size as int) AS score, cast(p_partkey as string) AS id FROM {part}")
    told = own.select("p_partkey", C.cursor_text(F.lit("s"), F.col("score"), F.col("id")).alias("cursor"))
    return told.select("p_partkey", C.cursor_parts(F.col("cursor"))["score"].alias("score"), C.cursor_parts(F.col("cursor"))["id"].alias("id"))


@R.add("h28_target_accuracy", "SELECT o_orderstatus AS supplier, count(*) * 2 AS cells FROM orders GROUP BY o_orderstatus")
def target_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy records of all jobs, by supplier."""
    jobs = frame(spark, sf_dir, "SELECT o_orderstatus AS supplier, array(named_struct('field', 'a', 'status', 'verified', 'changed', false), named_struct('field', 'b', 'status', 'verified', 'changed', true)) AS records, cast('2031-01-02' as timestamp) AS at FROM {orders}")
    found = L.accuracy(jobs.select("at", "supplier", F.inline("records")), F.lit("2031-01-03").cast("timestamp"))
    return found.where("period = '7d' and grouping = 'supplier'").select(F.col("name").alias("supplier"), "cells")


@R.add("x17_workbench_rows", f"SELECT i.doc, i.value AS \"Invoice Value\", CASE WHEN i.doc % 2 = 0 THEN 'Exact' ELSE 'Candidate' END AS \"Confidence\" FROM ({plain(INVOICES)}) i")
def workbench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, INVOICES)
    return own.select("doc", F.col("value").alias("Invoice Value"), F.when(F.col("doc") % 2 == 0, "Exact").otherwise("Candidate").alias("Confidence"))


@R.add("h57_same_arithmetic", "SELECT l_orderkey AS doc, bool_and(l_partkey % 50 <> 0) AS same FROM lineitem GROUP BY l_orderkey")
def same_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two reads have the same quantities, prices and amounts line by line."""
    base = f"SELECT l_orderkey AS doc, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) as int) AS line, concat_ws('|', cast(l_quantity as string), cast(l_partkey as string)) AS identity, l_partkey AS p FROM {{lineitem}}"
    own = frame(spark, sf_dir, base)
    return S.same_lines(own.drop("p"), own.withColumn("identity", F.when(F.col("p") % 50 == 0, "x").otherwise(F.col("identity"))).drop("p"))


@R.add("h26_picked_sites", "SELECT event_id AS doc, CASE WHEN event_id % 2 = 0 THEN 'OWNER-PICK' ELSE 'SUP-003' END AS rule FROM events")
def picked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site that follows from a pick is attributed to it."""
    own = frame(spark, sf_dir, "SELECT event_id AS doc, concat('S', cast(event_id % 2 as string)) AS site FROM {events}")
    picks = own.where("doc % 2 = 0").select("doc", "site", F.lit("OWNER-PICK").alias("rule"))
    return own.join(picks, ["doc", "site"], "left").select("doc", F.coalesce("rule", F.lit("SUP-003")).alias("rule"))
