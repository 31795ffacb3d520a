"""Queries for facts of printed text: each input stands beside what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import printed as P
from ..functions import text as T
from ..operators import catalog as C
from ..operators import layout as Y
from ..operators import outcome as X
from .registry import Registry, frame

R = Registry()


def joined(values: Column) -> Column:
    return F.array_join(values, ",")


R.scalar("f08_inbox_filter", "customer", "c_custkey", "concat(c_name, ' ', c_mktsegment)", lambda x: F.contains(F.lower(F.concat_ws(" ", x, F.col("c_custkey").cast("string"))), F.lower(F.lit("BUILD"))), "contains(lower(x || ' ' || c_custkey), 'build')")
R.scalar("f09_prefix", "part", "p_partkey", "concat(case when p_partkey % 2 = 0 then 't:50%_' else 't:50x' end, cast(p_partkey as string))", lambda x: F.startswith(x, F.lit("t:50%_")), "starts_with(x, 't:50%_')")
R.cases("f22_header_label", P.header_label, [("Tax Invoice No.", "tax invoice no"), ("Tax lnvoice Number", "tax invoice number"), ("Invoice Dale", "invoice date"), ("P0 No", None), ("Total", None), (None, None)])
R.cases("f24_role", P.role, [("S.N", "serial"), ("Bar Code / UPC", "gtin"), ("Product Description", "description"), ("Item Code (Ours)", "sku"), ("Qty in PCE", "qty"), ("VAT Amount AED", "tax_amount"), ("Unit price incl", "price"), ("Part Code", "part_code"), ("Colour", None), ("VAT 5%", "tax_amount")])
R.cases("f25_exact_role", P.exact_role, [("Amount", "net_amount"), ("amount AED", "other_amount"), ("Vat 5.0 %", "tax_amount"), ("UOM", "uom"), ("My Price", None), ("S.No", "serial"), ("TOTAL", "gross_amount")])
R.cases("f27_picked_sku", lambda x: P.picked_sku(F.split(x, r"\|")), [("item|123", "123"), ("AB12|CD-3", "AB12CD-3"), ("77|A/9", "A/9"), ("No|Number", None), ("=x|12", "12"), ("12|345", "345"), ("", None)])
R.cases("n15_amount_forms", lambda x: F.array_join(F.array_sort(N.amount_forms(x.cast("decimal(18,3)"))), "|"), [("1234.5", "1,234.50|1,234.500|1234.50|1234.500"), ("7", "7.00|7.000"), ("0", "0.000"), ("1234567.891", "1,234,567.89|1,234,567.891|1234567.89|1234567.891")])
R.cases("d06_confirmed_date", lambda x: P.confirms(x, F.lit("2031-04-03")), [("03/04/2031", True), ("04/03/2031", True), ("3rd April 2031", True), ("Apr 3, 2031", True), ("03 . 04 . 2031", True), ("05/04/2031", False), ("soon", False)], "BOOLEAN")
R.cases("d09_labelled_date", P.labelled_date, [("Invoice Date: 13/02/2031\nDocument Date 2031-02-14", "2031-02-14"), ("Invoice Date 13-Feb-2031\nInvoice Date 14-Feb-2031", None), ("Date: 25.12.2031", "2031-12-25"), ("Report Run Date: 2031-01-01", None), ("Due date: 2031-03-13", "2031-03-13"), ("x", None)], "DATE")
R.cases("h64_printed_currency", P.printed_currency, [("Currency: aed", "AED"), ("Total in USD\nAmount USD", "USD"), ("Total KWD 12.500", "KWD"), ("Currency: AED\nAmount USD 5", None), ("nothing", None)])
R.cases("a23_printed_money", lambda x: P.printed_money(x, [r"(?i)net\s*:\s*([0-9.,]+)", r"(?i)sub total ([0-9.,]+)"]), [("Net: 1,200.50\nsub total 1200.5", 1200.5), ("Net: 5\nNet: 6", None), ("Net: x", None), ("Sub Total 7.25", 7.25)], "DECIMAL(38, 6)")
R.cases("e02_printed_identifier", lambda x: P.printed_identifier(x, [r"(?i)po no\s*:\s*(\S+)", r"(?i)order (\S+)"]), [("PO No: AB-12.", "AB-12"), ("PO No: ab-12\nOrder AB-12", "ab-12"), ("PO No: Date", None), ("Order 1\nOrder 2", None), ("", None)])
R.cases("h68_packing_page", P.is_packing_page, [("Packing List 4", True), ("PACKING SLIP\nTax Invoice", False), ("Invoice", False), ("goods packing", False)], "BOOLEAN")
R.cases("v27_purchase_order", P.is_purchase_order, [("Purchase Order\nTax Invoice 3", True), ("Tax Invoice 3\nPurchase Order", False), ("PURCHASE ORDER NO 55", True), ("our purchase order", False), ("Invoice", False)], "BOOLEAN")
R.cases("h55_po_label", P.po_label, [("Customer  PO No. 7", "Customer PO No."), ("P.O. Box 5\nLPO 8", "LPO"), ("Purchase Order: 9", "Purchase Order"), ("P.O. Box No 3", None), ("x", None)])
R.cases("v33_scan", lambda x: P.is_scan(F.col("event_id") % 7 * 10, x), [("a.PNG", True), ("b.docx", False), ("c.jpeg", True), ("noext", False)], "BOOLEAN")
R.cases("v35_not_located", lambda x: P.not_located(F.lit("Invoice (ai)"), x), [("page 2", True), ("page 2 box [0, 1, 2, 3]", False), ("page 2 box", False), (None, True)], "BOOLEAN")
R.cases("h09_different_company", lambda x: P.different_company(x, F.lit("Acme Trading LLC")), [("ACME TRADING co", False), ("Co. L.L.C", False), ("Other Firm Ltd", True), ("The Acme Trading Est", False), ("", False)], "BOOLEAN")
R.cases("h08_numeric_tokens", lambda x: joined(F.array_sort(P.numeric_tokens(x, 2))), [("a 1,200.505 b 7", "7.00,1200.51"), ("12 12.00", "12.00"), ("none", ""), ("(5.999) -3", "3.00,6.00")])
R.cases("v10_unsafe_flags", lambda x: joined(P.unsafe_flags(F.split(x, r"\|"))), [("Column shifted|repeated", "Column shifted"), ("QUARANTINE|Structural issue", "QUARANTINE,Structural issue"), ("fine", "")])
R.cases("v11_entry_problem", lambda x: P.entry_problem(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1)), [("po=12", None), ("po=012", "must be a whole number"), ("date=2031-02-30", "must be YYYY-MM-DD"), ("date=2031-02-28", None), ("location_type=Store", "must be Store (S) or Warehouse (W)"), ("net=1e", "must be a number"), ("Quantity=3.5", None), ("number=" + "x" * 65, "is too long")])
R.cases("h48_row_marks", lambda x: joined(F.array_sort(P.row_marks(x))), [("2 Cream 1,250.00 x 3.5", "1,250.00,cream"), ("Rose Rose 12.345", "rose"), (None, "")])
R.cases("h48_line_marks", lambda x: joined(F.array_sort(P.line_marks([F.lit("1250").cast("decimal(18,2)"), F.lit(None).cast("decimal(18,2)")], x))), [("Cream 50ml", "1,250.00,1250.00,cream"), (None, "1,250.00,1250.00")])
R.cases("x27_guarded_barcode", lambda x: F.concat_ws("|", F.coalesce(P.guarded_barcode(x, F.col("event_id") % 2 == 0)["gtin"], F.lit("-")), F.coalesce(P.guarded_barcode(x, F.lit(False))["unchecked"], F.lit("-")), F.coalesce(P.guarded_barcode(x, F.lit(True))["reason"], F.lit("-"))), [("EAN: 4006381333931", "4006381333931|-|-"), ("4006381333932", "-|4006381333932|unreadable"), ("12 ? 4", "-|-|unreadable"), ("", "-|-|-")])
R.cases("h79_split_note", lambda x: P.split_note(F.lit(2), F.lit(3), F.split(x, ","), F.array(F.lit(3), F.lit(4))), [("A1,B2,C3", "The uploaded file bound 3 invoices (A1, B2, C3). It was split by page; this record is invoice 2 of 3 (pages 3-4 of the original file).")])
R.cases("c01_cell_values", lambda x: joined(C.cell_values(F.split(x, r"\|"))), [(" a |a|b", "a,b"), ("|  |", ""), ("x", "x")])
R.cases("h34_role_values", lambda x: joined(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(x, r"\|"), lambda v: T.normalize_name(v)), lambda v: v != "")))), [("Main Store|MAIN  store|B", "b,main store"), ("--|é", "e")])
R.cases("h05_same_market", lambda x: F.lower(F.trim(x)) == F.lower(F.lit("KSA")), [(" ksa", True), ("UAE", False), ("KSA", True)], "BOOLEAN")
R.cases("h01_matching_prefix", lambda x: T.strip_prefix(F.coalesce(x, F.lit(""))), [("ult_0012", "0012"), (" ULT_ULT_1", "ULT_1"), (None, ""), ("XULT_1", "XULT_1")])
R.cases("v30_amount_page", lambda x: X.amount_page(x, F.lit("520").cast("decimal(18,2)")), [("a\f520.00", 2), ("520.50\f1,520.00", None), ("5 20\fx", 1), ("net 520.000", 1), ("x520\f520,", 1)], "INT")
R.cases("e18_page_counter", lambda x: F.nullif(F.regexp_extract(x, r"(?i)\bpage\s*[:#]?\s*(\d{1,3})\s*(?:of|/)\s*(\d{1,3})\b", 2), F.lit("")), [("Page 1 of 12", "12"), ("PAGE: 2/3", "3"), ("page 4", None)])
R.cases("v21_self_check", lambda x: F.array_join(P.self_check(F.length(x), F.nullif(F.substring(x, 1, 1), F.lit("n")), F.lit(1), F.lit(False), F.length(x)), "; "), [("", "no lines; printed line nets do not sum to its net; fewer than 3 of number, date, PO, net and tax"), ("nab", "no number or net"), ("xx", "printed line nets do not sum to its net; fewer than 3 of number, date, PO, net and tax"), ("xyz", "printed line nets do not sum to its net")])
R.cases("h76_header_value", lambda x: P.header_value(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1), D.table_date(F.substring_index(x, "=", -1))), [("date=25.12.2031", "2031-12-25"), ("currency= aed", "AED"), ("currency=AEDX", None), ("number=INV 1", None), ("po=P-1/2", "P-1/2"), ("number=", None)])
R.cases("h71_normal_box", lambda x: F.concat_ws(",", F.least(x.cast("int"), F.lit(50)), F.greatest(x.cast("int"), F.lit(50))), [("10", "10,50"), ("60", "50,60")])


@R.add("h46_union_box", "SELECT event_id, round(least(event_id % 50, 40) / 100.0, 4)::DOUBLE AS x0, round(greatest(event_id % 50 + 20, 45) / 100.0, 4)::DOUBLE AS x1 FROM events WHERE event_id % 50 <= 80")
def union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box about two words of a row."""
    at = (F.col("event_id") % 50).cast("double")
    word = lambda left, right: F.struct(left.alias("x0"), F.lit(10.0).alias("top"), right.alias("x1"), F.lit(20.0).alias("bottom"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"))
    own = frame(spark, sf_dir, "SELECT event_id FROM {events}").withColumn("words", F.array(word(at, at + 20), word(F.lit(40.0), F.lit(45.0))))
    box = P.union_box(F.col("words"))
    return own.select("event_id", box[0].alias("x0"), box[2].alias("x1"))


@R.add("d08_labelled_next_line", "SELECT event_id AS doc, CASE event_id % 3 WHEN 0 THEN '12/02/2031' WHEN 1 THEN '2031-02-12' END AS value FROM events")
def labelled_next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date behind its label or on the line below it; two different ones are none."""
    rows = frame(spark, sf_dir, "SELECT event_id AS doc, n, CASE event_id % 3 WHEN 0 THEN CASE n WHEN 1 THEN 'Invoice Date:' WHEN 2 THEN ' 12/02/2031' ELSE 'x' END WHEN 1 THEN CASE n WHEN 1 THEN 'a' WHEN 2 THEN 'Invoice date 2031-02-12' ELSE '12/02/2031' END ELSE CASE n WHEN 1 THEN 'Invoice date 1/2/2031' WHEN 2 THEN 'Invoice date 3/2/2031' ELSE 'y' END END AS text FROM (SELECT event_id, explode(array(1, 2, 3)) AS n FROM {events})")
    return Y.next_line_value(rows, r"invoice\s+date", r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", ["n"])


@R.add("a24_totals_by_priority", "SELECT event_id AS doc, unnest(['gross', 'net']) AS field, unnest([CASE WHEN event_id % 2 = 0 THEN 110 WHEN event_id % 4 = 1 THEN 50 END, 100])::DECIMAL(38, 6) AS amount FROM events")
def totals_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts behind labels of totals: the label of the highest priority, if it says one amount."""
    rows = frame(spark, sf_dir, "SELECT event_id AS doc, explode(CASE WHEN event_id % 2 = 0 THEN array('Net total 100.00', 'Total 50.00', 'Grand total 110.00') WHEN event_id % 4 = 1 THEN array('Sub-total 100', 'Total 50.00') ELSE array('Net amount 100.00', 'Total 50.00', 'Total 60.00') END) AS text FROM {events}")
    return Y.totals(rows).withColumn("amount", F.col("amount").cast("decimal(38,6)"))


@R.add("e05_bucketed_words", "SELECT event_id AS doc, 1 AS page, 1 AS row_no, 'A' || event_id AS item, 'soft cream' AS description, CASE WHEN event_id % 2 = 0 THEN '3' ELSE '' END AS qty FROM events")
def bucketed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a row by the column in which their centre lies."""
    words = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, 1 AS row_no, inline(array(named_struct('text', 'cream', 'x0', 60.0D, 'x1', 80.0D), named_struct('text', concat('A', cast(event_id as string)), 'x0', 5.0D, 'x1', 20.0D), named_struct('text', 'soft', 'x0', 40.0D, 'x1', 55.0D), named_struct('text', '3', 'x0', CASE WHEN event_id % 2 = 0 THEN 100.0D ELSE 300.0D END, 'x1', CASE WHEN event_id % 2 = 0 THEN 105.0D ELSE 310.0D END))) FROM {events}")
    return Y.bucketed(words, [("item", 0, 30), ("description", 30, 90), ("qty", 90, 200)])


@R.add("e04_column_bounds", "SELECT event_id AS doc, unnest(['item', 'qty', 'price']) AS label, unnest([0.0, 30.0, 60.0])::DOUBLE AS \"left\", unnest([30.0, 60.0, 200.0])::DOUBLE AS \"right\" FROM events")
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = frame(spark, sf_dir, "SELECT event_id AS doc, 1 AS page, inline(array(named_struct('label', 'qty', 'x0', 40.0D, 'x1', 50.0D), named_struct('label', 'item', 'x0', 5.0D, 'x1', 20.0D), named_struct('label', 'price', 'x0', 70.0D, 'x1', 90.0D))) FROM {events}")
    return Y.column_bounds(heads, 200.0).drop("page")


@R.add("h76_value_rows", "SELECT event_id AS doc, unnest(['number', 'date']) AS field, unnest(['N' || event_id, '2031-02-03']) AS value FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, 'date', '2031-02-03' FROM events WHERE event_id % 3 = 2")
def value_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of labels over a row of values; a field with two values is dropped."""
    rows = frame(spark, sf_dir, "SELECT event_id AS doc, posexplode(CASE WHEN event_id % 3 = 2 THEN array(array('Invoice No', 'Invoice Date'), array('A1', '2031-02-03'), array('Invoice No', 'Invoice Date'), array('A2', '2031-02-03')) ELSE array(array('x'), array('Invoice No', 'Invoice Date', 'z'), array(concat('N', cast(event_id as string)), '2031-02-03', 'y')) END) AS (n, cells) FROM {events}")
    return Y.value_rows(rows, P.HEADER_LABELS, ["n"])
