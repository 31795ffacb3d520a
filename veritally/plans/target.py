"""Queries for the target sheets: evidence, cells, typed rows, template, issues, view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import target as G
from ..operators.check import TEMPLATE, printed
from .registry import Registry, frame, plain

R = Registry()

#: A cell an order, whose evidence is of another kind by turns; what it cites are rows of an extract and a master.
CELLS = """SELECT o_orderkey AS id, o_orderkey AS doc, CASE o_orderkey % 12 WHEN 0 THEN 'Store (S)' WHEN 1 THEN 'KSA' WHEN 6 THEN 'KWD' WHEN 7 THEN 'V5' WHEN 8 THEN '1250.5' WHEN 9 THEN 'ABC' WHEN 10 THEN '2031-03-04' ELSE concat('I', cast(o_orderkey as string)) END AS value,
  CASE o_orderkey % 12 WHEN 0 THEN 'location master' WHEN 1 THEN 'Location-market mapping' WHEN 2 THEN 'Item Master ITEM_PARENT' WHEN 3 THEN 'Item Master ITEM_PARENT' WHEN 4 THEN 'Selected by POG-001 among 3' WHEN 5 THEN 'PO rows RMS_ORDER_NO' WHEN 6 THEN 'Supplier-site table' WHEN 7 THEN 'Owner VAT code table (C/PV)' WHEN 11 THEN 'prefix fallback' ELSE 'Invoice line' END AS source,
  CASE o_orderkey % 12 WHEN 2 THEN concat('Items!', cast(o_orderkey as string)) WHEN 3 THEN concat('Items!', cast(o_orderkey as string), ', Items!', cast(o_orderkey + 1 as string), ' (+3)') WHEN 4 THEN concat('PO Extract!', cast(o_orderkey as string)) WHEN 5 THEN concat('Items!', cast(-o_orderkey as string)) WHEN 6 THEN concat('S', cast(o_orderkey % 5 as string), '|v1') END AS reference,
  CASE o_orderkey % 12 WHEN 8 THEN '1,250.50' WHEN 9 THEN 'ULT_ABC' WHEN 10 THEN '4th March 2031' END AS original, concat('L', cast(o_custkey % 4 as string)) AS location FROM {orders}"""
SOURCES = """SELECT 'Items' AS sheet, cast(o_orderkey as int) AS row_number, map('ITEM_PARENT', concat('i ', cast(o_orderkey as string)), 'X', 'y') AS data FROM {orders} UNION ALL
  SELECT 'PO Extract', cast(o_orderkey as int), map('CREATED_DATE', CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '2031-01-01' END, 'RMS_ITEM_ID', '123456789', 'RMS_ORDER_NO', CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE concat('I', cast(o_orderkey as string)) END) FROM {orders}"""
LOCATIONS = "SELECT concat('L', cast(r_regionkey as string)) AS location, CASE WHEN r_regionkey % 2 = 0 THEN 'store (S)' ELSE 'Warehouse (W)' END AS type, CASE WHEN r_regionkey < 2 THEN 'KSA' ELSE 'UAE' END AS market FROM {region}"
TEXTS = "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 5 = 1 THEN 'nothing' ELSE 'net 1 250.5 paid ABC on 4th March 2031' END AS text FROM {orders}"


@R.add("j24_evidence_statuses", """SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN CASE WHEN o_custkey % 4 % 2 = 0 THEN 'verified' ELSE 'mismatch' END WHEN 1 THEN CASE WHEN o_custkey % 4 < 2 THEN 'verified' ELSE 'mismatch' END WHEN 2 THEN 'verified'
    WHEN 3 THEN CASE WHEN o_orderkey + 1 IN (SELECT o_orderkey FROM orders) THEN 'over_cited' ELSE 'mismatch' END WHEN 4 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'data_gap' WHEN o_orderkey % 7 = 0 THEN 'mismatch' ELSE 'verified' END WHEN 5 THEN 'mismatch' WHEN 6 THEN CASE WHEN o_orderkey % 5 IN (1, 3) THEN 'verified' ELSE 'mismatch' END
    WHEN 7 THEN 'verified' WHEN 11 THEN 'unverifiable' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'unverifiable' WHEN o_orderkey % 5 = 1 THEN 'mismatch' WHEN o_orderkey % 12 = 8 THEN 'verified' ELSE 'verified' END END AS status FROM orders""")
def evidence_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence read again at the rows, tables and texts that it cites."""
    sites = frame(spark, sf_dir, "SELECT concat('S', cast(r_regionkey as string)) AS site, CASE WHEN r_regionkey IN (1, 3) THEN 'KWD' ELSE 'AED' END AS currency FROM {region}")
    codes = frame(spark, sf_dir, "SELECT DISTINCT 'V5' AS code FROM {region}")
    return G.evidence_statuses(frame(spark, sf_dir, CELLS), frame(spark, sf_dir, SOURCES), frame(spark, sf_dir, LOCATIONS), sites, codes, frame(spark, sf_dir, TEXTS))


@R.add("r17_cited_rows", """SELECT o_orderkey AS id, 'Items' AS sheet, CAST(o_orderkey AS INT) AS row_number FROM orders WHERE o_orderkey % 12 IN (2, 3) UNION ALL SELECT o_orderkey, 'Items', CAST(o_orderkey + 1 AS INT) FROM orders WHERE o_orderkey % 12 = 3
  UNION ALL SELECT o_orderkey, 'PO Extract', CAST(o_orderkey AS INT) FROM orders WHERE o_orderkey % 12 = 4 UNION ALL SELECT o_orderkey, 'Items', NULL FROM orders WHERE o_orderkey % 12 = 5""")
def cited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.references(frame(spark, sf_dir, CELLS))


@R.add("h13_held", "SELECT p_partkey, p_partkey % 3 <> 2 AS held FROM part")
def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cited row holds the value in the named column, else in any."""
    own = frame(spark, sf_dir, "SELECT p_partkey, map('BRAND', p_brand, 'OTHER', p_type) AS data, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN p_type ELSE p_type END AS value, CASE p_partkey % 3 WHEN 0 THEN 'BRAND' WHEN 1 THEN 'ABSENT' ELSE 'BRAND' END AS col FROM {part}")
    return own.select("p_partkey", G.held(F.col("data"), F.col("col"), F.col("value")).alias("held"))


@R.add("h14_field_statuses", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'empty_flagged' WHEN 1 THEN 'no_evidence' WHEN 2 THEN CASE WHEN event_id % 4 = 0 THEN 'verified' ELSE 'owner_entry_unattributed' END WHEN 3 THEN 'unverifiable' WHEN 4 THEN 'verified' ELSE 'mismatch' END AS cell_status FROM events""")
def field_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE '12' END AS value, CASE event_id % 6 WHEN 1 THEN NULL WHEN 2 THEN 'owner_entry' ELSE 'printed' END AS kind, CASE WHEN event_id % 6 = 3 THEN 'Invoice (ai)' ELSE 'Invoice line' END AS source, 'page 1' AS reference,
      '12.0' AS entered, 'owner' AS actor, CASE WHEN event_id % 4 = 0 THEN 'now' END AS at, CASE WHEN event_id % 6 = 5 THEN 'mismatch' ELSE 'verified' END AS status FROM {events}""")
    return G.field_statuses(own).select("event_id", "cell_status")


DOCS = "SELECT o_orderkey AS doc, cast(o_orderkey as int) AS transaction FROM {orders}"
FIELDS = "SELECT o_orderkey AS doc, inline(array(named_struct('key', 'number', 'value', concat('N', cast(o_orderkey as string))), named_struct('key', 'site', 'value', cast(o_custkey as string)), named_struct('key', 'po', 'value', concat('0', cast(o_orderkey as string))), named_struct('key', 'date', 'value', CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE cast(cast(o_orderdate as date) as string) END), named_struct('key', 'net', 'value', cast(cast(o_totalprice as decimal(18,2)) as string)), named_struct('key', 'taxCode', 'value', 'V5'))) FROM {orders}"
DETAILS = "SELECT l_orderkey AS doc, line, inline(array(named_struct('column', 'Item', 'value', cast(p as string), 'status', 'verified'), named_struct('column', 'UPC', 'value', '1', 'status', 'verified'), named_struct('column', 'Unit Cost', 'value', '2', 'status', CASE WHEN p % 3 = 0 THEN 'mismatch' ELSE 'verified' END), named_struct('column', 'Quantity', 'value', '3', 'status', 'verified'), named_struct('column', 'Unit Tax Code', 'value', NULL, 'status', NULL))) FROM (SELECT l_orderkey, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) AS line, l_partkey AS p FROM {lineitem}) t"
NAMED = {"number": "'N' || o_orderkey", "site": "CAST(o_custkey AS VARCHAR)", "po": "'0' || o_orderkey", "date": "CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END", "net": "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)", "taxCode": "'V5'"}
COLUMNS = [("Header", "Document", "number"), ("Header", "Supplier Site", "site"), ("Header", "Order No", "po"), ("Header", "Location", None), ("Header", "Location Type", None), ("Header", "Document Date", "date"), ("Header", "Total Cost Ex Tax", "net"), ("Header", "Tax Amount", None), ("Tax_Breakdown", "Tax Code", "taxCode"), ("Tax_Breakdown", "Tax Basis", "net")]
PLANNED = (
    "cells AS ("
    + " UNION ALL ".join(f"SELECT o_orderkey AS doc, '{s}' AS sheet, '{c}' AS \"column\", CAST(NULL AS INT) AS line, {NAMED.get(k, 'CAST(NULL AS VARCHAR)')} AS value, '{'verified' if k else 'empty_flagged'}' AS status, 'metric' AS scope FROM orders" for s, c, k in COLUMNS)
    + " UNION ALL SELECT o_orderkey, 'Header', unnest(['Ref No. 1', 'Ref No. 2', 'Ref No. 3', 'Comment']), NULL, NULL, 'empty_owner_rule', 'sheet' FROM orders"
    + " UNION ALL SELECT o_orderkey, unnest(['Header', 'Tax_Breakdown']), 'Transaction Number', NULL, CAST(o_orderkey AS VARCHAR), 'verified', 'sheet' FROM orders"
    + " UNION ALL SELECT doc, 'Details', 'Transaction Number', line, CAST(doc AS VARCHAR), 'verified', 'sheet' FROM l"
    + " UNION ALL SELECT doc, 'Details', unnest(['Item', 'UPC', 'Unit Cost', 'Quantity', 'Unit Tax Code']), line, unnest([CAST(p AS VARCHAR), NULL, '2', '3', NULL]), unnest(['verified', 'empty_owner_rule', CASE WHEN p % 3 = 0 THEN 'mismatch' ELSE 'verified' END, 'verified', 'empty_flagged']), 'metric' FROM l)"
)
LINED = "l AS (SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS line, l_partkey AS p FROM lineitem)"
CHECKS = "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'lines_to_net' ELSE 'template' END AS check, CASE o_orderkey % 3 WHEN 0 THEN 'fail' ELSE 'pass' END AS status, concat('detail ', cast(o_orderkey % 2 as string)) AS detail FROM {orders}"
CHECKED = plain(CHECKS).replace("AS check", 'AS "check"')


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = frame(spark, sf_dir, FIELDS).withColumn("status", F.lit("verified"))
    return G.planned_cells(frame(spark, sf_dir, DOCS), fields, frame(spark, sf_dir, DETAILS))


@R.add("x21_planned_cells", f'WITH {LINED}, {PLANNED} SELECT doc, sheet, "column", line, value, status, scope FROM cells')
def planned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13 cells of the header, 3 of the tax sheet and 6 of each line."""
    return _cells(spark, sf_dir)


@R.add("x20_target_check", f"""WITH {LINED}, {PLANNED}, n AS (SELECT doc, count_if(status = 'verified') AS v, count_if(status = 'empty_owner_rule') AS o, count_if(status = 'empty_flagged') AS e, count_if(status = 'mismatch') AS m FROM cells GROUP BY doc), c AS ({CHECKED})
  SELECT n.doc, 'Target sheet: ' || v || ' verified · ' || o || ' empty by owner rule · ' || e || ' empty (flagged) · ' || m || ' needs checking' || CASE WHEN c.status = 'fail' AND c."check" = 'lines_to_net' THEN ' · lines do not sum to net' ELSE '' END AS summary, m > 0 OR c.status = 'fail' AS holds FROM n JOIN c ON c.doc = n.doc""")
def target_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each invoice's cells and checks in one line, and whether they hold it back."""
    return G.summaries(_cells(spark, sf_dir), frame(spark, sf_dir, CHECKS))


@R.add("h19_target_issues", f"""WITH {LINED}, m AS (SELECT doc, count(*) AS n FROM l WHERE p % 3 = 0 GROUP BY doc), c AS ({CHECKED})
  SELECT doc, 'Target Mismatch' AS code, n || ' cell(s) do not equal the source their evidence points to: Details.Unit Cost' AS message FROM m UNION ALL SELECT doc, 'Target Check', detail FROM c WHERE status = 'fail'""")
def target_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.issues(_cells(spark, sf_dir), frame(spark, sf_dir, CHECKS))


@R.add("h20_checks_rows", f"""WITH {LINED}, {PLANNED}, c AS ({CHECKED}) SELECT doc AS transaction, sheet, "column", CAST(line AS VARCHAR) AS line, value, CASE WHEN status = 'mismatch' THEN 'needs_checking' ELSE status END AS status, status AS detail FROM cells UNION ALL SELECT doc, '(check)', "check", NULL, NULL, status, NULL FROM c""")
def checks_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks sheet."""
    return G.checks_rows(_cells(spark, sf_dir), frame(spark, sf_dir, CHECKS))


@R.add("x22_planned_rows", """SELECT o_orderkey AS doc, CAST(o_orderkey AS INT) AS "Transaction Number", 'N' || o_orderkey AS "Document", CAST(CASE WHEN o_custkey > 0 THEN o_custkey END AS BIGINT) AS "Supplier Site", CAST(NULL AS BIGINT) AS "Order No", CAST(NULL AS BIGINT) AS "Location", CAST(NULL AS VARCHAR) AS "Location Type",
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS "Document Date", CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DECIMAL(18, 4)) AS "Total Cost Ex Tax", CAST(NULL AS DECIMAL(18, 4)) AS "Tax Amount" FROM orders""")
def planned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header sheet, typed as it is written."""
    return G.planned_rows(frame(spark, sf_dir, FIELDS), frame(spark, sf_dir, DOCS)).drop(*G.OWNER_EMPTY)


SHEET = "SELECT cast(o_orderkey as string) AS `Transaction Number`, CASE WHEN o_orderkey % 7 = 0 THEN '=A1' ELSE 'N' END AS `Document`, CASE WHEN o_orderkey % 5 = 0 THEN '012' ELSE '12' END AS `Supplier Site`, '' AS `Order No`, '3' AS `Location`, CASE WHEN o_orderkey % 4 = 0 THEN 'Shop' ELSE 'Store (S)' END AS `Location Type`, CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE '2031-01-02' END AS `Document Date`, CASE WHEN o_orderkey % 3 = 0 THEN '1.234' ELSE '1,000.5' END AS `Total Cost Ex Tax`, CASE WHEN o_orderkey % 8 = 0 THEN 'five' ELSE '' END AS `Tax Amount`, '' AS `Ref No. 1`, '' AS `Ref No. 2`, CASE WHEN o_orderkey % 6 = 0 THEN 'r' END AS `Ref No. 3`, cast(NULL as string) AS `Comment` FROM {orders}"
PROBLEMS = [(7, "Header Document looks like a formula"), (5, "Header Supplier Site is not an owner id"), (4, "Header Location Type is not Store (S) or Warehouse (W)"), (9, "Header Document Date is not a date"), (3, "Header Total Cost Ex Tax has more decimals than the currency"), (8, "Header Tax Amount is not a number"), (6, "Header Ref No. 3 must stay empty")]


@R.add("v34_template_problems", " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, '{p}' AS problem FROM orders WHERE o_orderkey % {n} = 0" for n, p in PROBLEMS))
def template_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written header sheet against the template."""
    own = frame(spark, sf_dir, SHEET)
    assert own.columns == TEMPLATE["Header"]
    return G.template_problems("Header", own, 2)


VIEW = "SELECT event_id AS doc, inline(array(named_struct('key', 'number', 'value', CASE WHEN event_id % 2 = 0 THEN 'N' END, 'kind', 'printed'), named_struct('key', 'site', 'value', 'S', 'kind', CASE WHEN event_id % 3 <> 0 THEN 'sheet' END), named_struct('key', 'market', 'value', '', 'kind', NULL))) FROM {events}"


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.viewed(frame(spark, sf_dir, VIEW), frame(spark, sf_dir, "SELECT event_id AS doc, 'site' AS key, CASE WHEN event_id % 5 = 0 THEN 'T' ELSE ' ' END AS entry FROM {events}"))


VIEWED = """view AS (SELECT event_id AS doc, 'number' AS key, CASE WHEN event_id % 2 = 0 THEN 'N' END AS value, CASE WHEN event_id % 2 = 0 THEN 'printed' END AS kind, event_id % 2 <> 0 AS flagged, CASE WHEN event_id % 2 <> 0 THEN 'Not found' ELSE '' END AS reason FROM events UNION ALL
  SELECT event_id, 'site', CASE WHEN event_id % 3 <> 0 THEN 'S' WHEN event_id % 5 = 0 THEN 'T' END, CASE WHEN event_id % 3 <> 0 THEN 'sheet' WHEN event_id % 5 = 0 THEN 'owner_entry' END, event_id % 3 = 0 AND event_id % 5 <> 0, CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN 'No evidence' ELSE '' END FROM events UNION ALL
  SELECT event_id, 'market', NULL, NULL, TRUE, 'Not found' FROM events)"""


@R.add("x18_rules_view", f"WITH {VIEWED} SELECT doc, key, value, kind, flagged, reason FROM view")
def rules_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value shows only with its evidence."""
    return _view(spark, sf_dir)


RAISED = "SELECT event_id AS doc, concat('K', cast(event_id % 3 as string)) AS kind, event_id % 2 = 0 AS blocking FROM {events} WHERE event_id % 4 < 3"


@R.add("t07_view_issues", f"""WITH {VIEWED}, e AS ({plain(RAISED)}) SELECT doc, 'Missing Evidence' AS code, key AS subject, CASE WHEN key = 'market' THEN 'warning' ELSE 'hard' END AS level FROM view WHERE flagged UNION ALL SELECT doc, kind, '', CASE WHEN blocking THEN 'review' ELSE 'warning' END FROM e""")
def view_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.view_issues(_view(spark, sf_dir), frame(spark, sf_dir, RAISED))


@R.add("h03_accepted_ids", f"SELECT doc, kind || '|' AS accepted FROM ({plain(RAISED)}) WHERE blocking")
def accepted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.accepted_ids(G.view_issues(_view(spark, sf_dir), frame(spark, sf_dir, RAISED))).withColumn("accepted", F.array_join("accepted", ","))


@R.add("h02_extraction_evidence", "SELECT event_id AS doc, 'net' AS key, 'printed' AS kind, CASE WHEN event_id % 4 = 0 THEN 'Invoice (ocr)' ELSE 'Invoice (ai)' END AS source, CASE WHEN event_id % 2 = 0 THEN 'page 3' ELSE 'page not given' END || CASE WHEN event_id % 3 = 0 THEN ' box [0.1, 0.2]' ELSE '' END AS reference, left('total ' || repeat('x', 200), 120) AS original FROM events WHERE event_id % 5 <> 0")
def extraction_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT event_id AS doc, 'net' AS key, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE concat('total ', repeat('x', 200)) END AS quote, CASE WHEN event_id % 2 = 0 THEN 3 END AS page, CASE WHEN event_id % 3 = 0 THEN array('0.1', '0.2') END AS box, CASE WHEN event_id % 4 = 0 THEN 'ocr' END AS source FROM {events}")
    return G.extraction_evidence(own)


R.cases("v28_printed_value", lambda x: printed(x, F.lit("1,250.50")), [("paid 1 250.50 net", None), ("is 1250.5 net", True), ("nothing", False), ("  ", None)][1:], "BOOLEAN")
