"""Queries for joins, aggregates, windows, search, orders, balances and checks.

The driver's tables stand in for invoices: an order is an invoice and its line items are the invoice's lines; a part
is an item of the master; line items with their order's customer are the receipts report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import catalog as C
from ..operators import check as K
from ..operators import ledger as L
from ..operators import match as M
from ..operators import pages as P
from .registry import Registry, read

R = Registry()

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
LINES = f"""lines AS (SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS INT) AS line, l_partkey, l_suppkey,
  CAST(l_quantity AS DECIMAL(18, 2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount, l_linestatus, CAST(l_shipdate AS DATE) AS ship,
  CASE WHEN l_partkey % 7 <> 0 THEN 'ULT_' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') END AS gtin,
  CASE WHEN l_partkey % 7 = 0 AND l_partkey % 3 <> 0 THEN lpad(CAST(l_partkey AS VARCHAR), 6, '0') END AS sku FROM lineitem)"""
KEY = "'C' || lpad(CAST(o_custkey AS VARCHAR), 5, '0')"
PO = f"""po AS (SELECT {KEY} AS key, o.o_orderkey AS "order", (CASE WHEN o_custkey % 2 = 0 THEN '380' ELSE '800' END) || lpad(CAST(o_custkey % 50 AS VARCHAR), 3, '0') AS location,
  l_partkey AS item, CAST(l_quantity AS DECIMAL(18, 2)) AS ordered, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18, 2)) END AS received,
  CAST(l_extendedprice AS DECIMAL(18, 2)) AS cost, CASE o_custkey % 3 WHEN 0 THEN 'KWD' WHEN 1 THEN 'AED' ELSE 'USD' END AS currency
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey)"""
GROUPS = """groups AS (SELECT key, "order", location, sum(received) AS received, CASE WHEN count_if(received IS NOT NULL AND cost IS NULL) = 0 THEN sum(cost) FILTER (received IS NOT NULL) END AS cost,
  array_to_string(list_sort(list(DISTINCT item)), ',') AS items, array_to_string(list_sort(list(DISTINCT currency)), ',') AS currencies, sum(ordered) AS ordered, count(*) AS rows FROM po GROUP BY ALL)"""


def part_number(key: Column) -> Column:
    """A key as a part number: six characters, more where it has more than five digits. It begins with a zero and loses no digit."""
    return F.lpad(key, F.greatest(F.lit(6), F.length(key) + 1), F.lit("0"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))
    part = F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(own).alias("line"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), "l_linestatus", F.to_date("l_shipdate").alias("ship"),
        F.when(part % 7 != 0, F.concat(F.lit("ULT_"), F.lpad(part.cast("string"), 12, "0"))).alias("gtin"), F.when((part % 7 == 0) & (part % 3 != 0), part_number(part.cast("string"))).alias("sku"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    code = T.strip_prefix(F.concat(F.lit("ULT_"), F.lpad(key, 12, "0")))
    return read(spark, sf_dir, "part").select(code.alias("item_code"), part_number(key).alias("vpn"), key.alias("parent"), F.col("p_brand").alias("supplier"), F.col("p_name").alias("item_desc"), F.col("p_partkey").alias("item"))


def po_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, own = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    customer = F.col("o_custkey")
    return orders.join(own, orders.o_orderkey == own.l_orderkey).select(
        F.concat(F.lit("C"), F.lpad(customer.cast("string"), 5, "0")).alias("key"), F.col("o_orderkey").alias("order"),
        F.concat(F.when(customer % 2 == 0, "380").otherwise("800"), F.lpad((customer % 50).cast("string"), 3, "0")).alias("location"), F.col("l_partkey").alias("item"),
        F.col("l_quantity").cast("decimal(18,2)").alias("ordered"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("decimal(18,2)")).alias("received"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"), F.when(customer % 3 == 0, "KWD").when(customer % 3 == 1, "AED").otherwise("USD").alias("currency"),
    )


@R.add("j07_match_lines", f"""WITH {LINES} SELECT doc, line, CASE WHEN p_partkey IS NOT NULL AND (gtin IS NOT NULL OR sku IS NOT NULL) THEN CAST(p_partkey AS VARCHAR) END AS parent,
  CASE WHEN p_partkey IS NULL THEN NULL WHEN gtin IS NOT NULL THEN 'Barcode exact' WHEN sku IS NOT NULL THEN 'VPN exact' END AS method,
  CASE WHEN p_partkey IS NULL OR (gtin IS NULL AND sku IS NULL) THEN 'Item Exception' ELSE 'Matched' END AS status FROM lines LEFT JOIN part ON l_partkey = p_partkey""")
def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_lines(lines(spark, sf_dir), items(spark, sf_dir), ["doc", "line"]).select("doc", "line", "parent", "method", "status")


@R.add("a04_order_groups", f'WITH {PO}, {GROUPS} SELECT key, "order", location, received::DECIMAL(38, 2) AS received, cost::DECIMAL(38, 2) AS cost, items, currencies, ordered::DECIMAL(38, 2) AS ordered, rows FROM groups')
def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.order_groups(po_rows(spark, sf_dir)).withColumn("items", F.array_join("items", ",")).withColumn("currencies", F.array_join("currencies", ","))


INVOICES = f"""invoices AS (SELECT o_orderkey AS doc, {KEY} AS key, q AS quantity, v AS value, CASE o_custkey % 3 WHEN 0 THEN 'KWD' WHEN 1 THEN 'AED' ELSE 'USD' END AS invoice_currency,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey WHEN o_orderkey % 5 = 1 THEN o_orderkey + 1 END AS printed_order
  FROM orders JOIN (SELECT doc, sum(quantity) FILTER (l_linestatus = 'F') AS q, sum(amount) FILTER (l_linestatus = 'F') AS v FROM lines GROUP BY doc) ON doc = o_orderkey)"""
SELECTED = """tried AS (SELECT doc, g."order", printed_order, coalesce(CASE WHEN printed_order IS NOT NULL THEN g."order" = printed_order
    ELSE g.received = i.quantity AND abs(i.value - g.cost) <= CASE invoice_currency WHEN 'KWD' THEN 1 WHEN 'AED' THEN 2 ELSE 0 END END, FALSE) AS passed FROM invoices i LEFT JOIN groups g USING (key)),
  selected AS (SELECT doc, CASE WHEN count_if(passed) = 1 THEN min("order") FILTER (passed) END AS "order",
    CASE WHEN count_if(passed) = 1 THEN 'selected' WHEN count_if(passed) > 1 THEN 'ambiguous' WHEN bool_or(printed_order IS NOT NULL) THEN 'printed order unknown' ELSE 'missing' END AS status,
    count("order") AS candidates, CAST(count_if(passed) AS BIGINT) AS passed FROM tried GROUP BY doc)"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = lines(spark, sf_dir).where("l_linestatus = 'F'").groupBy("doc").agg(F.sum("quantity").alias("quantity"), F.sum("amount").alias("value"))
    billed = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc")).distinct()
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").withColumn("doc", order).join(billed, "doc", "left_semi").join(sums, "doc", "left").select(
        "doc", F.concat(F.lit("C"), F.lpad(customer.cast("string"), 5, "0")).alias("key"), "quantity", "value", F.when(customer % 3 == 0, "KWD").when(customer % 3 == 1, "AED").otherwise("USD").alias("invoice_currency"),
        F.when(order % 5 == 0, order).when(order % 5 == 1, order + 1).alias("printed_order"),
    )


@R.add("x09_order_resolution", f'WITH {LINES}, {PO}, {GROUPS}, {INVOICES}, {SELECTED} SELECT doc, "order", status, candidates, passed FROM selected')
def order_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select_orders(invoices(spark, sf_dir), M.order_groups(po_rows(spark, sf_dir)).drop("items", "currencies"))


@R.add("x15_invoice_status", f"""WITH {LINES}, {PO}, {GROUPS}, {INVOICES}, {SELECTED},
  matched AS (SELECT doc, count(*) AS n, CAST(count_if(p_partkey IS NOT NULL AND (gtin IS NOT NULL OR sku IS NOT NULL)) AS BIGINT) AS matched FROM lines LEFT JOIN part ON l_partkey = p_partkey GROUP BY doc)
  SELECT o_orderkey AS doc, s."order", coalesce(n, 0) AS lines, coalesce(matched, 0) AS matched,
    CASE WHEN coalesce(n, 0) = 0 THEN 'Blocked' WHEN s."order" IS NOT NULL AND n = matched THEN 'Approved' ELSE 'Review' END AS status
  FROM orders LEFT JOIN matched m ON m.doc = o_orderkey LEFT JOIN selected s ON s.doc = o_orderkey""")
def invoice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_lines(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("lines"), F.count_if(F.col("status") == "Matched").alias("matched"))
    chosen = order_resolution(spark, sf_dir).select("doc", "order")
    headers = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc")).join(found, "doc", "left").join(chosen, "doc", "left")
    ready = headers.select("doc", "order", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("matched", F.lit(0)).alias("matched"), F.lit(0).alias("exceptions"))
    return M.invoice_status(ready, ["order"]).drop("exceptions")


@R.add("a01_unique_or_null", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS priority, count(DISTINCT o_orderpriority) AS candidates FROM orders GROUP BY o_custkey")
def unique_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.unique_or_null(F.col("o_orderpriority"), F.col("o_orderkey")).alias("priority"), F.count_distinct("o_orderpriority").alias("candidates"))


@R.add("a02_distinct_parents", "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parents FROM lineitem GROUP BY l_suppkey")
def distinct_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("parents"))


@R.add("a05_locations_of_order", f'WITH {PO} SELECT "order", count(DISTINCT location) AS locations FROM po GROUP BY "order"')
def locations_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po_rows(spark, sf_dir).groupBy("order").agg(F.count_distinct("location").alias("locations"))


@R.add("a08_received_nothing", f'WITH {PO} SELECT key, "order" FROM po GROUP BY key, "order" HAVING count(received) = 0 AND bool_and(ordered > 0)')
def received_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po_rows(spark, sf_dir).groupBy("key", "order").agg(F.count("received").alias("n"), F.bool_and(F.col("ordered") > 0).alias("all")).where("n = 0 and all").select("key", "order")


@R.add("a09_resolved_share", f"""WITH {LINES} SELECT doc, count(*) AS lines, CAST(count_if(gtin IS NOT NULL) AS BIGINT) AS resolved_lines,
  round_even(CAST(count_if(gtin IS NOT NULL) AS DECIMAL(18, 8)) / count(*), 4)::DECIMAL(18, 4) AS share, round_even(CAST(count_if(gtin IS NOT NULL) AS DECIMAL(18, 8)) / count(*), 4) >= 0.95 AS enough FROM lines GROUP BY doc""")
def resolved_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resolved_share(lines(spark, sf_dir).withColumn("resolved", F.col("gtin").isNotNull())).withColumn("share", F.col("share").cast("decimal(18,4)"))


@R.add("a10_complete_sum", f"WITH {PO} SELECT item, CASE WHEN count(*) = count(received) THEN sum(received) END::DECIMAL(38, 2) AS quantity FROM po GROUP BY item")
def complete_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po_rows(spark, sf_dir).groupBy("item").agg(A.complete_sum(F.col("received")).cast("decimal(38,2)").alias("quantity"))


@R.add("a12_accepted_receipts", "SELECT l_orderkey || '|' || l_partkey AS key, coalesce(sum(CAST(l_quantity AS DECIMAL(18, 2))) FILTER (l_returnflag <> 'R'), 0)::DECIMAL(38, 2) AS received FROM lineitem GROUP BY 1")
def accepted_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_partkey").alias("key"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("status"))
    return L.accepted(rows).withColumn("received", F.col("received").cast("decimal(38,2)"))


@R.add("a13_ledger_use", "SELECT l_orderkey || '|' || l_partkey AS key, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DECIMAL(38, 2) AS used FROM lineitem GROUP BY 1")
def ledger_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.concat_ws("|", "l_orderkey", "l_partkey").alias("key"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    receipts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(entry).alias("allocations"))
    return L.allocations(receipts).withColumn("used", F.col("used").cast("decimal(38,2)"))


@R.add("w02_running_balance", f"""WITH {LINES}, held AS (SELECT l_partkey AS key, sum(CAST(l_quantity AS DECIMAL(18, 2))) FILTER (l_returnflag <> 'R') AS received FROM lineitem GROUP BY 1)
  SELECT doc, line, needed::DECIMAL(38, 2) AS needed, coalesce(needed > coalesce(received, 0) - 5 - 0, FALSE) AS over_received FROM
  (SELECT doc, line, l_partkey, sum(quantity) OVER (PARTITION BY l_partkey ORDER BY doc, line) AS needed FROM lines) JOIN held ON key = l_partkey""")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("status"))
    order_lines = rows.select("key").distinct().select("key", F.lit(10**6).cast("decimal(18,2)").alias("ordered"), F.lit(5).cast("decimal(18,2)").alias("invoiced"))
    none = rows.limit(0).select("key", F.col("qty").alias("used"))
    asked = lines(spark, sf_dir).select("doc", "line", F.col("l_partkey").alias("key"), F.col("quantity").alias("qty"))
    return L.balances(asked, order_lines, L.accepted(rows), none, ["doc", "line"], ["key"]).select("doc", "line", F.col("needed").cast("decimal(38,2)").alias("needed"), "over_received")


def _unit_cost() -> Column:
    return (F.floor(F.col("amount") * 1000 / F.col("quantity")) * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,3)")


@R.add("a15_lines_to_net", f"""WITH {LINES}, s AS (SELECT doc, round(sum(quantity * CAST(CAST(floor(amount * 1000 / quantity) AS DECIMAL(15, 0)) * 0.001 AS DECIMAL(18, 3))), 2) AS exact, sum(round(quantity * CAST(CAST(floor(amount * 1000 / quantity) AS DECIMAL(15, 0)) * 0.001 AS DECIMAL(18, 3)), 2)) AS rounded, sum(amount) AS net, count(*) AS n FROM lines GROUP BY doc)
  SELECT doc, exact::DECIMAL(38, 2) AS exact, rounded::DECIMAL(38, 2) AS rounded, net::DECIMAL(38, 2) AS net, CASE WHEN exact = net OR rounded = net THEN 'pass' WHEN abs(exact - net) <= n * 0.01 THEN 'warning' ELSE 'fail' END AS status FROM s""")
def lines_to_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    cells = own.select("doc", "quantity", _unit_cost().alias("cost"))
    found = K.lines_to_net(cells, own.groupBy("doc").agg(F.sum("amount").alias("net")))
    return found.select("doc", *[F.col(c).cast("decimal(38,2)").alias(c) for c in ("exact", "rounded", "net")], "status")


STATUS = "CASE event_id % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'empty_owner_rule' WHEN 2 THEN 'empty_flagged' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'data_gap' ELSE 'verified' END"


@R.add("a17_status_counts", f"""SELECT user_id, CAST(count_if(s = 'verified') AS BIGINT) AS verified, CAST(count_if(s = 'empty_owner_rule') AS BIGINT) AS empty_owner_rule, CAST(count_if(s = 'empty_flagged') AS BIGINT) AS empty_flagged,
  CAST(count_if(s NOT IN ('verified', 'empty_owner_rule', 'empty_flagged')) AS BIGINT) AS needs_checking, count(*) AS cells FROM (SELECT user_id, {STATUS} AS s FROM events) GROUP BY user_id""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.status_counts(read(spark, sf_dir, "events").select("user_id", F.expr(STATUS).alias("status")), ["user_id"])


@R.add("a20_accuracy", f"""WITH r AS (SELECT CAST(ts AS TIMESTAMP) AS seen, CAST(user_id % 9 AS VARCHAR) AS supplier, event_type AS field, {STATUS} AS status, event_id % 11 = 0 AS missing, value > 50 AS changed FROM events),
  n AS (SELECT max(seen) AS now FROM r), p AS (SELECT * FROM (VALUES ('7d', 7), ('30d', 30), ('all', NULL)) AS v(period, days)),
  t AS (SELECT period, r.* FROM r, n, p WHERE days IS NULL OR seen >= now - to_days(days)),
  g AS (SELECT period, 'status' AS "grouping", status AS name, changed FROM t UNION ALL SELECT period, 'overall', '', changed FROM t WHERE NOT missing
    UNION ALL SELECT period, 'field', field, changed FROM t WHERE NOT missing UNION ALL SELECT period, 'supplier', supplier, changed FROM t WHERE NOT missing)
  SELECT period, "grouping", name, count(*) AS cells, CAST(count_if(changed) AS BIGINT) AS changed, round((count(*) - count_if(changed)) / count(*), 4) AS accuracy FROM g GROUP BY ALL""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    records = events.select("at", (F.col("user_id") % 9).cast("string").alias("supplier"), F.col("event_type").alias("field"), F.expr(STATUS).alias("status"), (F.col("event_id") % 11 == 0).alias("missing"), (F.col("value") > 50).alias("changed"))
    latest = events.agg(F.max("at").alias("now"))
    return L.accuracy(records.join(F.broadcast(latest)), F.col("now"))


@R.add("a21_catalog_counts", "SELECT 'item' AS kind, count(*) AS rows FROM part UNION ALL SELECT 'po', count(*) FROM lineitem")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "part").select(F.lit("item").alias("kind")).unionByName(read(spark, sf_dir, "lineitem").select(F.lit("po").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("rows"))


@R.add("a26_digit_runs", "SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\d+')) AS run FROM documents) GROUP BY run")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


@R.add("a31_listed_references", """SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_orderkey::VARCHAR))[1:20], ', ') || CASE WHEN count(DISTINCT l_orderkey) > 20 THEN ' (+' || (count(DISTINCT l_orderkey) - 20) || ')' ELSE '' END AS refs
  FROM lineitem GROUP BY l_suppkey""")
def listed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(A.listed(F.collect_set(F.col("l_orderkey").cast("string"))).alias("refs"))


@R.add("a33_median", "SELECT l_suppkey, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_suppkey")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.5).alias("median"))


@R.add("a37_receipt_distance", """SELECT o_orderkey, min(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))))::INT AS nearest, min(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))) > 30 AS far
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def receipt_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, own = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    nearest = F.min(F.abs(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))))
    return o.join(own, o.o_orderkey == own.l_orderkey).groupBy("o_orderkey").agg(nearest.alias("nearest")).withColumn("far", F.col("nearest") > 30)


@R.add("j03_shared_identity", "SELECT DISTINCT p_partkey FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def shared_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    held = read(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey").join(held, "p_partkey", "left_semi")


@R.add("j04_order_context", """SELECT l_partkey, l_orderkey, n FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) WHERE n <= 21""")
def order_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("l_partkey").orderBy("l_orderkey")
    return read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct().withColumn("n", F.row_number().over(own)).where("n <= 21")


@R.add("j10_description_candidates", """WITH q AS (SELECT s_suppkey, list_distinct(regexp_extract_all(lower(d), '[a-z0-9]+')) AS w FROM (SELECT s_suppkey, p_name || ' new' AS d FROM supplier JOIN part ON p_partkey = s_suppkey * 3)),
  i AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS parent, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS v FROM part),
  s AS (SELECT s_suppkey, parent, round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 3) AS score FROM q JOIN i ON list_has_any(w, v))
  SELECT s_suppkey, parent, score, rank FROM (SELECT s_suppkey, parent, score, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, parent DESC) AS INT) AS rank FROM s) WHERE rank <= 5""")
def description_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("item")).join(items(spark, sf_dir), "item").select("s_suppkey", F.concat("item_desc", F.lit(" new")).alias("description"))
    return M.description_candidates(asked, items(spark, sf_dir), ["s_suppkey"])


@R.add("j11_soft_constraint", """WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_suppkey % 10 = l_orderkey % 10 AS inside FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem))
  SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, bool_or(inside) OVER (PARTITION BY l_orderkey) AS any_inside FROM m) WHERE inside OR NOT any_inside""")
def soft_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return A.keep_or_fall_back(own, ["l_orderkey"], F.col("l_suppkey") % 10 == F.col("l_orderkey") % 10)


LOCATION = "(CASE WHEN c_custkey % 3 = 0 THEN '380' WHEN c_custkey % 3 = 1 THEN '800' ELSE '999' END) || lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0')"


@R.add("j17_location_type", f"""WITH m AS (SELECT DISTINCT ON (location) {LOCATION} AS location, CASE WHEN c_custkey % 40 < 10 THEN 'Store (S)' WHEN c_custkey % 40 < 20 THEN 'Warehouse (W)' END AS type FROM customer WHERE c_custkey % 40 < 20)
  SELECT c_custkey, coalesce(m.type, p) AS type, m.type IS NOT NULL AND p IS NOT NULL AND m.type <> p AS conflict FROM
  (SELECT c_custkey, {LOCATION} AS location, CASE WHEN c_custkey % 3 = 0 THEN 'Store (S)' WHEN c_custkey % 3 = 1 THEN 'Warehouse (W)' END AS p FROM customer) c LEFT JOIN m USING (location)""")
def location_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    placed = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(key % 3 == 0, "380").when(key % 3 == 1, "800").otherwise("999"), F.lpad((key % 40).cast("string"), 3, "0")).alias("location"))
    master = placed.where("c_custkey % 40 < 20").select("location", F.when(key % 40 < 10, "Store (S)").otherwise("Warehouse (W)").alias("type")).distinct()
    prefix = F.when(F.startswith("location", F.lit("380")), "Store (S)").when(F.startswith("location", F.lit("800")), "Warehouse (W)")
    joined = placed.join(master, "location", "left")
    return joined.select("c_custkey", F.coalesce("type", prefix).alias("type"), (F.col("type").isNotNull() & prefix.isNotNull() & ~F.col("type").eqNullSafe(prefix)).alias("conflict"))


@R.add("j19_currency", """SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 4 <> 0 THEN r_name || '-cur' END, c_mktsegment) AS currency, CASE WHEN c_nationkey % 4 <> 0 THEN 'site and market' ELSE 'site' END AS source
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    governed = nation.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.concat("r_name", F.lit("-cur")).alias("by_market"))
    joined = read(spark, sf_dir, "customer").join(F.broadcast(governed), "c_nationkey", "left")
    return joined.select("c_custkey", F.coalesce("by_market", "c_mktsegment").alias("currency"), F.when(F.col("by_market").isNotNull(), "site and market").otherwise("site").alias("source"))


@R.add("j22_foreign_keys", "SELECT 'order without customer' AS problem, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) UNION ALL SELECT 'line without part', l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"))
    parts = read(spark, sf_dir, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"))
    orders = read(spark, sf_dir, "orders").join(customers, "o_custkey", "left_anti").select(F.lit("order without customer").alias("problem"), F.col("o_orderkey").alias("id"))
    return orders.unionByName(read(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left_anti").select(F.lit("line without part").alias("problem"), F.col("l_orderkey").alias("id")))


@R.add("j23_sheet_joins", """WITH h AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 1), t AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0), d AS (SELECT l_orderkey AS k FROM lineitem)
  SELECT 'repeated header' AS problem, k FROM h GROUP BY k HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'orphan tax row', k FROM t WHERE k NOT IN (SELECT k FROM h) UNION ALL SELECT DISTINCT 'orphan detail', k FROM d WHERE k NOT IN (SELECT k FROM h)
  UNION ALL SELECT DISTINCT 'header without tax rows', k FROM h WHERE k NOT IN (SELECT k FROM t) UNION ALL SELECT DISTINCT 'header without details', k FROM h WHERE k NOT IN (SELECT k FROM d)""")
def sheet_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    header = orders.where("k % 9 <> 0").unionByName(orders.where("k % 50 = 1"))
    return K.sheet_joins(header, orders.where("k % 4 <> 0"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@R.add("j25_confirmations", """WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS before FROM orders WHERE o_orderkey % 10 <> 0), f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS after FROM orders WHERE o_orderkey % 10 <> 1)
  SELECT k, before, after, before IS DISTINCT FROM after AS changed FROM s FULL JOIN f USING (k)""")
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("value"))
    return L.confirmations(orders.where("k % 10 <> 0"), orders.where("k % 10 <> 1").withColumn("value", F.when(F.col("k") % 3 == 0, "Z").otherwise(F.col("value"))), ["k"])


@R.add("t03_missing_items", f"""WITH {LINES}, o AS (SELECT DISTINCT doc, l_partkey FROM lines WHERE l_linestatus = 'F'), w AS (SELECT DISTINCT doc, l_partkey FROM lines)
  SELECT w.doc, w.doc AS "order", coalesce(array_to_string(list_sort(list(w.l_partkey) FILTER (o.doc IS NULL)), ','), '') AS missing FROM w LEFT JOIN o ON w.doc = o.doc AND w.l_partkey = o.l_partkey GROUP BY w.doc""")
def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    wanted = own.select("doc", F.col("doc").alias("order"), F.col("l_partkey").alias("item"))
    held = own.where("l_linestatus = 'F'").select(F.col("doc").alias("order"), F.col("l_partkey").alias("item"))
    return M.missing_items(wanted, held).withColumn("missing", F.array_join("missing", ","))


@R.add("t04_declared_sources", "SELECT k, side FROM (SELECT 'seen' AS side, k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) UNION ALL SELECT 'declared', k FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0 EXCEPT SELECT o_custkey FROM orders))")
def declared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, declared = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k"))
    return seen.subtract(declared).withColumn("side", F.lit("seen")).unionByName(declared.subtract(seen).withColumn("side", F.lit("declared")))


@R.add("w04_transaction_numbers", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS transaction FROM orders")
def transaction_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("transaction"))


@R.add("w05_repeated_documents", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def repeated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeated(read(spark, sf_dir, "documents"), "doc_id", "text")


@R.add("w09_last_five", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5")
def last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_of_each(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey")


@R.add("w16_latest_revision", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@R.add("w08_next_line", "SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events")
def next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_value"))


CATALOG = """cells AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'item' AS kind, p_name AS description, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS sku, p_brand AS supplier FROM part),
  terms AS (SELECT DISTINCT kind, id, unnest(list_concat(['i:' || sku, 'x:sku:' || sku, 'n:' || n], list_transform(list_filter(string_split(n, ' '), lambda w: length(w) >= 2), lambda w: 't:' || w), ['f:supplier:' || s])) AS term
    FROM (SELECT *, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(supplier), '[^a-z0-9]+', ' ', 'g')) AS s FROM cells))"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.array(c.cast("string"))
    key = F.col("p_partkey").cast("string")
    data = F.create_map(F.lit("Item description"), cell(F.col("p_name")), F.lit("SKU"), cell(F.lpad(key, 6, "0")), F.lit("Supplier"), cell(F.col("p_brand")), F.lit("Colour"), cell(F.col("p_type")))
    return read(spark, sf_dir, "part").select(key.alias("id"), F.lit("item").alias("kind"), data.alias("data"))


@R.add("c03_terms", f"WITH {CATALOG} SELECT kind, term, id FROM terms")
def catalog_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.terms(C.roles_of(catalog(spark, sf_dir)))


@R.add("c02_roles", """SELECT CAST(p_partkey AS VARCHAR) AS id, 'item' AS kind, unnest(['description', 'sku', 'supplier']) AS role, unnest(['Item description', 'SKU', 'Supplier']) AS "column", unnest([p_name, lpad(CAST(p_partkey AS VARCHAR), 6, '0'), p_brand]) AS value FROM part""")
def catalog_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.roles_of(catalog(spark, sf_dir))


@R.add("c04_record_ids", "SELECT p_partkey, sha256('h1' || chr(0) || p_brand || chr(0) || CAST(p_partkey AS VARCHAR)) AS id FROM part")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", C.record_id(F.lit("h1"), F.col("p_brand"), F.col("p_partkey")).alias("id"))


def _query(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, str]]:
    """The search of the example: the first part's own name."""
    name = read(spark, sf_dir, "part").orderBy("p_partkey").select(T.normalize_name(F.col("p_name")).alias("n")).first()[0]
    return C.search_terms(name, name)


ASKED = """q AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM part ORDER BY p_partkey LIMIT 1),
  asked AS (SELECT 'i:' || replace(n, ' ', '') AS term, 100000 AS score, 'max' AS way FROM q UNION ALL SELECT 'n:' || n, 90000, 'max' FROM q UNION ALL SELECT DISTINCT 't:' || w, 1000, 'sum' FROM (SELECT unnest(string_split(n, ' ')) AS w FROM q) WHERE length(w) >= 2),
  scored AS (SELECT id, CAST(coalesce(max(score) FILTER (way = 'max'), 0) + sum(CASE WHEN way = 'sum' THEN score ELSE 500 END) AS BIGINT) AS score FROM terms JOIN asked USING (term) GROUP BY id)"""


@R.add("s01_ranked_search", f"WITH {CATALOG}, {ASKED} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(C.search(catalog_terms(spark, sf_dir), "item", _query(spark, sf_dir)), 20)


@R.add("s02_next_page", f"WITH {CATALOG}, {ASKED}, ranked AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS n FROM scored) SELECT id, score FROM ranked WHERE n BETWEEN 11 AND 20")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = C.search(catalog_terms(spark, sf_dir), "item", _query(spark, sf_dir))
    last = C.page(scored, 10).orderBy("score", F.desc("id")).first()
    return C.page(scored, 10, (last.score, last.id) if last else None)


@R.add("s03_inbox", "SELECT o_orderkey, added FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS added FROM orders) ORDER BY added DESC NULLS LAST, o_orderkey LIMIT 200")
def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("added")).orderBy(F.desc_nulls_last("added"), "o_orderkey").limit(200)


@R.add("v03_reconcile", "SELECT o_orderstatus AS source_hash, o_orderpriority AS kind, CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3') THEN CAST(7 AS BIGINT) END AS expected, count(*) AS found FROM orders GROUP BY 1, 2 HAVING count(*) IS DISTINCT FROM CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3') THEN 7 END")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source_hash"), F.col("o_orderpriority").alias("kind"))
    expected = rows.where(F.left("kind", F.lit(1)).isin("1", "2", "3")).distinct().withColumn("count", F.lit(7).cast("bigint"))
    return C.reconcile(rows, expected).select("source_hash", "kind", "expected", "found")


@R.add("v04_duplicate_sources", "SELECT 'h' AS source_hash, l_orderkey AS sheet, l_linenumber AS row_number, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_sources(read(spark, sf_dir, "lineitem").select(F.lit("h").alias("source_hash"), F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row_number")))


SHIFT = "CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
ITEM9 = "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN '12' ELSE lpad(CAST(o_orderkey AS STRING), 9, '0') END"


@R.add("v08_shifted_rows", f"SELECT o_orderkey, o_orderkey % 6 = 0 OR o_orderkey % 5 IN (0, 1) AS shifted, o_orderkey % 6 = 0 OR o_orderkey % 5 = 1 AS malformed FROM orders")
def shifted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", K.shifted(F.expr(SHIFT), F.expr(ITEM9)).alias("shifted"), K.malformed(F.expr(SHIFT), F.expr(ITEM9)).alias("malformed"))


@R.add("v16_completeness", "SELECT o_orderkey, CASE WHEN m > 0 THEN least(s, 0.99) ELSE s END::DECIMAL(10, 2) AS score FROM (SELECT o_orderkey, o_orderkey % 5 AS m, round(greatest(0, 1 - CAST(o_orderkey % 5 AS DECIMAL(18, 8)) / (6 + 4 * (o_custkey % 7))), 2) AS s FROM orders)")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", K.completeness(F.col("o_orderkey") % 5, F.col("o_custkey") % 7).cast("decimal(10,2)").alias("score"))


@R.add("v24_inclusive_vat", f"""WITH {LINES}, t AS (SELECT doc, line, amount AS net, CASE l_partkey % 3 WHEN 0 THEN round(amount * 5 / 105, 2) WHEN 1 THEN round(amount * 5 / 100, 2) ELSE CAST(0.37 AS DECIMAL(18, 2)) END AS tax FROM lines)
  SELECT doc, line, net > 0 AND tax > 0 AND tax < net AND len(list_filter(range(1, 31), lambda r: abs(net * r / (100 + r) - tax) <= 0.01)) > 0 AND len(list_filter(range(1, 31), lambda r: abs(net * r / 100 - tax) <= 0.01)) = 0 AS inclusive FROM t""")
def inclusive_vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("amount")
    tax = F.when(F.col("l_partkey") % 3 == 0, F.round(net * 5 / 105, 2)).when(F.col("l_partkey") % 3 == 1, F.round(net * 5 / 100, 2)).otherwise(F.lit("0.37").cast("decimal(18,2)")).cast("decimal(18,2)")
    return lines(spark, sf_dir).select("doc", "line", K.inclusive_vat(net, tax).alias("inclusive"))


@R.add("v28_printed_evidence", r"SELECT doc_id, contains(lower(regexp_replace(text, '\s+', '', 'g')), 'licensedundertheapache') AS printed FROM documents WHERE trim(text) <> ''")
def printed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", K.printed(F.col("text"), F.lit("Licensed under the Apache")).alias("printed"))


@R.add("v02_reference_integrity", "SELECT 'repeated line' AS problem, l_orderkey || '.' || l_linenumber AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'quantity out of range', l_orderkey || '.' || l_linenumber FROM lineitem WHERE l_quantity > 49")
def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"), "l_quantity")
    repeated = own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated line").alias("problem"), "id")
    return repeated.unionByName(own.where("l_quantity > 49").select(F.lit("quantity out of range").alias("problem"), "id"))


@R.add("k13_typed_cells", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS number, CASE WHEN o_orderkey % 3 = 0 THEN '0' || o_orderkey END AS text FROM orders WHERE o_orderkey > 0")
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("0"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    number, text = K.typed_identifier(value)
    return read(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", number.alias("number"), text.alias("text"))


@R.add("k05_details_sheet", f"WITH {LINES} SELECT doc AS transaction_number, line, CAST(l_partkey AS VARCHAR) AS item, CAST(CAST(floor(amount * 1000 / quantity) AS DECIMAL(15, 0)) * 0.001 AS DECIMAL(18, 3)) AS unit_cost, quantity FROM lines")
def details_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("doc").alias("transaction_number"), "line", F.col("l_partkey").cast("string").alias("item"), _unit_cost().alias("unit_cost"), "quantity")


@R.add("x18_unpivoted_view", """SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) AS field, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS value FROM orders""")
def unpivoted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unpivot(read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_custkey"])


PAGE = "CASE WHEN event_id % 4 = 0 THEN 'Tax Invoice No: INV-' || CAST(user_id AS STRING) || '7' WHEN event_id % 4 = 1 THEN 'Page 1 of 3' WHEN event_id % 4 = 2 THEN 'Invoice Date 2031-01-02' ELSE 'Page: 2/3' END"


@R.add("e16_page_numbers", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'INV-' || CAST(user_id AS VARCHAR) || '7' ELSE '' END AS numbers, CASE event_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 END AS page FROM events")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(PAGE)
    return read(spark, sf_dir, "events").select("event_id", F.array_join(P.page_numbers(text), ",").alias("numbers"), P.page_counter(text)["page"].alias("page"))


@R.add("r11_normal_boxes", """SELECT event_id AS doc, least(value, 50) AS x0, greatest(value, 50) AS x1, CASE WHEN event_id % 2 = 0 THEN 800 - (value + 20) ELSE value + 10 END AS top, CASE WHEN event_id % 2 = 0 THEN 800 - (value + 10) ELSE value + 20 END AS bottom
  FROM events WHERE value <> 50 AND user_id % 22 BETWEEN 1 AND 20""")
def normal_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc"), (F.col("user_id") % 22).cast("int").alias("page"), F.lit("w").alias("text"), F.col("value").alias("x0"), F.lit(50.0).alias("x1"), (F.col("value") + 20).alias("top"),
        (F.col("value") + 10).alias("bottom"), F.when(F.col("event_id") % 2 == 0, "bottom-left").otherwise("top-left").alias("origin"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"),
    )
    return P.normal_boxes(words).select("doc", "x0", "x1", "top", "bottom")


@R.add("w01_page_segments")
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pages = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.row_number().over(own).alias("page_no"), F.expr(PAGE).alias("text"))
    return P.segments(pages)


@R.add("w11_word_rows")
def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.col("event_type").alias("text"), (F.col("event_id") % 50).cast("double").alias("x0"), F.col("value").alias("top"), (F.col("value") + 10).alias("bottom"))
    return P.rows_of_words(words)


def _in_order(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


@R.add("x29_tombstones", """WITH gone AS (SELECT o_custkey % 100 AS invoice_key, o_orderkey FROM orders WHERE o_orderkey % 10 = 0) SELECT CAST(invoice_key AS VARCHAR) AS invoice_key, array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR) || ':1')), ',') AS allocations FROM gone GROUP BY invoice_key""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("string").alias("invoice_key"), F.array(F.struct(F.col("o_orderkey").cast("string").alias("key"), F.lit(1).cast("decimal(18,0)").alias("qty"))).alias("allocations"))
    _, merged = L.delete_invoices(exports, exports.limit(0), exports.where("id % 10 = 0"))
    return merged.select("invoice_key", _in_order(F.transform("allocations", lambda a: F.concat_ws(":", a["key"], a["qty"].cast("string")))).alias("allocations"))
