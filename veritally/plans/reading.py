"""Queries for read quality, merging, evidence, accuracy helpers and queue state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import check as K
from ..operators import fuzzy as Z
from ..operators import ledger as L
from ..operators import pages as P
from ..operators import reading as Q
from ..streaming import jobs as J
from .registry import Registry, frame, plain, read
from .relational import LINES, ORDER, lines

R = Registry()

SHORT = "o_orderkey % 4 = 0"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        order.alias("doc"), F.when(order % 3 != 0, order.cast("string")).alias("number"), F.when(order % 5 != 0, F.to_date("o_orderdate")).alias("date"), F.when(order % 2 == 0, F.lit("P")).alias("po"),
        F.when(order % 7 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("net"), F.lit(None).cast("decimal(18,2)").alias("tax"),
    )


@R.add("h49_header_count", "SELECT o_orderkey AS doc, (o_orderkey % 3 <> 0)::INT + (o_orderkey % 5 <> 0)::INT + (o_orderkey % 2 = 0)::INT + (o_orderkey % 7 <> 0)::INT AS n FROM orders")
def header_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("doc", Q.header_count().alias("n"))


NET = f"""WITH {LINES}, h AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(18, 2)) END AS net, (o_orderkey % 3 <> 0)::INT + (o_orderkey % 5 <> 0)::INT + (o_orderkey % 2 = 0)::INT + (o_orderkey % 7 <> 0)::INT AS n FROM orders),
  s AS (SELECT doc, sum(amount) AS total, bool_or(gtin IS NOT NULL OR sku IS NOT NULL) AS coded FROM lines GROUP BY doc)"""


@R.add("a19_reconciled_lines", f"{NET} SELECT doc, coalesce(abs(total - net) <= 0.01, FALSE) AS reconciles FROM h LEFT JOIN s USING (doc)")
def reconciled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.reconcile_lines(lines(spark, sf_dir).select("doc", F.col("amount").alias("net_amount")), _headers(spark, sf_dir).select("doc", "net"))


@R.add("v20_weak_read", f"""{NET} SELECT doc, concat_ws('; ', CASE WHEN NOT coalesce(coded, FALSE) THEN 'no line has an item code' END, CASE WHEN net IS NULL THEN 'no net total' END,
  CASE WHEN net IS NOT NULL AND NOT coalesce(abs(total - net) <= 0.01, FALSE) THEN 'line nets do not reconcile with the printed net' END, CASE WHEN n < 3 THEN 'fewer than 3 of number, date, PO, net and tax' END) AS reasons FROM h LEFT JOIN s USING (doc)""")
def weak_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.weak_read(_headers(spark, sf_dir), lines(spark, sf_dir), reconciled_lines(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "; "))


@R.add("x24_best_read", "SELECT doc, position, completeness FROM (SELECT o_custkey AS doc, CAST(o_orderkey AS BIGINT) AS position, o_orderkey % 4 AS completeness, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.best_read(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % 4).alias("completeness")))


FIRST_READ = f"SELECT l_orderkey AS doc, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) as int) AS line, CASE WHEN l_partkey % 3 <> 0 THEN concat('A-', cast(l_partkey as string)) END AS sku, cast(l_quantity as decimal(18,2)) AS qty, CASE WHEN l_partkey % 4 <> 0 THEN cast(l_partkey as decimal(18,2)) END AS price, CASE WHEN l_partkey % 2 = 0 THEN 'Cream' END AS description FROM {{lineitem}}"
SECOND_READ = "SELECT doc, line, CASE WHEN p % 5 <> 0 THEN concat('a', cast(p as string)) ELSE 'zz' END AS sku, CASE WHEN p % 7 = 0 THEN q + 1 ELSE q END AS qty, cast(p as decimal(18,2)) AS price, CASE WHEN p % 6 = 0 THEN 'CREAM!' ELSE 'Rose' END AS description FROM (SELECT l_orderkey AS doc, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ORDER + ") as int) AS line, l_partkey AS p, cast(l_quantity as decimal(18,2)) AS q FROM {lineitem}) t WHERE NOT (doc % 6 = 0 AND line = 1)"


@R.add("j26_merged_reads", f"""WITH m AS ({plain(FIRST_READ)}), t AS ({plain(SECOND_READ)}), e AS (SELECT doc FROM (SELECT doc, count(*) AS a FROM m GROUP BY doc) JOIN (SELECT doc, count(*) AS b FROM t GROUP BY doc) USING (doc) WHERE a = b),
  j AS (SELECT m.*, t.sku AS tsku, t.qty AS tqty, t.price AS tprice, t.description AS tdescription, coalesce(replace(lower(m.sku), '-', '') = lower(t.sku), FALSE) OR coalesce(lower(m.description) = lower(replace(t.description, '!', '')), FALSE) OR coalesce(m.qty = t.qty AND m.price = t.price, FALSE) AS near, t.doc IS NOT NULL AS paired
    FROM m LEFT JOIN (SELECT * FROM t WHERE doc IN (SELECT doc FROM e)) t ON t.doc = m.doc AND t.line = m.line)
  SELECT doc, line, CASE WHEN near AND paired THEN coalesce(sku, tsku) ELSE sku END AS sku, qty, CASE WHEN near AND paired THEN coalesce(price, tprice) ELSE price END AS price, CASE WHEN near AND paired THEN coalesce(description, tdescription) ELSE description END AS description, near AND paired AS aligned,
    concat_ws(',', CASE WHEN paired AND replace(lower(sku), '-', '') <> lower(tsku) THEN 'sku' END, CASE WHEN paired AND qty <> tqty THEN 'qty' END, CASE WHEN paired AND price <> tprice THEN 'price' END) AS differing FROM j""")
def merged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads line by line: gaps filled only where the lines are the same printed row."""
    return Q.merge_reads(frame(spark, sf_dir, FIRST_READ), frame(spark, sf_dir, SECOND_READ), ["sku", "qty", "price", "description"]).withColumn("differing", F.array_join("differing", ","))


@R.add("a25_corroborated_claims", """WITH o AS (SELECT user_id AS doc, CAST(event_id % 7 AS VARCHAR) AS run, CAST(event_id % 3 AS INT) AS page, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
  c AS (SELECT user_id AS doc, event_id AS index, CAST(event_id % 7 AS VARCHAR) AS run, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 3 AS INT) END AS page FROM events WHERE event_id % 9 < 2),
  a AS (SELECT doc, run, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT doc, run, sum(n) AS total FROM o GROUP BY ALL),
  v AS (SELECT DISTINCT p.doc, p.run FROM (SELECT doc, run, page, count(*) AS here FROM c WHERE page IS NOT NULL GROUP BY ALL) p LEFT JOIN o USING (doc, run, page) WHERE here > coalesce(n, 0))
  SELECT c.doc, c.index FROM c JOIN a USING (doc, run) JOIN t USING (doc, run) WHERE k <= total AND NOT EXISTS (SELECT 1 FROM v WHERE v.doc = c.doc AND v.run = c.run)""")
def corroborated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("index"), (F.col("event_id") % 7).cast("string").alias("run"), (F.col("event_id") % 3).cast("int").alias("page"))
    occurrences = own.where("index % 2 = 0").groupBy("doc", "run", "page").agg(F.count("*").alias("n"))
    return Q.corroborated(own.where("index % 9 < 2").withColumn("page", F.when(F.col("index") % 5 != 0, F.col("page"))), occurrences)


R.scalar("h16_printed_line_count", "events", "event_id", "concat('x total lines: ', cast(event_id % 1200 as string), case when event_id % 2 = 0 then ' Total Lines 7' else '' end)", Q.printed_line_count, "CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 1200 IN (0, 7) OR event_id % 1200 > 1000 THEN 7 END WHEN event_id % 1200 BETWEEN 1 AND 1000 THEN CAST(event_id % 1200 AS INT) END")
R.scalar("h17_printed_discount", "events", "event_id", "concat('Total 10', chr(10), case when event_id % 2 = 0 then 'Discount ' else 'Sum ' end, cast(event_id as string), '.50')", lambda x: Q.printed_discount(x, F.col("event_id") + F.lit("0.5").cast("decimal(2,1)")), "event_id % 2 = 0")
R.scalar("v31_unreadable_pages", "events", "event_id", "concat('a', chr(12), case when event_id % 2 = 0 then ' ' else 'b' end, chr(12))", lambda x: F.array_join(Q.unreadable_pages(x, F.lit(4)), ","), "CASE WHEN event_id % 2 = 0 THEN '2,3,4' ELSE '3,4' END")
R.scalar("v32_one_digit_off", "orders", "o_orderkey", "concat('scan_', lpad(cast(case when o_orderkey % 2 = 0 then o_orderkey + 100000 else o_orderkey end as string), 7, '0'), '.pdf')", lambda x: Q.one_character_off(F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), x), "CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey + 100000 AS VARCHAR), 7, '0') END")
R.scalar("e02_labelled_identifier", "events", "event_id", "concat('PO No: P', cast(event_id % 9 as string), case when event_id % 2 = 0 then ' PO No: Q1' else '' end)", lambda x: Q.text_window(x, [r"PO No: (\w+)", r"Order (\w+)"]), "CASE WHEN event_id % 2 <> 0 THEN 'P' || event_id % 9 END")
R.scalar("v23_tax_label", "events", "event_id", "case when event_id % 4 = 0 then 'VAT 5%' when event_id % 4 = 1 then 'Tax Invoice' when event_id % 4 = 2 then 'TRN VAT 1' else concat('a', chr(10), 'Total tax 3') end", K.tax_label_printed, "event_id % 4 IN (0, 3)")
R.scalar("v22_po_box", "events", "event_id", "concat(case when event_id % 2 = 0 then 'P.O. Box: ' else 'PO ' end, cast(event_id as string))", lambda x: K.po_box(x, F.col("event_id").cast("string")), "event_id % 2 = 0")
R.scalar("h15_status_group", "events", "event_id", "case event_id % 3 when 0 then 'verified' when 1 then 'mismatch' else 'empty_flagged' end", K.group, "CASE WHEN {x} = 'mismatch' THEN 'needs_checking' ELSE {x} END")


@R.add("a16_missing_lines", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN greatest(9 - r, 1) ELSE least(greatest(CAST(round(CAST(abs(n - e) * r / e AS DECIMAL(18, 6)), 0) AS INT), 1), 2 * r) END AS missing FROM (SELECT o_orderkey, CAST(o_custkey % 7 + 1 AS INT) AS r, CAST(o_orderkey % 900 + 50 AS DECIMAL(18, 2)) AS n, CAST(100 AS DECIMAL(18, 2)) AS e FROM orders)")
def missing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", K.missing_lines((F.col("o_custkey") % 7 + 1).cast("int"), (order % 900 + 50).cast("decimal(18,2)"), F.lit(100).cast("decimal(18,2)"), F.when(order % 4 == 0, 9)).alias("missing"))


@R.add("h18_missing_line_cells", "SELECT o_orderkey, 'missing ' || i AS line, c AS field FROM (SELECT o_orderkey, unnest(range(1, o_custkey % 3 + 1)) AS i FROM orders) CROSS JOIN (VALUES ('Item'), ('UPC'), ('Unit Cost'), ('Quantity'), ('Unit Tax Code')) v(c)")
def missing_line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.col("o_custkey") % 3
    each = read(spark, sf_dir, "orders").where(counts > 0).select("o_orderkey", F.explode(F.sequence(F.lit(1), counts.cast("int"))).alias("i"))
    return each.select("o_orderkey", F.concat(F.lit("missing "), F.col("i").cast("string")).alias("line"), F.explode(F.array(*[F.lit(c) for c in K.TEMPLATE["Details"][1:]])).alias("field"))


@R.add("j31_printed_locations", """WITH t AS (SELECT conv_id AS doc, turn AS row, unnest(regexp_split_to_array(trim(text), '\\s+')) AS text, generate_subscripts(regexp_split_to_array(trim(text), '\\s+'), 1) AS place FROM conversations WHERE role = 'system' AND trim(text) <> ''),
  v AS (SELECT doc, row, a.text || ' ' || b.text AS value, a.place AS first, b.place AS last FROM t a JOIN t b USING (doc, row) WHERE a.place = 1 AND b.place = 2),
  f AS (SELECT doc, row, place, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS t FROM t)
  SELECT doc, value, row, CAST(first AS INT) AS first, CAST(CASE WHEN lower(regexp_replace(value, '[^0-9A-Za-z]', '', 'g')) = (SELECT f.t FROM f WHERE f.doc = v.doc AND f.row = v.row AND f.place = 1) THEN 1 ELSE last END AS INT) AS last FROM v WHERE lower(regexp_replace(value, '[^0-9A-Za-z]', '', 'g')) <> ''""")
def printed_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations").where("role = 'system' and trim(text) <> ''")
    tokens = own.select(F.col("conv_id").alias("doc"), F.col("turn").alias("row"), F.posexplode(F.split(F.trim("text"), r"\s+")).alias("place", "text")).withColumn("place", F.col("place") + 1)
    pairs = Window.partitionBy("doc", "row").orderBy("place")
    values = tokens.withColumn("next", F.lead("text").over(pairs)).where("place = 1 and next is not null").select("doc", F.concat_ws(" ", "text", "next").alias("value"))
    return Q.located(values, tokens)


@R.add("j32_near_misses", "SELECT c_nationkey AS doc, a AS value, b AS token FROM (SELECT DISTINCT c_nationkey, lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') AS a FROM customer) JOIN (SELECT DISTINCT c_nationkey, lpad(CAST(c_custkey % 37 AS VARCHAR), 3, '0') AS b FROM customer) USING (c_nationkey) WHERE hamming(a, b) = 1")
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "doc")
    values = own.select("doc", F.lpad((F.col("c_custkey") % 100).cast("string"), 3, "0").alias("value")).distinct()
    return P.near_misses(own.select("doc", F.lpad((F.col("c_custkey") % 37).cast("string"), 3, "0").alias("token")).distinct(), values)


@R.add("w03_export_balance", "SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DECIMAL(38, 2) AS needed FROM orders")
def export_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("qty"))
    return L.running_need(rows, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", F.col("needed").cast("decimal(38,2)").alias("needed"))


@R.add("t01_ledger", "SELECT CAST(o_orderkey AS VARCHAR) AS invoice_key, 'export' AS side FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'tombstone' FROM orders WHERE o_orderstatus = 'P'")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("invoice_key"), "o_orderstatus")
    return L.combined(own.where("o_orderstatus <> 'P'").select("invoice_key", F.lit("export").alias("side")), own.where("o_orderstatus = 'P'").select("invoice_key", F.lit("tombstone").alias("side")))


@R.add("q09_duplicate_invoices", "SELECT DISTINCT o_custkey AS invoice_key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def duplicate_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("invoice_key"))
    return L.duplicates(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("invoice_key")).distinct(), known)


@R.add("q03_interrupted_jobs", "SELECT event_id, CASE WHEN event_id % 6 IN (0, 1) THEN 'error' ELSE ['queued', 'processing', 'review', 'ready', 'error', 'exported'][event_id % 6 + 1] END AS status FROM events")
def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(s) for s in J.STATES])
    return J.interrupted(read(spark, sf_dir, "events").select("event_id", F.get(states, (F.col("event_id") % 6).cast("int")).alias("status")))


@R.add("q05_stale_rows", "SELECT event_id, event_type AS signature FROM events WHERE event_type IS DISTINCT FROM 'click'")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stale(read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("signature")), "click")


@R.add("q02_latest_jobs", "SELECT user_id AS id, max(event_id) AS revision, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), F.col("event_type").alias("status"))
    return J.merged(own.where("revision % 2 = 0"), own.where("revision % 2 = 1"))


@R.add("h22_accuracy_rate", "SELECT event_type, count(*) AS cells, CAST(count_if(value > 50) AS BIGINT) AS changed, round((count(*) - count_if(value > 50)) / count(*), 4) AS accuracy FROM events GROUP BY event_type")
def accuracy_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, changed = F.count("*"), F.count_if(F.col("value") > 50)
    return read(spark, sf_dir, "events").groupBy("event_type").agg(n.alias("cells"), changed.alias("changed"), F.round((n - changed) / n, 4).alias("accuracy"))


@R.add("h11_tax_rows", f"WITH {LINES} SELECT doc, line, round_even(CAST(amount * 5 / 100 AS DECIMAL(18, 4)), 2)::DECIMAL(18, 2) AS tax FROM lines")
def tax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc", "line", F.bround((F.col("amount") * F.lit("0.05").cast("decimal(3,2)")).cast("decimal(18,4)"), 2).cast("decimal(18,2)").alias("tax"))


@R.add("x12_tax_code", f"""WITH {LINES}, s AS (SELECT doc, sum(amount) AS net FROM lines GROUP BY doc), c AS (SELECT n_nationkey AS region, 'V' || n_nationkey AS code, CAST(n_nationkey % 4 * 5 AS DECIMAL(9, 2)) AS rate FROM nation)
  SELECT doc, CASE WHEN round(net * rate / 100, 2) = CASE WHEN doc % 2 = 0 THEN round(net * 5 / 100, 2) ELSE CAST(0 AS DECIMAL(18, 2)) END THEN code END AS tax_code FROM s JOIN orders ON o_orderkey = doc JOIN customer ON c_custkey = o_custkey JOIN c ON region = c_nationkey""")
def tax_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = lines(spark, sf_dir).groupBy("doc").agg(F.sum("amount").alias("net"))
    codes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("V"), F.col("n_nationkey").cast("string")).alias("code"), (F.col("n_nationkey") % 4 * 5).cast("decimal(9,2)").alias("rate"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("c_custkey"))
    joined = nets.join(orders, "doc").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(F.broadcast(codes), "c_nationkey")
    printed = F.when(F.col("doc") % 2 == 0, F.round(F.col("net") * 5 / 100, 2)).otherwise(0)
    return joined.select("doc", F.when(F.round(F.col("net") * F.col("rate") / 100, 2) == printed, F.col("code")).alias("tax_code"))


@R.add("t07_issues", "SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'missing number' END, CASE WHEN o_orderkey % 5 = 0 THEN 'missing date' END, CASE WHEN o_totalprice < 1000 THEN 'small' END], lambda x: x IS NOT NULL)) AS issue FROM orders")
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"missing number": F.col("o_orderkey") % 3 == 0, "missing date": F.col("o_orderkey") % 5 == 0, "small": F.col("o_totalprice") < 1000}
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(A.violations(tests)).alias("issue"))


@R.add("s04_similar_names")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "part").orderBy("p_partkey").select("p_name").first()[0]
    return Z.similar_names(read(spark, sf_dir, "part").select(F.col("p_name").alias("name")), asked[::-1][1:][::-1])


@R.add("x23_product_candidates")
def product_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best names with their parts, scored with a price clue; ties go by key."""
    found = similar_names(spark, sf_dir)
    parts = read(spark, sf_dir, "part").withColumnRenamed("p_name", "name").join(F.broadcast(found), "name")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    none = F.lit(None).cast("decimal(18,2)")
    scored = parts.select("p_partkey", "name", F.round(Z.clue_score(F.col("score"), price, F.lit(1000).cast("decimal(18,2)"), none, none, F.lit(False), F.lit(False)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "p_partkey").limit(20)
