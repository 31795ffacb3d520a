"""Queries for the catalog's store, product search, imports, mapping tables, jobs, deletion and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import catalog as C
from ..operators import stores as S
from .registry import Registry, frame, plain
from .relational import CATALOG, ORDER, catalog_terms

R = Registry()

# ------------------------------------------------------------------ terms and rows

PO_TERMS = "SELECT DISTINCT 'po' AS kind, inline(array(named_struct('term', concat('x:sku:', lpad(cast(l_partkey as string), 6, '0')), 'id', cast(l_orderkey as string)), named_struct('term', concat('f:po:', cast(l_orderkey % 20 as string)), 'id', cast(l_orderkey as string)))) FROM {lineitem}"
PO_TWIN = "poterms AS (SELECT DISTINCT 'x:sku:' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS term, CAST(l_orderkey AS VARCHAR) AS id FROM lineitem UNION SELECT DISTINCT 'f:po:' || (l_orderkey % 20), CAST(l_orderkey AS VARCHAR) FROM lineitem)"


@R.add("j01_rows_by_terms", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS payload FROM part WHERE p_partkey IN (3, 5) OR p_brand = (SELECT p_brand FROM part WHERE p_partkey = 1)")
def rows_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have any of some terms, each once."""
    brand = frame(spark, sf_dir, "SELECT 'item' AS kind, concat('f:supplier:', trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' '))) AS term FROM {part} WHERE p_partkey = 1 UNION ALL SELECT 'item', 'x:sku:000003' UNION ALL SELECT 'item', 'i:000005' UNION ALL SELECT 'item', 'i:000003'")
    rows = frame(spark, sf_dir, "SELECT cast(p_partkey as string) AS id, p_type AS payload FROM {part}")
    return S.rows_by_terms(catalog_terms(spark, sf_dir), brand, rows)


@R.add("j02_context_filter", f"WITH {CATALOG} SELECT DISTINCT id FROM terms t WHERE term LIKE 't:%' AND EXISTS (SELECT 1 FROM terms f WHERE f.id = t.id AND f.term = 'f:supplier:brand 11')")
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = catalog_terms(spark, sf_dir)
    return S.in_context(own.where(F.startswith("term", F.lit("t:"))).select("kind", "id").distinct(), own, [("supplier", "brand 11")]).select("id")


@R.add("j05_weighted_terms", f"WITH {CATALOG}, w AS (SELECT * FROM (VALUES ('t:red', 5), ('t:blue', 7), ('i:000004', 90)) v(term, weight)) SELECT id, max(weight)::INT AS weight FROM terms JOIN w USING (term) GROUP BY id")
def weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest weight of the wanted terms that a row has."""
    return S.weighted(catalog_terms(spark, sf_dir), "item", [("t:red", 5), ("t:blue", 7), ("i:000004", 90)])


@R.add("s05_row_pool", f"WITH {CATALOG}, w AS (SELECT id, count(*) AS weight FROM terms WHERE term LIKE 't:%' GROUP BY id) SELECT id, CAST(weight AS INT) AS weight, (SELECT count(*) FROM w) > 50 AS cut FROM w ORDER BY weight DESC, id LIMIT 50")
def row_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of greatest weight, with a notice if there were more."""
    weights = catalog_terms(spark, sf_dir).where(F.startswith("term", F.lit("t:"))).groupBy("id").agg(F.count("*").cast("int").alias("weight"))
    return S.pool(weights, 50)


@R.add("j06_late_payload", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS score, p_name AS payload FROM part ORDER BY p_size DESC, CAST(p_partkey AS VARCHAR) LIMIT 15")
def late_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks first, payloads behind."""
    rows = frame(spark, sf_dir, "SELECT cast(p_partkey as string) AS id, p_size AS score, p_name AS payload FROM {part}")
    return S.with_payload(C.page(rows.select("id", "score"), 15), rows.select("id", "payload"))


@R.add("r15_lookup_source", f"WITH {CATALOG} SELECT 'L' || l_orderkey AS probe, id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 10 = 0) JOIN terms ON term = 'x:sku:' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') WHERE CAST(id AS INT) % 3 <> 0")
def lookup_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of probes over the term index, re-checked on the original column. Each part of an order is a probe, though two print the same number."""
    probes = frame(spark, sf_dir, "SELECT DISTINCT named_struct('order', concat('L', cast(l_orderkey as string)), 'part', l_partkey) AS probe, 'item' AS kind, concat('x:sku:', lpad(cast(l_partkey as string), 6, '0')) AS term, lpad(cast(l_partkey as string), 6, '0') AS value FROM {lineitem} WHERE l_orderkey % 10 = 0")
    rows = frame(spark, sf_dir, "SELECT cast(p_partkey as string) AS id, CASE WHEN p_partkey % 3 <> 0 THEN lpad(cast(p_partkey as string), 6, '0') ELSE 'other' END AS exact FROM {part}")
    return S.probe(probes, catalog_terms(spark, sf_dir), rows).select(F.col("probe.order").alias("probe"), "id")


@R.add("j03_shared_terms", f"WITH {CATALOG}, {PO_TWIN} SELECT DISTINCT t.id FROM terms t JOIN poterms k ON k.term = t.term WHERE t.term LIKE 'x:%' AND k.id IN (SELECT id FROM poterms WHERE term = 'f:po:7')")
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share an identity with a row of an order."""
    return S.of_order(catalog_terms(spark, sf_dir), frame(spark, sf_dir, PO_TERMS), "7")


@R.add("w10_order_contexts", f"WITH {CATALOG}, {PO_TWIN}, m AS (SELECT t.id AS item, k.id AS row, row_number() OVER (PARTITION BY t.id ORDER BY k.id) AS n, count(*) OVER (PARTITION BY t.id) AS every FROM (SELECT DISTINCT id, term FROM terms WHERE term LIKE 'x:%') t JOIN poterms k USING (term)) SELECT item, row, every > 20 AS truncated FROM m WHERE n <= 20")
def order_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 order rows an item, and whether there were more."""
    return S.contexts(catalog_terms(spark, sf_dir), frame(spark, sf_dir, PO_TERMS))


@R.add("s08_public_scores", """WITH c AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS words, CASE p_partkey % 4 WHEN 0 THEN [lpad(CAST(p_partkey AS VARCHAR), 6, '0')] WHEN 1 THEN string_split(p_name, ' ') WHEN 2 THEN [left(string_split(p_name, ' ')[1], 2), 'zzz'] ELSE [string_split(p_name, ' ')[-1], 'qqq'] END AS asked FROM part),
  s AS (SELECT p_partkey, asked, words, list_transform(asked, lambda t: CASE WHEN list_contains(words, t) THEN 1.0 WHEN len(list_filter(words, lambda w: starts_with(w, t))) > 0 THEN 0.7 ELSE 0.0 END) AS w FROM c)
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 1.0 WHEN p_partkey % 4 = 1 THEN 0.95 ELSE round(0.5 + 0.39 * list_sum(w) / len(asked), 3) END::DOUBLE AS score FROM s""")
def public_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for an identifier, 0.95 for a description, else by the words that it has or begins."""
    own = frame(spark, sf_dir, "SELECT p_partkey, p_name, lpad(cast(p_partkey as string), 6, '0') AS code, split(p_name, ' ') AS words FROM {part}")
    asked = F.expr("case p_partkey % 4 when 0 then code when 1 then p_name when 2 then concat(substring(words[0], 1, 2), ' zzz') else concat(element_at(words, -1), ' qqq') end")
    return own.select("p_partkey", S.public_score(asked, F.array("code"), F.array("p_name")).alias("score"))


@R.add("s07_description_rank", "SELECT line, parent, n FROM (SELECT l_partkey % 50 AS line, CAST(l_suppkey AS VARCHAR) AS parent, CAST(row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR) DESC) AS INT) AS n FROM lineitem GROUP BY l_partkey % 50, l_suppkey) WHERE n <= 5")
def description_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five candidates: by score, then by the greater parent."""
    scored = frame(spark, sf_dir, "SELECT l_partkey % 50 AS line, cast(l_suppkey as string) AS parent, count(*) AS score FROM {lineitem} GROUP BY l_partkey % 50, l_suppkey")
    best = Window.partitionBy("line").orderBy(F.desc("score"), F.desc("parent"))
    return A.first_of_each(scored, ["line"], [F.desc("score"), F.desc("parent")], 5).withColumn("n", F.row_number().over(best)).drop("score")


@R.add("s06_final_order", "SELECT p_partkey, round(p_size / 50.0, 3) AS score FROM part ORDER BY round(p_size / 50.0, 3) DESC, p_partkey LIMIT 25")
def final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "SELECT p_partkey, round(p_size / 50.0D, 3) AS score FROM {part}").orderBy(F.desc("score"), "p_partkey").limit(25)


@R.add("s09_recent_jobs", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "SELECT event_id, ts FROM {events}").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id")


@R.add("s10_names", "SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct names, or a refusal beyond the bound."""
    return S.names(catalog_terms(spark, sf_dir))


@R.add("s11_refused_rows", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part")
def refused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bounded(frame(spark, sf_dir, "SELECT cast(p_partkey as string) AS id FROM {part}"), 50_000_000)


@R.add("s12_row_order", "SELECT p_brand AS sheet, p_partkey AS row_number, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS n FROM part")
def row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT p_brand AS sheet, p_partkey AS row_number FROM {part}")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("sheet").orderBy("row_number")))


@R.add("h33_descriptions", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'dept ' || p_type ELSE p_name END AS text FROM part")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions but for categories, unless that leaves none."""
    own = frame(spark, sf_dir, "SELECT p_partkey AS id, inline(CASE WHEN p_partkey % 3 = 0 THEN array(named_struct('column', 'Dept Name', 'value', concat('dept ', p_type))) ELSE array(named_struct('column', 'Item description', 'value', p_name), named_struct('column', 'Category', 'value', 'c')) END) FROM {part}")
    return S.descriptions(own).select(F.col("id").alias("p_partkey"), F.col("value").alias("text"))


@R.add("a30_role_conflicts", "SELECT p_partkey, p_partkey % 4 = 1 AS conflict FROM part")
def role_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides say something, and nothing alike."""
    own = frame(spark, sf_dir, "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN cast(array() as array<string>) ELSE array('a', 'b') END AS item, CASE p_partkey % 4 WHEN 1 THEN array('c') WHEN 2 THEN array('b', 'c') ELSE cast(array() as array<string>) END AS po FROM {part}")
    return own.select("p_partkey", S.roles_conflict(F.col("item"), F.col("po")).alias("conflict"))


# ------------------------------------------------------------------ imports

LOADED = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'item' ELSE 'po' END AS kind, o_orderstatus AS source_hash, cast(o_orderkey as int) AS line, o_orderpriority AS payload, o_orderkey % 4 AS terms FROM {orders}"


@R.add("a22_shadow_state", f"SELECT kind, source_hash, count(*) AS rows, sum(terms)::BIGINT AS terms FROM ({plain(LOADED)}) GROUP BY ALL")
def shadow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state(frame(spark, sf_dir, LOADED))


@R.add("h36_prefix_state", f"SELECT kind, source_hash, count(*) AS rows, sum(terms)::BIGINT AS terms FROM ({plain(LOADED)}) WHERE line <= 500 GROUP BY ALL")
def prefix_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what the first lines of an archive hold."""
    return S.state(frame(spark, sf_dir, LOADED).where("line <= 500"))


@R.add("h37_resume_differences", f"WITH e AS (SELECT kind, source_hash, count(*) AS rows, sum(terms)::BIGINT AS terms FROM ({plain(LOADED)}) WHERE line <= 700 GROUP BY ALL), a AS (SELECT kind, source_hash, count(*) AS rows, sum(terms)::BIGINT AS terms FROM ({plain(LOADED)}) WHERE line <= 700 AND line % 400 <> 7 GROUP BY ALL) SELECT kind, source_hash, e.rows AS expected, a.rows AS found FROM e FULL JOIN a USING (kind, source_hash) WHERE e.rows IS DISTINCT FROM a.rows OR e.terms IS DISTINCT FROM a.terms")
def resume_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a resumed import's state isn't what its first lines say."""
    own = frame(spark, sf_dir, LOADED).where("line <= 700")
    return S.state_differences(S.state(own), S.state(own.where("line % 400 <> 7")))


@R.add("h38_record_loads", f"SELECT line, CAST(length(payload) AS INT) AS bytes, CAST(terms AS INT) AS terms, CAST(sum(length(payload)) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) // 1000 AS BIGINT) AS batch FROM ({plain(LOADED)}) WHERE kind = 'item'")
def record_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and terms of each record, and the batch of bounded bytes that it falls into."""
    own = frame(spark, sf_dir, LOADED).where("kind = 'item'")
    return S.batches(own.select("kind", "line", F.octet_length("payload").alias("bytes"), F.col("terms").cast("int").alias("terms")), 1000).drop("kind")


@R.add("q04_resumed_import", f"SELECT line, kind FROM ({plain(LOADED)}) WHERE line > 400")
def resumed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import has still to load, by content identity."""
    own = frame(spark, sf_dir, LOADED).withColumn("id", F.sha2(F.concat_ws("|", "source_hash", "line"), 256))
    return S.still_to_load(own, own.where("line <= 400")).select("line", "kind")


@R.add("v05_source_counts", "SELECT 'source ' || coalesce(a.k, b.k) AS source, a.n AS declared, b.n AS found FROM (SELECT o_orderpriority AS k, 300 AS n FROM orders WHERE o_orderpriority < '4' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) b USING (k) WHERE a.n IS DISTINCT FROM b.n")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = frame(spark, sf_dir, "SELECT DISTINCT concat('source ', o_orderpriority) AS source, 300L AS declared FROM {orders} WHERE o_orderpriority < '4'")
    return S.count_differences(declared, frame(spark, sf_dir, "SELECT concat('source ', o_orderpriority) AS source FROM {orders}"))


@R.add("v01_envelope", "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 5 = 0 THEN 'kind is unknown' END, CASE WHEN o_orderkey % 3 = 0 THEN 'hash is malformed' END, CASE WHEN o_orderkey % 7 = 0 THEN 'row is not positive' END) AS violations FROM orders")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a catalog row's envelope."""
    own = frame(spark, sf_dir, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'po' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'ZZ' ELSE repeat('ab', 32) END AS source_hash, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS row_number FROM {orders}")
    tests = {k: v for k, v in C.envelope_violations(["kind"]).items()}
    return own.select("o_orderkey", F.array_join(A.violations(tests), "; ").alias("violations"))


# ------------------------------------------------------------------ mapping tables

VAT_ROWS = "SELECT cast(n_nationkey as int) AS row, CASE WHEN n_nationkey % 7 = 0 THEN 'D' ELSE 'c' END AS vat_type, CASE WHEN n_nationkey % 5 = 0 THEN 'XX' ELSE concat('pv', cast(n_nationkey as string)) END AS vat_code, concat(upper(substring(n_name, 1, 1)), ' Vat Region ') AS region_name, CASE WHEN n_nationkey % 11 = 3 THEN '-1' ELSE '5' END AS rate, '2031-01-01' AS active FROM {nation}"
VAT_KEPT = "k AS (SELECT CAST(n_nationkey AS INT) AS row, 'PV' || n_nationkey AS code, upper(left(n_name, 1)) AS region, n_nationkey % 11 <> 3 AS fine FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey % 5 <> 0), f AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY row) AS n FROM k WHERE fine)"


@R.add("v12_vat_codes", f"WITH {VAT_KEPT} SELECT row, code, region, '' AS reason FROM f WHERE n = 1 UNION ALL SELECT row, code, region, 'second C/PV code for the same VAT region' FROM f WHERE n > 1 UNION ALL SELECT row, code, region, 'region, rate or active date missing or invalid' FROM k WHERE NOT fine")
def vat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of type C with PV in the code; the first of each region counts, the others are flagged by row."""
    return S.vat_codes(frame(spark, sf_dir, VAT_ROWS)).select("row", "code", "region", "reason")


LOCATION_ROWS = "SELECT cast(c_custkey as int) AS row, concat('L', cast(c_custkey % 100 as string)) AS location, CASE c_custkey % 5 WHEN 0 THEN 'w/h' WHEN 1 THEN 'Shop' ELSE 'Store' END AS kind, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'kuwait' END AS country, 'ra1kwd' AS entity FROM {customer}"


@R.add("v13_locations", """WITH r AS (SELECT CAST(c_custkey AS INT) AS row, 'L' || (c_custkey % 100) AS location, CASE c_custkey % 5 WHEN 0 THEN 'Warehouse (W)' WHEN 1 THEN NULL ELSE 'Store (S)' END AS type, c_custkey % 5 <> 1 AND c_custkey % 9 <> 0 AS fine FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY row) AS n FROM r WHERE fine)
  SELECT row, location, type, '' AS reason FROM f WHERE n = 1 UNION ALL SELECT row, location, type, 'location id repeats' FROM f WHERE n > 1 UNION ALL SELECT row, location, type, 'location id, type (STORE or W/H) or country missing' FROM r WHERE NOT fine""")
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.locations(frame(spark, sf_dir, LOCATION_ROWS)).select("row", "location", "type", "reason")


SITE_ROWS = "SELECT cast(c_custkey as int) AS row, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('S', cast(c_custkey % 130 as string)) END AS site, CASE c_custkey % 6 WHEN 0 THEN 'aed' WHEN 1 THEN 'dirham' ELSE 'KWD' END AS currency, CASE c_custkey % 7 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'closed' ELSE 'inactive' END AS status FROM {customer}"
SITE_TWIN = "r AS (SELECT CAST(c_custkey AS INT) AS row, 'S' || (c_custkey % 130) AS site, c_custkey % 6 <> 1 AND c_custkey % 7 <> 1 AS fine FROM customer WHERE c_custkey % 10 <> 0), f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY row) AS n FROM r WHERE fine)"


@R.add("v14_supplier_sites", f"WITH {SITE_TWIN} SELECT row, site, '' AS reason FROM f WHERE n = 1 UNION ALL SELECT row, site, 'supplier site id repeats' FROM f WHERE n > 1 UNION ALL SELECT row, site, 'currency is not a 3-letter code or status is not Active/Inactive' FROM r WHERE NOT fine")
def supplier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.supplier_sites(frame(spark, sf_dir, SITE_ROWS)).select("row", "site", "reason")


@R.add("w06_first_rows", f"WITH {SITE_TWIN} SELECT row, site, n = 1 AS kept FROM f")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a key wins, later ones are flagged."""
    own = S.supplier_sites(frame(spark, sf_dir, SITE_ROWS))
    return own.where("reason in ('', 'supplier site id repeats')").select("row", "site", (F.col("reason") == "").alias("kept"))


@R.add("a28_mapping_report", f"WITH {SITE_TWIN} SELECT (SELECT count(*) FROM f WHERE n = 1) AS kept, (SELECT count(*) FROM f WHERE n > 1) + (SELECT count(*) FROM r WHERE NOT fine) AS flagged, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS without_id")
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what a mapping sheet keeps, flags and can't key; no value of it."""
    return S.mapping_report(frame(spark, sf_dir, SITE_ROWS), S.supplier_sites(frame(spark, sf_dir, SITE_ROWS)))


@R.add("v15_config_conflicts", "SELECT 'two currencies' AS problem, k AS key FROM (SELECT c_nationkey || '|' || c_mktsegment AS k FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey % 2) > 1) UNION ALL SELECT 'negative tolerance', 'T' || c_custkey FROM customer WHERE c_acctbal < 0")
def config_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = frame(spark, sf_dir, "SELECT concat(cast(c_nationkey as string), '|', c_mktsegment) AS key, cast(c_custkey % 2 as string) AS value FROM {customer}")
    tolerance = frame(spark, sf_dir, "SELECT concat('T', cast(c_custkey as string)) AS key, c_acctbal AS value FROM {customer}")
    return S.config_conflicts(currency, tolerance)


# ------------------------------------------------------------------ approval, jobs, deletion, sheets


@R.add("j21_enriched", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS location, CASE WHEN o_orderkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'PO ' || o_custkey END AS source FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields from the only order of that number; what is there stays."""
    own = frame(spark, sf_dir, "SELECT o_orderkey, cast(o_custkey as string) AS po, CASE WHEN o_orderkey % 3 = 0 THEN 'own' END AS location FROM {orders}")
    orders = frame(spark, sf_dir, "SELECT cast(c_custkey as string) AS po, c_mktsegment AS location FROM {customer} UNION ALL SELECT cast(c_custkey as string), 'second' FROM {customer} WHERE c_custkey % 2 = 1")
    return S.enriched(own, orders, "po", ["location"]).select("o_orderkey", "location", F.col("location_source").alias("source"))


@R.add("j20_approval", """SELECT o_orderkey AS doc, concat_ws(',', CASE WHEN o_custkey % 5 = 0 THEN 'SITE' END, CASE WHEN o_custkey % 4 = 0 THEN 'ROUTE' END, CASE WHEN o_orderkey % 6 = 0 THEN 'PO' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'PO_STATUS' END END, CASE WHEN o_custkey % 3 = 0 THEN 'TAX' END) AS failed FROM orders""")
def approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invoice against sites, routes, orders and tax rules: each must have exactly one row that fits."""
    own = frame(spark, sf_dir, "SELECT o_orderkey AS doc, concat('S', cast(o_custkey as string)) AS site, cast(o_custkey as string) AS route, cast(o_orderkey as string) AS po, cast(o_custkey as string) AS tax FROM {orders}")
    sites = frame(spark, sf_dir, "SELECT DISTINCT concat('S', cast(o_custkey as string)) AS site FROM {orders} WHERE o_custkey % 5 <> 0")
    routes = frame(spark, sf_dir, "SELECT DISTINCT cast(o_custkey as string) AS route, CASE WHEN o_custkey % 4 = 0 THEN 'pending' ELSE 'approved' END AS status FROM {orders}")
    orders = frame(spark, sf_dir, "SELECT cast(o_orderkey as string) AS po, CASE WHEN o_orderkey % 7 = 0 THEN 'closed' ELSE 'open' END AS status FROM {orders} WHERE o_orderkey % 12 <> 0 UNION ALL SELECT cast(o_orderkey as string), 'open' FROM {orders} WHERE o_orderkey % 12 = 6")
    taxes = frame(spark, sf_dir, "SELECT DISTINCT cast(o_custkey as string) AS tax FROM {orders} WHERE o_custkey % 3 <> 0")
    return S.approval(own, sites, routes, orders, taxes).withColumn("failed", F.array_join("failed", ","))


@R.add("h24_carried_marks", "SELECT l_orderkey AS doc, line, CASE WHEN l_partkey % 4 <> 0 THEN 'B' || l_partkey END AS unchecked FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line FROM lineitem)")
def carried_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's mark stays while its line is the same one."""
    base = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line, l_partkey AS p FROM {lineitem}"
    before = frame(spark, sf_dir, f"SELECT doc, line, cast(p as string) AS identity, concat('B', cast(p as string)) AS mark FROM ({base}) t")
    after = frame(spark, sf_dir, f"SELECT doc, line, CASE WHEN p % 4 = 0 THEN 'other' ELSE cast(p as string) END AS identity FROM ({base}) t")
    return S.carried(after, before, "mark").select("doc", "line", F.col("mark").alias("unchecked"))


@R.add("w17_first_attribution", "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 'first' WHEN o_orderkey % 3 = 1 THEN 'now' END AS actor FROM orders")
def first_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who entered a value first, as long as it stays."""
    entries = frame(spark, sf_dir, "SELECT o_orderkey AS doc, 'po' AS key, CASE o_orderkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'new' END AS before, CASE o_orderkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'newer' END AS after, 'first' AS previous, 'now' AS actor FROM {orders}")
    return S.attributed(entries).select("doc", "actor")


@R.add("h25_changed_line_sets", f"SELECT l_orderkey AS doc, bool_or(l_partkey % 40 = 0) AS changed FROM lineitem GROUP BY l_orderkey")
def changed_line_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines aren't the same ones in the same order; what is keyed by line is dropped for them."""
    before = frame(spark, sf_dir, f"SELECT l_orderkey AS doc, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) as int) AS line, cast(l_partkey as string) AS identity FROM {{lineitem}}")
    after = before.withColumn("identity", F.when(F.col("identity").cast("int") % 40 == 0, "x").otherwise(F.col("identity")))
    return S.same_lines(before, after).select("doc", (~F.col("same")).alias("changed"))


@R.add("h27_config_reset", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'exported' WHEN event_id % 3 = 1 THEN 'review' ELSE 'error' END AS status, CAST(event_id + CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS revision FROM events")
def config_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed configuration sends reviewed, unexported jobs back, with a new revision."""
    jobs = frame(spark, sf_dir, "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'exported' WHEN 1 THEN 'ready' ELSE 'error' END AS status, cast(event_id as bigint) AS revision FROM {events}")
    return S.reset_reviews(jobs)


@R.add("q06_revision_conflicts", "SELECT event_id AS id, event_id % 2 = 0 AS applied FROM events")
def revision_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update applies only to the revision that it was made for."""
    jobs = frame(spark, sf_dir, "SELECT event_id AS id, event_id % 5 AS revision FROM {events}")
    updates = frame(spark, sf_dir, "SELECT event_id AS id, event_id % 5 + event_id % 2 AS expected FROM {events}")
    return S.compare_and_set(jobs, updates).select("id", "applied")


@R.add("j28_deletion_conflicts", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'no job' WHEN o_orderkey % 7 = 0 THEN 'job names another export' END AS problem FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def deletion_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = frame(spark, sf_dir, "SELECT o_orderkey AS id, concat('J', cast(o_orderkey as string)) AS job_id FROM {orders}")
    jobs = frame(spark, sf_dir, "SELECT concat('J', cast(o_orderkey as string)) AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey END AS export_id FROM {orders} WHERE o_orderkey % 5 <> 0")
    return S.deletion_conflicts(exports, jobs)


@R.add("a29_split_batches", "SELECT o_custkey AS batch_id, count(*) AS members, CAST(count_if(o_orderkey % 2 = 0) AS BIGINT) AS chosen FROM orders GROUP BY o_custkey HAVING count_if(o_orderkey % 2 = 0) BETWEEN 1 AND count(*) - 1")
def split_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that a selection would split."""
    from ..operators.ledger import whole_batches

    own = frame(spark, sf_dir, "SELECT o_orderkey AS id, o_custkey AS batch_id FROM {orders}")
    return whole_batches(own, own.where("id % 2 = 0"))


@R.add("h43_redacted_audit", "SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 <> 0 THEN 'J' || (event_id % 3) END, CASE WHEN event_id % 4 <> 0 THEN 'K' || (event_id % 4) END) AS jobs FROM events WHERE event_id % 3 <> 0 OR event_id % 4 <> 0")
def redacted_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows without the deleted jobs; those that name no other go."""
    audit = frame(spark, sf_dir, "SELECT event_id, array(concat('J', cast(event_id % 3 as string)), concat('K', cast(event_id % 4 as string))) AS jobs FROM {events}")
    return S.redacted(audit, frame(spark, sf_dir, "SELECT 'J0' AS job UNION ALL SELECT 'K0' FROM {region} WHERE r_regionkey = 0")).withColumn("jobs", F.array_join("jobs", ","))


@R.add("h42_minimal_allocations", "SELECT o_orderkey, 'K' || o_orderkey || ':2.00' AS allocations FROM orders WHERE o_orderkey % 2 = 0")
def minimal_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocations reduced to key and quantity; one without either is refused."""
    own = frame(spark, sf_dir, "SELECT o_orderkey, array(named_struct('key', concat('K', cast(o_orderkey as string)), 'qty', CASE WHEN o_orderkey % 2 = 0 THEN cast(2 as decimal(18,2)) END, 'note', 'x')) AS allocations FROM {orders}")
    found = own.select("o_orderkey", S.minimal_allocations(F.col("allocations")).alias("a")).where("a is not null")
    return found.select("o_orderkey", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["key"], x["qty"].cast("string"))), ",").alias("allocations"))


@R.add("h41_merged_tombstones", "SELECT o_custkey AS invoice_key, 'K' || (o_custkey % 3) AS key, CAST(count(*) AS DECIMAL(38, 0)) AS qty FROM orders GROUP BY o_custkey")
def merged_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones of the same key add up their allocations."""
    own = frame(spark, sf_dir, "SELECT o_custkey AS invoice_key, array(named_struct('key', concat('K', cast(o_custkey % 3 as string)), 'qty', cast(1 as decimal(18,0)))) AS allocations FROM {orders}")
    return S.merged_allocations(own).withColumn("qty", F.col("qty").cast("decimal(38,0)"))


@R.add("h44_upload_paths", "SELECT DISTINCT 'up/' || (o_orderkey % 50) || '.pdf' AS path FROM orders WHERE o_orderkey % 3 = 0")
def upload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT to_json(named_struct('upload', concat('up/', cast(o_orderkey % 50 as string), '.pdf'), 'x', 1)) AS payload FROM {orders} WHERE o_orderkey % 3 = 0")
    return S.upload_paths(own)


@R.add("v06_draft_arithmetic", f"WITH s AS (SELECT l_orderkey AS doc, round(sum(CAST(l_quantity AS DECIMAL(18, 2)) * CAST(l_partkey % 9 + 1 AS DECIMAL(18, 2))), 4) AS total FROM lineitem GROUP BY l_orderkey) SELECT doc, concat_ws(',', CASE WHEN doc % 4 = 0 THEN 'tax basis' END, CASE WHEN doc % 5 = 0 THEN 'lines' END) AS problems FROM s")
def draft_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual draft: the tax basis is the net, and quantities times costs make it, to four places."""
    lines = frame(spark, sf_dir, "SELECT l_orderkey AS doc, cast(l_quantity as decimal(18,2)) AS quantity, cast(l_partkey % 9 + 1 as decimal(18,2)) AS unit_cost FROM {lineitem}")
    heads = lines.groupBy("doc").agg(F.sum(F.col("quantity") * F.col("unit_cost")).alias("t")).select("doc", (F.col("t") + F.when(F.col("doc") % 5 == 0, 1).otherwise(0)).alias("net"), (F.col("t") + F.when(F.col("doc") % 5 == 0, 1).otherwise(0) + F.when(F.col("doc") % 4 == 0, 1).otherwise(0)).alias("tax_basis"))
    return S.draft_problems(heads, lines).withColumn("problems", F.array_join("problems", ","))


@R.add("j30_vat_rates", "SELECT o_orderkey AS doc, CASE WHEN o_custkey % 4 < 3 THEN CAST(o_custkey % 4 * 5 AS DECIMAL(9, 2)) END AS rate FROM orders")
def vat_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "SELECT o_orderkey AS doc, concat(' V', cast(o_custkey % 4 as string), ' ') AS code FROM {orders}")
    codes = frame(spark, sf_dir, "SELECT DISTINCT concat('V', cast(r_regionkey as string)) AS code, cast(r_regionkey * 5 as decimal(9,2)) AS rate FROM {region} WHERE r_regionkey < 3")
    return S.rated(own, codes).select("doc", "rate")


@R.add("h29_draft_disclosure", "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 4 = 0 THEN 'not read' ELSE 'no lines' END AS reason FROM orders WHERE o_orderkey % 4 IN (0, 1)")
def draft_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices that a draft leaves out, with the reason."""
    return S.disclosed(frame(spark, sf_dir, "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 4 = 0 THEN 'error' ELSE 'review' END AS status, CASE WHEN o_orderkey % 4 = 1 THEN 0 ELSE 3 END AS lines FROM {orders}"))


@R.add("h23_order_date_rows", "SELECT o_orderkey AS transaction, 'Order Date' AS \"column\", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value, 'verified' AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'Order Date', NULL, 'empty_flagged' FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'Receipt Date', NULL, 'empty_flagged' FROM orders")
def order_date_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of evidence for each transaction."""
    return S.date_rows(frame(spark, sf_dir, "SELECT o_orderkey AS transaction, CASE WHEN o_orderkey % 2 = 0 THEN cast(cast(o_orderdate as date) as string) END AS order_date, cast(NULL as string) AS receipt_date FROM {orders}"))


@R.add("h10_raw_rows", f"SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS line, 'V' || l_partkey AS \"Candidate VPN\", CASE WHEN l_partkey % 2 = 0 THEN '12345678, 87654321' ELSE '12345678' END AS \"Candidate Barcode\" FROM lineitem")
def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw values of each line with its candidates, unchanged."""
    lines = frame(spark, sf_dir, f"SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS line, concat('V', cast(l_partkey as string)) AS sku, '12345678' AS gtin, CASE WHEN l_partkey % 2 = 0 THEN 'x 87654321 y' END AS description FROM {{lineitem}}")
    return S.raw_rows(lines)


@R.add("k08_review_counts", "SELECT unnest(['lines', 'exceptions', 'invoices']) AS sheet, unnest([(SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_partkey % 3 = 0), (SELECT count(*) FROM orders)]) AS rows")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of a review workbook and how many rows each has."""
    lines = frame(spark, sf_dir, "SELECT l_orderkey AS doc, l_partkey FROM {lineitem}")
    return S.sheet_counts({"lines": lines, "exceptions": lines.where("l_partkey % 3 = 0"), "invoices": frame(spark, sf_dir, "SELECT o_orderkey AS doc FROM {orders}")})


@R.add("k07_approved_rows", "SELECT o_orderkey AS transaction, CAST(l_partkey AS VARCHAR) AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def approved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of approved invoices alone."""
    heads = frame(spark, sf_dir, "SELECT o_orderkey AS doc, CASE WHEN o_orderstatus = 'F' THEN 'Approved' ELSE 'Review' END AS status FROM {orders}")
    return S.approved(heads, frame(spark, sf_dir, "SELECT l_orderkey AS doc, cast(l_partkey as string) AS item FROM {lineitem}")).select(F.col("doc").alias("transaction"), "item")


@R.add("k15_audit_rows", "SELECT event_id, 'export' AS event, 'J' || event_id AS job FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'delete', 'J' || event_id FROM events WHERE event_id % 2 = 1")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is appended to the audit log."""
    own = frame(spark, sf_dir, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'export' ELSE 'delete' END AS event, concat('J', cast(event_id as string)) AS job FROM {events}")
    return S.appended(own.where("event = 'export'"), own.where("event = 'delete'"))


@R.add("r14_job_scan", "SELECT event_id AS id, event_type AS status, CAST(event_id % 7 AS INT) AS revision FROM events")
def job_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns of jobs whose payload is JSON."""
    own = frame(spark, sf_dir, "SELECT event_id AS id, to_json(named_struct('status', event_type, 'revision', event_id % 7)) AS payload FROM {events}")
    return S.jobs(own)


@R.add("t05_cell_keys", "SELECT k FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def cell_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys before or after."""
    own = frame(spark, sf_dir, "SELECT o_orderkey AS k FROM {orders}")
    return S.either(own.where("k % 2 = 0"), own.where("k % 3 = 0"), ["k"])


@R.add("t06_line_union", f"SELECT l_orderkey AS doc, l_partkey AS p, 'table' AS reader FROM lineitem WHERE l_partkey % 2 = 0 UNION ALL SELECT l_orderkey, l_partkey, 'words' FROM lineitem a WHERE l_partkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey % 2 = 0 AND b.l_orderkey = a.l_orderkey AND b.l_quantity = a.l_quantity)")
def line_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a second reader that the first one doesn't have by quantity and price."""
    own = frame(spark, sf_dir, "SELECT l_orderkey AS doc, l_partkey AS p, cast(l_quantity as decimal(18,2)) AS qty, cast(1 as decimal(18,2)) AS price FROM {lineitem}")
    return S.line_union(own.where("p % 2 = 0").withColumn("reader", F.lit("table")), own.where("p % 3 = 0").withColumn("reader", F.lit("words"))).select("doc", "p", "reader")


@R.add("a18_columnar_checks", f"WITH l AS (SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS INT) + CASE WHEN l_orderkey % 6 = 0 THEN 1 ELSE 0 END AS serial, CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount FROM lineitem) SELECT doc, doc % 6 <> 0 AS contiguous, doc % 5 <> 0 AS sums FROM l GROUP BY doc")
def columnar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial numbers run from one without a gap, and the amounts make the net."""
    lines = frame(spark, sf_dir, f"SELECT l_orderkey AS doc, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) as int) + CASE WHEN l_orderkey % 6 = 0 THEN 1 ELSE 0 END AS serial, cast(l_extendedprice as decimal(18,2)) AS amount FROM {{lineitem}}")
    heads = lines.groupBy("doc").agg(F.sum("amount").alias("s")).select("doc", (F.col("s") + F.when(F.col("doc") % 5 == 0, 1).otherwise(0)).alias("net"))
    return S.columnar_checks(lines, heads)


@R.add("a27_tokens_per_page", "SELECT user_id AS doc, CAST(event_id % 4 AS INT) AS page, count(*) AS tokens FROM events GROUP BY ALL")
def tokens_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tokens_per_page(frame(spark, sf_dir, "SELECT user_id AS doc, cast(event_id % 4 as int) AS page FROM {events}"))


@R.add("a06_passing_orders", "SELECT o_custkey AS doc, CAST(count(DISTINCT o_orderkey) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS passing, count(*) AS candidates FROM orders GROUP BY o_custkey")
def passing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct orders of a document pass."""
    return S.passing(frame(spark, sf_dir, "SELECT o_custkey AS doc, o_orderkey AS order_no, o_orderkey % 3 = 0 AS passed FROM {orders}"))


@R.add("a32_template_fidelity", "SELECT o_custkey % 10 AS template, unnest(['number', 'net']) AS field, unnest([count(*), count(*)]) AS rows, unnest([CAST(count_if(o_orderkey % 4 <> 0) AS BIGINT), CAST(count_if(o_orderkey % 5 <> 0) AS BIGINT)]) AS equal FROM orders GROUP BY 1")
def template_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of a template's fields are the verified ones."""
    own = frame(spark, sf_dir, "SELECT o_custkey % 10 AS template, o_orderkey AS doc, cast(o_orderkey as string) AS number, '5' AS net FROM {orders}")
    made = own.withColumn("number", F.when(F.col("doc") % 4 == 0, "x").otherwise(F.col("number"))).withColumn("net", F.when(F.col("doc") % 5 != 0, F.col("net")))
    return S.fidelity(own, made, ["template", "doc"], ["number", "net"], "template")


@R.add("j27_equal_rows", f"SELECT a.l_orderkey AS doc, a.l_partkey AS p, b.l_partkey AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity = b.l_quantity WHERE a.l_partkey % 2 = 0 AND b.l_partkey % 2 = 1 AND a.l_partkey % 3 = b.l_partkey % 3")
def equal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables of a page that are the same line: quantity and price, and a code or text alike."""
    own = frame(spark, sf_dir, "SELECT l_orderkey AS doc, 1 AS page, l_partkey AS p, cast(l_quantity as decimal(18,2)) AS qty, cast(NULL as decimal(18,2)) AS price, cast(l_partkey % 3 as string) AS sku, cast(NULL as string) AS description FROM {lineitem}")
    return S.equal_rows(own.where("p % 2 = 0"), own.where("p % 2 = 1").withColumnRenamed("p", "q")).select("doc", "p", "q")


@R.add("j29_fuzzy_scan")
def fuzzy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's ratio with every distinct name."""
    from ..operators.fuzzy import ratios

    return names(spark, sf_dir).withColumn("r", ratios(F.col("name"), F.lit("blue rose soft"))).select("name", F.round("r.wide", 3).alias("score"))
