"""Queries for the functions of one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from .registry import Registry, read

R = Registry()

FOLD = "replace(strip_accents(lower({x})), 'ß', 'ss')"
NAME = f"trim(regexp_replace({FOLD}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
R.scalar("f01_normalize_name", "documents", "doc_id", "text", lambda x: T.normalize_name(x, exact=True), NAME)
R.scalar("f02_normalize_identifier", "documents", "doc_id", "text", T.normalize_identifier, f"replace({NAME}, ' ', '')")
R.scalar("f03_fold", "documents", "doc_id", "text", T.fold, FOLD)
R.scalar("f04_name_key", "documents", "doc_id", "text", lambda x: T.name_key(x, exact=True), f"regexp_replace({FOLD}, '[^\\p{{L}}\\p{{N}}]', '', 'g')")
R.scalar(
    "f05_strip_prefix", "part", "p_partkey", "concat(case when p_partkey % 3 = 0 then 'ULT_' when p_partkey % 3 = 1 then ' ult_' else '' end, lpad(cast(p_partkey as string), 12, '0'))", T.strip_prefix,
    "CASE WHEN upper(trim({x})[1:4]) = 'ULT_' THEN trim({x})[5:] ELSE trim({x}) END",
)
R.scalar("f06_normalize_barcode", "customer", "c_custkey", "concat(' 5-', lpad(cast(c_custkey as string), 8, '0'), '. ', c_nationkey, '/7 ')", T.normalize_barcode, r"regexp_replace(trim({x}), '[\s\-./]', '', 'g')")
UNITS_SQL = NAME.replace("[^\\p{L}\\p{N}]+", "[^\\p{L}\\p{N}_#]+")
_inner = FOLD
for _pattern, _unit in [
    (r"(\d)\s*(ml|millilit(?:er|re)s?)\b", "$1ml"), (r"(\d)\s*(g|gm|gms|grams?)\b", "$1g"), (r"(\d)\s*(kg|kilograms?)\b", "$1kg"), (r"(\d)\s*(l|lit(?:er|re)s?)\b", "$1l"),
    (r"(\d)\s*(oz|ounces?)\b", "$1oz"), (r"(\d)\s*(pcs?|pieces?)\b", "$1pc"),
]:
    _inner = f"regexp_replace({_inner}, '{_pattern}', '{_unit.replace('$', chr(92))}', 'g')"
R.scalar(
    "f07_normalize_description", "part", "p_partkey",
    "concat(p_name, ' (', p_size, case when p_partkey % 4 = 0 then ' ML' when p_partkey % 4 = 1 then ' grams' when p_partkey % 4 = 2 then 'Litres' else ' pieces' end, ') #', p_size, ' Été')",
    T.normalize_description, f"trim(regexp_replace({_inner}, '[^\\p{{L}}\\p{{N}}_#]+', ' ', 'g'))",
)
R.scalar("f10_squash", "documents", "doc_id", "text", T.squash, r"lower(regexp_replace({x}, '\s+', '', 'g'))")
R.scalar("f11_alnum_fold", "documents", "doc_id", "text", T.alnum_fold, "regexp_replace(lower({x}), '[^0-9a-z]', '', 'g')")
_company = "'co', 'company', 'llc', 'l', 'c', 'wll', 'w', 'ltd', 'limited', 'inc', 'plc', 'spc', 'corp', 'corporation', 'fzco', 'fze', 'fzllc', 'fz', 'est', 'establishment', 'gmbh', 'sa', 'bv'"
R.scalar(
    "f12_entity_tokens", "supplier", "s_suppkey", "concat(s_name, case when s_suppkey % 3 = 0 then ' Trading L.L.C' when s_suppkey % 3 = 1 then ' Łódź Ő Est' else ' & Sóns GmbH' end)", lambda x: F.array_join(T.entity_tokens(x), " "),
    "array_to_string(list_filter(regexp_extract_all(" + FOLD + f", '[a-z0-9]+'), lambda t: t NOT IN ({_company})), ' ')",
)
R.scalar(
    "f13_has_words", "documents", "doc_id", "text", lambda x: T.has_words(T.tokens(x), F.array(F.lit("of"), F.lit("the"))),
    "contains(' ' || array_to_string(regexp_extract_all(" + FOLD + ", '[a-z0-9]+'), ' ') || ' ', ' of the ')",
)
SITE = "concat('c', lpad(cast(c_custkey as string), 5, '0'), case when c_custkey % 4 = 0 then ' ra1kwd' when c_custkey % 4 = 1 then 'AE2' when c_custkey % 4 = 2 then 'x9' else '' end)"
UPPER = r"upper(regexp_replace({x}, '\s+', '', 'g'))"
R.scalar("f15_supplier_key", "customer", "c_custkey", SITE, T.supplier_key, f"CASE WHEN length({UPPER}) >= 6 THEN {UPPER}[1:6] END")
R.scalar("f16_entity", "customer", "c_custkey", SITE, lambda x: T.entity_hint(x)["entity"], f"CASE WHEN regexp_matches({UPPER}[7:], '^[A-Z]{{2}}\\d([A-Z]{{3}})?$') THEN {UPPER}[7:9] END")
R.scalar("f16_currency_hint", "customer", "c_custkey", SITE, lambda x: T.entity_hint(x)["currency_hint"], f"CASE WHEN regexp_matches({UPPER}[7:], '^[A-Z]{{2}}\\d([A-Z]{{3}})?$') THEN nullif({UPPER}[10:], '') END")
R.scalar("h07_site_entity", "customer", "c_custkey", SITE, T.entity_suffix, f"{UPPER}[7:]")
R.scalar(
    "f17_safe_text", "customer", "c_custkey", "concat(case when c_custkey % 5 = 0 then ' =' when c_custkey % 5 = 1 then '@' when c_custkey % 5 = 2 then concat('a', chr(9)) else '' end, c_name)", T.is_safe_text,
    r"NOT regexp_matches({x}, '[\x00-\x1F\x7F]') AND NOT regexp_matches(ltrim({x}), '^[=+\-@]') AND length({x}) <= 500",
)
R.scalar(
    "f18_party_name", "customer", "c_custkey", "concat(case when c_custkey % 2 = 0 then 'Bill To: Buyer - ' else 'BUYER ' end, c_name, case when c_custkey % 3 = 0 then ' P.O. Box 12' else ' Tel 4' end)", T.clean_party_name,
    r"regexp_replace(regexp_replace({x}, '^(Bill To: Buyer - |BUYER )', ''), '( P\.O\. Box 12| Tel 4)$', '')",
)
R.scalar("f19_slug", "customer", "c_custkey", "concat('--', c_name, ' / ', c_mktsegment, '!')", T.slug, r"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60]")
R.scalar("f20_safe_file_name", "customer", "c_custkey", "concat(c_name, ' (', c_mktsegment, ').xlsx')", T.safe_file_name, r"regexp_replace({x}, '[^A-Za-z0-9._-]+', '_', 'g')")
R.scalar(
    "f21_part_file_name", "orders", "o_orderkey", "concat('scan', o_orderkey, '.pdf')", lambda x: T.part_file_name(x, F.lit(2), F.lit(3), F.regexp_extract(x, r"(\d+)", 1)),
    r"regexp_replace({x}, '\.[^.]*$', '') || ' [2 of 3 ' || regexp_extract({x}, '(\d+)', 1) || ']' || regexp_extract({x}, '(\.[^.]*)$', 1)",
)
FACTS = "concat(p_name, case when p_partkey % 2 = 0 then concat(' SKU: ', p_partkey) else '' end, ', COO: ', p_brand, ' HS Code: 33', p_size)"
R.scalar("f23_description", "part", "p_partkey", FACTS, lambda x: T.description_facts(x)["description"], r"trim(regexp_extract({x}, '(?i)^(.*?)[\s,;|]*\b(?:sku|coo|hs code)\s*:', 1))")
R.scalar("f23_sku", "part", "p_partkey", FACTS, lambda x: T.description_facts(x)["sku"], r"nullif(trim(regexp_extract({x}, '(?i)\bsku\s*:\s*(.*?)[\s,;|]*\bcoo\s*:', 1)), '')")
R.scalar("f23_hs_code", "part", "p_partkey", FACTS, lambda x: T.description_facts(x)["hs_code"], r"nullif(trim(regexp_extract({x}, '(?i)\bhs code\s*:\s*(.*)$', 1)), '')")
R.scalar("f29_text_key", "documents", "doc_id", "text", T.text_key, r"nullif(regexp_replace({x}, '\s+', '', 'g'), '')")
R.scalar(
    "f28_evidence_kind", "events", "event_id", "case when event_id % 5 = 0 then 'owner' when event_id % 5 = 1 then 'Sheet1!12' when event_id % 5 = 2 then 'R-004' end",
    lambda x: T.evidence_kind(x, F.when(F.length(x) == 5, x), F.lit(False)),
    r"CASE WHEN {x} = 'owner' THEN 'owner entry' WHEN length({x}) = 5 THEN 'printed' WHEN regexp_matches({x}, '^[^!]+!\d+$') THEN 'source row' WHEN {x} IS NOT NULL THEN 'rule' ELSE 'none' END",
)

HEADERS = [
    "ITEM", "Item Code", "EAN / UPC", "Pack size", "Pack description", "Supplier Name", "Vendor site", "Store name", "Purchase Order No", "Short text",
    "Unit of Measure", "Colour", "Article number", "Warehouse", "Item description", "Barcode", "SKU", "Name", "P.O. number", "",
]
_own = "trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g'))"
_words = f"string_split({_own}, ' ')"


@R.add(
    "f26_header_roles",
    f"""SELECT header, CASE WHEN {_own} IN ('item', 'item id', 'item code', 'item number', 'rms item id') THEN 'internal_item' ELSE concat_ws(',',
      CASE WHEN list_has_any({_words}, ['gtin', 'upc', 'ean', 'barcode']) THEN 'gtin' END, CASE WHEN {_own} IN ('uom', 'unit', 'unit of measure', 'base unit', 'order unit') THEN 'uom' END,
      CASE WHEN list_contains({_words}, 'pack') AND NOT list_has_any({_words}, ['description', 'name']) THEN 'pack' END,
      CASE WHEN list_has_any({_words}, ['supplier', 'vendor']) THEN 'supplier' END,
      CASE WHEN list_has_any({_words}, ['site', 'plant', 'warehouse', 'branch']) OR {_own} IN ('location', 'location code', 'location name', 'store', 'store code', 'store name') THEN 'site' END,
      CASE WHEN {_own} IN ('po', 'po no', 'po number', 'purchase order', 'purchase order no', 'purchase order number', 'purchasing document') THEN 'po' END,
      CASE WHEN list_contains({_words}, 'description') OR {_own} IN ('name', 'item name', 'product name', 'material name', 'short text', 'article name') THEN 'description' END,
      CASE WHEN {_own} IN ('sku', 'item', 'item code', 'item id', 'item number', 'material', 'material code', 'material id', 'material number', 'product code', 'product id', 'article', 'article code', 'article number', 'internal item') THEN 'sku' END) END AS roles FROM (VALUES {', '.join(f"('{h}')" for h in HEADERS)}) AS t(header)""",
)
def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HEADERS], "header string").select("header", F.array_join(T.header_roles(F.col("header")), ",").alias("roles"))


AMOUNT = "concat(' ', case when o_orderkey % 4 = 0 then '1,' else '' end, cast(o_orderkey % 1000 + 100 as string), '.', lpad(cast(o_orderkey % 100 as string), 2, '0'), case when o_orderkey % 7 = 0 then 'x' else '' end)"
PLAIN = "try_cast(replace(trim({x}), ',', '') AS DECIMAL(38, 6))"
R.scalar("n01_to_decimal", "orders", "o_orderkey", AMOUNT, N.to_decimal, PLAIN)
R.scalar(
    "n02_clue", "orders", "o_orderkey", AMOUNT, N.clue,
    r"CASE WHEN regexp_full_match(trim({x}), '[+-]?(?:(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?|\.\d+)') AND length(trim({x})) <= 80 AND abs(" + PLAIN + r") <= 1000000000000000000 THEN " + PLAIN + " END",
)
PRINTED = "concat(case when o_orderkey % 3 = 0 then 'AED ' when o_orderkey % 3 = 1 then '(' else '$' end, cast(o_orderkey % 900 + 1 as string), case when o_orderkey % 2 = 0 then ' 250' else '.250' end, '.', lpad(cast(o_orderkey % 100 as string), 2, '0'), case when o_orderkey % 3 = 1 then ')' else '' end)"
_codes = r"trim(regexp_replace(upper({x}), 'AED|KWD|USD|EUR|GBP|SAR|QAR|OMR|BHD|[$€£]', '', 'g'))"
_cleaned = rf"regexp_replace(regexp_replace({_codes}, '[(),\s]', '', 'g'), '^(\d+)\.(\d{{3}}\.)', '\1\2')"
R.scalar(
    "n03_printed_decimal", "orders", "o_orderkey", PRINTED, N.printed_decimal,
    rf"CASE WHEN regexp_full_match({_cleaned}, '[+-]?\d+(?:\.\d+)?') THEN CASE WHEN {_codes} LIKE '(%)' THEN -1 ELSE 1 END * try_cast({_cleaned} AS DECIMAL(30, 6)) END::DECIMAL(38, 6)",
)
R.scalar("n04_plain_decimal", "orders", "o_orderkey", AMOUNT, N.plain_decimal, r"CASE WHEN regexp_full_match(replace(trim({x}), ',', ''), '\d{1,24}(?:\.\d{1,6})?') THEN " + PLAIN + " END")
R.scalar(
    "n05_entered_decimal", "orders", "o_orderkey", "concat(case when o_orderkey % 5 = 0 then '0' when o_orderkey % 5 = 1 then '-' else '' end, cast(o_orderkey % 700 + 1 as string), '.', cast(o_orderkey as string))", N.entered_decimal,
    r"CASE WHEN regexp_full_match({x}, '(0|[1-9]\d*)(\.\d{1,4})?') THEN try_cast({x} AS DECIMAL(24, 4)) END",
)
GTIN = "lpad(cast(p_partkey * 7919 + 40063813 as string), case when p_partkey % 5 = 0 then 8 when p_partkey % 5 = 1 then 12 when p_partkey % 5 = 2 then 14 when p_partkey % 5 = 3 then 13 else 11 end, '0')"


def checked(x: str) -> str:
    """SQL of the check digit test of a run of digits."""
    return f"(10 - list_sum(list_transform(range(1, length({x})), lambda i: CAST(reverse({x}[1:length({x}) - 1])[i:i] AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(right({x}, 1) AS INT)"


VALID = f"length({{x}}) IN (8, 12, 13, 14) AND {checked('{x}')}"
R.scalar("n07_gtin_valid", "part", "p_partkey", GTIN, N.gtin_valid, VALID)
R.scalar("n08_upc_valid", "part", "p_partkey", GTIN, N.upc_valid, f"length({{x}}) = 12 AND {checked('{x}')}")
R.scalar("n09_gs1_valid", "part", "p_partkey", GTIN, N.gtin_valid, VALID)
CODE = f"concat(case when p_partkey % 3 = 0 then 'EAN: ' when p_partkey % 7 = 0 then '? ' else '' end, {GTIN}, case when p_partkey % 11 = 0 then ' x' else '' end)"
DIGITS = r"regexp_replace(trim({x}), '^[^0-9]*', '')"
R.scalar("n11_barcode_digits", "part", "p_partkey", CODE, N.barcode_digits, rf"CASE WHEN regexp_full_match({DIGITS}, '\d+') THEN {DIGITS} END")
_sized = rf"regexp_full_match({DIGITS}, '\d{{8,14}}')"
_valid = VALID.replace("{x}", f"({DIGITS})")
R.scalar("n10_classify_gtin", "part", "p_partkey", CODE, lambda x: N.classify_barcode(x)["gtin"], f"CASE WHEN {_sized} THEN CASE WHEN {_valid} THEN {DIGITS} END END")
R.scalar("n10_classify_reason", "part", "p_partkey", CODE, lambda x: N.classify_barcode(x)["reason"], f"CASE WHEN NOT {_sized} THEN 'unreadable' WHEN NOT ({_valid}) THEN 'misprint' END")
R.scalar(
    "n12_similarity", "lineitem", "l_orderkey,l_linenumber,l_partkey,l_suppkey", "case when l_partkey % 9 <> 0 then cast(l_extendedprice as decimal(18,2)) end", lambda x: F.round(N.similarity(x, F.lit(30000).cast("decimal(18,2)")), 9),
    "CASE WHEN {x} IS NOT NULL THEN round(greatest(0.0, 1 - CAST(abs({x} - 30000) AS DOUBLE) / CAST(greatest(abs({x}), 30000, 0.000001) AS DOUBLE)), 9) END",
)
R.scalar("n13_places", "orders", "o_orderkey", AMOUNT, N.places, "CASE WHEN contains({x}, '.') THEN length(split_part({x}, '.', -1)) ELSE 0 END::INT")
CURRENCY = "case when c_custkey % 4 = 0 then ' kwd' when c_custkey % 4 = 1 then 'AED' when c_custkey % 4 = 2 then 'OMR' else 'XXX' end"
R.scalar("n14_decimals", "customer", "c_custkey", CURRENCY, N.decimals, f"CASE WHEN upper(trim({{x}})) IN ('KWD', 'BHD', 'OMR', 'JOD', 'IQD', 'TND', 'LYD') THEN 3 ELSE 2 END")
R.scalar("n14_policy_decimals", "customer", "c_custkey", CURRENCY, lambda x: N.decimals(x, N.POLICY_DECIMALS), "CASE WHEN upper(trim({x})) = 'KWD' THEN 3 ELSE 2 END")
VPN = "concat(case when p_partkey % 3 = 0 then 'I' else 'A' end, cast(p_partkey as string), case when p_partkey % 2 = 0 then 'O' else 'X' end)"


@R.add(
    "n17_ocr_variants",
    f"""WITH v AS (SELECT p_partkey, {VPN} AS x FROM part), p AS (SELECT p_partkey, x, list_filter(range(1, length(x) + 1), lambda i: x[i:i] IN ('I', '1', 'O', '0')) AS spots FROM v),
    m AS (SELECT p_partkey, x, spots, unnest(range(1, CAST(2 ** len(spots) AS BIGINT))) AS mask FROM p WHERE len(spots) BETWEEN 1 AND 8)
    SELECT p_partkey, array_to_string(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN list_contains(spots, i) AND (mask >> (list_position(spots, i) - 1)) & 1 = 1 THEN translate(x[i:i], 'I1O0', '1I0O') ELSE x[i:i] END), '') AS variant FROM m""",
)
def ocr_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(N.ocr_variants(F.expr(VPN))).alias("variant"))


UPC12 = "lpad(cast(p_partkey * 7919 + 36000291 as string), 12, '0')"
VARIANT = f"case when p_partkey % 3 = 0 then concat('AB-', {UPC12}) when p_partkey % 3 = 1 then concat({UPC12}, '-ZZ') else concat('AB-', {UPC12}, '-99') end"
_core = r"regexp_extract({x}, '(\d{12})', 1)"
R.scalar("n18_variant_upc", "part", "p_partkey", VARIANT, N.variant_upc, f"CASE WHEN {checked(_core)} THEN {_core} END")
RUNS = f"concat(p_name, ' ', {GTIN}, case when p_partkey % 3 = 0 then ' 12345678' else '' end)"
_runs = r"list_distinct(list_filter(regexp_extract_all({x}, '\d+'), lambda r: length(r) IN (8, 12, 13, 14)))"
R.scalar("n19_gtin_in_text", "part", "p_partkey", RUNS, N.gtin_in_text, f"CASE WHEN len({_runs}) = 1 THEN {_runs}[1] ELSE {{x}} END")
_tail = r"regexp_extract({x}, '(?:^|\s)(\d{8}|\d{12,14})\s*$', 1)"
R.scalar("n20_split_barcode", "part", "p_partkey", f"concat(p_name, ' ', {GTIN})", lambda x: N.split_barcode(x)["barcode"], f"CASE WHEN {_tail} <> '' THEN CASE WHEN {VALID.replace('{x}', _tail)} THEN {_tail} END END")
R.scalar("a07_value_tolerance", "customer", "c_custkey", "trim(" + CURRENCY + ")", N.value_tolerance, "CASE upper({x}) WHEN 'KWD' THEN 1 WHEN 'AED' THEN 2 ELSE 0 END::DECIMAL(4, 2)")


@R.add(
    "n06_round_by_currency",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN round(x, 2) WHEN 1 THEN round(x, 3) ELSE round(x, 0) END::DECIMAL(38, 4) AS value
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) * CAST(1.0505 AS DECIMAL(5, 4)) AS x FROM orders)""",
)
def round_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.expr("case o_orderkey % 3 when 0 then 2 when 1 then 3 else 0 end")
    amount = F.col("o_totalprice").cast("decimal(18,2)") * F.lit("1.0505").cast("decimal(5,4)")
    return read(spark, sf_dir, "orders").select("o_orderkey", N.round_to(amount, places).alias("value"))


@R.add(
    "n16_dropped_point",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18, 4)) AS q, CAST(l_partkey % 90 + 10 AS DECIMAL(18, 4)) AS p,
      CAST(CAST(l_quantity AS DECIMAL(18, 4)) * (l_partkey % 90 + 10) / CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 1000 ELSE 7 END AS DECIMAL(18, 4)) AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a = q * p THEN NULL WHEN a = CAST(q * p / 10 AS DECIMAL(18, 4)) THEN 1 WHEN a = CAST(q * p / 100 AS DECIMAL(18, 4)) THEN 2 WHEN a = CAST(q * p / 1000 AS DECIMAL(18, 4)) THEN 3 END AS shift FROM t""",
)
def dropped_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, price = F.col("l_quantity").cast("decimal(18,4)"), (F.col("l_partkey") % 90 + 10).cast("decimal(18,4)")
    divisor = F.expr("cast(case l_partkey % 5 when 0 then 1 when 1 then 10 when 2 then 100 when 3 then 1000 else 7 end as decimal(4,0))")
    amount = (quantity * price / divisor).cast("decimal(18,4)")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.dropped_point(quantity, price, F.array(amount)).alias("shift"))


DAY = "concat(cast(day(o_orderdate) as string), '/', cast(month(o_orderdate) as string), '/', cast(year(o_orderdate) as string))"
_d, _m, _y = "day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)"
_date = "CAST(o_orderdate AS DATE)"


@R.add("d01_ambiguous_date", f"SELECT o_orderkey, {_d} <= 12 AND {_m} <= 12 AND {_d} <> {_m} AS ambiguous FROM orders")
def ambiguous_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", D.ambiguous(F.expr(DAY)).alias("ambiguous"))


@R.add("d02_parse_date", f"SELECT o_orderkey, CASE WHEN {_d} > 12 OR {_d} = {_m} THEN {_date} END AS value FROM orders")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", D.parse(F.expr(DAY)).alias("value"))


@R.add("d03_table_date", f"SELECT o_orderkey, CAST({_date} AS VARCHAR) AS value FROM orders")
def table_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = F.expr("case when o_orderkey % 2 = 0 then cast(cast(o_orderdate as date) as string) else replace(" + DAY + ", '/', '.') end")
    return read(spark, sf_dir, "orders").select("o_orderkey", D.table_date(dotted).alias("value"))


@R.add("d04_long_date", f"SELECT o_orderkey, {_date} AS value FROM orders")
def long_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", D.long_date(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("value"))


@R.add("d05_same_date", "SELECT o_orderkey, TRUE AS same FROM orders")
def same_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    return read(spark, sf_dir, "orders").select("o_orderkey", D.same_date(F.to_date("o_orderdate").cast("string"), printed).alias("same"))


R.scalar("d07_day", "orders", "o_orderkey", "concat(cast(cast(o_orderdate as date) as string), case when o_orderkey % 2 = 0 then 'T10:00' else '' end)", D.day, "try_cast({x}[1:10] AS DATE)")
