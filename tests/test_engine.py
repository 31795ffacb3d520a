from __future__ import annotations

import datetime
import gzip
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veritally.functions import dates as D
from veritally.functions import numbers as N
from veritally.functions import text as T
from veritally.operators import aggregates as A
from veritally.operators import catalog as C
from veritally.operators import check as K
from veritally.operators import fuzzy
from veritally.operators import ledger as L
from veritally.operators import match as M
from veritally.operators import pages as P
from veritally.sources import archive, workbook
from veritally.streaming import jobs


def values(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}").withColumn("y", function(F.col("x"))).orderBy("i").collect()
    return [r.y for r in rows]


def test_names_fold_alike_in_both_forms(spark):
    names = ["Café  Straße, ", "ÀÉÎ-õü", None, "", "L'Œuvre 7"]
    assert values(spark, lambda x: T.normalize_name(x, exact=True), names) == ["cafe strasse", "aei ou", None, "", "l œuvre 7"]
    assert values(spark, T.normalize_name, names) == ["cafe strasse", "aei ou", None, "", "l œuvre 7"]


def test_prefix_and_barcode(spark):
    assert values(spark, T.strip_prefix, ["ULT_0123", "ult_9", "ULTX", " ULT_1", None]) == ["0123", "9", "ULTX", "1", None]
    assert values(spark, N.gtin_valid, ["4006381333931", "4006381333930", "", None, "12ab5678"]) == [True, False, False, False, False]
    assert values(spark, lambda x: N.classify_barcode(x)["reason"], ["EAN: 4006381333931", "4006381333930", "40 06?", None]) == [None, "misprint", "unreadable", None]
    assert values(spark, N.variant_upc, ["AB-036000291452", "036000291452-ZZ", "AB-036000291453", "AB-036000291452-999"]) == ["036000291452", "036000291452", None, "036000291452"]


def test_ocr_variants(spark):
    assert sorted(values(spark, N.ocr_variants, ["I0", "AB", "OOOOOOOOO"])[0]) == ["10", "1O", "IO"]
    assert values(spark, N.ocr_variants, ["AB", "OOOOOOOOO", None]) == [[], [], []]


def test_decimals(spark):
    assert values(spark, N.to_decimal, ["1,234.5", "x", "", None]) == [Decimal("1234.500000"), None, None, None]
    assert values(spark, N.clue, ["1,234", "12,34", ".5"]) == [Decimal("1234.000000"), None, Decimal("0.500000")]
    assert values(spark, N.printed_decimal, ["(1 250.00)", "AED 1.234.56", "n/a"]) == [Decimal("-1250.000000"), Decimal("1234.560000"), None]
    got = spark.sql("select cast(2.345 as decimal(10,4)) as v, 2 as p union all select cast(-2.345 as decimal(10,4)), 2 union all select cast(2.3455 as decimal(10,4)), 3").select(N.round_to(F.col("v"), F.col("p")).alias("r")).collect()
    assert [r.r for r in got] == [Decimal("2.3500"), Decimal("-2.3500"), Decimal("2.3460")]


def test_dates(spark):
    day = datetime.date(2031, 3, 25)
    assert values(spark, D.parse, ["25-Mar-31", "2031-03-25", "25/03/2031", "03/25/2031", "04/03/2031", "31/02/2031", ""]) == [day, day, day, day, None, None, None]
    assert values(spark, D.table_date, ["04.03.2031", "2031-99-99"]) == ["2031-03-04", "2031-99-99"]
    assert values(spark, lambda x: D.same_date(F.lit("2031-03-03"), x), ["3rd March 2031", "03-03-31", "4 March 2031"]) == [True, True, False]


def test_unique_or_null_never_picks_on_a_tie(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "X", 2), ("b", "x", 1), ("b", "y", 2), ("c", None, 1)], "g string, v string, n int")
    got = rows.groupBy("g").agg(A.unique_or_null(F.col("v"), F.col("n"), F.lower("v")).alias("v")).collect()
    assert {r.g: r.v for r in got} == {"a": "x", "b": None, "c": None}


def test_sums_with_a_gap_are_null_and_constraints_fall_back(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", None, False), ("b", 2, False), ("b", 3, False)], "g string, v int, ok boolean")
    assert {r.g: r.s for r in rows.groupBy("g").agg(A.complete_sum(F.col("v")).alias("s")).collect()} == {"a": None, "b": 5}
    assert A.keep_or_fall_back(rows, ["g"], F.col("ok")).groupBy("g").count().orderBy("g").collect() == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="more than 3 rows"):
        A.bounded(rows, 3).collect()
    assert A.bounded(rows, 4).count() == 4


def test_line_match(spark):
    items = spark.createDataFrame([("111", "V1", "P1", "S1"), ("222", "V2", "P2", "S1"), ("222", "V2", "P3", "S2"), ("333", "VO", "P4", "S1")], "item_code string, vpn string, parent string, supplier string")
    lines = spark.createDataFrame([(1, 1, "ULT_111", None, None), (1, 2, "222", None, None), (1, 3, None, "V1", None), (1, 4, "111", "V2", None), (1, 5, None, None, "no code"), (1, 6, None, "V0", None)], "doc int, line int, gtin string, sku string, description string")
    got = {r.line: (r.parent, r.status, r.method) for r in M.match_lines(lines, items, ["doc", "line"]).collect()}
    open_ = (None, "Item Exception", None)
    assert got == {1: ("P1", "Matched", "Barcode exact"), 2: open_, 3: ("P1", "Matched", "VPN exact"), 4: ("P1", "Item Conflict", "Barcode exact"), 5: open_, 6: open_}
    sites = spark.createDataFrame([(1, "S1")], "doc int, site string")
    got = {r.line: (r.parent, r.status) for r in M.match_lines(lines, items, ["doc", "line"], sites).collect()}
    assert got[2] == ("P2", "Matched")
    assert [(r.line, r.variant, r.parent) for r in M.ocr_matches(lines, items, ["doc", "line"], sites).collect()] == [(6, "VO", "P4")]


def test_order_selection_is_ambiguous_on_two(spark):
    groups = spark.createDataFrame([("K", 1, Decimal(5), Decimal(10)), ("K", 2, Decimal(5), Decimal(10)), ("K", 3, Decimal(7), Decimal(11))], "key string, order long, received decimal(9,2), cost decimal(9,2)")
    invoices = spark.createDataFrame([(1, "K", Decimal(5), Decimal(10), "USD", None), (2, "K", Decimal(7), Decimal(12), "KWD", None), (3, "K", Decimal(9), Decimal(1), "USD", 3), (4, "X", Decimal(1), Decimal(1), "USD", None), (5, "K", Decimal(1), Decimal(1), "USD", 9)], "doc int, key string, quantity decimal(9,2), value decimal(9,2), invoice_currency string, printed_order long")
    got = {r.doc: (r.order, r.status) for r in M.select_orders(invoices, groups).collect()}
    assert got == {1: (None, "ambiguous"), 2: (3, "selected"), 3: (3, "selected"), 4: (None, "missing"), 5: (None, "printed order unknown")}


def test_balances_run_within_an_allocation(spark):
    lines = spark.createDataFrame([(1, "k", Decimal(4)), (2, "k", Decimal(4))], "line int, key string, qty decimal(9,2)")
    receipts = spark.createDataFrame([("k", Decimal(6), "accepted"), ("k", Decimal(-1), "accepted"), ("k", Decimal(9), "pending")], "key string, qty decimal(9,2), status string")
    orders = spark.createDataFrame([("k", Decimal(20), Decimal(0))], "key string, ordered decimal(9,2), invoiced decimal(9,2)")
    used = spark.createDataFrame([], "key string, used decimal(9,2)")
    got = L.balances(lines, orders, L.accepted(receipts), used, ["line"], ["key"]).orderBy("line").collect()
    assert [(r.needed, r.available, r.over_received) for r in got] == [(4, 5, False), (8, 5, True)]


def test_deletion_keeps_allocations(spark):
    schema = "id string, invoice_key string, batch_id string, allocations array<struct<key:string,qty:int>>"
    exports = spark.createDataFrame([("1", "a", "b1", [("k", 1)]), ("2", "a", "b1", [("m", 2)]), ("3", "c", "b2", [("n", 3)])], schema)
    remaining, stones = L.delete_invoices(exports, exports.limit(0), exports.where("batch_id = 'b1'"))
    assert [r.id for r in remaining.collect()] == ["3"]
    assert sorted(a.key for a in stones.collect()[0].allocations) == ["k", "m"]
    assert [r.batch_id for r in L.whole_batches(exports, exports.where("id = '1'")).collect()] == ["b1"]


def test_page_segments(spark):
    pages = [
        ("a", 1, "Invoice No: INV-001"), ("a", 2, "continued"), ("a", 3, "Invoice No: INV-002"),
        ("b", 1, "Page 1 of 2"), ("b", 2, "Invoice No: B-77"),
        ("c", 1, "Invoice No: C-101"), ("c", 2, "Invoice No: C-102"), ("c", 3, "Invoice No: C-101"),
        ("d", 1, ""), ("d", 2, None), ("e", 1, "Invoice # E-11"), ("e", 2, "Page 1 of 1"), ("e", 3, "Invoice # E-12"),
    ]
    got = {r.doc: ([(s.number, s.pages) for s in r.segments], r.refused) for r in P.segments(spark.createDataFrame(pages, "doc string, page_no int, text string")).collect()}
    assert got["a"] == ([("INV-001", [1, 2]), ("INV-002", [3])], False)
    assert got["b"] == ([("B-77", [1, 2])], False)
    assert got["c"] == ([], True)
    assert got["d"] == ([(None, [1, 2])], False)
    assert got["e"] == ([("E-11", [1]), ("E-12", [2, 3])], False)


def test_checks(spark):
    assert values(spark, lambda x: K.printed(x, F.lit("1,200.50")), ["total 1200.5 due", "none", " "]) == [True, False, None]
    assert values(spark, K.tax_label_printed, ["VAT 5%: 10", "Tax Invoice", "VAT Reg No 12", "", None]) == [True, False, False, False, False]
    got = spark.sql("select 3 as r, cast(130 as decimal(9,2)) as n, cast(100 as decimal(9,2)) as e, cast(null as int) as p union all select 3, 130, 100, 5").select(K.missing_lines(F.col("r"), F.col("n"), F.col("e"), F.col("p")).alias("k")).collect()
    assert [r.k for r in got] == [1, 2]
    assert K.template_problems({"Header": spark.createDataFrame([], "a int")})[0] == "Tax_Breakdown: missing"


def test_fuzzy_ranks_typos_first(spark):
    assert fuzzy.ratio("abcd", "abcd") == 100 and fuzzy.common_length("kitten", "sitting") == 4
    names = spark.createDataFrame([("rose lipstick 3ml",), ("lipstick rose 5ml",), ("garden hose",), ("rose lipstick 3ml",)], "name string")
    got = [r.name for r in fuzzy.similar_names(names, "rose lipstcik 3ml").collect()]
    assert got[0] == "rose lipstick 3ml" and len(got) == len(set(got))


def test_archive_round_trip(spark, tmp_path):
    rows = [{"kind": "item", "source_hash": "a" * 64, "source_sheet": "S", "source_row": i, "keys": [], "data": {"SKU": f"AB{i}", "Item description": "Rose Été"}, "flags": []} for i in (1, 2)]
    path = tmp_path / "in.ndjson.gz"
    path.write_bytes(gzip.compress("\n".join(json.dumps(r) for r in rows).encode()))
    manifest = {"manifest_version": "1", "expected_counts": {"item": 2, "total": 2}, "sources": [{"hash": "a" * 64, "kind": "item", "count": 2}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    own = archive.read_manifest(spark, str(tmp_path / "m.json"))
    archive.publish(spark, archive.read_archive(spark, str(path)), own, str(tmp_path / "out"))
    found, index = archive.current(spark, str(tmp_path / "out"))
    assert found.count() == 2
    got = C.page(C.search(index, "item", C.search_terms("ab1", "ab1")), 5).collect()
    assert len(got) == 1 and got[0].score == C.EXACT_ID + C.PART
    with pytest.raises(ValueError, match="counts"):
        archive.publish(spark, archive.read_archive(spark, str(path)), {**own, "sources": [{"hash": "a" * 64, "kind": "item", "count": 3}]}, str(tmp_path / "out"))
    assert archive.current(spark, str(tmp_path / "out"))[0].count() == 2
    assert C.read_cursor(C.cursor("q", 5, "x"), "q") == (5, "x")
    with pytest.raises(ValueError, match="another query"):
        C.read_cursor(C.cursor("q", 5, "x"), "p")


def test_workbook_round_trip(spark, tmp_path):
    workbook.write_xlsx({"Header": [["a", 1], ["=b", None]], "Details": [[], ["x"]]}, str(tmp_path / "w.xlsx"))
    (tmp_path / "bad.xlsx").write_bytes(b"no")
    got = {(r.sheet, r.row_no): list(r.cells) for r in workbook.read_workbooks(spark, str(tmp_path / "w.xlsx")).collect()}
    assert got == {("Header", 1): ["a", "1"], ("Header", 2): ["=b", ""], ("Details", 2): ["x"]}
    assert workbook.read_workbooks(spark, str(tmp_path / "bad.xlsx")).collect()[0].problem


def test_stream_keeps_latest_revision(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "id string, revision int, status string"
    for i, rows in enumerate(([("a", 1, "queued"), ("b", 1, "queued")], [("a", 3, "ready"), ("a", 2, "review")])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("id", "revision", "status"), r, strict=True))) for r in rows))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = jobs.incoming(spark, str(tmp_path / "in"), schema, at_once=1)
    query = jobs.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = {r.id: (r.revision, r.status) for r in jobs.kept(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": (3, "ready"), "b": (1, "queued")}
    assert {r.status for r in jobs.interrupted(jobs.kept(spark, str(tmp_path / "out"), before=1)).collect()} == {"error"}


def test_every_query_runs_on_the_small_tables(spark, small):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
