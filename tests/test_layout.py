from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from veritally.operators import access as X
from veritally.operators import layout as Y
from veritally.operators import pages as P
from veritally.operators import readers as D
from veritally.operators import reading as Q


def test_rows_and_columns_of_words(spark):
    words = [("d", 1, "Qty", 100.0, 120.0, 10.0, 20.0), ("d", 1, "Item", 0.0, 30.0, 11.0, 21.0), ("d", 1, "5", 105.0, 110.0, 40.0, 50.0), ("d", 1, "rose", 2.0, 30.0, 41.0, 51.0), ("d", 1, "red", 35.0, 50.0, 40.5, 50.5)]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double, bottom double")
    assert [r.text for r in P.rows_of_words(df).orderBy("row_no").collect()] == ["Item Qty", "rose red 5"]
    numbered = df.withColumn("row_no", F.when(F.col("top") < 30, 1).otherwise(2))
    got = Y.bucketed(numbered, [("item", 0, 80), ("qty", 80, 200)]).orderBy("row_no").collect()
    assert [(r.item, r.qty) for r in got] == [("Item", "Qty"), ("rose red", "5")]
    heads = numbered.where("row_no = 1").select("doc", "page", F.col("text").alias("label"), "x0", "x1")
    assert {r.label: (r.left, r.right) for r in Y.column_bounds(heads, 300.0).collect()} == {"Item": (0.0, 65.0), "Qty": (65.0, 300.0)}


def test_label_rows_and_totals(spark):
    rows = spark.createDataFrame([("d", 1, ["Invoice No", "Date"]), ("d", 2, ["A-1", "2031-01-02"]), ("d", 3, ["Date", "x"]), ("d", 4, ["1", "2"])], "doc string, n int, cells array<string>")
    got = {r.field: r.value for r in Y.value_rows(rows, {"invoice no": "number", "date": "date"}, ["n"]).collect()}
    assert got == {"number": "A-1", "date": "2031-01-02"}
    lines = spark.createDataFrame([("d", "Sub-total 1,000.00"), ("d", "VAT amount 5% 50.00"), ("d", "Total 1,000.00"), ("d", "Grand total 1,050.00"), ("e", "Net total 1"), ("e", "Net total 2")], "doc string, text string")
    got = {(r.doc, r.field): r.amount for r in Y.totals(lines).collect()}
    assert got == {("d", "net"): Decimal(1000), ("d", "tax"): Decimal(50), ("d", "gross"): Decimal(1050), ("e", "net"): None}
    below = spark.createDataFrame([("d", 1, "Date:"), ("d", 2, "2031-01-02"), ("e", 1, "Date: 1"), ("e", 2, "Date: 2")], "doc string, n int, text string")
    assert {r.doc: r.value for r in Y.next_line_value(below, "date", r"[\d-]+", ["n"]).collect()} == {"d": "2031-01-02", "e": None}


def test_templates_and_priority(spark):
    template = {"name": "acme", "keywords": ["ACME"], "fields": {"number": r"No (\S+)"}, "lines": {"start": "^Items", "end": "^Total", "line": r"^(?P<sku>\w+) (?P<qty>\d+)$"}}
    texts = spark.createDataFrame([("a", "ACME\nNo 7\nItems\nAB 1\nnote\nCD 2\nTotal 3\nEF 4"), ("b", "other"), ("c", None)], "doc string, text string")
    got = {r.doc: (r.template, dict(r.fields), [dict(x) for x in r.lines]) for r in Y.by_template(texts, [template]).collect()}
    assert got["a"] == ("acme", {"number": "7"}, [{"sku": "AB", "qty": "1"}, {"sku": "CD", "qty": "2"}]) and got["b"] == (None, {}, []) == got["c"]
    readings = spark.createDataFrame([("d", 1, None, "x"), ("d", 2, "n", "y")], "doc string, position int, number string, po string")
    assert [(r.number, r.po) for r in Y.by_priority(readings, ["number", "po"]).collect()] == [("n", "x")]


def test_claims_bands_and_feedback(spark):
    claims = spark.createDataFrame([("d", 1, 1, "77"), ("d", 2, None, "77"), ("d", 3, 1, "88"), ("d", 4, 2, "99")], "doc string, index int, page int, run string")
    seen = spark.createDataFrame([("d", "77", 1, 2), ("d", "88", 2, 1), ("d", "99", 2, 1)], "doc string, run string, page int, n int")
    assert sorted(r["index"] for r in Q.corroborated(claims, seen).collect()) == [1, 2, 4]
    boxes = spark.createDataFrame([("d", 1, 1, 0.0, 10.0), ("d", 1, 2, 5.0, 15.0), ("d", 1, 3, 30.0, 40.0)], "doc string, page int, id int, top double, bottom double")
    assert sorted((r.a, r.b) for r in X.same_band(boxes).collect()) == [(1, 2), (2, 1)]
    log = D.filed_feedback(spark.createDataFrame([(1, "a", "e"), (2, "", "e"), (3, "b", "f")], "n int, correction string, evidence string").selectExpr("*", "n as id", "n as at", "'l' as log"), 4)
    assert [r.feedback_id for r in log.orderBy("n").collect()] == ["FB-0005", "FB-0006"]
    done = X.decided(log.withColumn("approver", F.lit(None).cast("string")), spark.createDataFrame([("FB-0005", "Approved", "o"), ("FB-0006", "Maybe", "o")], "feedback_id string, decision string, approver string"))
    assert {r.feedback_id: (r.decision, r.approver) for r in done.collect()} == {"FB-0005": ("Approved", "o"), "FB-0006": ("Proposed", None)}
