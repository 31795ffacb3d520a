"""Small cases of fields, lines and tables by where words stand, of learned templates, files and imports."""

from __future__ import annotations

import io
import json
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veritally.operators import learning as B
from veritally.operators import sinks
from veritally.operators import spatial as Q
from veritally.operators import tables as Z
from veritally.sources import shadow, workbook

SCHEMA = "doc string, page int, row_no int, width double, height double, words array<struct<x0:double,x1:double,top:double,bottom:double,text:string>>"


def page(spark, rows):
    """Rows of (page, row, top, [(left, right, text)])."""
    made = [("d", p, n, 600.0, 800.0, [(float(a), float(b), float(top), float(top) + 10, t) for a, b, t in words]) for p, n, top, words in rows]
    return spark.createDataFrame(made, SCHEMA)


def test_empty_rows_and_tables_give_nothing(spark):
    for rows in (page(spark, [(1, 1, 10, [])]), page(spark, []).limit(0)):
        assert Q.labelled_identifiers(rows, ["po no"]).count() == 0
        assert Q.compact_headers(rows).count() == 0
        assert Q.line_items(rows).count() == 0
        assert Q.party_names(rows, ["supplier"]).count() == 0
        assert Z.measured_tables(rows).count() == 0
        assert Z.label_tables(rows).count() == 0
        assert Z.columnar_lines(rows).count() == 0


def test_two_different_values_are_none(spark):
    rows = page(spark, [(1, 1, 10, [(10, 30, "PO"), (35, 50, "No"), (55, 80, "A-1")]), (2, 1, 10, [(10, 30, "PO"), (35, 50, "No"), (55, 80, "A-2")])])
    assert Q.labelled_identifiers(rows, ["po no"]).count() == 0
    assert Q.labelled_identifiers(rows.where("page = 1"), ["po no"]).first().value == "A-1"


def test_a_serial_glued_to_a_code_is_split_at_what_was_expected(spark):
    heads = Z.heading_spans(page(spark, [(1, 1, 10, [(10, 20, "Sr"), (30, 60, "Barcode"), (100, 160, "Description"), (200, 220, "Qty"), (240, 260, "Price")])])).select("doc", "spans")
    rows = page(spark, [(1, 2, 30, [(12, 58, "24006381333931"), (100, 140, "Rose"), (202, 210, "3"), (241, 259, "10.00")])]).join(heads, "doc")
    found = Z.mapped(rows, F.lit("2")).first()
    assert (found.split, found.cells["serial"], found.cells["gtin"]) == (True, "2", "4006381333931")
    other = Z.mapped(rows, F.lit("7")).first()
    assert (other.split, other.cells["gtin"]) == (False, "24006381333931")


def test_template_is_kept_only_if_it_reads_its_invoice_back():
    text = "Acme\nInvoice No: A-1\nItem Qty Price Amount\nX-1 2 5.00 10.00\nTotal 10.00\n"
    invoice = {"supplier_name": "Acme", "number": "A-1", "net": "10", "lines": [{"sku": "X-1", "qty": "2", "price": "5", "net_amount": "10"}]}
    template, problem = B.learn(text, invoice)
    assert problem is None
    again = B.read(template, text.replace("A-1", "B-22").replace("X-1", "Z-9").replace("2 5.00 10.00", "3 5.00 15.00"))
    assert again["number"] == "B-22"
    assert again["lines"] == [{"sku": "Z-9", "qty": "3", "price": "5.00", "net_amount": "15.00"}]
    for change, reason in (({"lines": []}, "no lines"), ({"number": "A-9"}, "back"), ({"lines": [{"qty": "7", "price": "5", "net_amount": "35"}]}, "not found")):
        found, problem = B.learn(text, {**invoice, **change})
        assert found is None
        assert reason in problem
    assert B.learn("", invoice)[0] is None


def test_fixes_name_what_the_other_reader_got_wrong():
    mine = {"number": "A", "lines": [{"qty": "1", "price": "2"}]}
    assert B.fixed(mine, {"number": "B", "lines": [{"qty": "1", "price": "3"}]}, mine) == ["number", "price"]
    assert B.fixed(mine, {"number": "A", "lines": []}, mine) == ["qty", "price", "rows"]


def test_an_export_stops_at_an_invoice_that_is_not_ready(spark):
    heads = spark.createDataFrame([("e", 1, False, "N", "1", "2", "3", "Store (S)", "2031-01-02", 1, 0, "S5")], "export string, doc int, ready boolean, number string, site string, po string, location string, location_type string, date string, net int, tax int, taxCode string")
    lines = spark.createDataFrame([], "export string, doc int, line int, item string, gtin string, price int, qty int")
    with pytest.raises(Exception, match="only validated"):
        sinks.batch_sheets(heads, lines).collect()
    with pytest.raises(Exception, match="location type"):
        sinks.batch_sheets(heads.withColumn("ready", F.lit(True)).withColumn("location_type", F.lit("Shop")), lines).collect()


def test_import_resumes_and_is_cut_over_only_when_complete(spark, tmp_path):
    rows, folder = spark.range(1, 26).withColumnRenamed("id", "line"), str(tmp_path)
    assert shadow.advance(spark, rows, folder, "a", most=2, size=10) == 1
    with pytest.raises(ValueError, match="not complete"):
        shadow.cut_over(spark, folder, "a", 25)
    assert shadow.in_use(spark, folder) is None
    assert shadow.advance(spark, rows, folder, "a", size=10) == 0
    assert shadow.advance(spark, rows, folder, "a", size=10) == 0
    shadow.cut_over(spark, folder, "a", 25)
    assert sorted(r.line for r in shadow.in_use(spark, folder).collect()) == list(range(1, 26))
    with pytest.raises(ValueError, match="in use"):
        shadow.discard(spark, folder, "a")


def test_ods_repeats_and_xlsx_relations(spark, tmp_path):
    body = (
        '<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:spreadsheet>'
        '<table:table table:name="S"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"><text:p>a</text:p></table:table-cell></table:table-row>'
        '<table:table-row table:number-rows-repeated="1048000"><table:table-cell/></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'
    )
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("content.xml", body)
    (tmp_path / "x.ods").write_bytes(box.getvalue())
    got = workbook.read_workbooks(spark, str(tmp_path / "x.ods")).collect()
    assert [(r.sheet, r.row_no, r.cells) for r in got] == [("S", 1, ["a", "a"]), ("S", 2, ["a", "a"])]


def test_the_rest_works_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    run = "import json, __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(json.dumps([len(q), len(s), any(k.startswith('op') for k in q), 'pipeline' in q]))"
    done = subprocess.run([sys.executable, "-c", run], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    queries, twins, texts, pipeline = json.loads(done.stdout)
    assert queries > 300
    assert twins > 300
    assert not texts
    assert not pipeline
