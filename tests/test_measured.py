"""Measured tables read in one pass: the rules of the operators that tell one row as columns, and one shuffle at most."""

from __future__ import annotations

import random

import pytest

from veritally import plans
from veritally.operators import measured
from veritally.operators import tables as Z

QUERIES = plans.queries()
SCHEMA = "doc string, page int, row_no int, width double, height double, words array<struct<x0:double,x1:double,top:double,bottom:double,text:string>>"
HEADINGS = "Sr|S.No|Item Code|SKU|Description|Product Name|Name|Barcode|EAN|Qty|Quantity|Unit Price|Price|UOM|Amount|Amount AED|VAT 5%|Size|Pri ce|Déscription|Barcode Part".split("|")
CELLS = ["1", "12", "4006381333931", "A-1", "Rose", "3OML", "30 mI", "5OOml", "10.00", "(1,000.50)", "AED", "AED 5", " 7 ", "Größe", "", None]


def drawn(draw, texts, top):
    x, out = 10.0, []
    for text in texts:
        wide = draw.choice([10, 20, 40])
        out.append((x, x + wide + draw.choice([0, 0, 30]), top, top + 10.0, text))
        x += wide + draw.choice([-5, 2, 5, 20])
    return out


def as_row(words):
    return (1, 1, 600.0, 800.0, *map(list, zip(*words, strict=True)))


def test_headings_and_cells_are_those_of_the_columns(spark):
    draw, heads, rows = random.Random(5), {}, []
    for n in range(300):
        texts = ["Description", "Qty", "Price", *draw.sample(HEADINGS, draw.randint(0, 5))]
        draw.shuffle(texts)
        heads[str(n)] = drawn(draw, " ".join(texts).split(), 10.0)
        rows.append((str(n), 1, 2, 600.0, 800.0, drawn(draw, [draw.choice(CELLS) for _ in range(draw.randint(1, 12))], 30.0)))
    told = Z.heading_spans(spark.createDataFrame([(k, 1, 1, 600.0, 800.0, w) for k, w in heads.items()], SCHEMA)).select("doc", "spans")
    under = {r.doc: r for r in Z.mapped(spark.createDataFrame(rows, SCHEMA).join(told, "doc")).select("doc", "spans", "cells").collect()}
    assert len(under) == 300
    for doc, *_, words in rows:
        spans = measured.heading_spans(as_row(heads[doc]))
        assert spans == [tuple(s) for s in under[doc].spans]
        assert measured.cells_of(as_row(words), spans, measured.borders(spans)) == under[doc].cells


def test_packing_pages_totals_and_other_invoices_end_tables(spark):
    head = [(10, 90, "Description"), (100, 120, "Qty"), (140, 160, "Price"), (200, 210, "Sr")]

    def row(page, n, top, words, doc="d"):
        return doc, page, n, 600.0, 800.0, [(float(a), float(b), float(top), float(top) + 10, t) for a, b, t in words]

    def item(page, n, top, name, serial, doc="d"):
        return row(page, n, top, [(10, 40, name), (102, 110, "2"), (141, 159, "5.00"), (200, 210, serial)], doc)

    number = [(10, 30, "Invoice"), (35, 50, "No:"), (60, 90, "I-1")]
    rows = [
        row(1, 1, 5, number), row(1, 2, 20, head), item(1, 3, 32, "Rose", "1"), row(1, 4, 44, [(10, 40, "red")]), row(1, 5, 90, [(10, 40, "far")]), row(1, 6, 102, [(10, 40, "lost")]), row(1, 7, 114, [(10, 40, "IBAN")]), item(1, 8, 126, "No", "2"),
        row(2, 1, 5, number), item(2, 2, 20, "Lily", "2"), row(2, 3, 32, [(10, 40, "Total")]), item(2, 4, 44, "No", "3"),
        row(3, 1, 5, number), item(3, 2, 20, "No", "3"), row(4, 1, 5, [(10, 40, "Packing")]), row(4, 2, 17, [(10, 40, "list")]), row(4, 3, 30, head), item(4, 4, 42, "No", "1"),
        row(1, 1, 20, head, "e"), item(1, 2, 32, "Fern", "1", "e"), item(2, 1, 32, "No", "2", "e"), row(None, 1, 20, head, "e"),
    ]
    found = Z.measured_tables(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc, r.page, r.header_page, r.row_no, r.cells["description"]) for r in found) == [("d", 1, 1, 3, "Rose\nred"), ("d", 2, 1, 2, "Lily"), ("e", 1, 1, 2, "Fern")]


@pytest.mark.parametrize("name", ["e10_measured_tables", "w07_carried_headings"])
def test_rows_of_words_are_not_shuffled(spark, small, name):
    """Events are dealt out to all cores before rows are made of them, and lie by document already."""
    found = QUERIES[name](spark, small)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
