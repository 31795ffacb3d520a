"""Tables from the words of a page, and lines from tables.

A table that goes on over pages depends on all rows before it; a document's rows are folded by one task (``measured_tables``), in Python
by Arrow (``measured``). Headings, cells and lines of single tables are built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.numbers import gtin_valid, printed_decimal
from ..functions.printed import exact_role, header_field, header_label, packed, role
from ..functions.text import clean_party_name
from . import measured
from .folding import folded
from .spatial import middle, normal, only_distinct, tallest, text_of

#: The grammar of a columnar tax invoice.
MONEY, QUANTITY, RATE, UNIT = r"^-?[0-9][0-9,]*\.\d{2}$", r"^[0-9][0-9,]*(?:\.\d{1,4})?$", r"^\d{1,2}(?:\.\d{1,2})?$", r"^[A-Za-z][A-Za-z.]{0,11}$"
COLUMNAR = ["Description", "Brand", "Quantity", "UOM"]
COLUMNAR_MARKS = [r"^TAX INVOICE(?:\s|$)", r"^#\s*([A-Z0-9][A-Z0-9./_-]{2,79})(?:\s|$)", r"^Date of Issuing\s*:\s*([A-Za-z]{3,9}\.?\s+\d{1,2}\s*,\s*\d{4})(?:\s|$)", r"^Issued By\s*:.*\sIssued To\s*:"]
COLUMNAR_END, COLUMNAR_FOOTER = r"^(TOTAL OF SUPPLY|Sub Total\s*,|Total VAT\s*,|Total\s*,|Terms and Conditions)", r"^Made with \w+"


def _centre(word: Column) -> Column:
    return (word["x0"] + word["x1"]) / 2


def heading_spans(rows: DataFrame) -> DataFrame:
    """Rows with ``spans``: (left, right, role) of headings of one to three words; a heading inside another one's span is none."""
    n = F.size("words")

    def wide(width: int) -> Column:
        named = F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda s: F.struct(
                F.array_min(F.transform(F.slice("words", s, width), lambda w: w["x0"])).alias("left"), F.array_max(F.transform(F.slice("words", s, width), lambda w: w["x1"])).alias("right"),
                text_of(F.slice("words", s, width)).alias("text"), packed(text_of(F.slice("words", s, width))).alias("own"), F.lit(width).alias("width"), s.alias("start"),
            ),
        )
        roles = F.transform(F.filter(named, lambda p: p["start"] + width - 1 <= n), lambda p: p.withField("role", exact_role(p["text"], p["own"])))
        return F.filter(roles, lambda p: p["role"].isNotNull())

    hits = F.concat(*[wide(w) for w in (1, 2, 3)])
    own = rows.withColumn("_hits", hits)
    best = F.filter("_hits", lambda h: ~F.exists("_hits", lambda o: (o["role"] == h["role"]) & ((o["width"] > h["width"]) | (o["width"] == h["width"]) & (o["start"] < h["start"]))))
    own = own.withColumn("_best", best)
    outer = F.filter("_best", lambda h: ~F.exists("_best", lambda o: (o["role"] != h["role"]) & (o["left"] <= h["left"]) & (o["right"] >= h["right"]) & (o["right"] - o["left"] > h["right"] - h["left"])))
    return own.withColumn("spans", F.array_sort(F.transform(outer, lambda h: F.struct(h["left"].alias("left"), h["right"].alias("right"), h["role"].alias("role"))))).drop("_hits", "_best")


def borders(spans: Column) -> Column:
    """Where each column but the last ends: a description reaches up to the next heading, a part number stays near its own."""

    def border(i: Column) -> Column:
        a, b = F.try_element_at(spans, i), F.try_element_at(spans, i + 1)
        gap = F.greatest(F.lit(0.0), b["left"] - a["right"])
        return F.when(a["role"] == "description", b["left"] - F.least(F.lit(3.0), gap * 0.08)).when(a["role"] == "sku", a["right"] + F.least(gap / 2, F.greatest(F.lit(4.0), (a["right"] - a["left"]) * 0.15))).otherwise(a["right"] + gap / 2)

    return F.when(F.size(spans) > 1, F.transform(F.sequence(F.lit(1), F.size(spans) - 1), border)).otherwise(F.array().cast("array<double>"))


def mapped(rows: DataFrame, serial: Column | None = None) -> DataFrame:
    """Rows with ``cells`` (role to text) under the ``spans`` in force, with three repairs by measure.

    A whole barcode that reaches from the description into its own heading is the barcode; a whole number left of the price
    heading, with the price behind it, is the quantity; a size's ``3OML`` is ``30ML``. With an expected serial, a token across
    the serial and the code column is split at it.
    """
    own = rows.withColumn("_cuts", borders(F.col("spans")))
    n = F.size("spans")
    words = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.struct(
            F.try_element_at("spans", i).alias("span"), F.try_element_at("spans", i + 1).alias("next"),
            F.filter("words", lambda w: (i.eqNullSafe(F.lit(1)) | (_centre(w) >= F.try_element_at("_cuts", F.greatest(i - 1, F.lit(1))))) & ((i == n) | (_centre(w) < F.try_element_at("_cuts", i)))).alias("words"),
        ),
    )
    own = own.withColumn("_c", words)
    find = lambda r: F.get(F.filter("_c", lambda c: c["span"]["role"] == r), F.lit(0))
    described, priced = find("description"), find("price")
    reaching = F.filter(described["words"], lambda w: (described["next"]["role"] == "gtin") & (w["x1"] > described["next"]["left"]) & w["text"].rlike(r"^\s*[0-9]{8,14}\s*$"))
    own = own.withColumn("_barcode", F.when((F.size(reaching) == 1) & (F.size(find("gtin")["words"]) == 0), F.get(reaching, F.lit(0))))
    cell = priced["words"]
    first = F.trim(F.get(cell, F.lit(0))["text"])
    before = (F.size(cell) >= 2) & first.rlike(r"^[0-9]{1,6}$") & (F.get(cell, F.lit(0))["x1"] < priced["span"]["left"]) & F.exists(F.slice(cell, 2, F.size("words") + 1), lambda w: printed_decimal(w["text"]).isNotNull())
    own = own.withColumn("_count", F.when(before & (find("qty")["next"]["role"] == "price") & (F.size(find("qty")["words"]) == 0), F.get(cell, F.lit(0))))

    def text(c: Column) -> Column:
        role_ = c["span"]["role"]
        mine = F.filter(c["words"], lambda w: ~F.coalesce((role_ == "description") & (w == F.col("_barcode")), F.lit(False)) & ~F.coalesce((role_ == "price") & (w == F.col("_count")), F.lit(False)))
        plain = F.nullif(F.trim(text_of(F.transform(mine, lambda w: w.withField("text", F.trim(w["text"]))))), F.lit(""))
        sized = F.regexp_replace(F.regexp_replace(plain, r"(?i)\b(\d+)O(\d*)(?=ml\b)", "$10$2"), r"(?<=\d)mI\b", "ml")
        return F.when((role_ == "gtin") & F.col("_barcode").isNotNull(), F.trim(F.col("_barcode")["text"])).when((role_ == "qty") & F.col("_count").isNotNull(), F.trim(F.col("_count")["text"])).when(role_ == "description", sized).otherwise(plain)

    cells = F.map_from_entries(F.transform("_c", lambda c: F.struct(c["span"]["role"].alias("role"), text(c).alias("text"))))
    told = own.withColumn("cells", F.when(n > 0, cells)).drop("_cuts", "_c", "_barcode", "_count")
    if serial is None:
        return told
    lead, code = F.get(F.col("spans"), F.lit(0)), F.get(F.col("spans"), F.lit(1))
    cut = borders(F.col("spans"))
    crossing = F.filter("words", lambda w: (w["x0"] >= lead["left"] - 3) & (w["x0"] < F.get(cut, F.lit(0))) & (w["x1"] > F.get(cut, F.lit(0))) & ((n == 2) | (w["x1"] <= F.try_element_at(cut, F.lit(2)))))
    raw = F.trim(F.get(crossing, F.lit(0))["text"])
    rest = F.when(F.startswith(raw, serial), F.substr(raw, F.length(serial) + 1))
    torn = (lead["role"] == "serial") & code["role"].isin("part_code", "gtin") & F.col("cells")["serial"].isNull() & (F.size(crossing) == 1) & (F.col("cells")[code["role"]] == raw) & rest.rlike(r"^[A-Za-z0-9][A-Za-z0-9./_-]{2,79}$")
    split = F.transform_values("cells", lambda k, v: F.when(k == "serial", serial).when(k == code["role"], rest).otherwise(v))
    return told.withColumn("split", F.coalesce(torn, F.lit(False))).withColumn("cells", F.when(F.coalesce(torn, F.lit(False)), split).otherwise(F.col("cells")))


def measured_number(rows: DataFrame) -> DataFrame:
    """(doc, page, value): the only invoice number behind its label in the top third of a page; an original invoice's is none."""
    text = text_of(F.col("words"))
    label = r"(?i)\b(?:tax\s+)?invoice\s+(?:no\.?|number|#)\s*[:\-]"
    behind = F.regexp_extract(text, label + r"\s*([A-Za-z0-9][A-Za-z0-9./_-]{0,79})\s*$", 1)
    other = text.rlike(r"(?i)\b(?:original|related|reference|previous)\s+(?:tax\s+)?invoice\s+(?:no\.?|number|#)\s*[:\-]")
    top = F.array_min(F.transform("words", lambda w: w["top"]))
    found = rows.where((F.size("words") > 0) & (top <= F.col("height") / 3)).where(~other).withColumn("value", F.nullif(behind, F.lit(""))).where("value is not null")
    return found.groupBy("doc", "page").agg(F.collect_set("value").alias("v")).where("size(v) = 1").select("doc", "page", F.get(F.col("v"), F.lit(0)).alias("value"))


def measured_tables(rows: DataFrame) -> DataFrame:
    """(doc, page, header_page, row_no, cells): rows of measured tables below a heading that names description, quantity and price.

    ``rows`` has (doc, page, row_no, width, height, words). A page without a heading carries the last page's on if the invoice
    number and the page size are the same and its first row has the next serial. A wrapped description joins its row. Packing
    pages and rows from a total or a footer on are left out.
    """
    own = rows.where("doc is not null and page is not null").select("doc", "page", "row_no", *[F.col(c).cast("double").alias(c) for c in ("width", "height")], *[F.col(f"words.{c}").alias(c) for c in ("x0", "x1", "top", "bottom", "text")])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = f"doc {kind['doc']}, page {kind['page']}, header_page {kind['page']}, row_no {kind['row_no']}, cells map<string,string>"
    # The window sorts a document's rows together, and shuffles them only where they don't lie so already.
    along = own.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("page", "row_no")))
    return along.mapInArrow(measured.fold(to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def label_tables(rows: DataFrame) -> DataFrame:
    """(doc, page, field, value): values right below a row of labels, each under the label in whose column its words stand.

    Labels are set apart by gaps wider than 1.2 times their height; at least two different fields must be named.
    """
    own = Window.partitionBy("doc", "page").orderBy("row_no")
    near = rows.where(F.size("words") > 0).withColumn("below", F.lead("words").over(own)).where("below is not null").withColumn("h", tallest(F.col("words")))

    def grow(cells: Column, w: Column) -> Column:
        last = F.try_element_at(cells, F.lit(-1))
        joined = F.struct(last["left"].alias("left"), F.greatest(last["right"], w["x1"]).alias("right"), F.concat(last["text"], F.lit(" "), F.trim(w["text"])).alias("text"))
        fresh = F.struct(w["x0"].alias("left"), w["x1"].alias("right"), F.trim(w["text"]).alias("text"))
        return F.when(last.isNotNull() & (w["x0"] - last["right"] <= F.col("h") * 1.2), F.concat(F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(cells, F.array(fresh)))

    cells = F.aggregate("words", F.array().cast("array<struct<left:double,right:double,text:string>>"), grow)
    told = near.withColumn("cells", cells)
    named = F.transform("cells", lambda c: header_field(header_label(c["text"])))
    fields = told.withColumn("fields", named).where(F.size(F.array_distinct(F.array_compact("fields"))) >= 2)
    gap = F.array_min(F.transform("below", lambda w: w["top"])) - F.array_max(F.transform("words", lambda w: w["bottom"]))
    flat = fields.where(gap <= F.col("h") * 2.5).select("doc", "page", "row_no", "cells", "below", F.posexplode("fields").alias("i", "field")).where("field is not null")
    left = F.when(F.col("i") > 0, (F.try_element_at("cells", F.col("i"))["right"] + F.try_element_at("cells", F.col("i") + 1)["left"]) / 2)
    right = (F.try_element_at("cells", F.col("i") + 1)["right"] + F.try_element_at("cells", F.col("i") + 2)["left"]) / 2
    placed = flat.withColumn("left", F.when(F.col("i") > 0, left)).withColumn("right", right)
    value = F.nullif(text_of(F.filter("below", lambda w: (F.col("left").isNull() | (_centre(w) >= F.col("left"))) & (F.col("right").isNull() | (_centre(w) < F.col("right"))))), F.lit(""))
    return placed.select("doc", "page", "field", value.alias("value")).where("value is not null")


def edge_headings(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, table, header): a table's header whose empty first or last cell, over a filled column, gets the words beside the others.

    ``tables`` has (doc, table, page, header, filled: booleans of its columns). The known headings must stand exactly once in a
    row of the page; a header without such a row stays as it is.
    """
    known = F.array_join(F.array_compact("header"), " ")
    wide = F.size("header") >= 3
    first, last = F.get(F.col("header"), F.lit(0)), F.try_element_at("header", F.lit(-1))
    open_ = tables.withColumn("_known", known).withColumn("_first", wide & first.isNull() & F.get(F.col("header"), F.lit(1)).isNotNull() & F.get(F.col("filled"), F.lit(0))).withColumn("_last", wide & last.isNull() & F.try_element_at("header", F.size("header") - 1).isNotNull() & F.try_element_at("filled", F.lit(-1)))
    texts = rows.select("doc", "page", "row_no", F.concat(F.lit(" "), text_of(F.col("words")), F.lit(" ")).alias("t"))
    beside = F.split("t", F.concat(F.lit(r"\Q "), F.col("_known"), F.lit(r" \E")), -1)
    found = open_.where("(_first or _last) and _known <> ''").join(texts, ["doc", "page"]).withColumn("b", beside).where("size(b) = 2")
    first_row = found.groupBy("doc", "table").agg(F.min_by("b", "row_no").alias("b"))
    joined = open_.join(first_row, ["doc", "table"], "left")
    before, after = F.nullif(F.trim(F.get(F.col("b"), F.lit(0))), F.lit("")), F.nullif(F.trim(F.get(F.col("b"), F.lit(1))), F.lit(""))
    n = F.size("header")
    filled = F.transform("header", lambda h, i: F.when(F.col("_first") & (i == 0), before).when(F.col("_last") & (i == n - 1), after).otherwise(h))
    return joined.select("doc", "table", filled.alias("header"))


def table_lines(rows: DataFrame) -> DataFrame:
    """(doc, table, row_no, sku, gtin, part_code, description, qty, uom, price, net_amount, tax_amount, other_amount) of tables.

    ``rows`` has (doc, table, row_no, cells). The last row above that names a quantity, a price and what a line is gives the
    roles; a row without any identity, or with neither quantity nor amount, is no line.
    """
    roles = F.transform("cells", lambda c: role(c))
    own = rows.withColumn("_roles", roles)
    whole = F.array_contains("_roles", "qty") & F.array_contains("_roles", "price") & F.arrays_overlap(F.array_compact("_roles"), F.array(*[F.lit(x) for x in ("sku", "gtin", "part_code", "description")]))
    so_far = Window.partitionBy("doc", "table").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = own.withColumn("_head", F.coalesce(whole, F.lit(False))).withColumn("_under", F.last(F.when(F.col("_head"), F.col("_roles")), ignorenulls=True).over(so_far)).where("not _head and _under is not null")

    def of(name: str) -> Column:
        return F.nullif(F.trim(F.get(F.filter(F.arrays_zip(F.col("_under").alias("r"), F.col("cells").alias("c")), lambda z: z["r"] == name), F.lit(0))["c"]), F.lit(""))

    read = marked.select("doc", "table", "row_no", *[of(c).alias(c) for c in ("sku", "gtin", "part_code", "description", "uom")], *[printed_decimal(of(c)).alias(c) for c in ("qty", "price", "net_amount", "tax_amount", "other_amount")])
    return read.where((F.coalesce("sku", "gtin", "part_code", "description").isNotNull()) & F.col("price").isNotNull() & (F.col("qty").isNotNull() | F.col("net_amount").isNotNull()))


def reconciled_amounts(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines whose second amount column becomes the net where it, and not the first, sums up to the printed net, and taxes fit it."""
    sums = lines.groupBy("doc").agg(
        F.when(F.count(F.lit(1)) == F.count("other_amount"), F.sum("other_amount")).alias("_other"), F.sum("net_amount").alias("_net"), F.sum("tax_amount").alias("_tax"), F.sum(F.when(F.col("tax_amount").isNotNull(), F.col("other_amount"))).alias("_taxed"),
    )
    rate = F.when(F.col("tax").isNotNull(), F.col("tax") / F.col("net")).when(F.col("_taxed") != 0, F.col("_tax") / F.col("_taxed")).otherwise(F.lit(0))
    told = heads.join(sums, "doc").withColumn("_rate", F.bround(rate, 4)).withColumn("_fits", (F.col("net") != 0) & (F.col("_other") == F.col("net")) & ~F.coalesce(F.col("_net") == F.col("net"), F.lit(False)))
    own = lines.join(told.select("doc", "_rate", "_fits"), "doc", "left")
    off = F.coalesce(F.abs(F.col("tax_amount") - F.col("other_amount") * F.col("_rate")) > F.lit("0.01").cast("decimal(3,2)"), F.lit(False))
    bad = own.groupBy("doc").agg(F.max(off).alias("_bad"))
    return own.join(bad, "doc").withColumn("net_amount", F.when(F.col("_fits") & ~F.col("_bad"), F.col("other_amount")).otherwise(F.col("net_amount"))).drop("_rate", "_fits", "_bad", "other_amount")


def table_buyers(cells: DataFrame, by_place: DataFrame) -> DataFrame:
    """(doc, value): the buyer by place, else the only one that a cell names, behind its label or in the next filled cell.

    ``cells`` has (doc, page, row_no, cells).
    """
    n = F.size("cells")
    label = lambda c: normal(c)
    at = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.try_element_at("cells", i).alias("c"), F.get(F.filter(F.slice("cells", i + 1, n), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.lit(0)).alias("next")))
    value = lambda p: F.when(label(p["c"]).isin("bill to", "buyer"), p["next"]).when(label(p["c"]).rlike("^(bill to|buyer) "), p["c"])
    named = cells.where(n > 0).select("doc", "page", "row_no", F.explode(F.filter(F.transform(at, value), lambda v: v.isNotNull())).alias("raw")).withColumn("value", clean_party_name(F.col("raw")))
    own = only_distinct(named)
    return by_place.withColumnRenamed("value", "_first").join(own, "doc", "full_outer").select("doc", F.coalesce("_first", "value").alias("value"))


def tail(words: Column) -> Column:
    """Quantity, unit, price, amount, rate, tax, total of exactly seven words; else null."""
    shapes = [QUANTITY, UNIT, MONEY, MONEY, RATE, MONEY, MONEY]
    fits = F.size(words) == 7
    for i, shape in enumerate(shapes):
        fits = fits & F.coalesce(F.get(words, F.lit(i)).rlike(shape), F.lit(False))
    number = lambda i: F.replace(F.get(words, F.lit(i)), F.lit(","), F.lit("")).try_cast("decimal(18,4)")
    return F.when(fits, F.struct(number(0).alias("qty"), F.get(words, F.lit(1)).alias("uom"), number(2).alias("price"), number(3).alias("net_amount"), number(4).alias("rate"), number(5).alias("tax_amount"), number(6).alias("total")))


def column_gap(words: Column, left: Column, right: Column, least: Column) -> Column:
    """How many words stand left of the widest gap that is centred between two bounds and clearly wider than the row's blanks; else null."""
    gaps = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.struct((b["x0"] - a["x1"]).alias("gap"), ((a["x1"] + b["x0"]) / 2).alias("at")))
    placed = F.transform(gaps, lambda g, i: F.struct(g["gap"].alias("gap"), (-i).alias("back"), g["at"].alias("at")))
    wide = F.array_sort(F.filter(F.transform(gaps, lambda g: g["gap"]), lambda g: g > 0))
    floor = F.when(F.size(wide) >= 3, F.greatest(least, F.try_element_at(wide, F.floor(F.size(wide) / 2).cast("int") + 1) * 2.5)).otherwise(least)
    best = F.array_max(F.filter(placed, lambda g: (g["gap"] >= floor) & (g["at"] >= left) & (g["at"] <= right)))
    return F.when(best.isNotNull(), 1 - best["back"])


def columnar(rows: DataFrame) -> DataFrame:
    """(doc): documents with every mark of the columnar layout: title, number, date, parties, table heading."""
    text = text_of(F.col("words"))
    marks = [F.bool_or(text.rlike(m)).alias(f"_{i}") for i, m in enumerate(COLUMNAR_MARKS)]
    head = F.size(F.array_intersect(F.transform("words", lambda w: w["text"]), F.array(*[F.lit(c) for c in COLUMNAR]))) == len(COLUMNAR)
    return rows.groupBy("doc").agg(*marks, F.bool_or(head).alias("_head")).where(" and ".join([*[f"_{i}" for i in range(len(COLUMNAR_MARKS))], "_head"])).select("doc")


def columnar_lines(rows: DataFrame) -> DataFrame:
    """(doc, no, page, description, brand, gtin, tail): lines of the columnar layout, over pages, wrapped texts joined."""
    text = text_of(F.col("words"))
    find = lambda name: F.get(F.filter("words", lambda w: w["text"] == name), F.lit(0))["x0"]
    own = rows.where(F.size("words") > 0).join(columnar(rows), "doc", "left_semi").withColumn("t", text)
    head = F.coalesce(*[F.when(find(c).isNull(), F.lit(False)) for c in COLUMNAR], F.lit(True))
    own = own.withColumn("head", head).withColumn("at", F.when(F.col("head"), F.struct(find("Description").alias("description"), find("Brand").alias("brand"), find("Quantity").alias("quantity"), F.greatest(F.lit(3.0), tallest(F.col("words")) * 0.4).alias("slack"))))
    codes = F.filter("words", lambda w: w["text"].rlike("^[A-Z]{3}$"))
    currency = (F.size(codes) >= 2) & F.forall("words", lambda w: w["text"].rlike("^[A-Z]{3}$") | (w["text"] == "%"))
    so_far = Window.partitionBy("doc").orderBy("page", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc").orderBy("page", "row_no")
    turned = F.coalesce(F.lag("page").over(before) != F.col("page"), F.lit(False))
    event = F.when(F.col("head"), "head").when(currency, "body").when(F.col("t").rlike(COLUMNAR_FOOTER), "foot").when(F.col("t").rlike(COLUMNAR_END), "end").when(turned, "turn")
    told = own.withColumn("event", event).withColumn("at", F.last("at", ignorenulls=True).over(so_far)).withColumn("state", F.last("event", ignorenulls=True).over(so_far))
    ended = F.max((F.col("event") == "end").cast("int")).over(so_far)
    body = told.withColumn("ended", F.coalesce(ended, F.lit(0))).where("at is not null and ended = 0 and state in ('body', 'turn') and coalesce(event, 'turn') = 'turn'")
    slack, first = F.col("at.slack"), F.get(F.col("words"), F.lit(0))
    left = F.col("at.description") - slack
    number = F.when(first["text"].rlike(r"^\d{1,4}$") & (first["x1"] <= left + 2 * slack), first["text"].cast("int"))
    rest = F.when(F.col("no").isNotNull(), F.slice("words", 2, F.size("words"))).otherwise(F.col("words"))
    cut = body.withColumn("no", number).withColumn("rest", rest)
    inside = lambda a, b: F.filter("rest", lambda w: (w["x0"] >= a if a is not None else F.lit(True)) & (w["x0"] < b if b is not None else F.lit(True)))
    brand, quantity = F.col("at.brand") - slack, F.col("at.quantity") - slack
    told = cut.withColumn("d", text_of(inside(None, brand))).withColumn("b", text_of(inside(brand, quantity))).withColumn("q", F.transform(inside(quantity, None), lambda w: w["text"]))
    told = told.withColumn("line", F.count("no").over(so_far)).where("line > 0")
    pieces = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page", "row_no", F.col(c).alias("t")))), lambda r: r["t"]), lambda t: t != ""), " ")
    lines = told.groupBy("doc", "line").agg(F.max("no").alias("no"), F.min("page").alias("page"), pieces("d").alias("whole"), pieces("b").alias("brand"), F.min_by("q", F.struct("page", "row_no")).alias("q"))
    code = F.regexp_extract("whole", r"(?:,\s*|\s|^)(\d{8,14})$", 1)
    valid = gtin_valid(code)
    return lines.select("doc", "no", "page", F.when(valid, F.rtrim(F.regexp_replace("whole", r"(?:,\s*|\s|^)\d{8,14}$", ""), F.lit(" ,"))).otherwise(F.col("whole")).alias("description"), "brand", F.when(valid, code).alias("gtin"), tail(F.col("q")).alias("tail"))


def columnar_parties(rows: DataFrame) -> DataFrame:
    """(doc, supplier, buyer): names on the row below the two labels, cut at the widest gap near the second one, else at its place."""
    own = Window.partitionBy("doc", "page").orderBy("row_no")
    found = rows.withColumn("below", F.lead("words").over(own)).where(text_of(F.col("words")).rlike(COLUMNAR_MARKS[3]) & F.col("below").isNotNull())
    issued = F.element_at(F.filter("words", lambda w: w["text"] == "Issued"), F.lit(-1))
    at = found.withColumn("label", issued).withColumn("k", column_gap(F.col("below"), F.get(F.col("words"), F.lit(0))["x0"], F.col("label.x1"), F.col("label.x1") - F.col("label.x0")))
    n = F.size("below")
    supplier = F.when(F.col("k").isNotNull(), text_of(F.slice("below", 1, F.coalesce("k", F.lit(1))))).otherwise(text_of(F.filter("below", lambda w: w["x1"] <= F.col("label.x0") + 1)))
    buyer = F.when(F.col("k").isNotNull(), text_of(F.slice("below", F.coalesce("k", F.lit(0)) + 1, n))).otherwise(text_of(F.filter("below", lambda w: w["x0"] >= F.col("label.x0") - 1)))
    return at.groupBy("doc").agg(F.min_by(F.struct(F.nullif(supplier, F.lit("")).alias("supplier"), F.nullif(buyer, F.lit("")).alias("buyer")), F.struct("page", "row_no")).alias("p")).select("doc", "p.*")


def overlapping_rows(words: DataFrame) -> DataFrame:
    """(doc, page, row_no, text): rows for reading: a word joins the nearest row that it is level with or overlaps by a quarter of the height.

    The mean of a row depends on its words so far; a page is folded as a whole.
    """

    def fold(key: tuple, page: list[dict]) -> list[tuple]:
        rows: list[dict] = []
        for w in sorted(page, key=lambda w: ((w["top"] + w["bottom"]) / 2, w["x0"], w["text"])):
            centre, tall, fits = (w["top"] + w["bottom"]) / 2, max(1.0, w["bottom"] - w["top"]), []
            for n, r in enumerate(rows):
                middle_, height = sum(r["centres"]) / len(r["centres"]), sorted(r["heights"])[len(r["heights"]) // 2]
                level = abs(centre - middle_) <= max(3.0, 0.55 * max(tall, height))
                if level or min(w["bottom"], r["bottom"]) - max(w["top"], r["top"]) >= 0.25 * min(tall, height):
                    fits.append((abs(centre - middle_), n))
            if not fits:
                rows.append({"centres": [], "heights": [], "words": [], "top": w["top"], "bottom": w["bottom"]})
            row = rows[min(fits)[1]] if fits else rows[-1]
            row["centres"].append(centre)
            row["heights"].append(tall)
            row["words"].append((w["x0"], w["text"]))
            row["top"], row["bottom"] = min(row["top"], w["top"]), max(row["bottom"], w["bottom"])
        rows.sort(key=lambda r: sum(r["centres"]) / len(r["centres"]))
        return [(*key, n, "  ".join(t for _, t in sorted(r["words"]))) for n, r in enumerate(rows, 1)]

    kind = words.schema["doc"].dataType.simpleString()
    return folded(words.select("doc", "page", "text", "x0", "top", "bottom"), ["doc", "page"], fold, f"doc {kind}, page int, row_no int, text string")


def payload_boxes(items: DataFrame) -> DataFrame:
    """(doc, page, text, x0, top, x1, bottom): a layout model's boxes by the top left corner; blocks only of documents without words.

    ``items`` has (doc, kind: word or block, page, text, origin, l, t, r, b, width, height). A box from the bottom left is turned.
    """
    up = F.upper("origin").contains("BOTTOM")
    top, bottom = F.when(up, F.col("height") - F.col("t")).otherwise(F.col("t")), F.when(up, F.col("height") - F.col("b")).otherwise(F.col("b"))
    fine = items.where("coalesce(trim(text), '') <> '' and l is not null and t is not null and r is not null and b is not null")
    worded = fine.where("kind = 'word'").select("doc").distinct()
    kept = fine.where("kind = 'word'").unionByName(fine.where("kind = 'block'").join(worded, "doc", "left_anti"))
    return kept.select("doc", "page", "text", F.least("l", "r").alias("x0"), F.least(top, bottom).alias("top"), F.greatest("l", "r").alias("x1"), F.greatest(top, bottom).alias("bottom"))


def verified_by_ocr(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc, field, page, token, review): where a local text layer prints an AI's value, else a token one character apart; never replaced.

    Both sides meet by equality: on the value, and on it with one place blanked.
    """
    squash = lambda c: F.regexp_replace(F.lower(c), r"[\s,]+", "")
    own = values.withColumn("_v", squash(F.col("value"))).where("_v <> ''")
    theirs = tokens.withColumn("_v", squash(F.col("text"))).where("_v <> ''").select("doc", "page", "n", "text", "_v").distinct()
    found = own.join(theirs, ["doc", "_v"]).groupBy("doc", "field").agg(F.min_by(F.struct("page", "text"), F.struct("page", "n")).alias("f"))
    holes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.overlay(c, F.lit("\u0000"), i, F.lit(1)))))
    missing = own.join(found.select("doc", "field"), ["doc", "field"], "left_anti").where(F.length("_v") >= 4)
    near = missing.withColumn("_h", holes(F.col("_v"))).join(theirs.select("doc", "text", F.col("_v").alias("_t"), holes(F.col("_v")).alias("_h")), ["doc", "_h"])
    close = near.groupBy("doc", "field").agg(F.collect_set("text").alias("texts"))
    joined = values.select("doc", "field").join(found, ["doc", "field"], "left").join(close, ["doc", "field"], "left")
    return joined.select("doc", "field", "f.page", F.col("f.text").alias("token"), F.when(F.size("texts") == 1, F.get(F.col("texts"), F.lit(0))).alias("review"))


def document_texts(files: DataFrame) -> DataFrame:
    """(path, text, problem) of txt, csv, json, docx and xlsx files; ``files`` has (path, content) as of Spark's binary source."""
    import io
    import zipfile
    from xml.etree import ElementTree

    from ..sources.workbook import sheet_rows

    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def text(path: str, content: bytes) -> str | None:
        kind = path.lower().rsplit(".", 1)[-1]
        if kind in ("txt", "csv", "json"):
            return content.decode("utf-8-sig")
        if kind == "docx":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                raw = z.read("word/document.xml")
            if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
                raise ValueError("document type declarations are refused")
            root = ElementTree.fromstring(raw)
            return "\n".join("".join(t.text or "" for t in p.iter(f"{word}t")) for p in root.iter(f"{word}p"))
        if kind == "xlsx":
            lines, last = [], None
            for sheet, _, cells in sheet_rows(content):
                if sheet != last:
                    lines.append(sheet)
                    last = sheet
                lines.append(" | ".join("" if c is None else str(c) for c in cells))
            return "\n".join(lines)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    found = text(path, bytes(content))
                    out.append((path, found, None if found is not None else "no reader"))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as problem:
                    out.append((path, None, str(problem)))
            yield pd.DataFrame(out, columns=["path", "text", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, problem string")


