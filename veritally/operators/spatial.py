"""Fields and lines by where words stand on a page. Rows carry their words from left to right; all is built-in expressions.

``rows`` has (doc, page, row_no, width of the page, words array<struct<x0,x1,top,bottom,text>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.numbers import plain_decimal
from ..functions.text import clean_party_name

#: Identifiers and labels that are read by position, and how column headings are printed: parts of a heading without its
#: blanks, most telling first, then whole headings.
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9./_-]{0,79}$"
TITLE = r"(?i)\b(?:tax|commercial|sales|debit|credit)\s*invoice\b"
DATE_LABELS, NOT_DATES = ["date", "document date", "invoice date"], ["due", "run", "report"]
BUYER_LABELS, NEXT_PARTY = ["bill to", "buyer"], ["ship to", "deliver to"]
COMPACT_LABELS = {"no": "number", "date": "date", "po no": "po", "po number": "po"}
HEADINGS = {
    "serial": (["serialnumber", "serialno", "srno", "sno"], ["s no", "sno", "sr", "sr no", "serial", "serial no", "line no", "line number"]),
    "item": (["itemnumber", "itemcode", "itemno"], ["item", "item no", "item number", "item code", "sku", "product code"]),
    "description": (
        ["productdescription", "itemdescription", "servicedescription", "description", "productname", "itemname", "particulars", "desc"],
        ["name", "item name", "product name", "service description", "item description", "product description", "particulars"],
    ),
    "uom": (["unitofmeasure", "measureunit", "uom"], ["uom", "u m", "unit", "unit of measure"]),
    "qty": (["quantity", "qty"], ["qty", "quantity"]),
    "price": (["sellingprice", "unitprice", "priceperunit", "price", "rate"], ["price", "unit price", "unitprice", "rate"]),
}
TWO_WORDS = {"description": ["product name", "item name", "product description", "item description", "service description"], "price": ["unit price"], "serial": ["s no", "sr no", "line no", "line number"]}
AFTER_PRICE = ["amount", "amt", "disc", "discount", "gross", "net", "rate", "subtotal", "tax", "total", "value", "vat"]
FOOTER = r"\b(?:net amount|tax amount|vat amount|total amount|sub total|subtotal|continued|page total)\b"
BARCODE = r"(?i)\b(?:EAN|GTIN|UPC)\s*[:#-]?\s*([0-9][0-9 -]{6,22}[0-9])\b"


def normal(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def word_rows(words: DataFrame) -> DataFrame:
    """Rows of words that carry a row number; ``words`` has (doc, page, row_no, width, x0, x1, top, bottom, text)."""
    return words.groupBy("doc", "page", "row_no").agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("x0", "x1", "top", "bottom", "text"))).alias("words"))


def text_of(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def middle(words: Column) -> Column:
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + (w["top"] + w["bottom"]) / 2)
    return F.try_divide(total, F.size(words))


def tallest(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w: F.greatest(F.lit(1.0), w["bottom"] - w["top"])))


def _token(word: Column) -> Column:
    return F.replace(F.trim(word["text"]), F.lit(" "), F.lit(""))


def _identifier(value: Column) -> Column:
    return F.when(value.rlike(IDENTIFIER) & value.rlike(r"\d"), value)


def only_distinct(found: DataFrame, column: str = "value") -> DataFrame:
    """(doc, value): the only value of a document, cases apart, as first printed."""
    own = found.where(F.col(column).isNotNull()).groupBy("doc")
    return own.agg(F.count_distinct(F.lower(F.col(column))).alias("n"), F.min_by(F.col(column), F.struct("page", "row_no")).alias(column)).where("n = 1").drop("n")


def labelled(rows: DataFrame, labels: list[str], widths: list[int], widest: bool = True) -> DataFrame:
    """Rows by each label in them: (…, label, left, right, height, before, behind): words behind it from its right edge on.

    Of labels that begin at the same word the widest counts, unless all are asked for.
    """
    n = F.size("words")

    def spans(width: int) -> Column:
        named = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda s: F.struct(s.alias("start"), F.lit(width).alias("width"), normal(text_of(F.slice("words", s, width))).alias("label")))
        return F.filter(named, lambda p: (p["start"] + width - 1 <= n) & p["label"].isin(labels))

    hits = F.concat(*[spans(w) for w in widths])
    own = rows.where(F.size("words") > 0).withColumn("_hits", hits)
    kept = F.filter("_hits", lambda h: ~F.exists("_hits", lambda o: (o["start"] == h["start"]) & (o["width"] > h["width"]))) if widest else F.col("_hits")
    every = own.withColumn("_h", F.explode(kept))
    words = F.slice("words", F.col("_h.start"), F.col("_h.width"))
    right = F.array_max(F.transform(words, lambda w: w["x1"]))
    behind = F.slice("words", F.col("_h.start") + F.col("_h.width"), n)
    marked = every.withColumn("label", F.col("_h.label")).withColumn("left", F.array_min(F.transform(words, lambda w: w["x0"]))).withColumn("right", right).withColumn("height", tallest(words))
    marked = marked.withColumn("before", F.when(F.col("_h.start") > 1, normal(F.try_element_at("words", F.col("_h.start") - 1)["text"]))).withColumn("anchor", (F.get(words, F.lit(0))["x0"] + F.get(words, F.lit(0))["x1"]) / 2)
    return marked.withColumn("after", behind).withColumn("behind", F.filter("after", lambda w: w["x0"] >= F.col("right"))).drop("_hits", "_h")


def labelled_identifiers(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(doc, value): the identifier right behind a label."""
    found = labelled(rows, labels, [1, 2, 3], widest=False)
    near = F.get(F.col("behind"), F.lit(0))["x0"] - F.col("right") <= F.greatest(F.lit(36.0), F.col("height") * 5)
    return only_distinct(found.withColumn("value", F.when(near, _identifier(_token(F.get(F.col("behind"), F.lit(0)))))))


def labelled_dates(rows: DataFrame) -> DataFrame:
    """(doc, value): the date behind its label, not that of a due date or a report's run."""
    found = labelled(rows, DATE_LABELS, [1, 2]).where((F.col("label") != "date") | F.col("before").isNull() | ~F.col("before").isin(NOT_DATES))
    near = F.get(F.col("behind"), F.lit(0))["x0"] - F.col("right") <= F.col("width") * 0.25
    return only_distinct(found.withColumn("value", F.when(near, dates.parse(F.get(F.col("behind"), F.lit(0))["text"]).cast("string"))))


def joined_identifiers(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(doc, value): an identifier whose parts a reader split: words that touch each other behind the label."""
    found = labelled(rows, labels, [2, 3])
    reach = F.greatest(F.lit(12.0), F.col("height") * 1.5)
    state = F.struct(F.lit("").alias("text"), F.col("right").alias("edge"), F.lit(True).alias("open"))

    def take(s: Column, w: Column) -> Column:
        token = _token(w)
        mark = (s["text"] == "") & token.isin(":", "#", "-")
        fits = s["open"] & (mark | ((w["x0"] - s["edge"] <= reach) & token.rlike(r"^[A-Za-z0-9./_-]+$")))
        return F.struct(F.when(fits & ~mark, F.concat(s["text"], token)).otherwise(s["text"]).alias("text"), F.when(fits, w["x1"]).otherwise(s["edge"]).alias("edge"), fits.alias("open"))

    return only_distinct(found.withColumn("value", _identifier(F.aggregate("behind", state, take)["text"])))


def title_numbers(rows: DataFrame) -> DataFrame:
    """(doc, value): the only identifier right of an invoice's title, on its row or else on the one above."""
    own = Window.partitionBy("doc", "page").orderBy("row_no")
    near = rows.withColumn("above", F.lag("words").over(own)).where(text_of(F.col("words")).rlike(TITLE))
    title = F.filter("words", lambda w: F.contains(normal(w["text"]), F.lit("invoice")) | (normal(w["text"]) == "tax"))
    marked = near.withColumn("edge", F.array_max(F.transform(title, lambda w: w["x1"]))).withColumn("height", tallest(title))

    def beside(words: Column) -> Column:
        tokens = F.transform(F.filter(words, lambda w: w["x0"] > F.col("edge")), lambda w: F.when(F.length(_token(w)) >= 4, _identifier(_token(w))))
        return F.array_distinct(F.array_compact(tokens))

    gap = middle(F.col("words")) - middle(F.col("above"))
    reach = F.greatest(F.lit(100.0), F.col("height") * 6)
    values = F.when(F.size(beside(F.col("words"))) > 0, beside(F.col("words"))).when((gap > 0) & (gap <= reach), beside(F.col("above")))
    return only_distinct(marked.withColumn("values", values).withColumn("value", F.when(F.size("values") == 1, F.get(F.col("values"), F.lit(0)))))


def _below(found: DataFrame, rows: DataFrame, reach: Column, words) -> DataFrame:
    """The first name below each label within a reach; the rows of a page meet its labels."""
    own = found.withColumn("_y", middle(F.col("words"))).withColumn("_reach", reach).withColumnRenamed("row_no", "_row").drop("words", "after", "behind", "above")
    beneath = own.join(rows.select("doc", "page", "row_no", "words"), ["doc", "page"]).where(F.col("row_no") > F.col("_row"))
    gap = middle(F.col("words")) - F.col("_y")
    named = beneath.where((gap > 0) & (gap <= F.col("_reach"))).withColumn("value", clean_party_name(text_of(words(F.col("words"))))).where("value is not null")
    return named.groupBy("doc", "page", F.col("_row").alias("row_no"), "left").agg(F.min_by("value", F.col("row_no")).alias("value"))


def party_names(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(doc, value): a party's name behind its label, else below it."""
    found = labelled(rows, labels, [1, 2])
    same = F.filter("behind", lambda w: w["x0"] - F.col("left") <= F.col("width") * 0.4)
    own = found.withColumn("value", clean_party_name(text_of(same)))
    under = _below(own.where("value is null"), rows, F.greatest(F.lit(50.0), F.col("height") * 4), lambda words: F.filter(words, lambda w: (w["x0"] >= F.col("left")) & (w["x0"] - F.col("left") <= F.col("width") * 0.35)))
    columns = ["doc", "page", "row_no", "value"]
    return only_distinct(own.select(columns).where("value is not null").unionByName(under.select(columns)))


def buyer_names(rows: DataFrame) -> DataFrame:
    """(doc, value): the name below the buyer's label, left of the party next to it."""
    found = labelled(rows, BUYER_LABELS, [1, 2])
    first = found.groupBy("doc", "page", "row_no").agg(F.min_by(F.struct(*[F.col(c) for c in found.columns if c not in ("doc", "page", "row_no")]), "left").alias("f")).select("doc", "page", "row_no", "f.*")
    n = F.size("after")
    nexts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("i"), normal(text_of(F.slice("after", i, 2))).alias("label"))), lambda p: p["label"].isin(NEXT_PARTY))
    edged = first.withColumn("edge", F.when(F.size(nexts) > 0, F.try_element_at("after", F.get(nexts, F.lit(0))["i"])["x0"]).otherwise(F.col("width")))

    def inside(words: Column) -> Column:
        return F.filter(words, lambda w: ((w["x0"] + w["x1"]) / 2 >= F.col("left")) & ((w["x0"] + w["x1"]) / 2 < F.col("edge")))

    return only_distinct(_below(edged, rows, F.greatest(F.lit(90.0), F.col("height") * 8), inside))


def compact_headers(rows: DataFrame) -> DataFrame:
    """(doc, number, date, po) of a block whose three labels share a column, each with a value behind it; else none.

    Bare labels as these say too little one by one. A date in figures is day first here.
    """
    found = labelled(rows, list(COMPACT_LABELS), [1, 2])
    field = F.create_map(*[F.lit(x) for pair in COMPACT_LABELS.items() for x in pair])[F.col("label")]
    value = F.get(F.filter("behind", lambda w: w["x0"] - F.col("right") <= F.col("width") * 0.22), F.lit(0))["text"]
    other = ((F.col("field") == "date") & (F.col("before") == "due")) | ((F.col("field") == "number") & F.col("before").isin("po", "lpo", "warehouse"))
    raw = found.withColumn("field", field).where(~F.coalesce(other, F.lit(False))).withColumn("raw", F.trim(value))
    day_first = F.try_to_timestamp("raw", F.lit("d/M/yyyy")).cast("date")
    read = F.when(F.col("field") == "date", F.coalesce(dates.parse(F.col("raw")), day_first).cast("string")).otherwise(_identifier(F.replace("raw", F.lit(" "), F.lit(""))))
    records = raw.withColumn("value", read).where("value is not null").select("doc", "page", "field", "anchor", "width", "value")
    near = records.select("doc", "page", F.col("anchor").alias("_anchor"), F.col("width").alias("_width")).distinct().join(records.drop("width").hint("merge"), ["doc", "page"])
    near = near.where(F.abs(F.col("anchor") - F.col("_anchor")) <= F.greatest(F.lit(18.0), F.col("_width") * 0.04))
    sets = near.groupBy("doc", "page", "_anchor").agg(*[F.collect_set(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("number", "date", "po")])
    full = sets.where("size(number) = 1 and size(date) = 1 and size(po) = 1").select("doc", F.struct(*[F.get(F.col(f), F.lit(0)).alias(f) for f in ("number", "date", "po")]).alias("block")).distinct()
    return full.groupBy("doc").agg(F.count("*").alias("n"), F.first("block").alias("b")).where("n = 1").select("doc", "b.*")


def anchors(words: Column) -> Column:
    """Where the column headings of a row stand: struct of serial, item, description, uom, qty, price; null where there is none.

    Words carry ``normal`` and ``packed``, their text without marks and without blanks (``spelled``).
    A heading printed into another one counts at its share of the word. Two words may make a heading, whose middle then counts.
    """
    packed = lambda w: w["packed"]
    centre = lambda w: (w["x0"] + w["x1"]) / 2

    def place(w: Column, role: str) -> Column:
        parts, whole = HEADINGS[role]
        found = F.when(w["normal"].isin(whole) | (w["normal"].startswith("desc") if role == "description" else F.lit(False)), centre(w))
        inside = None
        for part in parts:
            at = w["x0"] + (w["x1"] - w["x0"]) * (F.instr(packed(w), part) - 1 + len(part) / 2) / F.length(packed(w))
            inside = F.when(F.contains(packed(w), F.lit(part)), at) if inside is None else inside.when(F.contains(packed(w), F.lit(part)), at)
        return F.coalesce(inside, found)

    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.size(words)).alias("b"))

    def paired(role: str) -> Column:
        hits = F.filter(pairs, lambda p: F.concat_ws(" ", p["a"]["normal"], p["b"]["normal"]).isin(TWO_WORDS.get(role, [])))
        return (centre(F.get(hits, F.lit(0))["a"]) + centre(F.get(hits, F.lit(0))["b"])) / 2

    merged = F.array_sort(F.transform(F.filter(words, lambda w: F.contains(packed(w), F.lit("itemcode")) & F.contains(packed(w), F.lit("description")) & F.contains(packed(w), F.lit("uom")) & F.contains(packed(w), F.lit("qty"))), centre))
    spread = F.size(merged) >= 3
    unit_price = F.filter(pairs, lambda p: F.concat_ws(" ", p["a"]["normal"], p["b"]["normal"]) == "unit price")
    of = {}
    for role in HEADINGS:
        own = F.array_compact(_places(words, role, place))
        if role == "uom":
            own = F.filter(own, lambda x: ~F.exists(unit_price, lambda p: centre(p["a"]) == x))
        of[role] = F.coalesce(F.get(own, F.lit(0)), paired(role)) if role in TWO_WORDS else F.get(own, F.lit(0))
    of["uom"], of["qty"] = F.when(spread, F.get(merged, F.lit(1))).otherwise(of["uom"]), F.when(spread, F.get(merged, F.lit(2))).otherwise(of["qty"])
    return F.struct(*[of[r].alias(r) for r in HEADINGS])


def spelled(words: Column) -> Column:
    return F.transform(words, lambda w: w.withField("normal", normal(w["text"])).withField("packed", F.regexp_replace(F.lower(w["text"]), "[^a-z0-9]", "")))


def _places(words: Column, role: str, place) -> Column:
    return F.transform(words, lambda w: place(w, role))


def columns_of(rows: DataFrame) -> DataFrame:
    """Header rows: (doc, page, row_no, last_row, serial … price, price_right, net, tax bounds) of rows that name description,
    quantity and price from left to right, alone or with the row right below."""
    own = Window.partitionBy("doc", "page").orderBy("row_no")
    at = rows.where(F.size("words") > 0).withColumn("_spelled", spelled(F.col("words"))).withColumn("a", anchors(F.col("_spelled"))).withColumn("y", middle(F.col("words"))).withColumn("h", tallest(F.col("words")))
    near = at.withColumn("b", F.lead("a").over(own)).withColumn("below", F.lead("words").over(own)).withColumn("gap", F.lead("y").over(own) - F.col("y"))
    near = near.withColumn("above", F.when(F.col("y") - F.lag("y").over(own) <= F.greatest(F.lit(12.0), F.col("h") * 2), F.lag("words").over(own)))
    whole = F.col("a.description").isNotNull() & F.col("a.qty").isNotNull() & F.col("a.price").isNotNull()
    two = ~whole & (F.col("gap") <= F.greatest(F.lit(8.0), F.col("h") * 2))
    both = near.withColumn("two", F.coalesce(two, F.lit(False)))
    for role in HEADINGS:
        both = both.withColumn(role, F.coalesce(F.col("a")[role], F.when(F.col("two"), F.col("b")[role])))
    good = both.where((F.col("description") < F.col("qty")) & (F.col("qty") < F.col("price")))
    for role in ("serial", "item", "uom"):
        good = good.where(F.col(role).isNull() | (F.col(role) < F.col("qty")))
    main = F.when(F.col("two"), F.col("below")).otherwise(F.col("words"))
    upper = F.when(F.col("two"), F.col("words")).otherwise(F.coalesce("above", F.filter("words", lambda w: F.lit(False))))
    marked = good.withColumn("main", main).withColumn("upper", upper).withColumn("last_row", F.col("row_no") + F.col("two").cast("int"))
    later = F.array_min(F.transform(F.filter(F.concat("words", F.when(F.col("two"), F.col("below")).otherwise(F.filter("words", lambda w: F.lit(False)))), lambda w: ((w["x0"] + w["x1"]) / 2 > F.col("price") + 4) & normal(w["text"]).isin(AFTER_PRICE)), lambda w: (w["x0"] + w["x1"]) / 2))
    marked = marked.withColumn("price_right", F.coalesce((F.col("price") + later) / 2, F.col("width")))
    told = marked.withColumn("labels", _amount_labels()).withColumn("net", _bounds("net")).withColumn("tax", _bounds("tax"))
    return told.select("doc", "page", "row_no", "last_row", *HEADINGS, "price_right", "net", "tax")


def _amount_labels() -> Column:
    """Headings right of the price as (at, kind): net, tax or other. ``amount`` below ``vat`` or ``tax`` means the tax."""
    n = F.size("main")
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.try_element_at("main", i).alias("w"), F.try_element_at("main", i + 1).alias("next"), F.when(i > 1, F.try_element_at("main", F.greatest(i - 1, F.lit(1)))).alias("last")))

    def one(p: Column) -> Column:
        word, centre = normal(p["w"]["text"]), (p["w"]["x0"] + p["w"]["x1"]) / 2
        after = normal(p["next"]["text"])
        under = F.exists("upper", lambda u: normal(u["text"]).isin("vat", "tax") & (F.abs((u["x0"] + u["x1"]) / 2 - centre) <= F.greatest(F.lit(30.0), (p["w"]["bottom"] - p["w"]["top"]) * 2.5)))
        taxed = word.isin("vat amount", "vat amt", "tax amount", "tax amt") | (word.isin("amt", "amount") & under)
        return (
            F.when((word == "sub") & (after == "total"), F.struct(((centre + (p["next"]["x0"] + p["next"]["x1"]) / 2) / 2).alias("at"), F.lit("net").alias("kind")))
            .when((word == "total") & (normal(p["last"]["text"]) == "sub"), F.lit(None))
            .when(word.isin("subtotal", "sub total", "net amount", "taxable value"), F.struct(centre.alias("at"), F.lit("net").alias("kind")))
            .when((centre > F.col("price") + 4) & taxed, F.struct(centre.alias("at"), F.lit("tax").alias("kind")))
            .when((centre > F.col("price") + 4) & word.isin(AFTER_PRICE), F.struct(centre.alias("at"), F.lit("other").alias("kind")))
        )

    return F.array_compact(F.transform(every, one))


def _bounds(kind: str) -> Column:
    """The column of the only heading of a kind: from half way to its left neighbour to half way to its right one."""
    targets = F.filter("labels", lambda x: x["kind"] == kind)
    at = F.get(targets, F.lit(0))["at"]
    places = F.concat(F.transform("labels", lambda x: x["at"]), F.array("price"))
    left, right = F.array_max(F.filter(places, lambda x: x < at)), F.array_min(F.filter(places, lambda x: x > at))
    return F.when(F.size(targets) == 1, F.struct(F.coalesce((left + at) / 2, F.lit(0.0)).alias("left"), F.coalesce((at + right) / 2, F.col("width")).alias("right")))


def parts(rows: DataFrame) -> DataFrame:
    """Rows with their words by column: item, description, uom, qty, price, net, tax; rows carry the columns in force.

    Borders lie half way between two headings; a serial column is narrow, a description reaches up to the next heading.
    """
    named = F.array_sort(F.filter(F.array(*[F.struct(F.col(r).alias("at"), F.lit(r).alias("role")) for r in HEADINGS]), lambda x: x["at"].isNotNull()))
    own = rows.withColumn("_named", named)
    gap = lambda a, b: b["at"] - a["at"]

    def border(a: Column, b: Column) -> Column:
        described = (a["role"] == "description") & F.col("uom").isNotNull()
        return F.when((a["role"] == "serial") & (b["role"] == "item"), a["at"] + gap(a, b) * 0.25).when(described, b["at"] - F.greatest(F.lit(3.0), gap(a, b) * 0.08)).otherwise((a["at"] + b["at"]) / 2)

    n = F.size("_named")
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.try_element_at("_named", i)["role"].alias("role"), F.when(i > 1, border(F.try_element_at("_named", F.greatest(i - 1, F.lit(1))), F.try_element_at("_named", i))).alias("left"), F.when(i < n, border(F.try_element_at("_named", i), F.try_element_at("_named", i + 1))).alias("right")))
    own = own.withColumn("_cuts", cuts)
    centre = lambda w: (w["x0"] + w["x1"]) / 2

    def of(role: str) -> Column:
        cut = F.get(F.filter("_cuts", lambda c: c["role"] == role), F.lit(0))
        inside = F.filter("words", lambda w: (centre(w) < F.col("price_right")) & (cut["left"].isNull() | (centre(w) >= cut["left"])) & (cut["right"].isNull() | (centre(w) < cut["right"])))
        return F.when(cut.isNotNull(), inside).otherwise(F.filter("words", lambda w: F.lit(False)))

    def bounded(bounds: str) -> Column:
        return F.filter("words", lambda w: F.coalesce((centre(w) >= F.col(bounds)["left"]) & (centre(w) < F.col(bounds)["right"]), F.lit(False)))

    named_parts = [of(r).alias(f"{r}_words") for r in ("item", "description", "uom", "qty", "price")]
    return own.select("doc", "page", "row_no", "words", *named_parts, bounded("net").alias("net_words"), bounded("tax").alias("tax_words"))


def one_number(words: Column) -> Column:
    """The only number among words; one whose comma or point was read as a word of its own is joined first."""
    torn = F.exists(words, lambda w: (normal(w["text"]) == "") | normal(w["text"]).isin("comma", "dot") & ~w["text"].rlike("^[A-Za-z0-9]+$"))
    joined = plain_decimal(F.array_join(F.transform(words, lambda w: F.trim(w["text"])), ""))
    numbers = F.array_compact(F.transform(words, lambda w: plain_decimal(w["text"])))
    return F.when(torn, joined).when(F.size(numbers) == 1, F.get(numbers, F.lit(0)))


def totals_by_place(rows: DataFrame) -> DataFrame:
    """(doc, net, tax): the last number of rows that name them, or of a ``total in`` currency row under the columns; one value or none."""
    numbers = F.array_compact(F.transform("words", lambda w: plain_decimal(w["text"])))
    own = rows.where(F.size("words") > 0).withColumn("t", normal(text_of(F.col("words")))).withColumn("n", F.try_element_at(numbers, F.lit(-1)))
    named = own.select("doc", F.when(F.col("t").rlike(r"\b(?:sub\s*total|subtotal|net amount)\b"), F.col("n")).alias("net"), F.when(F.col("t").rlike(r"^(?:vat|tax)\b"), F.col("n")).alias("tax"))
    lined = governed(rows).where(normal(text_of(F.col("words"))).rlike(r"\btotal\s+in\s+[a-z]{3}\b"))
    first = parts(lined).groupBy("doc", "page").agg(F.min_by(F.struct(one_number(F.col("net_words")).alias("net"), one_number(F.col("tax_words")).alias("tax")), "row_no").alias("v")).select("doc", "v.net", "v.tax")
    every = named.unionByName(first).groupBy("doc").agg(*[F.collect_set(c).alias(c) for c in ("net", "tax")])
    return every.select("doc", *[F.when(F.size(c) == 1, F.get(F.col(c), F.lit(0))).alias(c) for c in ("net", "tax")])


def governed(rows: DataFrame) -> DataFrame:
    """Rows below a header of their page, with that header's columns, up to a footer or the next header."""
    heads = columns_of(rows)
    columns = [c for c in heads.columns if c not in ("doc", "page", "row_no")]
    marked = rows.join(heads.withColumn("_head", F.struct(*columns)).select("doc", "page", "row_no", "_head"), ["doc", "page", "row_no"], "left")
    so_far = Window.partitionBy("doc", "page").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumn("_head", F.last("_head", ignorenulls=True).over(so_far)).withColumn("_table", F.max(F.when(F.col("_head").isNotNull() & (F.col("row_no") <= F.col("_head.last_row")), F.col("row_no"))).over(so_far))
    return own.where(F.col("_head").isNotNull() & (F.col("row_no") > F.col("_head.last_row"))).select(*rows.columns, "_table", "_head.*")


def line_items(rows: DataFrame) -> DataFrame:
    """(doc, page, row_no, sku, gtin, description, qty, uom, price, net_amount, tax_amount, rows) of the tables on the pages.

    A row with a quantity, a price and an identity is a line. Rows right below it, each near the last, continue it; up to two
    rows that a gap sets apart begin the next one.
    """
    within = Window.partitionBy("doc", "page", "_table").orderBy("row_no")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    below = governed(rows).withColumn("_end", F.max(normal(text_of(F.col("words"))).rlike(FOOTER)).over(so_far)).where("not _end")
    cut = parts(below).join(below.select("doc", "page", "row_no", "_table"), ["doc", "page", "row_no"])
    join = lambda c: F.nullif(F.trim(text_of(F.col(c))), F.lit(""))
    gtin = F.nullif(F.replace(F.regexp_extract(F.coalesce(join("description_words"), F.lit("")), BARCODE, 1), F.lit(" "), F.lit("")), F.lit(""))
    plain = F.nullif(F.btrim(F.trim(F.regexp_replace(F.regexp_replace(join("description_words"), BARCODE, ""), r"\s+", " ")), F.lit(" -,:;")), F.lit(""))
    codes = F.filter(F.transform("item_words", lambda w: _token(w)), lambda t: t.rlike(IDENTIFIER) & ~normal(t).isin("item", "no", "number", "s no", "serial"))
    lettered = F.filter(codes, lambda t: t.rlike("[A-Za-z]"))
    ranked = F.array_max(F.transform(codes, lambda t: F.struct((F.when(t.rlike("[A-Za-z]"), 3).otherwise(1) + t.rlike("[-_/]").cast("int")).alias("score"), F.length(t).alias("n"), t.alias("t"))))["t"]
    sku = F.when(F.size(lettered) > 1, F.array_join(lettered, "")).otherwise(ranked)
    read = cut.select(
        "doc", "page", "row_no", "_table", middle(F.col("words")).alias("y"), tallest(F.col("words")).alias("h"), sku.alias("sku"), gtin.alias("gtin"), F.when(~plain.rlike(r"^[=+\-@]"), plain).alias("description"),
        one_number(F.col("qty_words")).alias("qty"), join("uom_words").alias("uom"), one_number(F.col("price_words")).alias("price"), one_number(F.col("net_words")).alias("net_amount"), one_number(F.col("tax_words")).alias("tax_amount"),
    )
    priced = F.col("qty").isNotNull() & F.col("price").isNotNull() & (F.col("sku").isNotNull() | F.col("gtin").isNotNull() | F.col("description").isNotNull())
    told = read.withColumn("priced", priced).withColumn("line", F.sum(F.col("priced").cast("int")).over(so_far))
    apart = F.col("y") - F.lag("y").over(within) > F.greatest(F.lit(12.0), F.col("h") * 2.2)
    in_line = Window.partitionBy("doc", "page", "_table", "line").orderBy("row_no")
    told = told.withColumn("apart", ~F.col("priced") & F.coalesce(apart, F.lit(False))).withColumn("far", (F.max("apart").over(in_line.rowsBetween(Window.unboundedPreceding, 0))) | (F.col("line") == 0))
    waiting = F.col("far") & ~F.col("priced") & (F.col("sku").isNotNull() | F.col("description").isNotNull())
    told = told.withColumn("waiting", waiting).withColumn("behind", F.count_if("waiting").over(in_line.rowsBetween(0, Window.unboundedFollowing)))
    owner = F.when(F.col("waiting"), F.when(F.col("behind") <= 2, F.col("line") + 1)).when(~F.col("far") | F.col("priced"), F.col("line"))
    every = told.withColumn("owner", owner).where("owner is not null").groupBy("doc", "page", "_table", "owner")
    kept = F.array_sort(F.collect_list(F.struct("row_no", "sku", "gtin", "description", "priced", "waiting")))
    value = lambda c: F.max(F.when(F.col("priced"), F.col(c)))
    lines = every.agg(F.max(F.when(F.col("priced"), F.col("row_no"))).alias("row_no"), *[value(c).alias(c) for c in ("qty", "uom", "price", "net_amount", "tax_amount")], kept.alias("_kept"), F.count("*").alias("rows")).where("row_no is not null")
    pieces = lambda c: F.filter(F.transform("_kept", lambda k: F.when(k["priced"] | (F.length(k[c]) > 1), k[c])), lambda v: v.isNotNull())
    gtins = F.filter(F.transform(F.concat(F.filter("_kept", lambda k: k["priced"]), F.filter("_kept", lambda k: ~k["priced"])), lambda k: k["gtin"]), lambda v: v.isNotNull())
    return lines.select("doc", "page", "row_no", F.nullif(F.array_join(pieces("sku"), ""), F.lit("")).alias("sku"), F.get(gtins, F.lit(0)).alias("gtin"), F.nullif(F.array_join(pieces("description"), " "), F.lit("")).alias("description"), "qty", "uom", "price", "net_amount", "tax_amount", "rows")


def under_heading(words: DataFrame, height: float) -> DataFrame:
    """(doc, page, value): numbers below an ``invoice number`` heading in the top 40 % of a page, the nearest within four line heights.

    ``words`` has (doc, page, n, text, x0, x1, top, bottom) in reading order.
    """
    own = Window.partitionBy("doc", "page").orderBy("n")
    pairs = words.select("doc", "page", "n", "text", "x0", "x1", "top", *[F.lead(c).over(own).alias(f"next_{c}") for c in ("text", "x0", "x1", "top", "bottom")])
    label = (F.lower("text") == "invoice") & F.lower("next_text").isin("number", "no", "no.", "#", "num", "num.", "nr", "nr.")
    heads = pairs.where(label & (F.abs(F.col("top") - F.col("next_top")) <= 2) & (F.col("next_x0") - F.col("x1") <= 15) & (F.col("top") <= height * 0.4))
    heads = heads.select("doc", "page", F.col("n").alias("head"), (F.col("x0") - 10).alias("left"), (F.col("next_x1") + 10).alias("right"), F.col("next_bottom").alias("from"), F.greatest(F.lit(1.0), F.col("next_bottom") - F.col("next_top")).alias("line"))
    below = heads.join(words, ["doc", "page"]).where((F.col("top") > F.col("from")) & (F.col("top") <= F.col("from") + 4 * F.col("line")) & (F.col("x1") > F.col("left")) & (F.col("x0") < F.col("right")))
    value = F.rtrim(F.trim("text"), F.lit(".,:;"))
    fit = value.rlike(r"(?i)^[A-Z0-9][A-Z0-9/-]{3,39}$") & value.rlike(r"\d") & ~value.rlike(r"^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}$")
    return below.where(fit).groupBy("doc", "page", "head").agg(F.min_by(value, F.struct("top", "n")).alias("value")).select("doc", "page", "value").distinct()
