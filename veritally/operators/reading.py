"""Read quality, read merging, evidence, printed facts: what decides between several readings of one invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key header fields of which three must be there.
KEY_FIELDS = ("number", "date", "po", "net", "tax")


def header_count(fields: tuple[str, ...] = KEY_FIELDS) -> Column:
    out = F.lit(0)
    for f in fields:
        out = out + (F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int")
    return out


def weak_read(headers: DataFrame, lines: DataFrame, reconciled: DataFrame) -> DataFrame:
    """(doc, reasons) why a read can't stand alone; none when it can. ``reconciled`` has (doc, reconciles)."""
    coded = lines.groupBy("doc").agg(F.bool_or(F.col("sku").isNotNull() | F.col("gtin").isNotNull()).alias("coded"))
    joined = headers.join(coded, "doc", "left").join(reconciled, "doc", "left")
    tests = [
        (~F.coalesce("coded", F.lit(False)), "no line has an item code"),
        (F.col("net").isNull(), "no net total"),
        (F.col("net").isNotNull() & ~F.coalesce("reconciles", F.lit(False)), "line nets do not reconcile with the printed net"),
        (header_count() < 3, "fewer than 3 of number, date, PO, net and tax"),
    ]
    return joined.select("doc", F.array_compact(F.array(*[F.when(t, F.lit(reason)) for t, reason in tests])).alias("reasons"))


def best_read(reads: DataFrame) -> DataFrame:
    """The read with the highest completeness of each document; ties keep the earlier reader."""
    columns = [c for c in reads.columns if c != "doc"]
    return reads.groupBy("doc").agg(F.max_by(F.struct(*columns), F.struct("completeness", -F.col("position"))).alias("r")).select("doc", "r.*")


#: Line fields by which two reads are compared as amounts.
AMOUNTS = ("qty", "price", "net_amount", "tax_amount")


def same_value(field: str, mine: Column, theirs: Column) -> Column:
    """Whether two readers agree: amounts by value, text by digits and letters."""
    if field in AMOUNTS:
        return mine == theirs
    folded = [F.regexp_replace(F.lower(c.cast("string")), "[^0-9a-z]", "") for c in (mine, theirs)]
    return folded[0] == folded[1]


def merge_reads(mine: DataFrame, theirs: DataFrame, fields: list[str]) -> DataFrame:
    """Lines (doc, line, fields) of the first read, gaps filled from the second one, ``aligned`` and the fields that differ.

    Pairs are those of equal number where a document has as many lines in both reads. A gap is filled only if the pair
    aligns: an equal code or text, or equal quantity and price. A value is never replaced; a differing one is named,
    descriptions apart.
    """
    counts = [df.groupBy("doc").agg(F.count("*").alias(name)) for df, name in ((mine, "a"), (theirs, "b"))]
    equal = counts[0].join(counts[1], "doc").where("a = b").select("doc", F.lit(True).alias("paired"))
    other = theirs.join(equal, "doc").select("doc", "line", "paired", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = mine.join(other, ["doc", "line"], "left")

    def agrees(f: str) -> Column:
        return F.coalesce(same_value(f, F.col(f), F.col(f"_{f}")), F.lit(False))

    aligned = F.lit(False)
    for f in ("sku", "gtin", "description"):
        aligned = aligned | agrees(f) if f in fields else aligned
    aligned = F.coalesce("paired", F.lit(False)) & (aligned | agrees("qty") & agrees("price"))
    differs = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & F.col(f"_{f}").isNotNull() & ~agrees(f), F.lit(f)) for f in fields if f != "description"]))
    marked = joined.withColumn("aligned", aligned).withColumn("differing", differs)
    return marked.select("doc", "line", *[F.when(F.col("aligned"), F.coalesce(f, f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields], "aligned", "differing")


def corroborated(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(doc, index) of barcode claims that the pages bear out.

    A run's claims must not exceed its occurrences in the document, nor those with a page the ones on that page; else
    none of the run's claims is confirmed, as nothing tells the owner apart.
    """
    total = occurrences.groupBy("doc", "run").agg(F.sum("n").alias("total"))
    asked = claims.groupBy("doc", "run").agg(F.count("*").alias("claims"))
    paged = claims.where("page is not null").groupBy("doc", "run", "page").agg(F.count("*").alias("here"))
    over = paged.join(occurrences, ["doc", "run", "page"], "left").where(F.col("here") > F.coalesce("n", F.lit(0))).select("doc", "run").distinct()
    fine = asked.join(total, ["doc", "run"]).where("claims <= total").join(over, ["doc", "run"], "left_anti")
    return claims.join(fine.select("doc", "run"), ["doc", "run"], "left_semi").select("doc", "index")


#: Fixed value: how the number of lines is printed.
TOTAL_LINES = r"(?i)\btotal\s+lines\s*:?\s*(\d{1,4})\b"


def printed_line_count(text: Column) -> Column:
    """The only distinct number of a printed ``Total lines: N`` from 1 to 1000."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOTAL_LINES), 1), lambda x: x.cast("int")))
    own = F.filter(found, lambda n: n.between(1, 1000))
    return F.when(F.size(own) == 1, own[0])


def printed_discount(text: Column, amount: Column) -> Column:
    """Whether the amount is printed on a line with the word discount."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"(?i)\bdiscount\b"))

    def prints(line: Column) -> Column:
        return F.exists(F.regexp_extract_all(line, F.lit(r"(\d[\d,]*\.?\d*)"), 1), lambda n: F.coalesce(F.replace(n, F.lit(","), F.lit("")).try_cast("decimal(38,6)") == amount, F.lit(False)))

    return F.exists(lines, prints)


def pages_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\f")


def unreadable_pages(text: Column, count: Column) -> Column:
    """Page numbers up to the count without any text."""
    pages = pages_of(text)
    return F.filter(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.trim(F.coalesce(F.get(pages, i - 1), F.lit(""))) == "")


def one_character_off(number: Column, name: Column) -> Column:
    """A run of five or more digits in a file name that differs from the number in one digit, else null."""
    digits = F.regexp_replace(number, r"\D", "")

    def apart(run: Column) -> Column:
        return F.aggregate(F.zip_with(F.split(run, ""), F.split(digits, ""), lambda a, b: (~a.eqNullSafe(b)).cast("int")), F.lit(0), lambda s, x: s + x)

    close = F.filter(F.regexp_extract_all(name, F.lit(r"(\d{5,})"), 1), lambda r: (F.length(r) == F.length(digits)) & (apart(r) == 1))
    return F.get(close, F.lit(0))


def located(values: DataFrame, tokens: DataFrame, widest: int = 12) -> DataFrame:
    """(doc, value, row, first, last): where each value is printed first, as up to ``widest`` neighbouring tokens of a row.

    ``tokens`` has (doc, row, place, text). Windows are joined on the folded text; values of other lengths never meet.
    """
    rows = tokens.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("place", F.regexp_replace(F.lower("text"), "[^0-9a-z]", "").alias("t")))).alias("ts"))
    windows = rows.select("doc", "row", F.posexplode("ts").alias("i", "first"), "ts").select("doc", "row", F.col("first.place").alias("first"), "i", "ts", F.explode(F.sequence(F.lit(1), F.least(F.lit(widest), F.size("ts") - F.col("i")))).alias("n"))
    joined = windows.select("doc", "row", "first", F.get("ts", F.col("i") + F.col("n") - 1)["place"].alias("last"), F.array_join(F.transform(F.slice("ts", F.col("i") + 1, F.col("n")), lambda t: t["t"]), "").alias("folded"))
    asked = values.select("doc", "value", F.regexp_replace(F.lower("value"), "[^0-9a-z]", "").alias("folded")).where("folded <> ''")
    return asked.join(joined, ["doc", "folded"]).groupBy("doc", "value").agg(F.min(F.struct("row", "first", "last")).alias("at")).select("doc", "value", "at.row", "at.first", "at.last")


def text_window(text: Column, patterns: list[str]) -> Column:
    """The first pattern's only distinct value over a text, patterns in order; null with none or several."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(p), 1))
        out = F.when(F.size(found) == 1, found[0]).when(F.size(found) > 1, None).otherwise(out)
    return out
