"""Pages to invoices, and word boxes to rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a page that count as its head, words that are labels, and how dates, headings and page counters are printed.
HEADER_LINES = 30
LABEL_WORDS = ["date", "total", "amount", "number", "type", "details", "summary", "copy", "page"]
DATE_LIKE = r"^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}$"
HEADING = r"(?i)\b(?:tax|commercial|sales|proforma|vat)?\s*invoice\s*(?:no\.?|number|num\.?|#|nr\.?)?\s*[:#.]?\s*([A-Z0-9][A-Z0-9/-]{3,39})\b"
COUNTER = r"(?i)\bpage\s*[:#]?\s*(\d{1,3})\s*(?:of|/)\s*(\d{1,3})\b"


def page_numbers(text: Column) -> Column:
    """Distinct invoice numbers at the head of a page, in print order."""
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), 1, HEADER_LINES), "\n")
    found = F.transform(F.regexp_extract_all(head, F.lit(HEADING), 1), lambda v: F.regexp_replace(v, r"[.,:;]+$", ""))
    return F.array_distinct(F.filter(found, lambda v: ~F.lower(v).isin(LABEL_WORDS) & v.rlike(r"\d") & ~v.rlike(DATE_LIKE)))


def page_counter(text: Column) -> Column:
    return F.when(text.rlike(COUNTER), F.struct(F.regexp_extract(text, COUNTER, 1).cast("int").alias("page"), F.regexp_extract(text, COUNTER, 2).cast("int").alias("pages")))


def segments(pages: DataFrame) -> DataFrame:
    """(doc, numbers, segments, refused) over (doc, page_no, text): runs of pages of one invoice.

    A page opens a run with a new number, or with a restarting counter; a run without a number takes the first one that
    follows. The state of the open run decides, so the pages of a document are folded in order, in one expression.
    """
    page = F.struct("page_no", page_numbers(F.col("text")).alias("numbers"), F.coalesce(page_counter(F.col("text"))["page"] == 1, F.lit(False)).alias("first"))
    docs = pages.groupBy("doc").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    run = "struct<number:string,pages:array<int>>"
    start = F.struct(F.expr(f"cast(array() as array<{run}>)").alias("runs"), F.lit(True).alias("clean"))

    def step(state: Column, p: Column) -> Column:
        number = F.get(p["numbers"], F.lit(0))
        runs = state["runs"]
        last = F.element_at(runs, -1)
        begun = F.size(runs) > 0
        restarts = p["first"] & begun
        adopts = begun & number.isNotNull() & last["number"].isNull() & ~restarts
        opens = ~begun | (~adopts & ((number.isNotNull() & ~number.eqNullSafe(last["number"])) | (restarts & number.isNull())))
        own = F.struct(number.alias("number"), F.array(p["page_no"]).alias("pages"))
        longer = F.struct(F.when(adopts, number).otherwise(last["number"]).alias("number"), F.concat(last["pages"], F.array(p["page_no"])).alias("pages"))
        again = opens & begun & number.isNotNull() & F.exists(runs, lambda r: r["number"] == number)
        grown = F.when(opens, F.concat(runs, F.array(own))).otherwise(F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer)))
        return F.struct(grown.alias("runs"), (state["clean"] & (F.size(p["numbers"]) <= 1) & ~again).alias("clean"))

    start_type = f"struct<runs:array<{run}>,clean:boolean>"
    folded = docs.withColumn("numbers", F.array_distinct(F.flatten(F.transform("pages", lambda p: p["numbers"])))).withColumn(
        "state", F.when(F.size("pages") > 0, F.aggregate("pages", start.cast(start_type), lambda s, p: step(s, p).cast(start_type)))
    )
    whole = F.array(F.struct(F.get("numbers", F.lit(0)).alias("number"), F.transform("pages", lambda p: p["page_no"]).alias("pages")))
    runs = F.col("state.runs")
    bad = ~F.col("state.clean") | F.exists(runs, lambda r: r["number"].isNull()) | (F.size(runs) != F.size("numbers"))
    single = F.size("numbers") < 2
    return folded.select("doc", "numbers", F.when(single, whole.cast(f"array<{run}>")).when(bad, F.array().cast(f"array<{run}>")).otherwise(runs).alias("segments"), (~single & bad).alias("refused"))


def normal_boxes(words: DataFrame) -> DataFrame:
    """Boxes with ordered corners and a top-left origin, on pages 1 to 20; boxes without text or area are left out."""
    top, bottom = F.least("top", "bottom"), F.greatest("top", "bottom")
    flipped = F.col("origin") == "bottom-left"
    out = words.select(
        "doc", "page", F.trim("text").alias("text"), F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"),
        F.when(flipped, F.col("page_h") - bottom).otherwise(top).alias("top"), F.when(flipped, F.col("page_h") - top).otherwise(bottom).alias("bottom"), "page_w", "page_h",
    )
    return out.where("text <> '' and x1 > x0 and bottom > top and page between 1 and 20")


def rows_of_words(words: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """(doc, page, row_no, text): words of a page gathered into rows about a moving mean of their centres.

    The mean depends on all words so far, which no window can express; a page is small and folded as a whole.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(centre=(page.top + page.bottom) / 2, height=page.bottom - page.top).sort_values(["centre", "x0", "text"])
        rows: list[list] = []
        means: list[float] = []
        limit = max(3.0, tolerance * float(page.height.clip(lower=1.0).median()))
        for w in page.itertuples():
            if rows and abs(w.centre - means[-1]) <= limit:
                rows[-1].append(w)
                means[-1] += (w.centre - means[-1]) / len(rows[-1])
            else:
                rows.append([w])
                means.append(w.centre)
        texts = [" ".join(w.text for w in sorted(r, key=lambda w: (w.x0, w.text))) for r in rows]
        return pd.DataFrame({"doc": page.doc.iloc[0], "page": page.page.iloc[0], "row_no": range(1, len(rows) + 1), "text": texts})

    kind = words.schema["doc"].dataType.simpleString()
    return words.select("doc", "page", "text", "x0", "top", "bottom").groupBy("doc", "page").applyInPandas(fold, f"doc {kind}, page int, row_no int, text string")


def near_misses(tokens: DataFrame, values: DataFrame) -> DataFrame:
    """(doc, value, token): printed tokens of equal length that differ from a value in one character."""
    both = values.withColumn("n", F.length("value")).join(tokens.withColumn("n", F.length("token")), ["doc", "n"])
    differing = F.aggregate(F.zip_with(F.split("value", ""), F.split("token", ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.where(differing == 1).select("doc", "value", "token")
