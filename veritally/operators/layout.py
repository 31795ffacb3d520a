"""Fields and lines from the layout of a page: columns, labelled values, totals, supplier templates.

Rows come from ``pages.rows_of_words`` or from words that carry a row number. What only looks at one row or its neighbour
is built-in expressions; a template walks a text in order and is an Arrow-batched function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import printed_decimal
from .aggregates import unique_or_null

#: Printed labels of totals, with the field that each means and its priority among equals.
TOTAL_LABELS = [
    ("net", 2, r"(?i)\b(?:total\s+(?:excl(?:uding)?\.?|before)\s+(?:tax|vat)|net\s+(?:total|amount)|sub\s*-?total)\b"),
    ("tax", 2, r"(?i)\b(?:total\s+(?:vat|tax)|vat\s+(?:total|amount)|tax\s+amount)\b"),
    ("gross", 2, r"(?i)\b(?:grand\s+total|total\s+(?:incl(?:uding)?\.?)\s+(?:tax|vat)|amount\s+due)\b"),
    ("gross", 1, r"(?i)^\s*total\b"),
]


def bucketed(words: DataFrame, bounds: list[tuple[str, float, float]]) -> DataFrame:
    """(doc, page, row_no, column texts…): words by the column in which their centre lies, joined from left to right."""
    centre = (F.col("x0") + F.col("x1")) / 2
    column = None
    for name, left, right in bounds:
        test = (centre >= left) & (centre < right)
        column = F.when(test, name) if column is None else column.when(test, name)
    placed = words.withColumn("column", column).where("column is not null")
    texts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == name, F.struct("x0", "text")))), lambda w: w["text"]), " ").alias(name) for name, _, _ in bounds]
    return placed.groupBy("doc", "page", "row_no").agg(*texts)


def column_bounds(headers: DataFrame, width: float) -> DataFrame:
    """(doc, page, label, left, right): a heading's column reaches half way to its neighbours."""
    own = Window.partitionBy("doc", "page").orderBy("x0", "label")
    before, after = F.lag("x1").over(own), F.lead("x0").over(own)
    return headers.select("doc", "page", "label", F.coalesce((before + F.col("x0")) / 2, F.lit(0.0)).alias("left"), F.coalesce((F.col("x1") + after) / 2, F.lit(width)).alias("right"))


def value_rows(rows: DataFrame, labels: dict[str, str], order: list[str]) -> DataFrame:
    """(doc, field, value): a row of at least two known labels over a row of as many values; conflicts drop the field.

    ``rows`` has (doc, cells); cells are the texts of a row from left to right.
    """
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    fields = F.transform("cells", lambda c: F.element_at(known, F.trim(F.lower(c))))
    own = Window.partitionBy("doc").orderBy(*order)
    paired = rows.withColumn("fields", fields).withColumn("values", F.lead("cells").over(own))
    sound = paired.where((F.size(F.filter("fields", lambda f: f.isNotNull())) >= 2) & (F.size("values") == F.size("cells")))
    cells = sound.select("doc", F.explode(F.arrays_zip("fields", "values")).alias("z")).select("doc", F.col("z.fields").alias("field"), F.trim("z.values").alias("value")).where("field is not null and value <> ''")
    return cells.groupBy("doc", "field").agg(unique_or_null(F.col("value"), F.col("value")).alias("value")).where("value is not null")


def totals(lines: DataFrame) -> DataFrame:
    """(doc, field, amount): the last amount behind a label, by the highest priority; several amounts there give none."""
    found = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("priority"), F.lit(i).alias("i")) for i, (f, p, _) in enumerate(TOTAL_LABELS)])
    hit: Column | None = None
    for i, (_, _, pattern) in enumerate(TOTAL_LABELS):
        hit = F.when(F.col("text").rlike(pattern), i) if hit is None else hit.when(F.col("text").rlike(pattern), i)
    amounts = F.regexp_extract_all("text", F.lit(r"(\(?-?\d[\d,]*\.?\d*\)?)(?!\s*%)"), 1)
    own = lines.withColumn("label", F.get(found, hit)).withColumn("amount", printed_decimal(F.element_at(amounts, -1))).where("label is not null and amount is not null")
    best = own.withColumn("best", F.max("label.priority").over(Window.partitionBy("doc", "label.field"))).where("label.priority = best")
    return best.groupBy("doc", F.col("label.field").alias("field")).agg(F.when(F.count_distinct("amount") == 1, F.max("amount")).alias("amount"))


def next_line_value(lines: DataFrame, label: str, value: str, order: list[str]) -> DataFrame:
    """(doc, value): what stands behind a label, or on the line below where nothing does; the only distinct one."""
    own = Window.partitionBy("doc").orderBy(*order)
    behind = F.nullif(F.regexp_extract("text", rf"(?i){label}\s*:?\s*({value})", 1), F.lit(""))
    below = F.when(F.col("text").rlike(rf"(?i){label}\s*:?\s*$"), F.nullif(F.regexp_extract("below", rf"^\s*({value})", 1), F.lit("")))
    found = lines.withColumn("below", F.lead("text").over(own)).withColumn("value", F.coalesce(behind, below))
    return found.groupBy("doc").agg(unique_or_null(F.col("value"), F.col("value")).alias("value"))


def by_priority(readings: DataFrame, fields: list[str]) -> DataFrame:
    """Each field from the first reader that has it; ``readings`` has (doc, position, fields…)."""
    return readings.groupBy("doc").agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("position"))).alias(f) for f in fields])


def by_template(texts: DataFrame, templates: list[dict]) -> DataFrame:
    """(doc, template, fields, lines) by the first supplier template all of whose keywords a text has.

    A template has ``name``, ``keywords``, ``fields`` (name to a pattern with one group) and optionally ``lines`` with
    ``start``, ``end`` and a ``line`` pattern with named groups. Templates are few and go to the workers with the task.
    """
    ready = [
        {**t, "fields": {k: re.compile(p) for k, p in t["fields"].items()}, "lines": {k: re.compile(p) for k, p in t.get("lines", {}).items()}} for t in templates
    ]

    def one(text: str | None) -> tuple[str | None, dict, list]:
        text = text or ""
        for t in ready:
            if not all(k in text for k in t["keywords"]):
                continue
            fields = {k: m[1].strip() for k, p in t["fields"].items() if (m := p.search(text))}
            rows, inside = [], "start" not in t["lines"]
            for line in text.splitlines() if t["lines"] else ():
                if inside and "end" in t["lines"] and t["lines"]["end"].search(line):
                    break
                if inside and (m := t["lines"]["line"].search(line)):
                    rows.append({k: v for k, v in m.groupdict().items() if v is not None})
                inside = inside or bool(t["lines"]["start"].search(line))
            return t["name"], fields, rows
        return None, {}, []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [one(t) for t in frame.text]
            yield pd.DataFrame({"doc": frame.doc, "template": [x[0] for x in found], "fields": [x[1] for x in found], "lines": [x[2] for x in found]})

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("doc", "text").mapInPandas(run, f"doc {kind}, template string, fields map<string,string>, lines array<map<string,string>>")
