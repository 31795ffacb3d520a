"""Access paths of the lookup source: a batch of probes joined with items or order rows, exactly re-checked, and bounded
per probe where the rule says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_description, normalize_name

#: Most rows a probe may bring.
SITE_ROWS, DESCRIPTION_ROWS, SHEET_ROWS = 20, 500, 50


def by_key(probes: DataFrame, rows: DataFrame, key: Column, order: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Rows whose key equals a probe's ``value``; with ``most`` the first ones of each probe by a total order."""
    joined = probes.join(rows.withColumn("_key", key), F.col("value") == F.col("_key")).drop("_key")
    if most is None:
        return joined
    own = Window.partitionBy("probe").orderBy(*(order or []))
    return joined.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n")


def by_supplier_name(probes: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    folded = probes.withColumn("value", normalize_name(F.col("value")))
    return by_key(folded, rows, normalize_name(F.col(name)))


def by_description(probes: DataFrame, rows: DataFrame, description: str, order: list[str], most: int = DESCRIPTION_ROWS) -> DataFrame:
    """(probe, rows…) of rows that share a word of 3 to 100 characters with the probe's first 30, at most ``most`` each.

    Only the probe is cut: a row is found by any of its words.
    """

    def words(value: Column) -> Column:
        return F.filter(F.array_distinct(F.split(normalize_description(value), " ")), lambda w: F.length(w).between(3, 100))

    # Probes with equal descriptions are looked up once, and of a word's rows only its first ones can be among the first of a probe.
    texts = probes.groupBy("probe").agg(F.array_sort(F.collect_set("value")).alias("_values"))
    asked = texts.select("_values").distinct().select("_values", F.explode("_values").alias("_value")).select("_values", F.explode(F.slice(words(F.col("_value")), 1, 30)).alias("_word"))
    of_word = Window.partitionBy("_word").orderBy(*order)
    held = rows.withColumn("_word", F.explode(words(F.col(description)))).withColumn("_n", F.dense_rank().over(of_word)).where(F.col("_n") <= most).drop("_n")
    joined = asked.distinct().join(held, "_word").drop("_word").dropDuplicates(["_values", *order])
    own = Window.partitionBy("_values").orderBy(*order)
    found = joined.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n")
    return texts.join(found, "_values").drop("_values")


def decided(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """The feedback log with decisions applied to proposals only; a decided entry never changes again."""
    joined = log.join(decisions.select("feedback_id", F.col("decision").alias("_to"), F.col("approver").alias("_by")), "feedback_id", "left")
    open_ = (F.col("decision") == "Proposed") & F.col("_to").isin("Approved", "Rejected")
    return joined.withColumn("approver", F.when(open_, F.col("_by")).otherwise(F.col("approver"))).withColumn("decision", F.when(open_, F.col("_to")).otherwise(F.col("decision"))).drop("_to", "_by")


def readiness(issues: DataFrame, headers: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc, hard, review, warning, duplicate, ready): nothing is ready before a reviewer confirmed it; that clears review-level
    issues, hard ones and a duplicate never."""
    counts = issues.groupBy("doc").agg(*[F.count_if(F.col("level") == level).alias(level) for level in ("hard", "review", "warning")])
    seen = ledger.select("invoice_key", F.lit(True).alias("duplicate")).distinct()
    joined = headers.join(counts, "doc", "left").join(seen, "invoice_key", "left")
    filled = joined.select("doc", "confirmed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hard", "review", "warning")], F.coalesce("duplicate", F.lit(False)).alias("duplicate"))
    return filled.select("doc", "hard", "review", "warning", "duplicate", ((F.col("hard") == 0) & ~F.col("duplicate") & F.col("confirmed")).alias("ready"))


def accepted_alternate(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, accepted, failed): whether a second reading is taken, and the criteria that it fails.

    ``heads`` has (doc, reading: 1 or 2, number, date, currency, po, net, tax); ``lines`` (doc, reading, line, qty, price,
    net_amount). It must have at least as many rows, the same totals, the header values that the first one read, strictly
    fewer missing quantities and prices, and reconcile no worse: as many lines that do, no more that don't, and each of
    the first one's that did.
    """
    first, second = (heads.where(F.col("reading") == r).drop("reading") for r in (1, 2))
    other = second.select("doc", *[F.col(c).alias(f"_{c}") for c in ("number", "date", "currency", "po", "net", "tax")])
    both = first.join(other, "doc")

    def squeezed(c: str, pattern: str) -> Column:
        return F.lower(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), pattern, ""))

    kept = F.lit(True)
    for c, pattern in (("number", r"[^\p{L}\p{N}]"), ("po", r"[^\p{L}\p{N}]"), ("date", r"\s+"), ("currency", r"\s+")):
        kept = kept & ((F.coalesce(F.col(c).cast("string"), F.lit("")) == "") | (squeezed(c, pattern) == squeezed(f"_{c}", pattern)))
    equal = F.col("net").eqNullSafe(F.col("_net")) & F.col("tax").eqNullSafe(F.col("_tax"))
    reconciles = F.col("qty") * F.col("price") == F.col("net_amount")
    told = lines.select("doc", "reading", "line", reconciles.alias("ok"), (F.col("qty").isNull().cast("int") + F.col("price").isNull().cast("int")).alias("gaps"))

    def of(reading: int, name: str) -> DataFrame:
        own = told.where(F.col("reading") == reading)
        return own.groupBy("doc").agg(F.count("*").alias(f"{name}_rows"), F.sum("gaps").alias(f"{name}_gaps"), F.count_if("ok").alias(f"{name}_right"), F.count_if(~F.col("ok")).alias(f"{name}_wrong"))

    lost = told.where("reading = 1 and ok").select("doc", "line").join(told.where("reading = 2 and ok").select("doc", "line"), ["doc", "line"], "left_anti").select("doc").distinct().withColumn("lost", F.lit(True))
    joined = both.join(of(1, "a"), "doc", "left").join(of(2, "b"), "doc", "left").join(lost, "doc", "left").na.fill(0)
    worse = (F.col("b_right") < F.col("a_right")) | (F.col("b_wrong") > F.col("a_wrong")) | F.col("lost").isNotNull()
    tests = [(F.col("b_rows") < F.col("a_rows"), "rows"), (~kept, "headers"), (~equal, "totals"), (F.col("b_gaps") >= F.col("a_gaps"), "gaps"), (worse, "reconciliation")]
    failed = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
    return joined.select("doc", (F.size(failed) == 0).alias("accepted"), failed.alias("failed"))


def same_band(boxes: DataFrame, share: float = 0.7) -> DataFrame:
    """(doc, page, a, b): boxes whose centres lie within a share of the height of each other.

    Centres are cut into bands of that width and meet their own and the two next bands, so that the range join is an
    equality join.
    """
    own = boxes.withColumn("centre", (F.col("top") + F.col("bottom")) / 2).withColumn("width", F.lit(share) * F.max(F.col("bottom") - F.col("top")).over(Window.partitionBy("doc", "page")))
    own = own.withColumn("band", F.floor(F.col("centre") / F.col("width")))
    left = own.select("doc", "page", F.col("id").alias("a"), F.col("centre").alias("ca"), (F.col("bottom") - F.col("top")).alias("height"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = own.select("doc", "page", F.col("id").alias("b"), F.col("centre").alias("cb"), "band")
    return left.join(right, ["doc", "page", "band"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("ca") - F.col("cb")) <= share * F.col("height"))).select("doc", "page", "a", "b")
