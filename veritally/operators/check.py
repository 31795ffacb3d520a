"""Checks of output against its sources: arithmetic, joins between sheets, printed evidence, template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The target sheets' columns.
TEMPLATE = {
    "Header": [
        "Transaction Number", "Document", "Supplier Site", "Order No", "Location", "Location Type", "Document Date", "Total Cost Ex Tax", "Tax Amount", "Ref No. 1", "Ref No. 2",
        "Ref No. 3", "Comment",
    ],
    "Tax_Breakdown": ["Transaction Number", "Tax Code", "Tax Basis"],
    "Details": ["Transaction Number", "Item", "UPC", "Unit Cost", "Quantity", "Unit Tax Code"],
}
#: Statuses that are groups of their own; all others need checking.
OWN_GROUPS = ("verified", "empty_owner_rule", "empty_flagged")


def group(status: Column) -> Column:
    return F.when(status.isin(*OWN_GROUPS), status).otherwise("needs_checking")


def status_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells by group, one column each; they add up to all cells."""
    names = (*OWN_GROUPS, "needs_checking")
    return cells.withColumn("_group", group(F.col("status"))).groupBy(*keys).agg(*[F.count_if(F.col("_group") == n).alias(n) for n in names], F.count("*").alias("cells"))


def printed(text: Column, original: Column) -> Column:
    """Whether the original is in the text, as it stands or as a number of equal value; null without text."""
    squashed = F.lower(F.regexp_replace(text, r"\s+", ""))
    wanted = F.lower(F.regexp_replace(original, r"\s+", ""))
    amount = F.replace(original, F.lit(","), F.lit("")).try_cast("decimal(38,6)")
    numbers = F.regexp_extract_all(text, F.lit(r"(-?\d[\d,]*\.?\d*)"), 1)
    by_value = amount.isNotNull() & F.exists(numbers, lambda n: F.coalesce(F.replace(n, F.lit(","), F.lit("")).try_cast("decimal(38,6)") == amount, F.lit(False)))
    return F.when(F.trim(text) != "", ((wanted != "") & F.contains(squashed, wanted)) | by_value)


def lines_to_net(lines: DataFrame, headers: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """(doc, exact, rounded, net, status): the sum of quantity times cost is the net, exactly or rounded line by line."""
    amount = F.col("quantity") * F.col("cost")
    sums = lines.groupBy("doc").agg(
        F.when(F.count("*") == F.count(amount), F.round(F.sum(amount), 2)).alias("exact"), F.when(F.count("*") == F.count(amount), F.sum(F.round(amount, 2))).alias("rounded"), F.count("*").alias("lines")
    )
    bound = F.col("lines") * F.lit(tolerance).cast("decimal(4,2)")
    status = (
        F.when(F.col("exact").isNull() | F.col("net").isNull(), "skipped").when((F.col("exact") == F.col("net")) | (F.col("rounded") == F.col("net")), "pass")
        .when(F.abs(F.col("exact") - F.col("net")) <= bound, "warning").otherwise("fail")
    )
    return headers.join(sums, "doc", "left").select("doc", "exact", "rounded", "net", status.alias("status"))


def missing_lines(read: Column, net: Column, exact: Column, printed_count: Column) -> Column:
    """Lines that are missing: by a printed count, else by the residual over the mean of what was read, at most twice that."""
    by_residual = F.least(F.greatest(F.round(F.abs(net - exact) * read / exact, 0).cast("int"), F.lit(1)), 2 * read)
    return F.when(printed_count.isNotNull(), F.greatest(printed_count - read, F.lit(1))).when(exact <= 0, 1).otherwise(by_residual)


def sheet_joins(header: DataFrame, tax: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """(problem, key): orphans below, repeated numbers above, and headers without rows below."""
    numbers = header.select(key)
    repeated = header.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    frames = {
        "repeated header": repeated,
        "orphan tax row": tax.select(key).distinct().join(numbers, key, "left_anti"),
        "orphan detail": details.select(key).distinct().join(numbers, key, "left_anti"),
        "header without tax rows": numbers.distinct().join(tax, key, "left_anti"),
        "header without details": numbers.distinct().join(details, key, "left_anti"),
    }
    out = None
    for name, frame in frames.items():
        part = frame.select(F.lit(name).alias("problem"), key)
        out = part if out is None else out.unionByName(part)
    return out


def template_problems(sheets: dict[str, DataFrame]) -> list[str]:
    """Differences between the sheets' columns and the template's, in order."""
    found = [f"{name}: missing" for name in TEMPLATE if name not in sheets]
    return found + [f"{name}: columns {df.columns}" for name, df in sheets.items() if df.columns != TEMPLATE.get(name)]


def typed_identifier(value: Column) -> tuple[Column, Column]:
    """(number, text) of a sink's cell: plain positive integers become numbers, anything else stays text."""
    plain = value.rlike(r"^[1-9]\d{0,14}$")
    return F.when(plain, value.try_cast("bigint")), F.when(~plain, value)


def completeness(missing: Column, lines: Column) -> Column:
    """Share of filled fields of six in the header and four a line; never whole while anything is missing."""
    score = F.round(F.greatest(F.lit(0), 1 - missing.cast("decimal(18,8)") / (6 + 4 * lines)), 2)
    return F.when(missing > 0, F.least(score, F.lit("0.99").cast("decimal(3,2)"))).otherwise(score)


def inclusive_vat(net: Column, tax: Column) -> Column:
    """True if the tax is r/(100+r) of the net for some whole rate up to 30, and r/100 of it for none."""
    cent = F.lit("0.01").cast("decimal(3,2)")
    rates = F.sequence(F.lit(1), F.lit(30))
    exclusive = F.exists(rates, lambda r: F.abs(net * r / 100 - tax) <= cent)
    inclusive = F.exists(rates, lambda r: F.abs(net * r / (100 + r) - tax) <= cent)
    return F.coalesce((net > 0) & (tax > 0) & (tax < net) & inclusive & ~exclusive, F.lit(False))


def shifted(created: Column, item: Column) -> Column:
    """A row whose columns moved: a date of creation that is none, or an item that isn't nine digits; blanks count."""
    return ~F.coalesce(created, F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}") | ~F.coalesce(item, F.lit("")).rlike(r"^\d{9}$")


def malformed(created: Column, item: Column) -> Column:
    """The matching side's test: as ``shifted``, but a blank item is allowed."""
    return (F.coalesce(item, F.lit("")) != "") & ~F.coalesce(item, F.lit("")).rlike(r"^\d{9}$") | ~F.coalesce(created, F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}")


#: A box number of an address, a label of a tax amount.
BOX_NUMBER = r"(?i)\bp\.?\s*o\.?\s*box\b[\s:#.]*(\w+)"
TAX_LABEL = r"(?i)\b(?:vat|gst|hst|sales\s+tax|tax(?:\s+(?:amount|total))?|total\s+tax)\b(?!\s*(?:invoice|reg(?:istration|istered|\.)?|no\b|number|id\b|#|trn|pin)|\s*[-:]?\s*\d{6,})"


def tax_label_printed(text: Column) -> Column:
    """Whether a line prints a label of a tax amount, and not a registration or the document's title."""
    return F.exists(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: line.rlike(TAX_LABEL) & ~line.rlike(r"(?i)\btrn\b"))


def po_box(text: Column, number: Column) -> Column:
    """Whether the text names the number as that of a P.O. box; only digits and letters of the number are searched for."""
    boxes = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BOX_NUMBER), 1)
    return F.coalesce(F.array_contains(boxes, number), F.lit(False))


def reconcile_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc, reconciles): all line nets are there and add up to the net within one cent."""
    sums = lines.groupBy("doc").agg(F.when(F.count("*") == F.count("net_amount"), F.sum("net_amount")).alias("total"))
    return headers.join(sums, "doc", "left").select("doc", F.coalesce(F.abs(F.col("total") - F.col("net")) <= F.lit("0.01").cast("decimal(3,2)"), F.lit(False)).alias("reconciles"))
