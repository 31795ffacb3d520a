"""What an invoice comes to: currency, tax code, buyer, totals, and its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_to
from ..functions.text import entity_tokens, has_words, tokens

#: Kinds of exceptions that don't hold an invoice back, and the header and line fields that it needs.
NON_BLOCKING = ["Data Quality", "Entity Hint", "Description Check", "Totals Audit", "Quantity Mismatch", "Item Quantity Mismatch", "Item Review"]
MANDATORY_HEADER = ["document", "site", "order", "location", "location_type", "date", "currency"]
MANDATORY_LINE = ["item", "unit_cost", "quantity"]
#: The status that is shown for a kind of exception, and its check; other kinds are shown as they are.
FAILURE_STATUS = {
    "OCR Review": ("OCR Exception", "C-01"), "Unreadable Invoice": ("OCR Exception", "C-01"), "Header Exception": ("Header Exception", "C-02"), "Date Review": ("Header Exception", "C-02"),
    "Supplier Exception": ("Supplier Exception", "C-03"), "POGRN Supplier Exception": ("POGRN Supplier Exception", "C-04"), "Supplier Site Exception": ("Supplier Site Exception", "C-05"),
    "Item Exception": ("Item Exception", "C-08"), "Item Review": ("Item Exception", "C-08"), "Item Conflict": ("Item Conflict", "C-09"), "Line Exception": ("Line Parsing Exception", "C-10"),
    "Item Quantity Mismatch": ("Quantity Mismatch", "C-11"), "Missing PO": ("Missing/Ambiguous PO", "C-12"), "Ambiguous PO": ("Missing/Ambiguous PO", "C-12"), "Location ID": ("Mapping Exception", "C-13"),
    "Market Mapping": ("Mapping Exception", "C-13"), "Currency Mapping": ("Currency Exception", "C-14"), "Cross-border": ("Currency Exception", "C-14"), "USD Review": ("Currency Exception", "C-14"),
    "Quantity Mismatch": ("Quantity Mismatch", "C-15"), "Value Mismatch": ("Value Mismatch", "C-16"), "Lineage": ("Audit Exception", "C-17"), "Totals Audit": ("Audit Exception", "C-17"),
    "Malformed Source Row": ("Audit Exception", "C-17"), "Buyer Review": ("Header Exception", "C-02"),
}


def currencies(invoices: DataFrame, by_market: DataFrame, sites: DataFrame, usd_sites: DataFrame) -> DataFrame:
    """(doc, currency, exception): the one governed for site and market, else the active site's own; the invoice must not differ.

    ``invoices`` has (doc, site, market, printed, hint_market); ``by_market`` (site, market, configured); ``sites`` (site,
    own_currency, site_status); ``usd_sites`` (site) may bill in dollars.
    """
    joined = invoices.join(F.broadcast(by_market), ["site", "market"], "left").join(sites, "site", "left").join(F.broadcast(usd_sites.select("site").distinct().withColumn("usd_ok", F.lit(True))), "site", "left")
    configured = F.coalesce("configured", F.when(F.col("site_status") == "Active", F.col("own_currency")))
    printed = F.nullif(F.upper(F.trim("printed")), F.lit(""))
    foreign = F.coalesce(F.lower("hint_market") != F.lower("market"), F.lit(False))
    problem = (
        F.when(F.col("site").isNull() | F.col("market").isNull(), "Currency Mapping").when(F.col("configured").isNull() & F.col("site_status").isNotNull() & (F.col("site_status") != "Active"), "Currency Mapping")
        .when(configured.isNull(), F.when(foreign, "Cross-border").otherwise("Currency Mapping")).when((configured == "USD") & F.col("usd_ok").isNull(), "USD Review")
        .when((printed == "USD") & (configured != "USD"), "USD Review").when(printed != configured, "Currency Mapping")
    )
    return joined.select("doc", F.when(problem.isNull(), configured).alias("currency"), problem.alias("exception"))


def location_markets(locations: DataFrame, master: DataFrame, mapping: DataFrame) -> DataFrame:
    """(location, market, values): the market on which the location master and the separate mapping don't disagree."""
    both = locations.join(F.broadcast(master.select("location", F.col("market").alias("a"))), "location", "left").join(F.broadcast(mapping.select("location", F.col("market").alias("b"))), "location", "left")
    found = F.array_distinct(F.array_compact(F.array(F.nullif("a", F.lit("")), F.nullif("b", F.lit("")))))
    return both.select("location", F.when(F.size(found) == 1, found[0]).alias("market"), F.size(found).alias("values"))


def tax_codes(invoices: DataFrame, lines: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, tax_code, exception): the printed code, else the region's, if it was in force and its rate explains the tax.

    ``invoices`` has (doc, printed_code, market, date, net, tax, places); ``lines`` (doc, net_amount); ``codes`` (region, code,
    rate, active_from). The tax must be the rate of the net, or the sum of the rates of all lines, each rounded half up.
    """
    joined = invoices.join(F.broadcast(codes.withColumn("region", F.upper("region"))), F.upper("market") == F.col("region"), "left")
    rated = lines.join(joined.where("code is not null").select("doc", "rate", "places"), "doc").groupBy("doc").agg(
        F.when(F.count(F.lit(1)) == F.count("net_amount"), F.sum(round_to(F.col("net_amount") * F.col("rate") / 100, F.col("places")))).alias("by_line")
    )
    told = joined.join(rated, "doc", "left")
    agrees = F.coalesce(round_to(F.col("net") * F.col("rate") / 100, F.col("places")) == F.col("tax"), F.lit(False)) | F.coalesce(F.col("by_line") == F.col("tax"), F.lit(False))
    printed = F.nullif(F.trim("printed_code"), F.lit(""))
    problem = (
        F.when(printed.isNotNull() | F.col("market").isNull(), None).when(F.col("code").isNull(), "no code for the region").when(F.col("date").isNull() | (F.col("date") < F.col("active_from")), "not in force")
        .when(F.col("tax").isNull(), "no printed tax").when(~agrees, "rate differs")
    )
    return told.select("doc", F.when(printed.isNotNull(), printed).when(F.col("market").isNotNull() & problem.isNull(), F.col("code")).alias("tax_code"), problem.alias("exception"))


def buyers(invoices: DataFrame, owner: str) -> DataFrame:
    """(doc, buyer, evidence, different): always the owner; printed if a buyer row names its entity, else by the owner's rule.

    ``invoices`` has (doc, rows, reader_buyer); different if the first name printed is another company's.
    """
    entity = entity_tokens(F.lit(owner))
    quote = F.get(F.filter("rows", lambda r: has_words(tokens(r), entity)), F.lit(0))
    named = F.when(F.size("rows") > 0, F.get(F.filter("rows", lambda r: F.size(entity_tokens(r)) > 0), F.lit(0))).otherwise(F.col("reader_buyer"))
    other = quote.isNull() & named.isNotNull() & (F.size(entity_tokens(named)) > 0) & ~has_words(entity_tokens(named), entity)
    return invoices.select("doc", F.lit(owner).alias("buyer"), F.when(quote.isNotNull(), "printed").otherwise("owner_rule").alias("evidence"), quote.alias("quote"), F.coalesce(other, F.lit(False)).alias("different"))


def amount_page(text: Column, amount: Column) -> Column:
    """The first page, from 1, on which an amount is printed with two or three decimals, or whole if it is, with commas or without."""
    comma = [F.format_number(amount, 2), F.format_number(amount, 3), F.when(amount == F.floor(amount), F.format_number(amount, 0))]
    forms = F.array_compact(F.array(*comma, *[F.replace(c, F.lit(","), F.lit("")) for c in comma]))
    pages = F.transform(F.split(F.coalesce(text, F.lit("")), "\\f"), lambda p: F.replace(p, F.lit(" "), F.lit("")))

    def prints(page: Column) -> Column:
        return F.exists(forms, lambda f: F.rlike(page, F.concat(F.lit(r"(?<![\d.,])"), F.replace(f, F.lit("."), F.lit(r"\.")), F.lit(r"(?![\d]|[.,]\d)"))))

    numbered = F.filter(F.transform(pages, lambda p, i: F.when(prints(p), i + 1)), lambda i: i.isNotNull())
    return F.get(numbered, F.lit(0))


def totals(invoices: DataFrame) -> DataFrame:
    """(doc, net_page, tax_page, gross): where the totals are printed; the gross only if both are. ``invoices`` has (doc, text, net, tax)."""
    found = invoices.select("doc", "net", "tax", amount_page(F.col("text"), F.col("net")).alias("net_page"), amount_page(F.col("text"), F.col("tax")).alias("tax_page"))
    return found.select("doc", "net_page", "tax_page", F.when(F.col("net_page").isNotNull() & F.col("tax_page").isNotNull(), F.col("net") + F.col("tax")).alias("gross"))


def line_values(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc, value, source): the printed net, else the sum of the line amounts if none is missing."""
    sums = lines.groupBy("doc").agg(F.when(F.count(F.lit(1)) == F.count("net_amount"), F.sum("net_amount")).alias("total"))
    joined = headers.select("doc", "net").join(sums, "doc", "left")
    return joined.select("doc", F.coalesce("net", "total").alias("value"), F.when(F.col("net").isNotNull(), "printed net").when(F.col("total").isNotNull(), "sum of printed line amounts").alias("source"))


def line_exceptions(lines: DataFrame) -> DataFrame:
    """(doc, line, exception, detail) where quantity times cost isn't the line's amount at its own precision, or one is missing.

    ``lines`` has (doc, line, quantity, unit_cost, net_amount, places, discounted); a printed discount explains a smaller amount.
    """
    computed = round_to(F.col("quantity") * F.col("unit_cost"), F.col("places"))
    missing = F.col("quantity").isNull() | F.col("unit_cost").isNull()
    explained = F.col("discounted") & F.col("net_amount").between(0, computed)
    detail = F.when(missing, "missing").when(F.col("net_amount").isNotNull() & (computed != F.col("net_amount")) & ~explained, "differs")
    return lines.withColumn("detail", detail).where("detail is not null").select("doc", "line", F.lit("Line Exception").alias("exception"), "detail")


def shown_status(exceptions: DataFrame) -> DataFrame:
    """Exceptions with the status and check that are shown for their kind, and whether they hold the invoice back."""
    table = F.create_map(*[F.lit(x) for k, (status, check) in FAILURE_STATUS.items() for x in (k, f"{status}|{check}")])
    told = F.try_element_at(table, F.col("kind"))
    return exceptions.withColumn("shown", F.coalesce(F.substring_index(told, "|", 1), F.col("kind"))).withColumn("check", F.coalesce(F.substring_index(told, "|", -1), F.lit(""))).withColumn("blocking", ~F.col("kind").isin(NON_BLOCKING))


def statuses(headers: DataFrame, lines: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(doc, status, missing, blocking): Approved with every header and line field, a tax code, lines, and nothing blocking;
    Blocked if nothing was read (R-001) or an invoice failed in processing; else Review."""
    absent = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in MANDATORY_HEADER]))
    gap = None
    for c in MANDATORY_LINE:
        gap = F.col(c).isNull() if gap is None else gap | F.col(c).isNull()
    of_lines = lines.groupBy("doc").agg(F.count("*").alias("lines"), F.bool_or(gap).alias("gaps"))
    blocking = ~F.col("kind").isin(NON_BLOCKING)
    of_doc = exceptions.groupBy("doc").agg(F.count_if(blocking).alias("blocking"), F.bool_or(blocking & F.col("rule").isin("R-001", "ALG-028")).alias("unread"))
    joined = headers.withColumn("missing", absent).join(of_lines, "doc", "left").join(of_doc, "doc", "left")
    fine = (F.size("missing") == 0) & (F.coalesce("blocking", F.lit(0)) == 0) & ~F.coalesce("gaps", F.lit(False)) & (F.coalesce("lines", F.lit(0)) > 0) & F.col("tax_code").isNotNull()
    return joined.select("doc", F.when(fine, "Approved").when(F.coalesce("unread", F.lit(False)), "Blocked").otherwise("Review").alias("status"), "missing", F.coalesce("blocking", F.lit(0)).alias("blocking"))


def tax_rows(lines: DataFrame) -> DataFrame:
    """(doc, line, taxable, rate): the line amount, else quantity times cost; the rate half even to four places."""
    taxable = F.coalesce(F.col("net_amount").cast("decimal(18,4)"), (F.col("quantity") * F.col("unit_cost")).cast("decimal(18,4)"))
    rate = F.bround((F.col("tax_amount").cast("decimal(18,6)") / F.nullif(taxable, F.lit(0).cast("decimal(18,4)"))).cast("decimal(28,12)"), 4).cast("decimal(18,4)")
    return lines.select("doc", "line", taxable.alias("taxable"), rate.alias("rate"))


def invoice_discounts(lines: DataFrame, headers: DataFrame, prints: Column) -> DataFrame:
    """(doc, discount): what the lines at their prices are above the net, if line amounts make the net and it is printed.

    ``prints`` tests that ``discount`` and ``total`` stand in the text, over the joined rows.
    """
    product = F.col("quantity") * F.col("unit_cost")
    sums = lines.groupBy("doc").agg(
        F.when(F.count(F.lit(1)) == F.count(product), F.sum(product)).alias("exact"), F.when(F.count(F.lit(1)) == F.count("net_amount"), F.sum("net_amount")).alias("lines_net"),
    )
    joined = headers.join(sums, "doc").withColumn("total", F.round("exact", 2)).withColumn("discount", F.round("exact", 2) - F.round("net", 2))
    return joined.where((F.round("lines_net", 2) == F.round("net", 2)) & (F.col("discount") > 0) & prints).select("doc", "discount")
