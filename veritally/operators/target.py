"""The target sheets of an invoice: which cells they hold, where each one's evidence stands, and what still needs checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .check import TEMPLATE, group, printed, shifted

#: Header columns and the field of each, columns that the owner leaves empty, and required fields.
HEADER_FIELDS = {"Document": "number", "Supplier Site": "site", "Order No": "po", "Location": "location", "Location Type": "location_type", "Document Date": "date", "Total Cost Ex Tax": "net", "Tax Amount": "tax"}
OWNER_EMPTY = ["Ref No. 1", "Ref No. 2", "Ref No. 3", "Comment"]
REQUIRED_HEADER = ["number", "site", "po", "location", "location_type", "date", "net", "tax", "taxCode"]
REQUIRED_LINE = ["Item", "Unit Cost", "Quantity", "Unit Tax Code"]
LOCATION_TYPES = ["Store (S)", "Warehouse (W)"]
IDENTIFIER = r"^[1-9]\d{0,14}$"


def squashed(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", ""))


def same(value: Column, original: Column) -> Column:
    """Whether a value is what was printed: as text, without the barcode prefix, by number, or as a date."""
    from ..functions.dates import same_date

    a, b = (F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(38,6)") for c in (value, original))
    bare = F.regexp_replace(F.trim(original), "(?i)^ult_", "")
    return F.coalesce(squashed(value) == squashed(original), F.lit(False)) | F.coalesce(bare == F.trim(value), F.lit(False)) | F.coalesce(a == b, F.lit(False)) | same_date(value, original)


def held(data: Column, column: Column, value: Column) -> Column:
    """Whether a source row has the value in the named column, or in any if it lacks that one or none is named."""
    named = column.isNotNull() & F.map_contains_key(data, F.coalesce(column, F.lit("")))
    return F.when(named, squashed(F.try_element_at(data, column)) == squashed(value)).otherwise(F.exists(F.map_values(data), lambda v: squashed(v) == squashed(value)))


def references(cells: DataFrame) -> DataFrame:
    """(id, sheet, row_number) of every source row that a cell's evidence cites; what was left out of the list isn't named."""
    cited = F.filter(F.split(F.coalesce("reference", F.lit("")), ", "), lambda x: F.contains(x, F.lit("!")))
    each = cells.select("id", F.explode(cited).alias("ref"))
    return each.select("id", F.trim(F.regexp_replace("ref", r"![^!]*$", "")).alias("sheet"), F.regexp_extract("ref", r"!(\d+)(?: \(\+.*)?$", 1).try_cast("int").alias("row_number"))


def evidence_statuses(cells: DataFrame, sources: DataFrame, locations: DataFrame, sites: DataFrame, codes: DataFrame, text: DataFrame) -> DataFrame:
    """(id, status) of filled cells with evidence, re-read where it points.

    ``cells`` has (id, doc, value, source, reference, original, location); ``sources`` (sheet, row_number, data map);
    ``locations`` (location, type, market); ``sites`` (site, currency); ``codes`` (code); ``text`` (doc, text). Every cited
    row must exist, none be shifted, and all hold the value; some that don't are over-cited.
    """
    source = F.coalesce("source", F.lit(""))
    last = F.element_at(F.split(source, " "), -1)
    column = F.when(F.startswith(source, F.lit("Selected by POG-001")), "RMS_ORDER_NO").when((last != "") & (last == F.upper(last)) & F.rlike(last, F.lit("[A-Z]")), last)
    rows = references(cells).join(cells.select("id", "value", column.alias("column")), "id").join(sources, ["sheet", "row_number"], "left")
    broken = F.startswith("sheet", F.lit("PO Extract")) & shifted(F.try_element_at("data", F.lit("CREATED_DATE")), F.try_element_at("data", F.lit("RMS_ITEM_ID")))
    cited = rows.groupBy("id").agg(
        F.bool_or(F.col("data").isNull()).alias("absent"), F.bool_or(F.coalesce(broken, F.lit(False)) & F.col("data").isNotNull()).alias("broken"),
        F.bool_and(F.coalesce(held(F.col("data"), F.col("column"), F.col("value")), F.lit(False))).alias("every"), F.bool_or(F.coalesce(held(F.col("data"), F.col("column"), F.col("value")), F.lit(False))).alias("some"),
    )
    master = F.broadcast(locations.select("location", F.col("type").alias("_type"), F.col("market").alias("_market")))
    paid = F.broadcast(sites.select(F.col("site").alias("_site"), F.col("currency").alias("value")).distinct().withColumn("_paid", F.lit(True)))
    coded = F.broadcast(codes.select(F.col("code").alias("value")).distinct().withColumn("_coded", F.lit(True)))
    joined = cells.withColumn("_site", F.substring_index("reference", "|", 1)).join(cited, "id", "left").join(master, "location", "left").join(paid, ["_site", "value"], "left").join(coded, "value", "left").join(text, "doc", "left")
    value, original = F.col("value"), F.coalesce("original", F.lit(""))
    found = printed(F.coalesce("text", F.lit("")), original)
    found = F.when(~found & same(value, original), printed(F.coalesce("text", F.lit("")), value)).otherwise(found)

    def fits(test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), "verified").otherwise("mismatch")

    by_rows = F.when(F.col("absent"), "mismatch").when(F.col("broken"), "data_gap").when(F.col("every"), "verified").when(F.col("some"), "over_cited").otherwise("mismatch")
    by_print = F.when(found.isNull(), "unverifiable").otherwise(fits(found & same(value, original)))
    status = (
        F.when(source == "location master", fits(squashed(F.col("_type")) == squashed(value))).when(source == "Location-market mapping", fits(squashed(F.col("_market")) == squashed(value)))
        .when(source == "prefix fallback", "unverifiable").when(F.col("absent").isNotNull() & (source != "Reviewed invoice tax code"), by_rows).when(source == "Supplier-site table", fits(F.col("_paid")))
        .when(F.startswith(source, F.lit("Owner VAT code table")), fits(F.col("_coded")))
        .when(F.startswith(source, F.lit("Invoice")) | source.isin("Printed on invoice", "Reviewed invoice tax code"), by_print).otherwise("mismatch")
    )
    return joined.select("id", status.alias("status"))


def field_statuses(cells: DataFrame) -> DataFrame:
    """Cells with ``cell_status``: empty, without evidence, an owner's entry that is attributed or not, an AI's value that isn't
    located, else what its evidence says. ``cells`` has (value, kind, source, reference, entered, actor, at, status)."""
    from ..functions.printed import not_located

    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    attributed = F.coalesce(same(F.col("value"), F.col("entered")), F.lit(False)) & F.col("actor").isNotNull() & F.col("at").isNotNull()
    status = (
        F.when(blank, "empty_flagged").when(F.col("kind").isNull(), "no_evidence").when(F.col("kind") == "owner_entry", F.when(attributed, "verified").otherwise("owner_entry_unattributed"))
        .when((F.col("status") == "verified") & not_located(F.col("source"), F.col("reference")), "unverifiable").otherwise(F.col("status"))
    )
    return cells.withColumn("cell_status", status)


def planned_cells(docs: DataFrame, fields: DataFrame, lines: DataFrame, upc: str = "empty") -> DataFrame:
    """(doc, sheet, column, line, value, status, scope) of every cell: 13 of the header, 3 of the tax sheet, 6 a line.

    ``docs`` has (doc, transaction); ``fields`` (doc, key, value, status); ``lines`` (doc, line, column, value, status), one row
    for each line and column. Structural cells have the scope sheet, the others metric.
    """

    def key_cells(sheet: str, frame: DataFrame, line: Column) -> DataFrame:
        return frame.select("doc", F.lit(sheet).alias("sheet"), F.lit("Transaction Number").alias("column"), line.alias("line"), F.col("transaction").cast("string").alias("value"), F.lit("verified").alias("status"), F.lit("sheet").alias("scope"))

    none = F.lit(None).cast("int")
    wanted = [("Header", c, k) for c, k in HEADER_FIELDS.items()] + [("Tax_Breakdown", "Tax Code", "taxCode"), ("Tax_Breakdown", "Tax Basis", "net")]
    listed = F.array(*[F.struct(F.lit(s).alias("sheet"), F.lit(c).alias("column"), F.lit(k).alias("key")) for s, c, k in wanted])
    named = docs.select("doc", F.inline(listed)).join(fields, ["doc", "key"], "left")
    filled = named.select("doc", "sheet", "column", none.alias("line"), "value", F.coalesce("status", F.lit("empty_flagged")).alias("status"), F.lit("metric").alias("scope"))
    empty = docs.select("doc", F.lit("Header").alias("sheet"), F.explode(F.array(*[F.lit(c) for c in OWNER_EMPTY])).alias("column"), none.alias("line"), F.lit(None).cast("string").alias("value"), F.lit("empty_owner_rule").alias("status"), F.lit("sheet").alias("scope"))
    left_out = F.col("column").eqNullSafe("UPC") & F.lit(upc == "empty")
    details = lines.select("doc", F.lit("Details").alias("sheet"), "column", "line", F.when(~left_out, F.col("value")).alias("value"), F.when(left_out, "empty_owner_rule").otherwise(F.coalesce("status", F.lit("empty_flagged"))).alias("status"), F.lit("metric").alias("scope"))
    numbered = lines.select("doc", "line").distinct().join(docs, "doc")
    parts = [key_cells("Header", docs, none), filled, empty, key_cells("Tax_Breakdown", docs, none), key_cells("Details", numbered, F.col("line")), details]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def planned_rows(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """The header sheet's row of each invoice, typed as it is written: plain identifiers as numbers, day and amounts as such.

    ``fields`` has (doc, key, value); the pivot's columns are the template's.
    """
    wide = fields.groupBy("doc").pivot("key", list(HEADER_FIELDS.values())).agg(F.min(F.nullif(F.trim("value"), F.lit(""))))
    own = docs.join(wide, "doc", "left")

    def identifier(c: str) -> Column:
        return F.when(F.col(c).rlike(IDENTIFIER), F.col(c).try_cast("bigint"))

    return own.select(
        "doc", F.col("transaction").alias("Transaction Number"), F.col("number").alias("Document"), identifier("site").alias("Supplier Site"), identifier("po").alias("Order No"), identifier("location").alias("Location"),
        F.col("location_type").alias("Location Type"), F.col("date").try_cast("date").alias("Document Date"), F.col("net").try_cast("decimal(18,4)").alias("Total Cost Ex Tax"), F.col("tax").try_cast("decimal(18,4)").alias("Tax Amount"),
        *[F.lit(None).cast("string").alias(c) for c in OWNER_EMPTY],
    )


def template_problems(sheet: str, rows: DataFrame, places: int | None = None) -> DataFrame:
    """(key, problem) of a sheet's rows, whose cells are texts, against the template: types, identifiers, formulas and decimals."""
    columns = TEMPLATE[sheet]

    def text(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    def number(c: str) -> Column:
        return F.replace(text(c), F.lit(","), F.lit("")).try_cast("decimal(38,10)")

    tests = [(~text("Transaction Number").rlike(r"^\d+$"), f"{sheet} Transaction Number is not a whole number")]
    tests += [(text(c).rlike(r"^[=+@].") & number(c).isNull(), f"{sheet} {c} looks like a formula") for c in columns]
    if sheet == "Header":
        tests += [((text(c) != "") & ~text(c).rlike(IDENTIFIER), f"Header {c} is not an owner id") for c in ("Supplier Site", "Order No", "Location")]
        tests += [((text("Location Type") != "") & ~text("Location Type").isin(LOCATION_TYPES), "Header Location Type is not Store (S) or Warehouse (W)"), ((text("Document Date") != "") & text("Document Date").try_cast("date").isNull(), "Header Document Date is not a date")]
        tests += [(text(c) != "", f"Header {c} must stay empty") for c in OWNER_EMPTY]
    if sheet == "Details":
        tests += [((text(c) != "") & number(c).isNull(), f"Details {c} is not a number") for c in ("Unit Cost", "Quantity")] + [((text("Item") != "") & ~text("Item").rlike(IDENTIFIER), "Details Item is not an Item Master id")]
    for c in {"Header": ["Total Cost Ex Tax", "Tax Amount"], "Tax_Breakdown": ["Tax Basis"], "Details": []}[sheet]:
        tests.append(((text(c) != "") & number(c).isNull(), f"{sheet} {c} is not a number"))
        if places is not None:
            tests.append((number(c).isNotNull() & (F.length(F.regexp_extract(text(c), r"\.(\d*)$", 1)) > places), f"{sheet} {c} has more decimals than the currency"))
    return rows.select(F.col("`Transaction Number`").cast("string").alias("key"), F.explode(F.array_compact(F.array(*[F.when(t, F.lit(p)) for t, p in tests]))).alias("problem"))


def issues(cells: DataFrame, checks: DataFrame) -> DataFrame:
    """(doc, code, message): one for cells that differ from their source, one for those not proved, and one a failed check.

    ``cells`` has (doc, sheet, column, status); ``checks`` (doc, check, status, detail). Lines that are missing are told by their check.
    """
    open_ = cells.where((group(F.col("status")) == "needs_checking") & (F.col("status") != "missing_line"))
    core = F.col("status") == "mismatch"
    found = open_.groupBy("doc", core.alias("core")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "sheet", "column"))), ", ").alias("fields"))
    said = F.when(F.col("core"), " cell(s) do not equal the source their evidence points to: ").otherwise(" filled cell(s) could not be proven from their evidence: ")
    of_cells = found.select("doc", F.when(F.col("core"), "Target Mismatch").otherwise("Target Unverified").alias("code"), F.concat(F.col("n").cast("string"), said, "fields").alias("message"))
    return of_cells.unionByName(checks.where("status = 'fail'").select("doc", F.lit("Target Check").alias("code"), F.col("detail").alias("message")))


def summaries(cells: DataFrame, checks: DataFrame) -> DataFrame:
    """(doc, summary, holds): the counts of an invoice's cells in one line, and whether anything holds it back."""
    counted = cells.groupBy("doc").agg(*[F.count_if(group(F.col("status")) == g).alias(g) for g in ("verified", "empty_owner_rule", "empty_flagged", "needs_checking")])
    failed = checks.where("status = 'fail'").groupBy("doc").agg(F.count("*").alias("failed"), F.bool_or(F.col("check") == "lines_to_net").alias("lines"))
    own = counted.join(failed, "doc", "left")
    text = F.concat(
        F.lit("Target sheet: "), F.col("verified").cast("string"), F.lit(" verified · "), F.col("empty_owner_rule").cast("string"), F.lit(" empty by owner rule · "), F.col("empty_flagged").cast("string"), F.lit(" empty (flagged) · "),
        F.col("needs_checking").cast("string"), F.lit(" needs checking"), F.when(F.coalesce("lines", F.lit(False)), " · lines do not sum to net").otherwise(""),
    )
    return own.select("doc", text.alias("summary"), ((F.col("needs_checking") > 0) | (F.coalesce("failed", F.lit(0)) > 0)).alias("holds"))


def checks_rows(cells: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows of the checks sheet: every cell's group and status, then the invoice's own checks."""
    of_cells = cells.select(F.col("doc").alias("transaction"), "sheet", "column", F.col("line").cast("string").alias("line"), "value", group(F.col("status")).alias("status"), F.col("status").alias("detail"))
    none = F.lit(None).cast("string")
    return of_cells.unionByName(checks.select(F.col("doc").alias("transaction"), F.lit("(check)").alias("sheet"), F.col("check").alias("column"), none.alias("line"), none.alias("value"), "status", none.alias("detail")))


def viewed(fields: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, key, value, kind, flagged, reason): a value shows only with evidence; a reviewer's entry fills what is empty or unproved.

    ``fields`` has (doc, key, value, kind), kind null without evidence; ``entries`` (doc, key, entry).
    """
    joined = fields.join(entries, ["doc", "key"], "left")
    blank, unproved = F.trim(F.coalesce("value", F.lit(""))) == "", F.col("kind").isNull()
    entered = (F.trim(F.coalesce("entry", F.lit(""))) != "") & (blank | unproved)
    empty = ~entered & (blank | unproved)
    return joined.select("doc", "key", F.when(entered, F.col("entry")).when(~empty, F.col("value")).alias("value"), F.when(entered, "owner_entry").when(~empty, F.col("kind")).alias("kind"), empty.alias("flagged"), F.when(entered, "").when(blank, "Not found").when(unproved, "No evidence").otherwise("").alias("reason"))


def view_issues(view: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(doc, code, subject, level): flagged fields, hard if the target can't be written without them, and the rules' exceptions.

    ``view`` has (doc, key, flagged, reason); ``exceptions`` (doc, kind, blocking).
    """
    required = F.col("key").isin(REQUIRED_HEADER + REQUIRED_LINE)
    missing = view.where("flagged").select("doc", F.lit("Missing Evidence").alias("code"), F.col("key").alias("subject"), F.when(required, "hard").otherwise("warning").alias("level"))
    return missing.unionByName(exceptions.select("doc", F.col("kind").alias("code"), F.lit("").alias("subject"), F.when(F.col("blocking"), "review").otherwise("warning").alias("level")))


def accepted_ids(found: DataFrame) -> DataFrame:
    """(doc, accepted): the review-level issues that a confirmation accepts, sorted; another set needs a new one."""
    return found.where("level = 'review'").groupBy("doc").agg(F.array_sort(F.collect_set(F.concat_ws("|", "code", "subject"))).alias("accepted"))


def extraction_evidence(entries: DataFrame) -> DataFrame:
    """(doc, key, kind, source, reference, original) of a reader's quotes; an entry without one is no evidence."""
    where = F.concat(F.coalesce(F.concat(F.lit("page "), F.col("page").cast("string")), F.lit("page not given")), F.when(F.col("box").isNotNull(), F.concat(F.lit(" box ["), F.array_join("box", ", "), F.lit("]"))).otherwise(""))
    own = entries.where("trim(coalesce(quote, '')) <> ''")
    return own.select("doc", "key", F.lit("printed").alias("kind"), F.concat(F.lit("Invoice ("), F.coalesce("source", F.lit("ai")), F.lit(")")).alias("source"), where.alias("reference"), F.substring("quote", 1, 120).alias("original"))
