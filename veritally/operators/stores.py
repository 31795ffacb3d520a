"""The catalog's store, imports, mapping tables, jobs, deletion and sheets: set operations over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_identifier, normalize_name
from .aggregates import violations
from .match import barcode_candidates, vpn_candidates

#: Order rows kept of an item, names that a search takes, columns that hold categories.
CONTEXTS, NAMES = 20, 250_000
CATEGORIES = ["dept name", "class name", "sub name", "category", "department"]
EQUAL, WORD, PREFIX = 0.5, 0.39, 0.7


def rows_by_terms(terms: DataFrame, wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that have any wanted (kind, term), each once; payloads join behind the distinct ids."""
    ids = terms.join(F.broadcast(wanted.select("kind", "term").distinct()), ["kind", "term"], "left_semi").select("id").distinct()
    return rows.join(ids, "id", "left_semi")


def in_context(ids: DataFrame, terms: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """(kind, id) whose own rows have every filter's term. Filters are those of one query."""
    out = ids
    for role, value in filters:
        out = out.join(terms.where(F.col("term") == f"f:{role}:{value}").select("kind", "id"), ["kind", "id"], "left_semi")
    return out


def weighted(terms: DataFrame, kind: str, wanted: list[tuple[str, int]]) -> DataFrame:
    """(id, weight): the highest weight of the wanted terms, those of one query, that a row has."""
    asked = F.create_map(*[F.lit(x) for t, w in wanted for x in (t, w)])
    own = terms.where((F.col("kind") == kind) & F.col("term").isin([t for t, _ in wanted]))
    return own.groupBy("id").agg(F.max(F.element_at(asked, F.col("term"))).alias("weight"))


def pool(weights: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of greatest weight, and whether there were more."""
    first = weights.orderBy(F.desc("weight"), "id").limit(most + 1)
    own = Window.orderBy(F.desc("weight"), "id")  # over no more than most + 1 rows
    return first.withColumn("_n", F.row_number().over(own)).withColumn("cut", F.max("_n").over(Window.partitionBy()) > most).where(F.col("_n") <= most).drop("_n")


def with_payload(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """Ranked ids, a page of them, with their payloads."""
    return rows.join(F.broadcast(ranked), "id").select(*ranked.columns, *[c for c in rows.columns if c not in ranked.columns])


def probe(probes: DataFrame, terms: DataFrame, rows: DataFrame) -> DataFrame:
    """(probe, value, rows…): a batch of probes over the index, a normalised superset, re-checked on the original column ``exact``."""
    hits = probes.join(terms, ["kind", "term"]).select("probe", "value", "id").distinct()
    return hits.join(rows, "id").where("exact = value")


def of_order(terms: DataFrame, po_terms: DataFrame, order: str) -> DataFrame:
    """Ids of items that share an identity term with a row of the order."""
    rows = po_terms.where(F.col("term") == f"f:po:{order}").select("id")
    shared = po_terms.join(rows, "id", "left_semi").where(F.startswith("term", F.lit("x:"))).select("term").distinct()
    return terms.where(F.startswith("term", F.lit("x:"))).join(shared, "term", "left_semi").select("id").distinct()


def contexts(terms: DataFrame, po_terms: DataFrame, most: int = CONTEXTS) -> DataFrame:
    """(item, row, truncated): order rows of an item by shared identity, the first ones, and whether there were more."""
    items = terms.where(F.startswith("term", F.lit("x:"))).select("term", F.col("id").alias("item")).distinct()
    rows = po_terms.where(F.startswith("term", F.lit("x:"))).select("term", F.col("id").alias("row"))
    own = Window.partitionBy("item")
    found = items.join(rows, "term").select("item", "row").distinct()
    return found.withColumn("n", F.row_number().over(own.orderBy("row"))).where(F.col("n") <= most + 1).withColumn("truncated", F.max("n").over(own) > most).where(F.col("n") <= most).drop("n")


def public_score(query: Column, identifiers: Column, descriptions: Column) -> Column:
    """1 if the query is an identifier, 0.95 if a description, else by the share of its words that descriptions have or begin."""
    asked = normalize_name(query)
    words = F.split(asked, " ")
    told = F.transform(descriptions, lambda d: normalize_name(d))
    held = F.flatten(F.transform(told, lambda d: F.split(d, " ")))
    weights = F.transform(words, lambda w: F.when(F.array_contains(held, w), 1.0).when(F.exists(held, lambda h: F.startswith(h, w)), PREFIX).otherwise(0.0))
    share = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x) / F.size(words)
    exact = F.array_contains(F.transform(identifiers, lambda i: normalize_identifier(i)), normalize_identifier(query))
    return F.when(exact, 1.0).when(F.array_contains(told, asked), 0.95).otherwise(F.round(EQUAL + WORD * share, 3))


def names(terms: DataFrame, most: int = NAMES) -> DataFrame:
    """All distinct item names, or an error beyond the bound: refuse, never truncate."""
    from .aggregates import bounded

    return bounded(terms.where((F.col("kind") == "item") & F.startswith("term", F.lit("n:"))).select(F.substr("term", F.lit(3)).alias("name")).distinct(), most)


def descriptions(cells: DataFrame) -> DataFrame:
    """(id, column, value) of description cells but for categories, unless an item has no others."""
    from .aggregates import keep_or_fall_back

    return keep_or_fall_back(cells, ["id"], ~normalize_name(F.col("column")).isin(CATEGORIES))


def roles_conflict(left: Column, right: Column) -> Column:
    return (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)


def state(rows: DataFrame) -> DataFrame:
    """(kind, source_hash, rows, terms) of what is loaded."""
    return rows.groupBy("kind", "source_hash").agg(F.count("*").alias("rows"), F.sum("terms").cast("long").alias("terms"))


def state_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(kind, source_hash, expected, found) where an import's state isn't the expected one."""
    both = expected.withColumnRenamed("terms", "_terms").withColumnRenamed("rows", "expected").join(actual.withColumnRenamed("rows", "found"), ["kind", "source_hash"], "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")) | ~F.col("_terms").eqNullSafe(F.col("terms"))).select("kind", "source_hash", "expected", "found")


def batches(records: DataFrame, most_bytes: int) -> DataFrame:
    """Records of a kind with the batch into which the bytes up to their line put them."""
    upto = Window.partitionBy("kind").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("batch", F.floor(F.sum("bytes").over(upto) / most_bytes))


def still_to_load(rows: DataFrame, loaded: DataFrame) -> DataFrame:
    return rows.join(loaded.select("id"), "id", "left_anti")


def count_differences(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, declared, found) of sources whose rows aren't as many as the manifest says, on either side."""
    both = declared.join(rows.groupBy("source").agg(F.count("*").alias("found")), "source", "full")
    return both.where(~F.col("declared").eqNullSafe(F.col("found")))


def _first_of(rows: DataFrame, key: str, fine: Column, wrong: str, again: str) -> DataFrame:
    """Rows with a reason: none for the first sound row of a key, in sheet order; the others are flagged, never dropped."""
    marked = rows.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(key, "_fine").orderBy("row"))
    return marked.withColumn("reason", F.when(~F.col("_fine"), wrong).when(place > 1, again).otherwise("")).drop("_fine")


def vat_codes(rows: DataFrame) -> DataFrame:
    """Rows (row, vat_type, vat_code, region_name, rate, active) of type C with PV in the code, with region and reason."""
    own = rows.where((F.upper(F.trim("vat_type")) == "C") & F.contains(F.upper("vat_code"), F.lit("PV")))
    region = F.trim(F.regexp_replace(F.upper(F.trim("region_name")), r"\s*VAT\s+REGION\s*$", ""))
    named = own.withColumn("code", F.upper(F.trim("vat_code"))).withColumn("region", region)
    rate = F.replace("rate", F.lit(","), F.lit("")).try_cast("decimal(18,6)")
    return _first_of(named, "region", (F.col("region") != "") & (rate >= 0) & F.col("active").try_cast("date").isNotNull(), "region, rate or active date missing or invalid", "second C/PV code for the same VAT region")


def locations(rows: DataFrame) -> DataFrame:
    """Rows (row, location, kind, country, entity) with type, market, entity in capitals and reason."""
    kind = F.upper(F.trim("kind"))
    typed = rows.withColumn("type", F.when(kind == "STORE", "Store (S)").when(kind == "W/H", "Warehouse (W)")).withColumn("market", F.upper(F.trim("country"))).withColumn("entity", F.upper(F.trim("entity")))
    return _first_of(typed, "location", (F.trim("location") != "") & F.col("type").isNotNull() & (F.col("market") != ""), "location id, type (STORE or W/H) or country missing", "location id repeats")


def supplier_sites(rows: DataFrame) -> DataFrame:
    """Rows (row, site, currency, status) with a site id, currency in capitals, status in title case, and reason."""
    own = rows.where(F.trim(F.coalesce("site", F.lit(""))) != "").withColumn("currency", F.upper(F.trim("currency"))).withColumn("status", F.initcap(F.trim("status")))
    return _first_of(own, "site", F.col("currency").rlike("^[A-Z]{3}$") & F.col("status").isin("Active", "Inactive"), "currency is not a 3-letter code or status is not Active/Inactive", "supplier site id repeats")


def mapping_report(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(kept, flagged, without_id): one row of counts, and no value of the sheet."""
    counts = kept.agg(F.count_if(F.col("reason") == "").alias("kept"), F.count_if(F.col("reason") != "").alias("flagged"))
    return counts.join(F.broadcast(rows.agg(F.count_if(F.trim(F.coalesce("site", F.lit(""))) == "").alias("without_id"))))


def config_conflicts(currencies: DataFrame, tolerances: DataFrame) -> DataFrame:
    """(problem, key): keys with two currencies, and negative tolerances."""
    twice = currencies.groupBy("key").agg(F.count_distinct("value").alias("n")).where("n > 1").select(F.lit("two currencies").alias("problem"), "key")
    return twice.unionByName(tolerances.where("value < 0").select(F.lit("negative tolerance").alias("problem"), "key"))


def enriched(invoices: DataFrame, orders: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Invoices whose empty fields come from the only order of their number, each with where from."""
    single = orders.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(f).alias(f"_{f}") for f in fields]).where("_n = 1")
    joined = invoices.join(single, key, "left")
    out = [c for c in invoices.columns if c not in fields]
    filled = [F.coalesce(F.nullif(F.trim(f), F.lit("")), F.col(f"_{f}")).alias(f) for f in fields]
    told = [F.when((F.trim(F.coalesce(f, F.lit(""))) == "") & F.col(f"_{f}").isNotNull(), F.concat(F.lit("PO "), F.col(key))).alias(f"{f}_source") for f in fields]
    return joined.select(*out, *filled, *told)


def approval(invoices: DataFrame, sites: DataFrame, routes: DataFrame, orders: DataFrame, taxes: DataFrame) -> DataFrame:
    """(doc, failed): what an invoice's site, trading route, order and tax rule fail; each must be one row."""

    def counted(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias(f"_{key}"))

    of_order = orders.groupBy("po").agg(F.count("*").alias("_po"), F.min("status").alias("_status"))
    joined = invoices.join(counted(sites, "site"), "site", "left").join(counted(routes.where("status = 'approved'"), "route"), "route", "left").join(of_order, "po", "left").join(counted(taxes, "tax"), "tax", "left")

    def other(c: str) -> Column:
        return F.coalesce(F.col(c) != 1, F.lit(True))

    tests = {"SITE": other("_site"), "ROUTE": F.col("_route").isNull(), "PO": other("_po"), "PO_STATUS": ~other("_po") & (F.col("_status") != "open"), "TAX": other("_tax")}
    return joined.select("doc", violations(tests).alias("failed"))


def carried(after: DataFrame, before: DataFrame, mark: str) -> DataFrame:
    """Lines (doc, line, identity) with the mark that the same line had before."""
    return after.join(before.select("doc", "line", "identity", mark), ["doc", "line", "identity"], "left")


def attributed(entries: DataFrame) -> DataFrame:
    """Entries with the actor who made them: the previous one while the value stays, none without a value."""
    actor = F.when(F.col("after").isNull(), None).when(F.col("after").eqNullSafe(F.col("before")) & F.col("previous").isNotNull(), F.col("previous")).otherwise(F.col("actor"))
    return entries.withColumn("actor", actor)


def same_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, same): whether a document's lines have the same identities in the same places."""
    both = before.select("doc", "line", "identity", F.lit(1).alias("a")).join(after.select("doc", "line", "identity", F.lit(1).alias("b")), ["doc", "line", "identity"], "full")
    return both.groupBy("doc").agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same"))


def reset_reviews(jobs: DataFrame) -> DataFrame:
    """Ready jobs go back to review with a new revision; exported ones stay."""
    back = F.col("status") == "ready"
    return jobs.withColumn("revision", F.col("revision") + back.cast("int")).withColumn("status", F.when(back, "review").otherwise(F.col("status")))


def compare_and_set(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates with whether they apply: only to the revision that they expect."""
    return updates.join(jobs.select("id", "revision"), "id", "left").withColumn("applied", F.coalesce(F.col("revision") == F.col("expected"), F.lit(False)))


def deletion_conflicts(exports: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, problem) of exports whose job is gone or names another export."""
    joined = exports.join(jobs.withColumn("_job", F.lit(True)), "job_id", "left")
    problem = F.when(F.col("_job").isNull(), "no job").when(~F.col("export_id").eqNullSafe(F.col("id")), "job names another export")
    return joined.select("id", problem.alias("problem")).where("problem is not null")


def redacted(audit: DataFrame, deleted: DataFrame) -> DataFrame:
    """Audit rows without the deleted jobs, one selection's; rows that name no other go."""
    gone = F.broadcast(deleted.agg(F.collect_set("job").alias("_gone")))
    return audit.join(gone).withColumn("jobs", F.array_except("jobs", "_gone")).where(F.size("jobs") > 0).drop("_gone")


def minimal_allocations(allocations: Column) -> Column:
    """Key and quantity of each allocation; null if one lacks either."""
    own = F.transform(allocations, lambda a: F.struct(a["key"].alias("key"), a["qty"].alias("qty")))
    return F.when(F.forall(own, lambda a: (F.coalesce(a["key"], F.lit("")) != "") & a["qty"].isNotNull()), own)


def merged_allocations(tombstones: DataFrame) -> DataFrame:
    """(invoice_key, key, qty): what all tombstones of an invoice hold of each allocation."""
    return tombstones.select("invoice_key", F.inline("allocations")).groupBy("invoice_key", "key").agg(F.sum("qty").alias("qty"))


def upload_paths(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.get_json_object("payload", "$.upload").alias("path")).where("path is not null").distinct()


def jobs(rows: DataFrame) -> DataFrame:
    """(id, status, revision) of jobs by their JSON payload."""
    own = rows.withColumn("_p", F.from_json("payload", "status string, revision int"))
    return own.select("id", "_p.status", "_p.revision")


def draft_problems(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, problems) of manual drafts: the tax basis is the net, and the lines make it, to four places."""
    sums = lines.groupBy("doc").agg(F.round(F.sum(F.col("quantity") * F.col("unit_cost")), 4).alias("total"))
    joined = heads.join(sums, "doc", "left")
    tests = {"tax basis": ~F.round("tax_basis", 4).eqNullSafe(F.round("net", 4)), "lines": ~F.col("total").eqNullSafe(F.round("net", 4))}
    return joined.select("doc", violations(tests).alias("problems"))


def rated(invoices: DataFrame, codes: DataFrame) -> DataFrame:
    """Invoices with the rate of their tax code."""
    return invoices.withColumn("code", F.trim("code")).join(F.broadcast(codes), "code", "left")


def disclosed(jobs: DataFrame) -> DataFrame:
    """(doc, reason) of invoices that a draft leaves out."""
    reason = F.when(F.col("status") == "error", "not read").when(F.col("lines") == 0, "no lines")
    return jobs.select("doc", reason.alias("reason")).where("reason is not null")


def date_rows(results: DataFrame) -> DataFrame:
    """(transaction, column, value, status): an order date and a receipt date for each transaction."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(c).alias("value")) for n, c in (("Order Date", "order_date"), ("Receipt Date", "receipt_date"))])
    own = results.select("transaction", F.inline(pairs))
    return own.withColumn("status", F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty_flagged").otherwise("verified"))


def raw_rows(lines: DataFrame) -> DataFrame:
    """(doc, line, Candidate VPN, Candidate Barcode): candidates of each line as they are printed."""
    keys = ["doc", "line"]

    def told(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("origin", "value"))), lambda c: c["value"]), ", ").alias(name))

    codes, vpns = told(barcode_candidates(lines, keys), "Candidate Barcode"), told(vpn_candidates(lines, keys), "Candidate VPN")
    return lines.select(*keys).join(vpns, keys, "left").join(codes, keys, "left").na.fill("", ["Candidate VPN", "Candidate Barcode"])


def sheet_counts(sheets: dict[str, DataFrame]) -> DataFrame:
    """(sheet, rows) of a workbook's frames."""
    out = None
    for name, df in sheets.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("sheet"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def approved(heads: DataFrame, details: DataFrame) -> DataFrame:
    """Details of approved invoices alone."""
    return details.join(heads.where("status = 'Approved'").select("doc"), "doc", "left_semi")


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    return log.unionByName(new)


def either(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).unionByName(right.select(*keys)).distinct()


def line_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first reader's lines, and the second one's that it doesn't have by document, quantity and price."""
    known = first.select("doc", "qty", "price").distinct()
    return first.unionByName(second.join(known, ["doc", "qty", "price"], "left_anti").select(first.columns))


def columnar_checks(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, contiguous, sums): whether serials run from one without a gap, and amounts make the net."""
    found = lines.groupBy("doc").agg((F.max("serial") == F.count("*")).alias("_last"), (F.min("serial") == 1).alias("_first"), (F.count_distinct("serial") == F.count("*")).alias("_once"), F.sum("amount").alias("_total"))
    return heads.join(found, "doc").select("doc", (F.col("_last") & F.col("_first") & F.col("_once")).alias("contiguous"), (F.col("_total") == F.col("net")).alias("sums"))


def tokens_per_page(words: DataFrame) -> DataFrame:
    return words.groupBy("doc", "page").agg(F.count("*").alias("tokens"))


def passing(candidates: DataFrame) -> DataFrame:
    """(doc, passing, candidates): distinct orders that pass, of all candidates."""
    return candidates.groupBy("doc").agg(F.count_distinct(F.when(F.col("passed"), F.col("order_no"))).alias("passing"), F.count("*").alias("candidates"))


def fidelity(verified: DataFrame, made: DataFrame, keys: list[str], fields: list[str], by: str) -> DataFrame:
    """(by, field, rows, equal): how many of the verified values of each field are made."""
    joined = verified.join(made.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields]), keys, "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).eqNullSafe(F.col(f"_{f}")).alias("_same")) for f in fields])
    return joined.select(by, F.inline(pairs)).groupBy(by, "field").agg(F.count("*").alias("rows"), F.count_if("_same").alias("equal"))


def equal_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of lines of a page with equal quantity and price, nulls alike, and an equal code or text, or neither on one side."""
    a, b = left.alias("a"), right.alias("b")
    same = (F.col("a.page") == F.col("b.page")) & (F.col("a.doc") == F.col("b.doc")) & F.col("a.qty").eqNullSafe(F.col("b.qty")) & F.col("a.price").eqNullSafe(F.col("b.price"))
    alike = F.coalesce(F.col("a.sku") == F.col("b.sku"), F.lit(False)) | F.coalesce(F.lower("a.description") == F.lower("b.description"), F.lit(False))
    rest = [c for c in right.columns if c not in left.columns]
    return a.join(b, same).where(alike).select("a.*", *[f"b.{c}" for c in rest])
