"""The searchable catalog: roles, terms, identity, reconciliation, ranked search and paging."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import header_roles, normalize_identifier, normalize_name

ROLES = ("sku", "gtin", "internal_item", "identity", "uom", "pack", "description", "supplier", "site", "po")
#: Scores of a search.
EXACT_ID, EXACT_NAME, TOKEN, PART = 100_000, 90_000, 1_000, 500


def record_id(source_hash: Column, sheet: Column, row: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", source_hash, sheet, row.cast("string")), 256)


def cell_values(values: Column, longest: int = 2000) -> Column:
    """Distinct trimmed texts of a list cell, blanks and overlong ones left out."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & F.length(v).between(1, longest)))


def roles_of(data: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(id, kind, role, column, value) of catalog rows (id, kind, data map of lists).

    ``declared`` has (kind, role, header); a kind in it uses its mapping alone, any other the headers' own meaning.
    """
    cells = data.select("id", "kind", F.explode("data").alias("column", "values")).select("id", "kind", "column", F.explode(cell_values(F.col("values"))).alias("value"))
    guessed = cells.withColumn("role", F.explode(header_roles(F.col("column"))))
    if declared is None:
        return guessed.select("id", "kind", "role", "column", "value")
    mapping = declared.select("kind", "role", normalize_name(F.col("header")).alias("header")).distinct()
    by_mapping = cells.withColumn("header", normalize_name(F.col("column"))).join(F.broadcast(mapping), ["kind", "header"])
    free = guessed.join(F.broadcast(mapping.select("kind").distinct()), "kind", "left_anti")
    return by_mapping.select("id", "kind", "role", "column", "value").unionByName(free.select("id", "kind", "role", "column", "value"))


def terms(roles: DataFrame) -> DataFrame:
    """(kind, term, id): identifiers i: and x:, names n: and their words t:, filters f:."""
    code, name = normalize_identifier(F.col("value")), normalize_name(F.col("value"))
    own = roles.withColumn("code", code).withColumn("name", name)
    role = F.col("role")
    coded, named = F.length("code").between(2, 300), F.length("name").between(2, 1000)
    wide = F.when(role == "po", F.col("code")).otherwise(F.col("name"))
    words = F.filter(F.split("name", " "), lambda w: F.length(w).between(2, 100))
    none = F.array().cast("array<string>")
    made = F.array_distinct(
        F.flatten(
            F.array(
                F.when(role.isin("sku", "gtin", "internal_item", "po") & coded, F.array(F.concat(F.lit("i:"), "code"))).otherwise(none),
                F.when(role.isin("sku", "gtin", "internal_item") & coded, F.array(F.concat(F.lit("x:"), "role", F.lit(":"), "code"))).otherwise(none),
                F.when((role == "description") & named, F.concat(F.array(F.concat(F.lit("n:"), "name")), F.transform(words, lambda w: F.concat(F.lit("t:"), w)))).otherwise(none),
                F.when(role.isin("supplier", "site", "po") & F.length(wide).between(1, 500), F.array(F.concat(F.lit("f:"), "role", F.lit(":"), wide))).otherwise(none),
            )
        )
    )
    return own.select("kind", F.explode(made).alias("term"), "id").distinct()


def search_terms(query: str, normalized: str) -> list[tuple[str, int, str]]:
    """(term, score, way of adding up) of a normalised query."""
    return [(f"i:{normalized.replace(' ', '')}", EXACT_ID, "max"), (f"n:{normalized}", EXACT_NAME, "max")] + [(f"t:{w}", TOKEN, "sum") for w in dict.fromkeys(normalized.split()) if len(w) >= 2]


def search(index: DataFrame, kind: str, wanted: list[tuple[str, int, str]], within: DataFrame | None = None) -> DataFrame:
    """(id, score): exact identifiers and names by their highest score, words by their sum; others add PART each.

    ``within`` has ids to which the search is restricted. The wanted terms are the words of one query.
    """
    asked = index.sparkSession.createDataFrame(wanted, "term string, score int, way string")
    # The list reaches the scan of a stored index, which is sorted by term.
    hits = index.where((F.col("kind") == kind) & F.col("term").isin([t for t, _, _ in wanted])).join(F.broadcast(asked), "term")
    if within is not None:
        hits = hits.join(within.select("id").distinct(), "id", "left_semi")
    exact = F.coalesce(F.max(F.when(F.col("way") == "max", F.col("score"))), F.lit(0))
    return hits.groupBy("id").agg((exact + F.sum(F.when(F.col("way") == "sum", F.col("score")).otherwise(PART))).cast("long").alias("score"))


def page(scored: DataFrame, size: int, after: tuple[int, str] | None = None) -> DataFrame:
    """The next ``size`` rows by falling score and rising id, behind a cursor's row."""
    if after is not None:
        scored = scored.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("id") > after[1])))
    return scored.orderBy(F.desc("score"), "id").limit(size)


def cursor_text(signature: Column, score: Column, identifier: Column) -> Column:
    """A cursor as a column: url-safe, without padding."""
    body = F.to_json(F.struct(signature.alias("q"), score.alias("score"), identifier.alias("id")))
    return F.rtrim(F.translate(F.base64(body.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def cursor_parts(text: Column) -> Column:
    """(q, score, id) of a cursor; null if it can't be read."""
    padded = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "q string, score int, id string")


def cursor(signature: str, score: int, identifier: str) -> str:
    import base64

    return base64.urlsafe_b64encode(json.dumps([signature, score, identifier]).encode()).decode().rstrip("=")


def read_cursor(text: str, signature: str) -> tuple[int, str]:
    """The row of a cursor; a stale or foreign one is refused."""
    import base64

    try:
        own, score, identifier = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError:
        raise ValueError("the cursor can't be read") from None
    if own != signature:
        raise ValueError("the cursor belongs to another query")
    return int(score), str(identifier)


def reconcile(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(source_hash, kind, expected, found) where counts by source and kind differ from the manifest's."""
    found = rows.groupBy("source_hash", "kind").agg(F.count("*").alias("found"))
    both = found.join(expected.select("source_hash", "kind", F.col("count").alias("expected")), ["source_hash", "kind"], "full_outer")
    return both.where(~F.col("found").eqNullSafe(F.col("expected")))


def duplicate_sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_hash", "sheet", "row_number").agg(F.count("*").alias("rows")).where("rows > 1")


def envelope_violations(row_keys: list[str]) -> dict[str, Column]:
    """Tests on a catalog row that must not hold."""
    tests = {f"{k} is missing": F.col(k).isNull() for k in row_keys}
    return tests | {"kind is unknown": ~F.col("kind").isin("item", "po"), "hash is malformed": ~F.col("source_hash").rlike("^[0-9a-f]{64}$"), "row is not positive": F.col("row_number") < 1}
