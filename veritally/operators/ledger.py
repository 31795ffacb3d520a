"""Approval balances, the export ledger, deletion with tombstones, accuracy over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocations(ledger: DataFrame) -> DataFrame:
    """(key, used) over all receipts and tombstones of the ledger."""
    return ledger.select(F.explode("allocations").alias("a")).groupBy("a.key").agg(F.sum("a.qty").alias("used"))


def combined(exports: DataFrame, tombstones: DataFrame) -> DataFrame:
    return exports.unionByName(tombstones, allowMissingColumns=True)


def accepted(receipts: DataFrame) -> DataFrame:
    """(key, received): accepted receipts alone; returns count negative."""
    return receipts.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("status") == "accepted", F.col("qty"))), F.lit(0)).alias("received"))


def running_need(lines: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """Adds ``needed``: the quantity asked of an allocation up to each line."""
    own = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("needed", F.sum(F.coalesce("qty", F.lit(0))).over(own))


def balances(lines: DataFrame, order_lines: DataFrame, received: DataFrame, used: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """Lines with needed, available and the two tests of the balance; missing receipts and uses are none."""
    known = order_lines.join(received, "key", "left").join(used, "key", "left").select(
        "key", "ordered", "invoiced", F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("used", F.lit(0)).alias("used")
    )
    joined = running_need(lines, order, within).join(known, "key", "left")
    available = F.col("received") - F.col("invoiced") - F.col("used")
    return joined.withColumn("available", available).withColumn("over_received", F.col("needed") > available).withColumn("over_ordered", F.col("needed") > F.col("ordered") - F.col("invoiced") - F.col("used"))


def delete_invoices(exports: DataFrame, tombstones: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining exports, tombstones): deleted receipts leave their allocations behind; equal keys merge theirs."""
    remaining = exports.join(selected.select("id"), "id", "left_anti")
    gone = exports.join(selected.select("id"), "id", "left_semi").select("invoice_key", F.transform("allocations", lambda a: F.struct(a["key"].alias("key"), a["qty"].alias("qty"))).alias("allocations"))
    merged = gone.unionByName(tombstones.select("invoice_key", "allocations")).groupBy("invoice_key").agg(F.flatten(F.collect_list("allocations")).alias("allocations"))
    return remaining, merged


def whole_batches(exports: DataFrame, selected: DataFrame) -> DataFrame:
    """(batch_id, members, chosen) of batches that a selection would split; a deletion with any is refused."""
    marked = exports.join(selected.select("id", F.lit(True).alias("picked")), "id", "left")
    return marked.groupBy("batch_id").agg(F.count("*").alias("members"), F.count("picked").alias("chosen")).where("chosen between 1 and members - 1")


def duplicates(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    return keys.join(ledger.select("invoice_key").distinct(), "invoice_key", "left_semi")


def repeated(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of rows whose value a row with a smaller key has; values meet as digests, and only the least key of each goes through a join."""
    own = rows.select(key, F.sha2(F.coalesce(value, F.lit("")), 256).alias("_digest"), F.col(value).isNull().alias("_none"))
    first = own.groupBy("_digest", "_none").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return own.join(first, ["_digest", "_none"]).where(F.col(key) > F.col("_first")).select(key)


def latest(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The row with the highest revision of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), revision).alias("_row")).select(key, "_row.*")


#: The roll-up's periods in days.
PERIODS = {"7d": 7, "30d": 30, "all": None}


def accuracy(records: DataFrame, now: Column) -> DataFrame:
    """(period, grouping, name, cells, changed, accuracy) overall and by field, status and supplier.

    ``records`` has (at, supplier, field, line, status, changed); a missing line counts under its status alone.
    """
    spans = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).cast("int").alias("days")) for n, d in PERIODS.items()])
    timed = records.select("*", F.explode(spans).alias("p")).where(F.col("p.days").isNull() | (F.col("at") >= now - F.make_dt_interval(F.coalesce("p.days", F.lit(0)))))
    real = F.lit(True) if "missing" not in records.columns else ~F.col("missing")
    groups = F.concat(
        F.array(F.struct(F.lit("status").alias("grouping"), F.col("status").alias("name"))),
        F.when(real, F.array(*[F.struct(F.lit(g).alias("grouping"), v.alias("name")) for g, v in (("overall", F.lit("")), ("field", F.col("field")), ("supplier", F.coalesce("supplier", F.lit(""))))])).otherwise(
            F.array().cast("array<struct<grouping:string,name:string>>")
        ),
    )
    own = timed.select(F.col("p.name").alias("period"), F.inline(groups), "changed").groupBy("period", "grouping", "name")
    return own.agg(F.count("*").alias("cells"), F.count_if("changed").alias("changed")).withColumn("accuracy", F.round((F.col("cells") - F.col("changed")) / F.col("cells"), 4))


def confirmations(system: DataFrame, final: DataFrame, keys: list[str]) -> DataFrame:
    """Cells before and after confirmation, with whether they changed; a cell of one side alone counts as changed."""
    both = system.withColumnRenamed("value", "before").join(final.withColumnRenamed("value", "after"), keys, "full_outer")
    return both.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))
