"""Aggregates with the engine's rules: exactly one value or nothing, and sums that a missing operand makes null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_or_null(value: Column, order: Column, key: Column | None = None) -> Column:
    """The first spelling of the only distinct value, by ``order``; null with none or several."""
    own = value if key is None else key
    return F.when(F.count_distinct(own) == 1, F.min_by(value, F.when(value.isNotNull(), order)))


def complete_sum(value: Column) -> Column:
    """The sum, or null if any value is missing."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def keep_or_fall_back(df: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """Rows that pass the test, or all rows of a group of which none passes."""
    passed = F.coalesce(test, F.lit(False))
    return df.withColumn("_pass", passed).withColumn("_any", F.max("_pass").over(Window.partitionBy(*keys))).where("_pass or not _any").drop("_pass", "_any")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column | str], most: int = 1) -> DataFrame:
    """The first rows of each group; the order must be total for a defined result."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n")


def listed(values: Column, most: int = 20) -> Column:
    """Sorted values as one string, cut with the number left out."""
    own = F.array_sort(F.array_distinct(values))
    rest = F.size(own) - most
    return F.concat(F.array_join(F.slice(own, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" (+"), rest.cast("string"), F.lit(")"))).otherwise(F.lit("")))


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.inline(pairs))


def violations(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """The rows, or an error at run time if there are more than ``most``: refuse, never truncate."""
    size = df.limit(most + 1).agg(F.count(F.lit(1)).alias("_size"))
    checked = size.select(F.when(F.col("_size") > most, F.raise_error(F.lit(f"more than {most} rows"))).otherwise(F.lit(None).cast("void")).alias("_ok"))
    return df.join(F.broadcast(checked), F.lit(True), "inner").where("_ok is null").drop("_ok")
