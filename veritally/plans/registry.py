"""Queries over the driver's tables and their twins in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return put

    def scalar(self, name: str, table: str, key: str, source: str, function: Callable[[Column], Column], sql: str) -> None:
        """A function of one value over a whole table. ``source`` is an expression in both dialects, ``{x}`` its place in the twin."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            own = read(spark, sf_dir, table).select(*key.split(","), F.expr(source).alias("x"))
            return own.select(*key.split(","), function(F.col("x")).alias("value"))

        self.queries[name] = query
        self.sql[name] = f"SELECT {key}, {sql.replace('{x}', 'x')} AS value FROM (SELECT {key}, {source} AS x FROM {table})"

    def cases(self, name: str, function: Callable[[Column], Column], rows: list[tuple[str | None, object]], kind: str = "VARCHAR") -> None:
        """A function of one text over the events, each with one of these inputs; the twin states what must come out."""
        n = len(rows)
        source = "case event_id % " + str(n) + " " + " ".join(f"when {i} then {_literal(x)}" for i, (x, _) in enumerate(rows)) + " end"
        told = f"CASE event_id % {n} " + " ".join(f"WHEN {i} THEN {_expected(y)}" for i, (_, y) in enumerate(rows)) + " END"
        self.scalar(name, "events", "event_id", source, function, f"CAST({told} AS {kind})")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; pandas functions of this package find it wherever the workers start."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _literal(value: str | None) -> str:
    """A text for both engines; line ends, page ends and quotes by their codes."""
    if value is None:
        return "cast(NULL as string)"
    parts = re.split(r"([\n\f'])", value)
    told = [f"chr({ord(p)})" if p in "\n\f'" else f"'{p}'" for p in parts if p]
    return f"concat({', '.join(told)})" if len(told) > 1 else (told[0] if told else "''")


def _expected(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else str(value)


TABLE = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows made from the driver's tables, named ``{orders}``, by a statement that both engines read."""
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in set(TABLE.findall(sql))})


def plain(sql: str) -> str:
    """The same statement for the twin."""
    return TABLE.sub(r"\1", sql)


def views(spark: SparkSession, sf_dir: str, *tables: str) -> tuple[DataFrame, ...]:
    return tuple(read(spark, sf_dir, t) for t in tables)
