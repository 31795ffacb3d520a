"""Groups of rows folded by a function, in one pass over sorted rows: small groups cost no frame each, large ones no list in a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that is given out.
GIVEN = 10_000


def _values(column: pa.Array) -> list:
    """Python values; a missing number is NaN, as in a frame."""
    kind = column.type
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(kind) or pa.types.is_integer(kind) else column.to_pylist()


def folded(rows: DataFrame, keys: list[str], fold: Callable[[tuple, list[dict]], list[tuple]], ddl: str, order: list[str] | None = None) -> DataFrame:
    """Rows ``ddl`` that ``fold`` makes of each group's key and rows, these in no order but that of ``order``."""
    names = rows.columns
    places = [names.index(k) for k in keys]
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def given() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            heads = zip(*(batch.column(p).to_pylist() for p in places), strict=True)
            cells = zip(*map(_values, batch.columns), strict=True)
            for head, row in zip(heads, cells, strict=True):
                if head != key and group:
                    out += fold(key, group)
                    group = []
                    if len(out) >= GIVEN:
                        yield given()
                        out = []
                key = head
                group.append(dict(zip(names, row, strict=True)))
        if group:
            out += fold(key, group)
        if out:
            yield given()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, ddl)
