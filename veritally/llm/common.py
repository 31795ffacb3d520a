"""Shared pieces of the training-text operators."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that a worker handles at once; a longer text is a group of its own.
GROUP_CHARS = 1 << 20

#: A-Z to a-z, and every byte outside [0-9a-z] and the non-ASCII bytes to a blank.
#: All bytes of a non-ASCII character are over 0x7F, so this acts on UTF-8 bytes as on characters.
ALNUM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8; none for null."""
    return text.encode().translate(ALNUM_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8; none for null.

    ``bytes.lower`` and ``bytes.split`` know ASCII alone, which are these very classes.
    """
    return text.encode().lower().split() if text else []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def is_held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def text_groups(batches: Iterable[pa.RecordBatch], chars: int = GROUP_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(first column, second column) lists, of about ``chars`` characters each, from two-column batches."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        keys: list = []
        group: list[str | None] = []
        size = 0
        for key, value in zip(ids, texts, strict=True):
            text = value.as_py()
            if group and size + len(text or "") > chars:
                yield keys, group
                keys, group, size = [], [], 0
            keys.append(key)
            group.append(text)
            size += len(text or "")
        if group:
            yield keys, group


#: What this worker keeps from task to task, by name: how to drop it; and which of that the open task has asked for.
_kept: dict[str, Callable[[], object]] = {}
_asked: set[str] = set()


def keep(name: str, drop: Callable[[], object]) -> None:
    """Something is in use, and stays in the worker until a task ends that doesn't use it."""
    _kept[name] = drop
    _asked.add(name)


def kept(make: Callable) -> Callable:
    """A function whose results a worker keeps until a task ends that doesn't ask for them."""
    name, cached = f"{make.__module__}.{make.__qualname__}", lru_cache(maxsize=4)(make)

    @wraps(make)
    def get(*args):
        keep(name, cached.cache_clear)
        return cached(*args)

    return get


def open_task() -> None:
    _asked.clear()


def close_task() -> None:
    """Drop what an earlier operator's tasks have kept: workers outlive operators."""
    for name in _kept.keys() - _asked:
        _kept.pop(name)()
    release()


def release() -> None:
    """Give freed memory back to the system, of a worker or of the driver."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``, with this package on the workers' path wherever they start; on a cluster it is installed there."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_task()
        yield from run(batches)
        close_task()

    return df.mapInArrow(task, schema)


def map_texts(df: DataFrame, work: Callable[[list, list[str | None]], dict[str, list]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run ``work(keys, texts) -> columns`` over groups of whole texts, in Arrow batches and without a shuffle."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches):
            columns = work(keys, texts)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return map_arrow(df.select(key, text), run, schema)


#: Rows whose texts are judged at once when rows are filtered.
FILTERED_ROWS = 256


def filter_texts(df: DataFrame, keep: Callable[[list[str | None]], list[bool]], text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts are kept: a map, so that no text goes through a shuffle."""
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, FILTERED_ROWS):
                part = batch.slice(i, FILTERED_ROWS)
                yield part.filter(pa.array(keep(part.column(place).to_pylist()), pa.bool_()))

    return map_arrow(df, run, df.schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only where it is unset on one machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            configured = tempfile.mkdtemp(prefix="veritally-")
        context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


#: Rows of a key from which it is joined apart, at least; and the most such keys there can be.
HOT_ROWS, HOT_KEYS = 100_000, 10_000


def join_values(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Rows inner-joined with one value row for each key, where ``n`` counts the key's rows; ``n`` is dropped.

    Keys with very many rows would each meet in one task. They are joined by broadcast: as each has over ``HOT_ROWS`` rows
    and over one in ``HOT_KEYS`` of all, they are fewer than ``HOT_KEYS``.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    large, small = values.where(hot).drop("n"), values.where(~hot).drop("n")
    apart = F.broadcast(large)
    return rows.join(apart, key).unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder, so that lost executors cost nothing that came before."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
