"""What the training-data operators share: work tables and small text helpers."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import folder as work_dir
from ..sources.work import materialize

#: A word: what stands between space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: The same for Spark's regular expressions.
GAP_SQL = r"[\x20\x09-\x0D]+"

#: Rows that a task turns into Python values at once.
ROWS_AT_ONCE = 1_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def sql_ascii_lower(column):
    """Lower-cases A-Z only, in Spark."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def give_back() -> None:
    """Returns the memory that this Python worker has freed to the system; a C library without malloc_trim keeps its own.

    Workers outlive tasks: what a step has freed, but its allocators hold, would count beside the need of all later steps.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_kept: dict[str, tuple] = {}


def kept(name: str, of, make: Callable):
    """What make() gives, once a Python worker for each `of`; it goes when a task comes that doesn't keep it (frugal)."""
    if name not in _kept or _kept[name][0] != of:
        _kept[name] = of, make()
    return _kept[name][1]


def forget(but: str | None) -> None:
    """Drops what earlier tasks of this worker have kept; a stage after them would carry it along."""
    for name in [n for n in _kept if n != but]:
        del _kept[name]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function of a task's batches, with give_back at its end, and forget at its beginning."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def frugal_group(step: Callable[[pa.Table], pa.Table], keeps: str | None = None) -> Callable[[pa.Table], pa.Table]:
    """step, a function of a group's rows, with give_back at its end, and forget at its beginning."""

    def tidy(table: pa.Table) -> pa.Table:
        forget(keeps)
        try:
            return step(table)
        finally:
            give_back()

    return tidy


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Applies a function of one Arrow batch, as lists of values by column, in every task.

    make() runs once a task and returns that function; it may keep what it has learnt of earlier batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield pa.RecordBatch.from_pydict(step(batch.slice(begin, ROWS_AT_ONCE).to_pydict()), schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(frugal(run), schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """Keeps the rows for which a function of the batch says True; all columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                yield part.filter(pa.array(step(part), pa.bool_()))

    return df.mapInArrow(frugal(run), df.schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out():
    """True for the rows that no classifier learns from: crc32 of the decimal doc_id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def share_order(*columns: str):
    """A number from 0 to 1 that depends on the given columns only; picks bounded samples alike in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))
