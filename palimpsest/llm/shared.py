"""Shared storage for intermediate tables, and helpers that more than one operator needs."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of other characters than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a side that may be broadcast, as an estimate of what it takes in memory; larger sides are joined by a shuffle.
BROADCAST_BYTES = 32_000_000
#: Rows that a Python worker gets at once, and that Parquet's reader holds: texts are long, and Spark's own bounds are 10,000
#: and 4,096, so that single buffers of many megabytes would come and go. Bytes of a row group, for the same reason.
ARROW_ROWS, READER_ROWS, ROW_GROUP = 500, 512, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Whether the shuffles of a query that has ended are removed at once, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage and survives lost executors.

    The files are removed when the scratch() around it ends, or else when the driver's Python does, as the frame returned to the
    caller may still read them. The frame knows how many rows it has.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    seen = Observation()
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**{"parquet.block.size": ROW_GROUP} | options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_rows = seen.get["rows"]
    for tables in _scratch.open[-1:]:
        tables[path] = out
    return out


class _Scratch(threading.local):
    def __init__(self):
        self.open: list[dict[str, DataFrame]] = []


_scratch = _Scratch()


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables stored within at its end, but for those given to the function that it yields."""
    tables, kept = {}, []
    _scratch.open.append(tables)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scratch.open.pop()
        for path, df in tables.items():
            if any(df is k for k in kept):
                for outer in _scratch.open[-1:]:
                    outer[path] = df
            else:
                _remove(df.sparkSession, path)


def rows_of(df: DataFrame) -> int:
    """The count of a frame's rows, which stored ones know."""
    found = getattr(df, "stored_rows", None)
    if found is None:
        found = df.stored_rows = df.count()
    return found


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of rows in a batch, if they are higher or open. They stay: frames run after they are made."""
    for key, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, str(rows))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended before, and its folder may have gone with it
        pass


def small_side(df: DataFrame, size: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """df (stored already, or of at most `rows` rows) with a broadcast hint if it takes at most so many bytes; else Spark picks a shuffled join.

    A row counts 32 bytes, 8 a number and 32 any other column, so it is for rows of numbers, keys and names.
    """
    width = 32 + sum(8 if isinstance(f.dataType, T.NumericType) else 32 for f in df.schema)
    return F.broadcast(df) if (rows_of(df) if rows is None else rows) * width <= size else df


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: What a Python worker keeps between tasks: one object at most, of the operator that ran last.
_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The object that this process keeps under a key, made if it is not there; whatever else it kept goes."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def begin(keeps: bool) -> None:
    if not keeps:
        _held.clear()


def end() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """run for a Python worker that tasks of several operators share: frees what another one kept, and gives memory back after."""

    def wrapped(batches: Iterator) -> Iterator:
        begin(keeps)  # by their names in this module: what this function holds itself would be sent along as a copy
        try:
            yield from run(batches)
        finally:
            end()

    return wrapped
