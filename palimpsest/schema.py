"""The change log's schema, operation codes, statuses and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 1, 0

#: A row of the change log. value is null only for deletions: an empty value is a value.
LOG = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.ByteType(), False),
    T.StructField("value", T.BinaryType(), True),
])

#: Status names by code.
STATUS = ("OK", "NOT_FOUND", "IO_ERROR", "CORRUPTION", "OOM", "BUSY", "INVALID_ARG")


class StoreError(Exception):
    """Base of the errors below."""


class InvalidArgument(StoreError):
    """An empty or missing key, or an argument out of range."""


class BusyError(StoreError):
    """Another writer committed first, or open snapshots forbid a compaction."""


class CorruptionError(StoreError):
    """Stored data does not match its checksum or layout."""


def status_name(code: Column) -> Column:
    """The name of a status code; UNKNOWN for others."""
    names = F.array(*[F.lit(s) for s in STATUS])
    return F.when((code >= 0) & (code < len(STATUS)), F.get(names, code.cast("int"))).otherwise(F.lit("UNKNOWN"))
