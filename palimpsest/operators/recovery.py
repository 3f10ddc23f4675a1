"""Record checksums, and recovery of the longest valid prefix of a log: of rows, or of a log's bytes.

A log's bytes come in segments, each a file that one task holds whole, as large as a writer lets its log become before it
writes a run. A segment is good up to its first record that is cut off, has a checksum of other bytes, an unknown operation or
an empty key; a log is good up to the first such place of its first segment that has one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.codec import u32le


def body(op: Column, key: Column, value: Column) -> Column:
    """What a record's checksum covers: operation, lengths, key and value."""
    v = F.coalesce(value, F.lit(b""))
    return F.concat(F.unhex(F.lpad(F.hex(op.cast("long")), 2, "0")), u32le(F.octet_length(key)), u32le(F.octet_length(v)), key, v)


def record(op: Column, key: Column, value: Column) -> Column:
    """A log record: CRC-32 of its body, little-endian, then the body."""
    return F.concat(u32le(F.crc32(body(op, key, value))), body(op, key, value))


def records(data: bytes) -> Iterator[tuple[int, bytes, bytes | None] | None]:
    """(op, key, value) of each record up to the first bad one; None in its place. Deletions have no value."""
    at = 0
    while at < len(data):
        head = data[at + 4 : at + 13]
        if len(head) < 9:
            yield None
            return
        op, keys, values = struct.unpack("<BII", head)
        end = at + 13 + keys + values
        if op not in (0, 1) or not keys or end > len(data) or zlib.crc32(data[at + 4 : end]) != int.from_bytes(data[at : at + 4], "little"):
            yield None
            return
        yield op, data[at + 13 : at + 13 + keys], data[at + 13 + keys : end] if op else None
        at = end


def read_segments(segments: DataFrame) -> DataFrame:
    """segments (segment, data) -> segment, place (from 0), op, key, value; op is null where a segment goes bad."""
    schema = f"segment {segments.schema['segment'].dataType.simpleString()}, place long, op int, key binary, value binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column("data")):
                found = [x or (None, None, None) for x in records(data.as_py() or b"")]
                cols = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
                own = pa.array([b.column("segment")[i].as_py()] * len(found), b.column("segment").type)
                yield pa.RecordBatch.from_arrays([own, pa.array(range(len(found)), pa.int64()), *cols], ["segment", "place", "op", "key", "value"])

    return segments.select("segment", "data").mapInArrow(run, schema)


def recovered(segments: DataFrame) -> DataFrame:
    """segment, place, op, key, value of the records before the first bad place of the log."""
    rows = read_segments(segments)
    first = rows.where("op IS NULL").agg(F.min("segment").alias("first")).scalar()
    return rows.withColumn("first", first).where("op IS NOT NULL AND (first IS NULL OR segment <= first)").drop("first")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The recovered records of a folder of segments, in the order of the files' names."""
    files = spark.read.format("binaryFile").load(folder)
    return recovered(files.select(F.element_at(F.split("path", "/"), -1).alias("segment"), F.col("content").alias("data")))


def with_crc(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", F.crc32(body(F.col("op"), F.col("key"), F.col("value"))))


def is_bad(stored_crc: str = "crc") -> Column:
    """Whether a row's stored checksum, operation or key is not valid."""
    bad = F.crc32(body(F.col("op"), F.col("key"), F.col("value"))) != F.col(stored_crc)
    return F.coalesce(bad | ~F.col("op").isin(0, 1) | (F.octet_length("key") == 0), F.lit(True))


def valid_prefix(log: DataFrame, bad: Column) -> DataFrame:
    """The rows before the first bad one, by seq; all of them if none is bad. The bound is one row, a scalar subquery."""
    first = log.where(bad).agg(F.min("seq").alias("first")).scalar()
    return log.where(F.col("seq") < F.coalesce(first, F.lit(2**63 - 1)))
