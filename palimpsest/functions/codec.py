"""Byte and text codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def once(x: Column, f) -> Column:
    """f(x) with x worked out once, as a variable of an array of one: named in f as it is, it would be wherever f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def le_bytes(n: Column, size: int) -> Column:
    """An integer's `size` low bytes, lowest first, as binary."""
    byte = lambda i: F.unhex(F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0"))
    return F.concat(*[byte(i) for i in range(size)])


def u32le(n: Column) -> Column:
    return le_bytes(n, 4)


def u64le(n: Column) -> Column:
    return le_bytes(n, 8)


def le_number(data: Column, at: Column | int, size: int) -> Column:
    """The signed integer in `size` bytes from the place `at` (from 0) on, lowest first; null if they are not all there."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(data, at.cast("int") + 1, F.lit(size)))
    turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when((at >= 0) & (F.octet_length(data) >= at + size), F.conv(turned, 16, -10).cast("long"))


def u32le_at(data: Column, at: Column | int) -> Column:
    return le_number(data, at, 4)


def u64le_at(data: Column, at: Column | int) -> Column:
    return le_number(data, at, 8)


#: Bytes before the key in a sorted run's record.
RUN_HEADER = 17


def run_record_fields(data: Column) -> Column:
    """The struct (op, seq, key, value) of a sorted run's record; null if it is not exactly one. Deletions have no value."""
    return once(data, _fields)


def _fields(data: Column) -> Column:
    keys, values = u32le_at(data, 9), u32le_at(data, 13)
    whole = F.coalesce((keys > 0) & (values >= 0) & (F.octet_length(data) == RUN_HEADER + keys + values), F.lit(False))
    op = le_number(data, 0, 1)
    value = F.when(op != 0, F.substring(data, RUN_HEADER + 1 + keys.cast("int"), values.cast("int")))
    fields = F.struct(op.alias("op"), u64le_at(data, 1).alias("seq"), F.substring(data, F.lit(RUN_HEADER + 1), keys.cast("int")).alias("key"), value.alias("value"))
    return F.when(whole & op.isin(0, 1), fields)


def run_record(op: Column, seq: Column, key: Column, value: Column) -> Column:
    """A sorted run's record: operation, seq, lengths, key and value."""
    v = F.coalesce(value, F.lit(b""))
    return F.concat(F.unhex(F.lpad(F.hex(op.cast("long")), 2, "0")), u64le(seq), u32le(F.octet_length(key)), u32le(F.octet_length(v)), key, v)


def tokens(text: Column, separators: str) -> Column:
    """The non-empty parts between runs of separators: empty fields collapse, and the later ones move up."""
    return F.filter(F.split(text, f"[{separators}]"), lambda x: x != "")


def joined(*fields: Column | str, separator: str = "|") -> Column:
    return F.concat_ws(separator, *fields)


def field(text: Column, i: int, separator: str = "|", missing: str = "?") -> Column:
    """The i-th non-empty part of a delimited text, or `missing`."""
    return F.coalesce(F.get(tokens(text, separator), F.lit(i)), F.lit(missing))


def product_id(n: Column) -> Column:
    """P and the number with at least three digits."""
    return F.format_string("P%03d", n)


def csv_rows(lines: DataFrame) -> DataFrame:
    """lines (line_no from 1, line) -> id, name, category, price, status: the first line and blank ones are skipped.

    A line needs four non-empty fields, else its status is error; further fields are ignored.
    """
    clean = F.regexp_replace("line", "[\r\n]+$", "")
    body = lines.where("line_no > 1").select(clean.alias("line")).where("line <> ''").select(tokens(F.col("line"), ",").alias("f"))
    names = ("id", "name", "category", "price")
    full = F.size("f") >= len(names)
    return body.select(*[F.when(full, F.get("f", F.lit(i))).alias(n) for i, n in enumerate(names)], F.when(full, "loaded").otherwise("error").alias("status"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """A product file by the rules of csv_rows; each file's first line is its header."""
    # One column, split at a character that no product holds: Spark's own reader drops each file's header and can split files.
    lines = spark.read.schema("line string").options(header=True, sep="\x01", quote="", escape="").csv(path)
    return csv_rows(lines.select(F.lit(2).alias("line_no"), "line"))


def read_products_strict(spark: SparkSession, path: str) -> DataFrame:
    """The same file as quoted CSV: empty fields stay empty, malformed lines fail."""
    return spark.read.schema("id string, name string, category string, price string").option("header", True).option("mode", "FAILFAST").csv(path)
