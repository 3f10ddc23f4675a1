"""Bloom filters: sizing, two 32-bit hashes by column expressions, positions, probes and the byte layout."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codec import once

#: Fixed values of the hashes.
M32 = 0xFFFFFFFF
FNV_BASIS, FNV_PRIME, GOLDEN = 0x811C9DC5, 0x01000193, 0x9E3779B9
MIX_1, MIX_2 = 0x85EBCA6B, 0xC2B2AE35
MIN_BITS, MAX_HASHES = 8, 30


def sizing(n: int, fpr: float) -> tuple[int, int]:
    """(bits, hashes) for n keys and a false positive rate; the hashes come from the bits before these are rounded to bytes."""
    if n < 1 or not 0 < fpr < 1:
        raise ValueError("n must be positive and the rate between 0 and 1")
    bits = max(MIN_BITS, math.ceil(-n * math.log(fpr) / math.log(2) ** 2))
    hashes = min(MAX_HASHES, max(1, math.floor(bits / n * math.log(2) + 0.5)))
    return (bits + 7) // 8 * 8, hashes


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2^32 without a 64-bit overflow: 16 bits of x at a time."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c)
    high = F.shiftleft((F.shiftright(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(M32))


def _finish(x: Column) -> Column:
    steps = (lambda v: v.bitwiseXOR(F.shiftright(v, 16)), lambda v: _times(v, MIX_1), lambda v: v.bitwiseXOR(F.shiftright(v, 13)), lambda v: _times(v, MIX_2), lambda v: v.bitwiseXOR(F.shiftright(v, 16)))
    for step in steps:
        x = once(x, step)
    return x


def _bytes(key: Column) -> Column:
    """The bytes of a binary or text column as an array of integers."""
    digits = F.hex(key.cast("binary"))
    n = F.octet_length(key.cast("binary"))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))


def hashes(key: Column) -> tuple[Column, Column]:
    """The two hashes of a key, each a long below 2^32."""
    fnv = lambda a, b: (a.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(M32))
    turned = lambda a: (F.shiftleft(a, 5).bitwiseOR(F.shiftright(a, 27))).bitwiseAND(F.lit(M32))
    one = F.aggregate(_bytes(key), F.lit(FNV_BASIS).cast("long"), fnv)
    two = F.aggregate(_bytes(key), F.lit(FNV_BASIS ^ GOLDEN).cast("long"), lambda a, b: once(fnv(a, b), turned))
    return _finish(one), _finish(two)


def with_hashes(df: DataFrame, key: str = "key") -> DataFrame:
    one, two = hashes(F.col(key))
    return df.withColumns({"h1": one, "h2": two})


def sizes(n: Column, fpr: float) -> tuple[Column, Column]:
    """sizing() of a column of counts."""
    bits = F.greatest(F.lit(MIN_BITS).cast("long"), F.ceil(-n * F.lit(math.log(fpr)) / F.lit(math.log(2) ** 2)))
    hashes = F.least(F.lit(MAX_HASHES).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(bits / n * F.lit(math.log(2)) + F.lit(0.5))))
    return F.floor((bits + 7) / 8) * 8, hashes


def positions(bits: Column | int, count: Column | int) -> Column:
    """The distinct bits of the columns h1 and h2."""
    bits, count = (F.lit(x) if isinstance(x, int) else x for x in (bits, count))
    # Both hashes are bound to a variable first: named within the inner function, each would be worked out for each position.
    places = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")), lambda i: (h["h1"] + i * h["h2"]).bitwiseAND(F.lit(M32)) % bits))
    return once(F.struct("h1", "h2"), places)


def build(keys: DataFrame, bits: int, count: int, key: str = "key") -> DataFrame:
    """pos: the bits that are set; at most `bits` rows, whatever the keys."""
    return with_hashes(keys, key).select(F.explode(positions(bits, count)).alias("pos")).distinct()


def build_each(keys: DataFrame, fpr: float, by: str = "run", key: str = "key") -> DataFrame:
    """keys (by, key) -> by, pos: a filter for each group, of the size that its count of distinct keys asks for."""
    keys = keys.select(by, key).distinct()
    bits, count = sizes(F.col("n"), fpr)
    sized = keys.groupBy(by).agg(F.count("*").alias("n")).select(by, bits.alias("bits"), count.alias("count"))
    return with_hashes(keys, key).join(sized, by).select(by, F.explode(positions(F.col("bits"), F.col("count"))).alias("pos")).distinct()


def as_bytes(filter_bits: DataFrame, bits: int) -> bytes:
    """A built filter as bytes, lowest bit first; the driver holds bits / 8 bytes."""
    per_byte = filter_bits.groupBy(F.floor(F.col("pos") / 8).alias("at")).agg(F.sum(F.call_function("shiftleft", F.lit(1), (F.col("pos") % 8).cast("int"))).alias("b"))
    out = bytearray(bits // 8)
    for r in per_byte.toLocalIterator():
        out[r["at"]] = r["b"]
    return bytes(out)


def probe(keys: DataFrame, filter_bits: DataFrame, bits: int, count: int, key: str = "key") -> DataFrame:
    """keys with may_contain. The filter meets each key's bits in a join; without a filter row nothing is contained."""
    hashed = with_hashes(keys.select(key).distinct(), key).select(key, positions(bits, count).alias("at"))
    hits = hashed.select(key, F.size("at").alias("need"), F.explode("at").alias("pos")).join(filter_bits, "pos", "left_semi")
    found = hits.groupBy(key, "need").count().where("count = need").select(key, F.lit(True).alias("hit"))
    return keys.join(found, key, "left").withColumn("may_contain", F.coalesce("hit", F.lit(False))).drop("hit")


def encode(filter_bytes: bytes, bits: int, count: int) -> bytes:
    """Bits and hashes as little-endian 32-bit integers, then the filter."""
    return struct.pack("<II", bits, count) + filter_bytes


def decode(data: bytes) -> tuple[bytes, int, int]:
    """(filter, bits, hashes); ValueError if the data can't be one."""
    if len(data) < 8:
        raise ValueError("short header")
    bits, count = struct.unpack_from("<II", data)
    if bits == 0 or bits % 8 or len(data) - 8 < bits // 8:
        raise ValueError("bad size")
    return data[8 : 8 + bits // 8], bits, count


def may_contain(filter_bytes: bytes | None, bits: int, count: int, h1: int, h2: int) -> bool:
    """One probe on the driver; without a filter everything may be contained."""
    if filter_bytes is None:
        return True
    at = [((h1 + i * h2) & M32) % bits for i in range(count)]
    return all(filter_bytes[p >> 3] >> (p & 7) & 1 for p in at)
