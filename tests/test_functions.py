import struct
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import bloom, codec
from palimpsest.operators import recovery


def test_sizing():
    want = {(1, 0.01): (16, 7), (100, 0.01): (960, 7), (500, 0.01): (4800, 7), (1000, 0.01): (9592, 7), (10_000, 0.01): (95_856, 7), (1_000_000, 0.001): (14_377_592, 10)}
    assert {k: bloom.sizing(*k) for k in want} == want
    with pytest.raises(ValueError):
        bloom.sizing(0, 0.01)


def test_hashes(spark):
    want = {"apple": (2973335288, 1456920331), "user:1": (1763983599, 2280205522), "P001": (4125390688, 154975662), "key0": (2910253809, 597401074)}
    got = {r["key"]: (r["h1"], r["h2"]) for r in bloom.with_hashes(spark.createDataFrame([(k,) for k in want], "key string")).collect()}
    assert got == want


def test_no_false_negatives_and_few_false_positives(spark):
    bits, count = bloom.sizing(2000, 0.01)
    keys = spark.range(2000).select(F.concat(F.lit("ins"), "id").alias("key"))
    built = bloom.build(keys, bits, count)
    assert bloom.probe(keys, built, bits, count).where("NOT may_contain").count() == 0
    others = spark.range(5000).select(F.concat(F.lit("probe"), "id").alias("key"))
    assert bloom.probe(others, built, bits, count).where("may_contain").count() < 0.03 * 5000


def test_filter_bytes_round_trip(spark):
    bits, count = bloom.sizing(3, 0.01)
    keys = bloom.with_hashes(spark.createDataFrame([("a",), ("b",), ("",)], "key string"))
    data, n_bits, n_hashes = bloom.decode(bloom.encode(bloom.as_bytes(bloom.build(keys.select("key"), bits, count), bits), bits, count))
    assert (n_bits, n_hashes) == (bits, count)
    assert all(bloom.may_contain(data, bits, count, r["h1"], r["h2"]) for r in keys.collect())
    assert bloom.may_contain(None, bits, count, 1, 2)
    for bad in (b"", b"1234567", b"\0" * 8, bloom.encode(b"", 16, 7), bloom.encode(b"\0" * 2, 12, 7)):
        with pytest.raises(ValueError):
            bloom.decode(bad)


def test_little_endian(spark):
    got = spark.range(1).select(codec.u32le(F.lit(0x04030281)).alias("a"), codec.u64le(F.lit(2**40 + 255)).alias("b")).collect()[0]
    assert bytes(got["a"]) == bytes([0x81, 2, 3, 4]) and bytes(got["b"]) == (2**40 + 255).to_bytes(8, "little")


def test_separators_collapse(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("id,name,category,price\nP001,a,b,1.5\r\nP002,,b,2\n\nP003,a,,b,3,x\n,P004,n,c,9\n")
    got = codec.read_products(spark, str(f))
    rows = {r["id"]: r["price"] for r in got.where("status = 'loaded'").collect()}
    assert rows == {"P001": "1.5", "P003": "3", "P004": "9"} and got.where("status = 'error'").count() == 1


def test_missing_fields_are_marked(spark):
    df = spark.createDataFrame([("n|c",), ("",), ("|x||y",)], "v string").select(*[codec.field(F.col("v"), i).alias(str(i)) for i in range(3)])
    assert [tuple(r) for r in df.collect()] == [("n", "c", "?"), ("?", "?", "?"), ("x", "y", "?")]


def test_records_decode_and_bad_ones_give_null(spark):
    rows = [(1, 2**40 + 7, b"k", b"v"), (0, 1, b"key", None), (1, 2**32, b"\x00\xff", b""), (1, 5, b"a" * 300, b"b" * 70_000)]
    df = spark.createDataFrame(rows, "op int, seq long, key binary, value binary")
    record = codec.run_record(F.col("op"), F.col("seq"), F.col("key"), F.col("value"))
    got = df.select("seq", codec.run_record_fields(record).alias("f")).collect()
    want = {r[1]: r for r in rows}
    for r in got:
        f = r["f"]
        assert (f["op"], f["seq"], bytes(f["key"]), None if f["value"] is None else bytes(f["value"])) == want[r["seq"]]
    cut = df.select(codec.run_record_fields(F.substring(record, F.lit(1), F.octet_length(record) - 1)).alias("f"), codec.run_record_fields(F.lit(b"")).alias("g")).collect()
    assert all(r["f"] is None and r["g"] is None for r in cut)
    n = spark.sql("SELECT unhex('FFFFFFFF0100000000000080') AS b").select(codec.u32le_at(F.col("b"), 0), codec.u64le_at(F.col("b"), 4), codec.u32le_at(F.col("b"), 9)).collect()[0]
    assert tuple(n) == (2**32 - 1, -(2**63) + 1, None)


def log_bytes(*rows):
    body = lambda op, k, v: struct.pack("<BII", op, len(k), len(v)) + k + v
    return [zlib.crc32(b).to_bytes(4, "little") + b for b in (body(*r) for r in rows)]


def test_recovery_of_bytes_stops_at_the_first_bad_place(spark, tmp_path):
    whole = log_bytes((1, b"k1", b"v1"), (0, b"k1", b""), (1, b"k2", b""), (1, b"k3", b"v" * 5000))
    data = b"".join(whole)
    keys = lambda d: [r and r[1] for r in recovery.records(d)]
    assert list(recovery.records(data))[:3] == [(1, b"k1", b"v1"), (0, b"k1", None), (1, b"k2", b"")] and keys(b"") == []
    for n in range(len(data)):  # torn anywhere: whole records only, then the mark of what is torn
        ends = [sum(map(len, whole[: i + 1])) for i in range(4)]
        if n < 60 or n % 97 == 0:
            done = sum(e <= n for e in ends)
            assert keys(data[:n]) == [b"k1", b"k1", b"k2", b"k3"][:done] + [None] * (n not in [0, *ends])
    for i in range(len(whole[0]), len(whole[0]) + len(whole[1])):  # one flipped byte anywhere in the second record
        assert keys(data[:i] + bytes([data[i] ^ 0xFF]) + data[i + 1 :]) == [b"k1", None]
    assert keys(data + b"LEFTOVERS") == [b"k1", b"k1", b"k2", b"k3", None]
    assert keys(b"".join(log_bytes((2, b"k", b"")))) == [None] and keys(b"".join(log_bytes((1, b"", b"v")))) == [None]
    for name, d in (("000", data), ("001", data[:-1]), ("002", data)):
        (tmp_path / name).write_bytes(d)
    got = sorted((r["segment"], r["place"], bytes(r["key"])) for r in recovery.read_log(spark, tmp_path.as_uri()).collect())
    assert got == [("000", i, k) for i, k in enumerate((b"k1", b"k1", b"k2", b"k3"))] + [("001", i, k) for i, k in enumerate((b"k1", b"k1", b"k2"))]
