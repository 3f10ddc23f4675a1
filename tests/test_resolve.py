import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest.operators import recovery, resolve
from palimpsest.schema import LOG

SCHEMA = "key binary, seq long, op int, value binary, run long"


def log(spark, rows):
    return spark.createDataFrame([(k, i + 1, op, v, i // 3) for i, (k, op, v) in enumerate(rows)], SCHEMA)


def as_dict(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


def model(rows, upto=None):
    out = {}
    for k, op, v in rows[:upto]:
        out.pop(k, None)
        if op:
            out[k] = v
    return out


ops = st.lists(st.tuples(st.sampled_from([b"a", b"a\x00", b"b", b"\x80", b"\xff\x01"]), st.integers(0, 1), st.sampled_from([b"", b"x", b"\xf0y"])), max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ops, cut=st.integers(0, 40))
def test_live_snapshot_and_compact_follow_a_dict(spark, rows, cut):
    rows = [(k, op, v if op else None) for k, op, v in rows]
    df = log(spark, rows)
    assert as_dict(resolve.live(df)) == model(rows)
    assert as_dict(resolve.snapshot(df, cut)) == model(rows, cut)
    assert as_dict(resolve.compact(resolve.flush(df))) == model(rows)
    assert {bytes(r["key"]) for r in resolve.tombstones(df).collect()} == {k for k, _, _ in rows} - set(model(rows))


def test_two_versions_in_one_run_with_a_snapshot_between(spark):
    df = log(spark, [(b"k", 1, b"1"), (b"k", 1, b"2")])
    assert as_dict(resolve.snapshot(df, 1)) == {b"k": b"1"}


def test_empty_deleted_and_absent_differ(spark):
    df = log(spark, [(b"empty", 1, b""), (b"gone", 1, b"x"), (b"gone", 0, None)])
    keys = spark.createDataFrame([(b"empty",), (b"gone",), (b"never",)], "key binary")
    got = {bytes(r["key"]): (r["status"], r["value"]) for r in resolve.get_many(df, keys).collect()}
    assert got[b"empty"][0] == "OK" and bytes(got[b"empty"][1]) == b""
    assert got[b"gone"] == got[b"never"] == ("NOT_FOUND", None)
    assert resolve.get_raw(df, b"gone").collect()[0]["op"] == 0 and not resolve.get_raw(df, b"never").collect()


def test_order_is_of_unsigned_bytes_newest_first(spark):
    rows = [(b"\xff", 1, b"1"), (b"a", 1, b"2"), (b"", 1, b"3"), (b"a\x00", 1, b"4"), (b"a", 1, b"5")]
    got = [(bytes(r["key"]), r["seq"]) for r in resolve.ordered(log(spark, rows)).collect()]
    assert got == [(b"", 3), (b"a", 5), (b"a", 2), (b"a\x00", 4), (b"\xff", 1)]


def test_difference_is_what_two_snapshots_say(spark):
    rng = random.Random(3)
    rows = [(bytes([97 + rng.randrange(8)]), op := rng.randrange(2), bytes([rng.randrange(3)]) if op else None) for _ in range(60)]
    old, new = model(rows, 20), model(rows, 45)
    got = {bytes(r["key"]): r["change"] for r in resolve.difference(log(spark, rows), 20, 45).collect()}
    want = {k: "added" if k not in old else "removed" if k not in new else "changed" for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert got == want


def test_key_predicate_reaches_the_scan_and_value_predicate_does_not(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, [(b"a", 1, b"1"), (b"b", 0, None)]).write.parquet(path)
    df = resolve.get(spark.read.parquet(path), b"a").where("value = X'31'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert "EqualTo(key" in scan and "op" not in scan.partition("PushedFilters")[2].partition("]")[0] and "EqualTo(value" not in scan


def test_valid_prefix_by_checksum(spark):
    df = recovery.with_crc(log(spark, [(b"good", 1, b"record"), (b"k", 0, None), (b"z", 1, b"")]).drop("run"))
    assert {r["seq"]: r["crc"] for r in df.collect()}[1] == 312827944
    torn = df.selectExpr("key", "seq", "op", "value", "CASE WHEN seq = 2 THEN crc + 1 ELSE crc END AS crc")
    assert [r["seq"] for r in recovery.valid_prefix(torn, recovery.is_bad()).collect()] == [1]
    assert recovery.valid_prefix(df, recovery.is_bad()).count() == 3


def test_log_record_bytes(spark):
    from pyspark.sql import functions as F

    df = log(spark, [(b"good", 1, b"record"), (b"k", 0, None)])
    got = [r[0] for r in df.orderBy("seq").select(F.lower(F.hex(recovery.record(F.col("op"), F.col("key"), F.col("value"))))).collect()]
    assert got == ["2860a512010400000006000000676f6f647265636f7264", "e5c4912e0001000000000000006b"]


def test_schema_of_log():
    assert [f.name for f in LOG] == ["key", "seq", "op", "value"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops, st.lists(st.tuples(st.sampled_from([b"a", b"b", b"none"]), st.integers(0, 45)), max_size=12), st.integers(1, 50))
def test_stretches_do_not_show(spark, rows, probes, stretch):
    df = log(spark, rows)
    got = sorted((bytes(r["key"]), r["version"], r["seq"]) for r in resolve.versions(df, stretch).collect())
    want = []
    for k in {r[0] for r in rows}:
        want += [(k, n + 1, i + 1) for n, i in enumerate(i for i in reversed(range(len(rows))) if rows[i][0] == k)]
    assert got == sorted(want)
    asked = spark.createDataFrame(probes, "key binary, at long")
    found = sorted((bytes(r["key"]), r["at"], r["seq"] or 0) for r in resolve.as_of_join(asked, df, stretch).collect())
    assert found == sorted((k, at, max((i + 1 for i, r in enumerate(rows) if r[0] == k and i < at), default=0)) for k, at in probes)


def test_blocks_are_filled_in_key_order(spark):
    rows = [(b"%03d" % i, 1, b"v" * (i * 37 % 4000)) for i in range(60)]
    used, blocks = 0, 1
    for k, _, v in rows:
        n = 17 + len(k) + len(v)
        used, blocks = (n, blocks + 1) if used + n > 4088 else (used + n, blocks)
    df = spark.createDataFrame([(k, i + 1, op, v, 7) for i, (k, op, v) in enumerate(rows)], SCHEMA)
    assert [tuple(r) for r in resolve.run_blocks(df).collect()] == [(7, blocks)]
    assert resolve.any_live(df).collect()[0][0] and not resolve.any_live(df.limit(0)).collect()[0][0]
