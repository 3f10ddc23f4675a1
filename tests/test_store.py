import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import resolve
from palimpsest.schema import BusyError, InvalidArgument
from palimpsest.sources.store import Manifest, SecondaryIndex, Store, StoreOptions
from palimpsest.streaming import ingest


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key binary, value binary, at int")


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, (tmp_path / "store").as_uri())


def test_put_get_overwrite_delete(spark, store):
    store.put(rows(spark, (b"name", b"alice"), (b"k", b"v1"), (b"k", b"v2"), (b"empty", b"")), order="at")
    assert (store.get(b"name"), store.get(b"k"), store.get(b"empty"), store.get(b"none")) == (b"alice", b"v2", b"", None)
    store.delete(rows(spark, (b"name", None), (b"absent", None)))
    assert store.get(b"name") is None and store.current_seq() == 6
    assert [bytes(r["key"]) for r in store.scan().collect()] == [b"empty", b"k"]


def test_reopen_goes_on_with_the_sequence(spark, store):
    store.put(rows(spark, (b"a", b"1")))
    again = Store.open(spark, store.path)
    again.put(rows(spark, (b"a", b"2")))
    assert again.current_seq() == 2 and again.get(b"a") == b"2"


def test_empty_keys_are_refused_and_nothing_is_committed(spark, store):
    for bad in (b"", None):
        with pytest.raises(InvalidArgument):
            store.put(rows(spark, (b"a", b"1"), (bad, b"2")))
    with pytest.raises(InvalidArgument):
        store.get(b"")
    assert store.run_count() == 0 and store.manifest().version == 0


def test_snapshots_are_isolated_and_forbid_compaction(spark, store):
    store.put(rows(spark, (b"k", b"v1"), (b"x", b"1")))
    with store.snapshot() as one:
        store.put(rows(spark, (b"k", b"v2"), (b"new", b"n")))
        store.delete(rows(spark, (b"x", None)))
        with store.snapshot() as two:
            assert (one.get(b"k"), one.get(b"x"), one.get(b"new")) == (b"v1", b"1", None)
            assert (two.get(b"k"), two.get(b"x"), two.get(b"new")) == (b"v2", None, b"n")
            with pytest.raises(BusyError):
                store.compact()
        with pytest.raises(BusyError):
            store.vacuum()
    store.compact()


def test_compaction_keeps_the_newest_and_drops_deletions(spark, store):
    store.compact()
    assert store.manifest().version == 0
    for r in range(3):
        store.put(rows(spark, *[(b"key%d" % i, b"r%d" % r) for i in range(20)]))
    store.delete(rows(spark, (b"key3", None)))
    store.compact()
    assert store.run_count() == 1 and store.log().count() == 19 and store.log().where("op = 0").count() == 0
    assert store.get(b"key3") is None and store.get(b"key4") == b"r2"
    assert len(store.vacuum()) == 4 and Store.open(spark, store.path).get(b"key19") == b"r2"


def test_compaction_of_deletions_only_leaves_no_run(spark, store):
    store.put(rows(spark, (b"a", b"1")))
    store.delete(rows(spark, (b"a", None)))
    store.compact()
    assert store.run_count() == 0 and store.log().count() == 0


def test_runs_beyond_the_option_are_compacted(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "s").as_uri(), StoreOptions(max_runs=2))
    for i in range(3):
        store.put(rows(spark, (b"k", b"%d" % i)))
    assert store.run_count() == 1 and store.get(b"k") == b"2"


def raced(*jobs):
    """Runs the jobs at once; what each gives, or the error."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.exception() or f.result() for f in [pool.submit(j) for j in jobs]]


def test_writers_that_race_lose_nothing(spark, store):
    def work(name):
        own = Store.open(spark, store.path)
        for i in range(4):
            own.put(rows(spark, (b"%s%d" % (name, i), name), (b"shared", b"%s%d" % (name, i))), order="at")

    found = raced(lambda: work(b"a"), lambda: work(b"b"), lambda: work(b"c"))
    assert found == [None] * 3
    log = sorted((r["seq"], bytes(r["key"]), r["run"]) for r in store.log().collect())
    assert [x[0] for x in log] == list(range(1, 25)) and [x[2] for x in log] == [1 + i // 2 for i in range(24)]
    assert store.current_seq() == 24 and all(store.get(b"%s%d" % (n, i)) == n for n in (b"a", b"b", b"c") for i in range(4))
    assert store.vacuum() == [] and store.recover() == 0 and len(store.files.names("data")) == 12


def test_a_writer_races_a_compaction_and_a_vacuum(spark, store):
    store.put(rows(spark, *[(b"k%d" % i, b"old") for i in range(30)]))
    store.put(rows(spark, (b"k1", b"new")))
    store.delete(rows(spark, (b"k2", None)))

    def write():
        for i in range(4):
            Store.open(spark, store.path).put(rows(spark, (b"w%d" % i, b"w"), (b"k3", b"%d" % i)), order="at")

    def upkeep():
        for _ in range(3):
            try:
                Store.open(spark, store.path).compact()
            except BusyError:
                pass
            Store.open(spark, store.path).vacuum()

    assert raced(write, upkeep) == [None, None]
    assert [store.get(x) for x in (b"k1", b"k2", b"k3", b"k4", b"w0", b"w3")] == [b"new", None, b"3", b"old", b"w", b"w"]
    assert store.scan().count() == 33 and store.current_seq() == 40


def test_two_compactions_one_wins(spark, store):
    for i in range(3):
        store.put(rows(spark, (b"k", b"%d" % i)))
    found = raced(*[lambda: Store.open(spark, store.path).compact()] * 2)
    assert store.run_count() == 1 and store.get(b"k") == b"2" and all(isinstance(x, (Manifest, BusyError)) for x in found)


def test_a_batch_of_a_dead_writer_is_invisible_and_goes_when_old(spark, tmp_path, monkeypatch):
    store = Store.open(spark, (tmp_path / "s").as_uri(), StoreOptions(grace_seconds=1))
    store.put(rows(spark, (b"a", b"1")))
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.put(rows(spark, (b"a", b"2")))
    assert store.get(b"a") == b"1" and len(store.files.names("data")) == 2
    store.put(rows(spark, (b"b", b"1")))
    time.sleep(1.5)
    assert len(store.vacuum()) == 1 and store.get(b"a") == b"1" and store.get(b"b") == b"1"


def test_a_writer_gives_up_after_so_many_attempts(spark, tmp_path, monkeypatch):
    store = Store.open(spark, (tmp_path / "s").as_uri(), StoreOptions(attempts=2))
    monkeypatch.setattr(Store, "_commit", lambda *_: False)
    with pytest.raises(BusyError):
        store.put(rows(spark, (b"a", b"1")))
    assert store.files.names("data") == [] and store.files.names("_work") == []


def test_leases_run_out_and_are_renewed(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "s").as_uri(), StoreOptions(lease_seconds=1))
    store.put(rows(spark, (b"k", b"1")))
    one, two = store.snapshot(), store.snapshot()
    assert len(store.snapshots()) == 2
    time.sleep(1.2)
    two.renew()
    assert store.snapshots() == [two.lease] and store.recover() == 1 and two.get(b"k") == b"1"
    two.release()
    one.release()
    assert store.snapshots() == []


@pytest.mark.parametrize("local", [True, False])
def test_a_manifest_appears_once(store, local):
    store.files.local = local  # the other way is that of HDFS, which local disks know too
    assert store.files.publish("x/1", "one") and not store.files.publish("x/1", "two")
    assert store.files.read("x/1") == "one" and store.files.names("_tmp") == []


def test_a_batch_of_a_stream_is_written_once(spark, store):
    store.write(rows(spark, (b"k", b"1")).withColumn("op", F.lit(1)), batch=("s", 0))
    store.put(rows(spark, (b"k", b"2")))
    store.write(rows(spark, (b"k", b"1")).withColumn("op", F.lit(1)), batch=("s", 0))
    assert store.get(b"k") == b"2" and store.current_seq() == 2
    store.compact()
    store.write(rows(spark, (b"k", b"3")).withColumn("op", F.lit(1)), batch=("s", 1))
    assert store.get(b"k") == b"3" and store.manifest().batches == {"s": 1}


def test_a_damaged_run_fails_loudly(spark, store, tmp_path):
    store.put(rows(spark, *[(b"key%05d" % i, b"value%05d" % i) for i in range(2000)]))
    for f in (tmp_path / "store" / "data").rglob("part-*.parquet"):
        data = bytearray(f.read_bytes())
        data[200] ^= 0xFF
        f.write_bytes(data)
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):  # noqa: B017  what Parquet's reader raises
        Store.open(spark, store.path).scan().collect()


def test_secondary_index(spark, tmp_path):
    main, idx = Store.open(spark, (tmp_path / "m").as_uri()), Store.open(spark, (tmp_path / "i").as_uri())
    both = SecondaryIndex(idx, main)
    main.put(rows(spark, (b"u001", b"ana"), (b"u002", b"bob")))
    both.put(spark.createDataFrame([(b"a@x", b"u001"), (b"b@x", b"u002"), (b"orphan@x", b"u999")], "secondary binary, primary binary"))
    assert both.get(b"a@x") == b"ana" and both.lookup_primary(b"orphan@x") == b"u999" and both.get(b"orphan@x") is None
    assert both.join().count() == 2
    both.delete(rows(spark, (b"a@x", None)))
    assert both.get(b"a@x") is None and main.get(b"u001") == b"ana"


def test_stream_into_store(spark, tmp_path):
    events = spark.range(50).select(F.concat(F.lit("k"), F.col("id") % 7).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("op"), F.col("id").alias("at"))
    for i in range(3):
        events.where(F.col("at") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store.open(spark, (tmp_path / "s").as_uri())
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    ingest.into_store(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.log().count() == 50
    folder, state = str(tmp_path / "state"), ingest.live_state(stream.withColumnRenamed("at", "seq"))
    ingest.into_folder(state, folder, str(tmp_path / "cp2")).awaitTermination()
    want = {bytes(r["key"]): bytes(r["value"]) for r in resolve.live(events.withColumnRenamed("at", "seq")).collect()}
    found = ingest.live_rows(ingest.state_of(spark, folder, state.schema))
    assert {bytes(r["key"]): bytes(r["value"]) for r in found.collect()} == want


def test_a_micro_batch_that_is_run_again_is_there_once(spark, tmp_path):
    rows(spark, (b"k", b"old")).withColumn("op", F.lit(1)).write.parquet(str(tmp_path / "in"))
    store, checkpoint = Store.open(spark, (tmp_path / "s").as_uri()), tmp_path / "cp"
    stream = lambda: spark.readStream.schema("key binary, value binary, at int, op int").parquet(str(tmp_path / "in"))
    ingest.into_store(stream(), store, str(checkpoint)).awaitTermination()
    store.put(rows(spark, (b"k", b"new")))
    for f in (checkpoint / "commits").iterdir():  # as if the driver had died before the query noted its batch
        f.unlink()
    ingest.into_store(stream(), store, str(checkpoint)).awaitTermination()
    assert store.get(b"k") == b"new" and store.current_seq() == 2
