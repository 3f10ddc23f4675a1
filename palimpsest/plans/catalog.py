"""The catalogue of queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import bloom, codec
from palimpsest.operators import index, recovery, resolve
from palimpsest.schema import status_name

RUN_EVENTS = 500
BLOOM_FPR = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log over events: users are keys, errors delete, 500 events are a run."""
    is_error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(is_error, 0).otherwise(1).alias("op"),
        F.when(~is_error, F.col("props")).alias("value"), F.expr(f"event_id DIV {RUN_EVENTS}").alias("run"),
    )


def _named(df: DataFrame) -> DataFrame:
    """Result columns: k and v, as key and value are words of SQL."""
    return df.withColumnsRenamed({"key": "k", "value": "v"})


def _over_log(f):
    return lambda spark, sf_dir: _named(f(log(spark, sf_dir)))


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.range(200).select(F.col("id").cast("string").alias("key"))
    return _named(resolve.get_many(log(spark, sf_dir), keys))


def index_log(spark: SparkSession, sf_dir: str, shift: int = 0, deleted: str | None = None) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("primary", F.col("o_custkey") + shift)
    return index.entries(orders, "o_orderpriority", "primary", "o_orderkey", deleted)


def index_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return index.lookup(index_log(spark, sf_dir), customers, "c_custkey").select("secondary", F.col("primary").alias("prim"), "c_name")


def index_phantom(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return index.phantoms(index_log(spark, sf_dir, 1000), customers, "c_custkey").select("secondary", F.col("primary").alias("prim"))


def index_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return index.resolvable(index_log(spark, sf_dir, 1000), customers, "c_custkey").select("secondary", F.col("primary").alias("prim"))


def index_lookup_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lookup_primary(index_log(spark, sf_dir)).select("secondary", F.col("primary").alias("prim"))


def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lookup_primary(index_log(spark, sf_dir, deleted="o_orderstatus = 'P'")).select("secondary", F.col("primary").alias("prim"))


def index_delete_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers lead to their last orders; open orders leave the main table, and the entries that lead to them go."""
    orders = table(spark, sf_dir, "orders")
    entries = index.entries(orders, "o_custkey", "o_orderkey", "o_orderkey")
    removed = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("secondary"), F.col("o_orderkey").alias("primary"), (F.col("o_orderkey") + 10**12).alias("seq"))
    return index.lookup_primary(entries.unionByName(index.delete(entries, removed))).select("secondary", F.col("primary").alias("prim"))


def index_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = index.multi_entries(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", "o_orderkey")
    return resolve.live(entries).groupBy(F.col("key.secondary").alias("secondary")).agg(F.count("*").alias("entries"), F.max("seq").alias("last_seq"))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    return part.select(F.col("p_partkey").alias("id"), codec.joined(F.col("p_name"), F.col("p_type"), F.format_string("%.2f", "p_retailprice")).alias("encoded"))


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("encoded")
    return _encoded(spark, sf_dir).select("id", "encoded", codec.field(e, 0).alias("name"), codec.field(e, 1).alias("category"), codec.field(e, 2).alias("price"), codec.field(e, 3).alias("missing"))


def find_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("encoded")
    out = _encoded(spark, sf_dir).select("id", codec.field(e, 0).alias("name"), codec.field(e, 1).alias("category"))
    return out.where(F.col("category") == "ECONOMY")


def wal_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose stored checksum is off by one, as a torn write leaves them, every 7777th; then the prefix before the first."""
    return _named(recovery.valid_prefix(log(spark, sf_dir), F.col("seq") % 7777 == 0).select("key", "seq", "op"))


def wal_crc_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same prefix, found by checksums: those of every 7777th record are off by one."""
    rows = log(spark, sf_dir).select(F.col("key").cast("binary").alias("key"), "seq", "op", F.col("value").cast("binary").alias("value"))
    rows = recovery.with_crc(rows).withColumn("crc", F.col("crc") + F.when(F.col("seq") % 7777 == 0, 1).otherwise(0))
    return recovery.valid_prefix(rows, recovery.is_bad()).select(F.col("key").cast("string").alias("k"), "seq", "op")


def wal_bytes_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as the bytes of segments, one a run: the checksum of every 7777th record is wrong and the last segment is cut off."""
    rows = log(spark, sf_dir).select("run", "seq", "op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    record = recovery.record(F.col("op"), F.col("key"), F.col("value"))
    broken = F.concat(codec.u32le(F.crc32(recovery.body(F.col("op"), F.col("key"), F.col("value"))).bitwiseXOR(F.lit(1))), F.substring(record, F.lit(5), F.octet_length(record)))
    hexed = F.hex(F.when(F.col("seq") % 7777 == 0, broken).otherwise(record))
    last = rows.agg(F.max("seq")).scalar()
    # A run has a fixed number of events, so its array is bounded.
    whole = rows.select("run", "seq", hexed.alias("hexed")).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "hexed"))).alias("r"), F.max("seq").alias("high"))
    data = F.unhex(F.array_join("r.hexed", ""))
    segments = whole.withColumn("last", last).select(F.col("run").alias("segment"), F.when(F.col("high") == F.col("last"), F.substring(data, F.lit(1), F.octet_length(data) - 3)).otherwise(data).alias("data"))
    return recovery.recovered(segments).select(F.col("segment").alias("run"), "place", "op", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def crc32_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select(F.col("key").cast("binary").alias("key"), "seq", "op", F.col("value").cast("binary").alias("value"))
    return recovery.with_crc(rows).select("seq", "crc")


def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return rows.select("seq", F.lower(F.hex(codec.run_record(F.col("op"), F.col("seq"), F.col("key").cast("binary"), F.col("value").cast("binary")))).alias("record"))


def run_record_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record encoded and decoded again."""
    record = codec.run_record(F.col("op"), F.col("seq"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    fields = log(spark, sf_dir).select(codec.run_record_fields(record).alias("f")).select("f.*")
    return fields.select("seq", "op", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def bloom_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(bloom.with_hashes(log(spark, sf_dir).select("key").distinct()))


def bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter for each run of the log, of the size that its keys ask for."""
    return bloom.build_each(log(spark, sf_dir), BLOOM_FPR)


def _bloom_of_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    keys = log(spark, sf_dir).select("key").distinct()
    bits, count = bloom.sizing(max(1, keys.count()), BLOOM_FPR)
    return bloom.build(keys, bits, count), bits, count


def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of all keys of the log, probed for every customer."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return _named(bloom.probe(customers, *_bloom_of_all(spark, sf_dir)))


def bloom_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter as it is stored: its header, then its bytes."""
    filter_bits, bits, count = _bloom_of_all(spark, sf_dir)
    stored = bloom.encode(bloom.as_bytes(filter_bits, bits), bits, count)
    return spark.createDataFrame([(bits, count, stored.hex())], "bits long, hashes long, stored string")


def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(1, 0.01), (100, 0.01), (500, 0.01), (1000, 0.01), (10_000, 0.01), (1_000_000, 0.001)]
    return spark.createDataFrame([(n, p, *bloom.sizing(n, p)) for n, p in cases], "n long, fpr double, bits long, hashes long")


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order the latest event of its customer up to the order's number."""
    probes = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("at"))
    found = resolve.as_of_join(probes, log(spark, sf_dir))
    return _named(found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("seq", "op")}))


def live_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = resolve.live(log(spark, sf_dir).select("key", "seq", "op", F.lit(None).cast("string").alias("value")))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_nationkey", "c_acctbal")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    per = live.join(customers, "key").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))
    return per.join(nations, "c_nationkey").select("n_name", "n", F.round("total", 2).alias("balance"))


def _product_file(spark: SparkSession, sf_dir: str) -> str:
    """A folder of product files of all parts: some have no type, so that a field is short, some a field too many."""
    import uuid

    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    price = F.concat(F.format_string("%.2f", "p_retailprice"), F.when(key % 11 == 0, ",extra").otherwise(""))
    line = F.concat_ws(",", codec.product_id(key), "p_name", F.when(key % 7 == 0, "").otherwise(F.col("p_type")), price)
    folder = f"{shared(spark)}/products-{uuid.uuid4().hex}"
    # A header in each file, as a file that is loaded has one.
    part.select(line.alias("id,name,category,price")).write.options(header=True, sep="\x01", quote="", escape="").csv(folder)
    return folder


def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.read_products(spark, _product_file(spark, sf_dir)).where("status = 'loaded'").drop("status")


def cli_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line that the shell gives for each of some commands over a store of all parts."""
    import uuid

    from palimpsest.cli import Shell

    shell = Shell(spark, f"{shared(spark)}/shell-{uuid.uuid4().hex}")
    steps = [("load", _product_file(spark, sf_dir))] + [(x.split()[0], x.partition(" ")[2]) for x in ("list", "find ECONOMY", "get P001", "del P001", "get P001", "put P001 a b 1", "last b", "compact", "snap")]
    rows = []
    for i, (command, argument) in enumerate(steps):
        line = ""
        for line in shell.run(f"{command} {argument}"):  # noqa: B007  the last one is what is looked at
            pass
        rows.append((i, command, line))
    return spark.createDataFrame(rows, "step int, command string, line string")


def product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", codec.product_id(F.col("p_partkey")).alias("id"))


def status_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-1, 9).select("id", status_name(F.col("id")).alias("name"))


def byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by unsigned bytes, a prefix before what it begins: ranks of part names cut at different lengths."""
    keys = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.substring("p_name", 1, 3), F.lit(""))).alias("s")).distinct()
    k = F.encode("s", "UTF-8")
    return keys.select("s", (k < F.encode(F.lit("m"), "UTF-8")).alias("below_m"), (k == F.encode(F.lit(""), "UTF-8")).alias("is_empty"), F.length(k).cast("long").alias("n_bytes"))


def list_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.live(log(spark, sf_dir)).agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view once more, by a streaming aggregate over the file source."""
    import uuid

    from palimpsest.streaming import ingest

    events = table(spark, sf_dir, "events")
    is_error = F.col("event_type") == "error"
    # A glob that matches this table only: the file source takes a folder or a pattern, and the table may be a single file.
    rows = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").select(
        F.col("user_id").cast("string").alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(is_error, 0).otherwise(1).alias("op"), F.when(~is_error, F.col("props")).alias("value")
    )
    folder, state = f"{shared(spark)}/stream-{uuid.uuid4().hex}", ingest.live_state(rows)
    ingest.into_folder(state, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return _named(ingest.live_rows(ingest.state_of(spark, f"{folder}/state", state.schema)))


def _store(spark: SparkSession, name: str):
    import uuid

    from palimpsest.sources.store import Store

    return Store.open(spark, f"{shared(spark)}/{name}-{uuid.uuid4().hex}")


def _parts(rows: DataFrame, n: int) -> list[DataFrame]:
    """The log in n stretches of seq."""
    last = rows.agg(F.max("seq")).collect()[0][0] or 0
    return [rows.where((F.col("seq") > last * i // n) & (F.col("seq") <= last * (i + 1) // n)) for i in range(n)]


def _as_text(log: DataFrame) -> DataFrame:
    return log.select(F.col("key").cast("string").alias("k"), "seq", F.col("value").cast("string").alias("v"))


def store_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view once more, through a store: three batches, a compaction, then a scan."""
    store = _store(spark, "store")
    for part in _parts(log(spark, sf_dir), 3):
        store.write(part, order="seq")
    store.compact()
    return _as_text(resolve.live(store.log()))


def store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store that was opened anew for each of three batches knows of its runs, and where its sequence stands."""
    from palimpsest.sources.store import Store

    store = _store(spark, "store")
    for part in _parts(log(spark, sf_dir), 3):
        store = Store.open(spark, store.path)
        store.write(part, order="seq")
    runs = [(r["n"], r["entries"], r["deletes"], r["min_seq"], r["max_seq"], store.current_seq()) for r in store.manifest().runs]
    return spark.createDataFrame(runs, "run long, entries long, deletes long, min_seq long, max_seq long, current_seq long")


def store_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view once more, of keys that two writers append at the same time, with a compaction between."""
    from concurrent.futures import ThreadPoolExecutor

    from palimpsest.schema import BusyError
    from palimpsest.sources.store import Store

    store, rows = _store(spark, "store"), log(spark, sf_dir)

    def work(odd: int) -> None:
        own = Store.open(spark, store.path)
        for part in _parts(rows.where(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(2)) == odd), 2):
            own.write(part, order="seq")

    def upkeep() -> None:
        try:
            Store.open(spark, store.path).compact()
        except BusyError:
            pass

    with ThreadPoolExecutor(3) as pool:
        for job in [pool.submit(work, 0), pool.submit(work, 1), pool.submit(upkeep)]:
            job.result()
    return _as_text(resolve.live(store.log())).drop("seq")


def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot sees that was opened between two batches, after the second one."""
    store = _store(spark, "store")
    first, second = _parts(log(spark, sf_dir), 2)
    store.write(first, order="seq")
    snapshot = store.snapshot()
    store.write(second, order="seq")
    seen = _as_text(snapshot.live())
    snapshot.release()
    return seen


def store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secondary index in a store of its own, from names to customers, of which those in debt have left it."""
    from palimpsest.sources.store import SecondaryIndex

    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("secondary"), F.col("c_custkey").cast("string").alias("primary"), "c_mktsegment", "c_acctbal")
    both = SecondaryIndex(_store(spark, "index"), _store(spark, "main"))
    both.main.put(customers.select(F.col("primary").alias("key"), F.col("c_mktsegment").alias("value")))
    both.put(customers.select("secondary", "primary"))
    both.delete(customers.where("c_acctbal < 0").select(F.col("secondary").alias("key")))
    return both.join().select(*[F.col(c).cast("string").alias(n) for c, n in (("secondary", "secondary"), ("primary", "prim"), ("value", "v"))])


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        spark.conf.set("spark.checkpoint.dir", base := "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return base


def queries() -> dict:
    return {
        "get_raw": _over_log(resolve.latest),
        "get": _over_log(lambda x: resolve.get(x, "42")),
        "live": _over_log(resolve.live),
        "tombstones": _over_log(resolve.tombstones),
        "multi_get": multi_get,
        "snapshot_5000": _over_log(lambda x: resolve.snapshot(x, 5000)),
        "snapshot_diff": _over_log(lambda x: resolve.difference(x, 3000, 7000)),
        "iter_all": _over_log(lambda x: resolve.versions(x).drop("run")),
        "version_counts": _over_log(resolve.counts),
        "flush_runs": _over_log(resolve.flush),
        "run_meta": _over_log(resolve.run_meta),
        "run_scan": _over_log(lambda x: resolve.flush(x.where("run = 3")).drop("run")),
        "compact": _over_log(lambda x: resolve.compact(resolve.flush(x))),
        "compact_stats": _over_log(lambda x: resolve.compact_stats(resolve.flush(x))),
        "logical_size": _over_log(resolve.logical_size),
        "index_get": index_get,
        "index_phantom": index_phantom,
        "index_semi": index_semi,
        "index_lookup_primary": index_lookup_primary,
        "index_delete": index_delete,
        "index_delete_removed": index_delete_removed,
        "index_multi": index_multi,
        "codec_roundtrip": codec_roundtrip,
        "find_category": find_category,
        "range_scan": _over_log(lambda x: resolve.key_range(x, "10", "12")),
        "list_count": list_count,
        "any_live": _over_log(resolve.any_live),
        "csv_load": csv_load,
        "product_ids": product_ids,
        "wal_valid_prefix": wal_valid_prefix,
        "wal_crc_prefix": wal_crc_prefix,
        "wal_bytes_prefix": wal_bytes_prefix,
        "crc32_record": crc32_record,
        "run_record": run_record,
        "run_record_decode": run_record_decode,
        "run_blocks": _over_log(resolve.run_blocks),
        "bloom_hash": bloom_hash,
        "bloom_build": bloom_build,
        "bloom_probe": bloom_probe,
        "bloom_bytes": bloom_bytes,
        "bloom_sizing": bloom_sizing,
        "as_of_join": as_of_join,
        "live_by_nation": live_by_nation,
        "status_names": status_names,
        "byte_order": byte_order,
        "stream_live": stream_live,
        "store_live": store_live,
        "store_runs": store_runs,
        "store_two_writers": store_two_writers,
        "store_snapshot": store_snapshot,
        "store_index": store_index,
        "cli_session": cli_session,
    }


def oracle_sql() -> dict[str, str]:
    from palimpsest.plans import oracles

    return oracles.SQL
