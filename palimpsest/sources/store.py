"""A durable store: immutable sorted Parquet runs under a manifest that is committed by compare and swap.

A batch is one run. Readers see the runs a manifest names and never list the data folder, so a run of a writer that failed is
invisible and goes with vacuum(). All versions stay until a compaction, so a snapshot sees what it saw however often batches
are committed; a compaction is refused while snapshots are open. A batch is acknowledged when its manifest is there: what is
durable is the batch, not the single row.

Any number of writers may share a store. Each attempt writes a folder of its own, and a manifest appears whole or not at all, by
an atomic link (local disks) or rename (HDFS) that fails if the version is there. A writer that comes second numbers its batch
anew after the first one's and tries again; a compaction that comes second keeps the runs that came in the meantime behind its
own. Nothing has to be cleared up after a writer that died. Plain object stores have neither operation.

Files are reached through Hadoop's file systems.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import resolve
from palimpsest.schema import DELETE, LOG, PUT, BusyError, CorruptionError, InvalidArgument


@dataclass(frozen=True)
class StoreOptions:
    """max_runs: runs beyond which a batch is followed by a compaction, if no snapshot is open; 0 never compacts by itself."""

    max_runs: int = 0
    records_per_file: int = 5_000_000
    #: Distinct keys a file's Bloom filter is sized for, at most; fewer if the run has fewer rows.
    bloom_keys: int = 1_000_000
    verify_checksums: bool = True
    #: Attempts of a batch that other writers come before, at most.
    attempts: int = 50
    #: A snapshot forbids compactions for so long, unless it is renewed; an unnamed run is left to its writer for so long.
    lease_seconds: int = 3600
    grace_seconds: int = 3600


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_seq: int = 1
    next_run: int = 1
    runs: tuple[dict, ...] = field(default=())
    #: The last batch that came from each stream.
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "next_seq": self.next_seq, "next_run": self.next_run, "runs": list(self.runs), "batches": self.batches})


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.jvm, self.root = spark.sparkContext, spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.sc._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def stats(self, folder: str) -> list:
        """The statuses of a folder's entries, by name; none if it is not there."""
        p = self.path(folder)
        return sorted(self.fs.listStatus(p), key=lambda s: s.getPath().getName()) if self.fs.exists(p) else []

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.stats(folder)]

    def age(self, name: str) -> float:
        """Seconds since the newest change to a file, a folder or anything in it; 0 if it has just gone."""
        try:
            status = self.fs.getFileStatus(self.path(name))
            own = time.time() - status.getModificationTime() / 1000
            return min([own, *(self.age(f"{name}/{n}") for n in (self.names(name) if status.isDirectory() else ()))])
        except Py4JJavaError:
            return 0.0

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def publish(self, name: str, text: str) -> bool:
        """A new file, which appears whole; False if it is there already."""
        own = f"_tmp/{uuid.uuid4().hex}"
        self.write(own, text)
        self.fs.mkdirs(self.path(name).getParent())
        try:
            if self.local:
                place = lambda n: self.jvm.java.io.File(self.path(n).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(place(name), place(own))
            else:
                files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.sc._jsc.hadoopConfiguration())
                files.rename(self.path(own), self.path(name), self.sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self.delete(own)
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """Batches in, versions out. Open one with Store.open."""

    def __init__(self, spark: SparkSession, path: str, options: StoreOptions):
        self.spark, self.path, self.options, self.files = spark, path.rstrip("/"), options, _Files(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: StoreOptions | None = None) -> Store:
        store = cls(spark, path, options or StoreOptions())
        if not store.files.names("_manifest"):
            store.files.publish("_manifest/00000000.json", Manifest().text())
        return store

    # manifests

    def _versions(self) -> list[str]:
        return [n for n in self.files.names("_manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or the one of a version."""
        names = self._versions()
        name = names[-1] if version is None else f"{version:08d}.json"
        if name not in names:
            raise InvalidArgument(f"no version {version}")
        try:
            m = json.loads(self.files.read(f"_manifest/{name}"))
            return Manifest(m["version"], m["next_seq"], m["next_run"], tuple(m["runs"]), m["batches"])
        except (ValueError, KeyError) as e:
            raise CorruptionError(f"manifest {name}: {e}") from e

    def _commit(self, new: Manifest) -> bool:
        """Whether new is now the newest manifest; not if its version is there already."""
        return self.files.publish(f"_manifest/{new.version:08d}.json", new.text())

    def recover(self) -> int:
        """Removes what writers and readers that died left beside the runs: half-written files and leases that have run out; returns how many."""
        dead = [f"_tmp/{n}" for n in self.files.names("_tmp") if self.files.age(f"_tmp/{n}") > self.options.grace_seconds]
        dead += [f"_work/{n}" for n in self.files.names("_work") if self.files.age(f"_work/{n}") > self.options.grace_seconds]
        dead += [f"_leases/{n}" for n in self.files.names("_leases") if self._out(n)]
        for n in dead:
            self.files.delete(n)
        return len(dead)

    # writes

    def put(self, rows: DataFrame, order: str | None = None) -> Manifest:
        """Appends rows (key, value); within the batch later ones in the order column win."""
        return self.write(rows.withColumn("op", F.lit(PUT)), order)

    def delete(self, keys: DataFrame) -> Manifest:
        """Appends a deletion of each key, whether the store has it or not."""
        return self.write(keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit(DELETE).alias("op")))

    def write(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> Manifest:
        """Appends rows (key, value, op) as one run and commits it; an empty batch commits nothing.

        batch: the name of a stream and the number of its batch; one that the store has already is not written again.
        """
        value = F.when(F.col("op") == PUT, F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
        rows = rows.select(F.col("key").cast("binary").alias("key"), value.alias("value"), F.col("op").cast("byte").alias("op"), *([F.col(order).alias("at")] if order else []))
        work = f"_work/{uuid.uuid4().hex}"
        try:
            # Ranges of the order column, then a row's place in its file, number the batch without one task for all of it.
            (rows.repartitionByRange("at").sortWithinPartitions("at") if order else rows).write.parquet(f"{self.path}/{work}")
            placed = self.spark.read.parquet(f"{self.path}/{work}").select("*", F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("int").alias("file"), F.col("_metadata.row_index").alias("place"))
            # One row a file, which is a task's: what precedes its rows.
            files = placed.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.octet_length("key"), F.lit(0)) == 0).alias("bad")).orderBy("file").collect()
            if any(f["bad"] for f in files):
                raise InvalidArgument("a key is empty or null")
            count = sum(f["n"] for f in files)
            before = itertools.accumulate((f["n"] for f in files), initial=0)
            starts = F.broadcast(self.spark.createDataFrame([(f["file"], n) for f, n in zip(files, before)], "file int, before long"))  # noqa: B905  one more sum than files
            placed = placed.join(starts, "file").select("key", (F.col("before") + F.col("place")).alias("place"), "op", "value")
            for _ in range(self.options.attempts):
                old = self.manifest()
                if not count or (batch and old.batches.get(batch[0], -1) >= batch[1]):
                    return old
                log = placed.select("key", (F.lit(old.next_seq) + F.col("place")).cast("long").alias("seq"), "op", "value")
                meta = self._write_run(log, old.next_run, count)
                new = Manifest(old.version + 1, old.next_seq + count, old.next_run + 1, (*old.runs, meta), old.batches | ({batch[0]: batch[1]} if batch else {}))
                if self._commit(new):
                    break
                self.files.delete(f"data/attempt={meta['attempt']}")
            else:
                raise BusyError(f"other writers came first {self.options.attempts} times")
        finally:
            self.files.delete(work)
        if self.options.max_runs and len(new.runs) > self.options.max_runs and not self.snapshots():
            with contextlib.suppress(BusyError):  # somebody else compacts, or has opened a snapshot
                return self.compact()
        return new

    def _write_run(self, log: DataFrame, run: int, rows: int) -> dict:
        """Writes a run under an attempt's name of its own, which no other writer can meet."""
        own = {"n": run, "attempt": uuid.uuid4().hex}
        parts = log.repartitionByRange("key", "seq").sortWithinPartitions(F.col("key").asc(), F.col("seq").desc())
        parts.write.options(**{
            "maxRecordsPerFile": self.options.records_per_file, "parquet.bloom.filter.enabled#key": "true",
            "parquet.bloom.filter.expected.ndv#key": str(max(1, min(rows, self.options.bloom_keys))), "parquet.page.write-checksum.enabled": "true",
        }).parquet(f"{self.path}/{_place(own)}")
        m = self._read(own).agg(F.count("*").alias("entries"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.min(F.hex("key")).alias("first"), F.max(F.hex("key")).alias("last"), F.count_if(F.col("op") == DELETE).alias("deletes")).collect()[0]
        return own | {"entries": m["entries"], "deletes": m["deletes"], "min_seq": m["low"], "max_seq": m["high"], "min_key": m["first"], "max_key": m["last"]}

    # reads

    def _read(self, *runs: dict) -> DataFrame:
        """Runs as one scan, with the run's number from its folder's name."""
        reader = self.spark.read.schema(T.StructType([*LOG, T.StructField("attempt", T.StringType(), False), T.StructField("run", T.LongType(), False)])).option("basePath", f"{self.path}/data")
        reader = reader.option("parquet.page.verify-checksum.enabled", str(self.options.verify_checksums).lower()).option("ignoreCorruptFiles", "false")
        return reader.parquet(*[f"{self.path}/{_place(r)}" for r in runs]).drop("attempt")

    def log(self, manifest: Manifest | None = None, up_to: int | None = None, key: bytes | None = None) -> DataFrame:
        """Every version, with its run; runs that begin after up_to or can't hold key are not read."""
        m = manifest or self.manifest()
        wanted = [r for r in m.runs if (up_to is None or r["min_seq"] <= up_to) and (key is None or r["min_key"] <= key.hex().upper() <= r["max_key"])]
        out = self._read(*wanted) if wanted else self.spark.createDataFrame([], T.StructType([*LOG, T.StructField("run", T.LongType(), False)]))
        if key is not None:
            out = out.where(F.col("key") == F.lit(key))
        return out if up_to is None else resolve.as_of(out, up_to)

    def get(self, key: bytes) -> bytes | None:
        """The live value of a key, or None."""
        if not key:
            raise InvalidArgument("the key is empty")
        rows = resolve.live(self.log(key=key)).collect()
        return bytes(rows[0]["value"]) if rows else None

    def get_many(self, keys: DataFrame) -> DataFrame:
        return resolve.get_many(self.log(), keys)

    def scan(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Live rows in key order."""
        return resolve.key_range(self.log(), low, high)

    def current_seq(self) -> int:
        return self.manifest().next_seq - 1

    def run_count(self) -> int:
        return len(self.manifest().runs)

    # snapshots and upkeep

    def snapshot(self) -> Snapshot:
        """A view of the store as it is, and a lease that forbids compactions until it is released or runs out."""
        lease = uuid.uuid4().hex
        self._lease(lease)
        # The manifest comes after the lease, so that no vacuum that overlooked the lease can take its runs.
        return Snapshot(self, self.manifest(), lease)

    def _lease(self, name: str) -> None:
        self.files.write(f"_leases/{name}", str(time.time() + self.options.lease_seconds))

    def _out(self, lease: str) -> bool:
        try:
            return float(self.files.read(f"_leases/{lease}") or "inf") < time.time()
        except Py4JJavaError:  # released in the meantime
            return True

    def snapshots(self) -> list[str]:
        """Leases that have not run out."""
        return [n for n in self.files.names("_leases") if not self._out(n)]

    def compact(self) -> Manifest:
        """Merges all runs into one without deletions and old versions; nothing to do below two runs.

        Runs that other writers commit meanwhile stay behind it. It takes the number of the newest run that it holds.
        """
        if self.snapshots():
            raise BusyError("snapshots are open")
        old = self.manifest()
        if len(old.runs) < 2:
            return old
        merged = resolve.compact(self.log(old)).select("key", "seq", F.lit(PUT).cast("byte").alias("op"), "value")
        meta = self._write_run(merged, old.runs[-1]["n"], sum(r["entries"] for r in old.runs))
        for _ in range(self.options.attempts):
            now = self.manifest()
            if now.runs[: len(old.runs)] != old.runs:
                break
            later = now.runs[len(old.runs) :]
            new = Manifest(now.version + 1, now.next_seq, now.next_run, ((meta,) if meta["entries"] else ()) + later, now.batches)
            if self._commit(new):
                return new
        self.files.delete(f"data/attempt={meta['attempt']}")
        raise BusyError("another compaction came first")

    def vacuum(self) -> list[str]:
        """Removes the runs that the newest manifest doesn't name; returns their folders. Not while snapshots are open.

        Runs that an older manifest names go at once; others may be those of writers at work, and go when they are old enough.
        """
        newest = self.manifest()
        if self.snapshots():
            raise BusyError("snapshots are open")
        named = {r["attempt"] for r in newest.runs}
        there = {n.partition("=")[2] for n in self.files.names("data") if n.startswith("attempt=")} - named
        past = {r["attempt"] for n in self._versions() if int(n[:8]) < newest.version for r in self.manifest(int(n[:8])).runs} if there else set()
        gone = sorted(x for x in there if x in past or self.files.age(f"data/attempt={x}") > self.options.grace_seconds)
        for x in gone:
            self.files.delete(f"data/attempt={x}")
        return [f"attempt={x}" for x in gone]


def _place(run: dict) -> str:
    return f"data/attempt={run['attempt']}/run={run['n']:06d}"


class Snapshot:
    """The store as of one manifest. Also a context manager."""

    def __init__(self, store: Store, manifest: Manifest, lease: str):
        self.store, self.manifest, self.lease, self.seq = store, manifest, lease, manifest.next_seq - 1

    def log(self) -> DataFrame:
        return self.store.log(self.manifest, self.seq)

    def live(self) -> DataFrame:
        return resolve.live(self.log())

    def get(self, key: bytes) -> bytes | None:
        rows = resolve.live(self.store.log(self.manifest, self.seq, key)).collect()
        return bytes(rows[0]["value"]) if rows else None

    def renew(self) -> None:
        """Makes the lease last as long again."""
        self.store._lease(self.lease)

    def release(self) -> None:
        self.store.files.delete(f"_leases/{self.lease}")

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class SecondaryIndex:
    """A store of secondary -> primary keys beside a main store."""

    def __init__(self, index: Store, main: Store):
        self.index, self.main = index, main

    def put(self, rows: DataFrame) -> Manifest:
        """rows (secondary, primary)."""
        return self.index.put(rows.select(F.col("secondary").alias("key"), F.col("primary").alias("value")))

    def delete(self, secondary: DataFrame) -> Manifest:
        """rows (key); the main store is not touched."""
        return self.index.delete(secondary)

    def lookup_primary(self, secondary: bytes) -> bytes | None:
        return self.index.get(secondary)

    def get(self, secondary: bytes) -> bytes | None:
        """The main value that a secondary key leads to; None without an entry, or if it leads nowhere."""
        primary = self.index.get(secondary)
        return None if primary is None else self.main.get(primary)

    def join(self) -> DataFrame:
        """secondary, primary, value of all entries that lead somewhere."""
        entries = resolve.live(self.index.log()).select(F.col("key").alias("secondary"), F.col("value").alias("primary"))
        return entries.join(resolve.live(self.main.log()).select(F.col("key").alias("primary"), "value"), "primary")
