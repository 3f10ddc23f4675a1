"""Version resolution over a change log: latest, as of, live, iteration, flush and compaction.

A log is a DataFrame of key, seq, op (1 put, 0 delete), value and, where runs matter, run. Key and value may be of any type
with an order; seq is unique. Predicates on op or value never go below the choice of the latest version: they are written on
the aggregate's output, through which Catalyst only moves predicates on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.schema import DELETE, PUT


#: Types of which an aggregate buffer can be updated in place, so that Spark aggregates by hash.
_FIXED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def latest(log: DataFrame, by: Sequence[str] = ("key",), order: Sequence[str] = ("seq",), kept: Sequence[str] = ("seq", "op", "value")) -> DataFrame:
    """The row with the largest order of each group, deletions included: a partial and a final aggregate, no window.

    Columns of fixed width are aggregated one by one, which Spark does by hash. Others go through one struct, which it does by
    a sort within each partition; either way only a row a key and partition is shuffled.
    """
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    if len(order) == 1 and all(isinstance(log.schema[c].dataType, _FIXED) for c in kept):
        return log.groupBy(*by).agg(*[F.max_by(c, at).alias(c) for c in kept])
    return log.groupBy(*by).agg(F.max_by(F.struct(*kept), at).alias("top")).select(*by, *[F.col(f"top.{c}").alias(c) for c in kept])


def live(log: DataFrame) -> DataFrame:
    """key, seq, value of the keys whose latest version is a put."""
    return latest(log).where(F.col("op") == PUT).drop("op")


def tombstones(log: DataFrame) -> DataFrame:
    """key, seq of the keys whose latest version is a deletion."""
    return latest(log, kept=("seq", "op")).where(F.col("op") == DELETE).drop("op")


def as_of(log: DataFrame, seq: int | Column) -> DataFrame:
    """The part of the log that a snapshot at seq sees; seq is compared at the scan."""
    return log.where(F.col("seq") <= seq)


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    return live(as_of(log, seq))


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key) -> key, status, value: NOT_FOUND for absent and for deleted keys."""
    wanted = keys.select("key").distinct()
    found = live(log.join(wanted, "key", "left_semi"))
    return keys.select("key").join(found, "key", "left").select("key", F.when(F.col("seq").isNull(), "NOT_FOUND").otherwise("OK").alias("status"), "value")


def get(log: DataFrame, key) -> DataFrame:
    """The live row of one key; the key predicate reaches the scan."""
    return live(log.where(F.col("key") == F.lit(key)))


def get_raw(log: DataFrame, key) -> DataFrame:
    """The latest row of one key, deletion or not, which tells absent from deleted."""
    return latest(log.where(F.col("key") == F.lit(key)))


def key_range(log: DataFrame, low=None, high=None) -> DataFrame:
    """Live rows with low <= key < high, ordered."""
    if low is not None:
        log = log.where(F.col("key") >= F.lit(low))
    if high is not None:
        log = log.where(F.col("key") < F.lit(high))
    return live(log).orderBy("key")


#: Sequence numbers in a stretch. As they are unique, no task of a window by key and stretch gets more versions, however hot a key is.
STRETCH = 1_000_000


def versions(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Every version with its rank within its key, newest first: the rank within a stretch, after the newer stretches' counts."""
    rows = log.withColumn("stretch", F.floor(F.col("seq") / stretch))
    newer = F.sum("n").over(Window.partitionBy("key").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1))
    before = rows.groupBy("key", "stretch").agg(F.count("*").alias("n")).select("key", "stretch", F.coalesce(newer, F.lit(0)).alias("newer"))
    rank = F.row_number().over(Window.partitionBy("key", "stretch").orderBy(F.col("seq").desc()))
    ranked = rows.withColumn("version", rank).join(before, ["key", "stretch"])
    return ranked.select(*log.columns, (F.col("version") + F.col("newer")).cast("int").alias("version"))


def ordered(log: DataFrame) -> DataFrame:
    """Every version by key, newest first within a key."""
    return log.orderBy(F.col("key").asc(), F.col("seq").desc())


def counts(log: DataFrame) -> DataFrame:
    """Versions and deletions of each key."""
    return log.groupBy("key").agg(F.count("*").alias("versions"), F.count_if(F.col("op") == DELETE).alias("deletes"))


def difference(log: DataFrame, old: int, new: int) -> DataFrame:
    """key, change (added, removed, changed), old and new value between two snapshots, from one pass over the log.

    Both versions come from one aggregate, so the log is read and shuffled once instead of joined with itself.
    """
    top = lambda s: F.max_by(F.when(F.col("seq") <= s, F.struct("seq", "op", "value")), F.when(F.col("seq") <= s, F.col("seq")))
    both = as_of(log, max(old, new)).groupBy("key").agg(top(old).alias("o"), top(new).alias("n"))
    had, has = F.coalesce(F.col("o.op") == PUT, F.lit(False)), F.coalesce(F.col("n.op") == PUT, F.lit(False))
    change = F.when(~had & has, "added").when(had & ~has, "removed").when(had & has & ~F.col("o.value").eqNullSafe(F.col("n.value")), "changed")
    out = both.select("key", change.alias("change"), F.when(had, F.col("o.value")).alias("old_value"), F.when(has, F.col("n.value")).alias("new_value"))
    return out.where(F.col("change").isNotNull())


def flush(log: DataFrame) -> DataFrame:
    """run, key, seq, op, value: the latest version of each key within its run, deletions kept."""
    return latest(log, by=("run", "key"))


def run_meta(log: DataFrame) -> DataFrame:
    """What a run's index and footer know: bounds of its keys and of seq, its keys and its deletions."""
    return flush(log).groupBy("run").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"),
        F.count_if(F.col("op") == DELETE).alias("deletes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def run_blocks(runs: DataFrame, size: int = 4096, used: int = 8, header: int = 17) -> DataFrame:
    """run, blocks: how many blocks of `size` bytes, `used` of them for itself, a flushed run's records fill in the order of their keys.

    A record never crosses blocks. A run is as large as a writer lets a batch become, so its sizes fit into one array.
    """
    bytes_of = header + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    room, wide = size - used, 1 << 20
    # Blocks and the bytes taken of the last one are one number.
    step = lambda s, r: F.when(s % wide + r["n"] > room, (F.floor(s / wide) + 1) * wide + r["n"]).otherwise(s + r["n"])
    of = flush(runs).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("key", bytes_of.cast("long").alias("n")))).alias("records"))
    return of.select("run", F.floor(F.aggregate("records", F.lit(wide).cast("long"), step) / wide).alias("blocks"))


def any_live(log: DataFrame) -> DataFrame:
    """One row, any_live: whether a key is live."""
    return live(log).agg((F.count("*") > 0).alias("any_live"))


def compact(runs: DataFrame) -> DataFrame:
    """key, seq, value after merging runs: the newest run wins, then deletions go."""
    return latest(runs, order=("run", "seq")).where(F.col("op") == PUT).drop("op")


def compact_stats(runs: DataFrame) -> DataFrame:
    """rows_in, keys, rows_out of a compaction."""
    top = runs.groupBy("key").agg(F.count("*").alias("n"), F.max_by("op", F.struct("run", "seq")).alias("op"))
    return top.agg(F.sum("n").alias("rows_in"), F.count("*").alias("keys"), F.count_if(F.col("op") == PUT).alias("rows_out"))


def as_of_join(probes: DataFrame, log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """probes (key, at) -> key, at, seq, op, value: for each probe the latest version with seq <= at, null if there is none.

    Probes and log meet in a sorted window by key and stretch, so a key's probes and versions never multiply; a probe before
    all versions of its stretch takes the newest one of the key's earlier stretches, of which each gives one row.
    """
    place = lambda at: F.floor(F.col(at) / stretch).alias("stretch")
    a = log.select("key", place("seq"), F.col("seq").alias("at"), F.lit(0).alias("probe"), F.struct("seq", "op", "value").alias("hit"))
    b = probes.select("key", place("at"), "at", F.lit(1).alias("probe"), F.lit(None).cast(a.schema["hit"].dataType).alias("hit"))
    seen = Window.partitionBy("key", "stretch").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn("hit", F.last("hit", ignorenulls=True).over(seen)).where("probe = 1")
    earlier = F.last("top", ignorenulls=True).over(Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    tops = a.unionByName(b).groupBy("key", "stretch").agg(F.max_by("hit", F.when(F.col("probe") == 0, F.col("at"))).alias("top"))
    tops = tops.select("key", "stretch", earlier.alias("earlier")).where("earlier IS NOT NULL")
    found = found.join(tops, ["key", "stretch"], "left").withColumn("hit", F.coalesce("hit", "earlier"))
    return found.select("key", "at", "hit.seq", "hit.op", "hit.value")


def logical_size(log: DataFrame) -> DataFrame:
    """entries and bytes of a log: keys and values with a header of 17 bytes each."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 17
    return log.agg(F.count("*").alias("entries"), F.sum(size.cast("long")).alias("bytes"))
