"""Structured Streaming into a change log: live state by key, and runs of a store by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.operators.resolve import latest
from palimpsest.schema import PUT
from palimpsest.sources.store import Store


def live_state(log: DataFrame) -> DataFrame:
    """The latest version of each key of a streaming log. Late rows do no harm, as the largest seq wins in any order.

    The state holds one row a key. Deletions stay in it, as an older put may still come.
    """
    top = F.max_by(F.struct("op", "value"), "seq").alias("top")
    return log.groupBy("key").agg(F.max("seq").alias("seq"), top).select("key", "seq", F.col("top.op").alias("op"), F.col("top.value").alias("value"))


def live_rows(state: DataFrame) -> DataFrame:
    return state.where(F.col("op") == PUT).drop("op")


def into_store(log: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Appends what a streaming log (key, value, op, at) has now to a store, a run for each micro-batch, exactly once.

    The manifest that commits a batch also holds its number, by the checkpoint's name. A micro-batch that is run again after a
    failure, in whatever order with other writers' batches, is found there and not written again.
    """
    write: Callable[[DataFrame, int], None] = lambda batch, number: store.write(batch, order="at", batch=(checkpoint, number))
    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_folder(state: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows of a state that each micro-batch has changed to a folder of its own; state_of() reads them back.

    A micro-batch that is run again replaces its folder. Nothing but the query's progress reaches the driver.
    """
    write: Callable[[DataFrame, int], None] = lambda changed, number: changed.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return state.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_of(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The newest state of each key in a folder of into_folder()."""
    return latest(spark.read.schema(schema).parquet(f"{folder}/batch=*"))
