"""Secondary indexes: a second log from secondary to primary key, the last writer wins, then a lookup join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.resolve import live
from palimpsest.schema import DELETE, PUT


def entries(rows: DataFrame, secondary: str, primary: str, order: str, deleted: str | None = None) -> DataFrame:
    """An index log of rows: key is the secondary key, value the primary one; rows where `deleted` holds remove the entry."""
    op = F.when(F.expr(deleted), F.lit(DELETE)).otherwise(F.lit(PUT)) if deleted else F.lit(PUT)
    value = F.when(op == PUT, F.col(primary)) if deleted else F.col(primary)
    return rows.select(F.col(secondary).alias("key"), F.col(order).alias("seq"), op.alias("op"), value.alias("value"))


def multi_entries(rows: DataFrame, secondary: str, primary: str, order: str) -> DataFrame:
    """An index log with an entry for each pair of secondary and primary key, so a secondary key may lead to many."""
    return rows.select(F.struct(F.col(secondary).alias("secondary"), F.col(primary).alias("primary")).alias("key"), F.col(order).alias("seq"), F.lit(PUT).alias("op"), F.col(primary).alias("value"))


def lookup_primary(index: DataFrame) -> DataFrame:
    """secondary, primary: what the index holds, without a look at the main table."""
    return live(index).select(F.col("key").alias("secondary"), F.col("value").alias("primary"))


def lookup(index: DataFrame, main: DataFrame, key: str) -> DataFrame:
    """The main rows that the index leads to; entries that lead nowhere give none."""
    return lookup_primary(index).join(main, F.col("primary") == F.col(key))


def phantoms(index: DataFrame, main: DataFrame, key: str) -> DataFrame:
    """Entries whose primary key is not in the main table."""
    return lookup_primary(index).join(main, F.col("primary") == F.col(key), "left_anti")


def resolvable(index: DataFrame, main: DataFrame, key: str) -> DataFrame:
    """Entries whose primary key is in the main table."""
    return lookup_primary(index).join(main, F.col("primary") == F.col(key), "left_semi")


def delete(index: DataFrame, removed: DataFrame) -> DataFrame:
    """Index rows to append as removed (secondary, primary, seq) leave the main table: only entries that lead to them go."""
    return removed.join(lookup_primary(index), ["secondary", "primary"]).select(F.col("secondary").alias("key"), "seq", F.lit(DELETE).alias("op"), F.lit(None).cast(index.schema["value"].dataType).alias("value"))
