"""Mixing sources to target weights, with DataFrame functions only.

Sources in code point order, null last, take the weights in turn. The budget is a share of all sizes; a target stops at
`most` times its source's size and the excess goes to the others by weight (water filling). A document of a source with
rate r = target / size is emitted floor(r) times, and once more if a hash of its id falls below the fraction of r.

Null texts have size 0; null sources form one source; a source of size 0 has target and rate 0, so its documents are not
taken. Rows that repeat a doc_id are drawn alike; a null doc_id is drawn by its text. Sources with equal ratios of cap and weight
are taken in the order of their names. A very long text is counted whole, as others are. An empty table gives an empty mix. Other
columns pass through as fields of `doc`, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import small_side, stored, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
SEED = "mix-1"


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed only."""
    key = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """sizes (source, size) -> one row a source: source, source_size, target, rate.

    A source is full if its cap / weight is at most the level that its equals and the larger ones could get; as the level
    falls with each full source, the full ones are a prefix in the order of cap / weight.
    """
    # One row a source from here on: the windows without a key see as many rows as there are sources.
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "share": F.sum("source_size").over(everything) * F.lit(budget),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)),
    })
    per = per.withColumn("level", (F.col("share") - F.col("spent")) / F.col("left_w"))
    per = per.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")).alias("at"))).over(everything)
    per = per.withColumn("final", final["level"])
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w"))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def with_copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc (the row of docs, whatever its columns are called), size, source_size, target and copies: how often it is taken."""
    sized = docs.select(F.struct("*").alias("doc"), word_count(F.col("text")).alias("size"))
    per = stored(rates(sized.select(F.col("doc.source").alias("source"), "size"), weights, budget, most), "mix-rates")
    out = sized.join(small_side(per), F.col("doc.source").eqNullSafe(F.col("source")), "left")
    extra = (draw(F.col("doc.doc_id"), F.col("doc.text"), seed) < F.col("rate") - F.floor("rate")).cast("int")
    return out.select("doc", "size", "source_size", "target", (F.floor("rate") + extra).cast("int").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as in docs."""
    out = with_copies(docs, **how).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("doc.*")
