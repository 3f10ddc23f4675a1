"""URL filter: a character language-model ratio behind a list of host rules, with DataFrame functions only.

Rules judge the urls they fit. Those urls are the accepted and rejected corpora of two Markov models over characters, whose
orders 0 to 3 are smoothed into each other: p(c | context) = (n(context c) + K p(c | shorter context)) / (n(context) + K).
A url without a rule is blocked if its mean log-likelihood difference, rejected less accepted, reaches a threshold. The
threshold is calibrated on a fifth of the judged urls that the models don't see: it has the largest difference between the
shares of rejected and of accepted urls that reach it; of equals the lowest.

Scores are whole micronats, so sums don't depend on their order. Characters are put into 32 classes, so a model is a table
of 32^4 integers at most, whatever the input: it reaches the rows as one scalar subquery of that fixed size.

Null urls, and those without "://", have an empty host and path, so no rule fits. A null or empty url has score null and is
allowed, as is every url while either corpus, or its calibration part, is empty. Of rules that fit, the longest by host and path
together wins, and of equally long ones the last in the order of their texts. Rows that repeat a page_id, or have none, are judged
each for itself; urls that repeat count as often in the corpora. A very long url is one array of its characters' numbers in one
task. An empty table gives an empty one. Of other columns than page_id and url none is read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import stored

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Class i + 1 is the i-th; all other characters, and what is before the url, are class 0.
CLASSES = "abcdefghijklmnopqrstuvwxyz0/.-:"
A = 32
K = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits the columns host and path, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the later wins
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(url: Column) -> Column:
    """For each character of the url, the classes of it and of the three before it as one number below 32^4."""
    plain = F.translate(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "123456789", "0" * 9)
    classes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(CLASSES), c))
    # Bound to a variable by way of an array of one: named in the inner function as it is, it would be worked out for each character.
    bound = lambda cs: F.transform(cs, lambda c, i: ((_at(cs, i - 3) * A + _at(cs, i - 2)) * A + _at(cs, i - 1)) * A + c)
    return F.flatten(F.transform(F.array(classes), bound))


def _at(values: Column, i: Column) -> Column:
    return F.when(i >= 0, F.get(values, i)).otherwise(F.lit(0))


def ratios(counts: DataFrame) -> DataFrame:
    """counts (code, a, r: occurrences in accepted and rejected urls) -> code, micro: the log ratio of its last character.

    counts has a row for each gram that occurs in any url, so at most 32^4; so do all windows here together.
    """
    logs = []
    for n in ("a", "r"):
        p = F.lit(1.0 / A)
        total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
        for order in range(4):
            ends = F.col("code") % A ** (order + 1)
            seen = F.sum(n).over(Window.partitionBy(ends))
            context = F.sum(n).over(Window.partitionBy(F.floor(ends / A))) if order else total
            p = (seen + F.lit(K) * p) / (context + F.lit(K))
        logs.append(F.log(p))
    return counts.select("code", F.floor((logs[1] - logs[0]) * F.lit(1e6) + F.lit(0.5)).cast("int").alias("micro"))


def as_array(micros: DataFrame) -> DataFrame:
    """One row with one array of 32^4 integers: entry code + 1 is that code's."""
    every = micros.sparkSession.range(A**4).join(micros, F.col("id") == F.col("code"), "left")
    sorted_values = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    parts = every.withColumn("filled", F.coalesce("micro", F.lit(0))).groupBy(F.floor(F.col("id") / 1024).alias("part"))
    parts = parts.agg(sorted_values("id", "filled").alias("values"))
    return parts.agg(F.flatten(sorted_values("part", "values")).alias("table"))


def threshold(scores: DataFrame) -> DataFrame:
    """scores (label -1 or 1, score) -> one row with at: the score from which urls are blocked; null without both labels."""
    # A histogram by millinats: its rows are bounded by the largest ratio, not by the input.
    bins = scores.groupBy(F.floor(F.col("score") / 1000).alias("bin")).agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("label") == -1, 1).otherwise(0)).alias("a"))
    reach, everything = Window.orderBy(F.col("bin").desc()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gain = F.sum("r").over(reach) * F.sum("a").over(everything) - F.sum("a").over(reach) * F.sum("r").over(everything)
    both = (F.sum("r").over(everything) > 0) & (F.sum("a").over(everything) > 0)
    return bins.select(F.when(both, gain).alias("gain"), "bin").agg((F.max_by("bin", F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("bin")))) * 1000).alias("at"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict, score (mean micronats, null without characters)."""
    url = F.col("url")
    seen = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path")).withColumn("fit", fitting(rules))
    label = F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit.verdict") == "allow", -1).otherwise(0)
    held = F.conv(F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % 5 == 0
    seen = seen.select("page_id", "url", "host", "path", "fit", label.alias("label"), held.alias("held"))
    each = seen.select("label", "held", F.explode(grams(url)).alias("code"))
    of = lambda side: F.sum(F.when((F.col("label") == side) & ~F.col("held"), 1).otherwise(0))
    counts = stored(each.groupBy("code").agg(of(-1).alias("a"), of(1).alias("r")), "url-grams")
    table = stored(as_array(ratios(counts)), "url-model")
    scored = seen.withColumn("codes", grams(url)).withColumn("table", table.scalar())
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + F.get("table", c))
    scored = scored.withColumn("score", F.when(F.size("codes") > 0, F.floor(total / F.size("codes")))).drop("codes", "table")
    at = threshold(scored.where((F.col("label") != 0) & F.col("held")).select("label", "score"))
    by_model = F.when(F.col("score") >= F.col("at"), "block").otherwise("allow")
    scored = scored.withColumn("at", at.scalar())
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_model).alias("verdict"), "score")
