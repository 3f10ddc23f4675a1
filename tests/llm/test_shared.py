import pytest
from pyspark.sql import functions as F

from palimpsest.llm import shared


def test_stored_tables_are_in_the_shared_folder_and_cut_the_lineage(spark):
    df = shared.stored(spark.range(10).withColumn("x", F.lit("é")), "test")
    where = spark.conf.get("spark.checkpoint.dir")
    assert all(f.startswith(where) for f in df.inputFiles()) and df.count() == 10
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_only_counted_sides_are_hinted(spark):
    df = shared.stored(spark.range(100), "test")
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(shared.small_side(df, 4000)) and "broadcast" not in plan(shared.small_side(df, 3999))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with shared.scratch() as keep:
        with shared.scratch() as inner:
            a, b = shared.stored(spark.range(3), "a"), inner(shared.stored(spark.range(4), "b"))
        c = keep(shared.stored(b.where("id > 0"), "c"))
    assert c.count() == shared.rows_of(c) == 3 and shared.rows_of(spark.range(7)) == 7
    for gone in (a, b):
        with pytest.raises(Exception):  # noqa: B017  what Spark raises for files that are not there
            gone.collect()


def test_words(spark):
    texts = [None, "", " \t\n\v\f\r", "a", "a b\tc\nd", "a b   c", "é ü"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", shared.word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in sorted(got)] == [0, 0, 0, 1, 4, 3, 2]


def test_a_worker_keeps_one_operators_object():
    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [shared.held(("a",), make(1)), shared.held(("a",), make(2)), shared.held(("b",), make(3)), shared.held(("a",), make(4))] == [1, 1, 3, 4]
    assert list(shared.lean(iter, keeps=True)([5])) == [5] and shared.held(("a",), make(6)) == 4
    assert list(shared.lean(iter)([5])) == [5] and shared.held(("a",), make(7)) == 7
    shared.begin(False)
