from pyspark.sql import functions as F

from palimpsest.llm import mix


def targets(sizes, weights=mix.WEIGHTS, budget=mix.BUDGET, most=mix.MOST):
    """The rule as it is stated: reshare the excess by weight until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, budget * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(w[s] for s in open_) if open_ else 0
        above = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not above:
            return full | {s: level * w[s] for s in open_}
        for s in above:
            full[s] = most * sizes[s]
            left -= full[s]


def test_targets_follow_the_rule(spark):
    cases = [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 3, None: 7}, {"é": 5, "z": 500, "Z": 1, "": 40, "b": 0}, {None: 3}, {"x": 0}]
    for sizes in cases:
        got = {r["source"]: r["target"] for r in mix.rates(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_each_source_comes_near_its_target(documents, prose):
    docs = documents(*[(i, prose(i, 20 + i % 30), "en", "hot" if i % 3 == 0 else f"s{i % 8}") for i in range(3000)])
    got = mix.with_copies(docs).groupBy("doc.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.12 * r["target"] for r in got)


def test_edge_rows(spark, documents, clashing):
    docs = documents((1, None, None, None), (2, "", "en", "a"), (3, " a b \v c", "en", "a"), (None, "x y", "en", "b"), (3, " a b \v c", "en", "a"))
    rows = mix.with_copies(docs).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 2, 2, 2]
    assert all(0 <= r["copies"] <= 2 for r in rows) and len({r["copies"] for r in rows if r["doc"]["doc_id"] == 3}) == 1
    extra = clashing(docs)
    out = mix.mix(extra)
    assert out.columns == extra.columns and {r["size"] for r in out.collect()} <= {"own size"}
    assert mix.mix(docs.limit(0)).count() == 0
    assert sorted(map(str, mix.mix(docs).collect())) == sorted(map(str, mix.mix(docs.repartition(3)).collect()))
