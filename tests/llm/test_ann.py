import numpy as np
import pytest

from palimpsest.llm import ann


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def plain(rows, k=10, every=100):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, at in usable:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((v - at) ** 2).sum())), i) for i, v in usable if i != q and len(v) == len(at))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block_rows", [100_000, 300])
def test_recall(spark, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 64))
    rows = [(i, (centres[i % 8] + 0.7 * rng.standard_normal(64)).tolist()) for i in range(2500)]
    got, want = found(ann.nearest(table(spark, rows), block_rows=block_rows)), plain(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = {(q, i): s for q in want for s, i in want[q]}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in got for s, i in got[q] if (q, i) in exact)


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = plain([(r["vec_id"], list(r["embedding"])) for r in df.collect()], every=10)
    got = found(ann.nearest(df, every=10))
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_most_of_a_block_is_verified_but_not_all_and_recall_holds():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    v, ids = np.array(t["embedding"].to_pylist(), float), np.array(t["vec_id"])
    asked = np.flatnonzero(ids % 25 == 0)
    hits = verified = 0
    for q, found, d, n in ann.search(v, ids, v[asked], ids[asked], 10):
        true = np.sqrt(((v - v[asked[q]]) ** 2).sum(1))
        true[ids == ids[asked[q]]] = np.inf
        assert (np.diff(d) >= 0).all() and len(set(found.tolist())) == 10
        hits += (d <= np.sort(true)[9] + 1e-12).sum()
        verified += n
    recall, share = hits / 10 / len(asked), verified / len(asked) / (len(v) - 1)
    # vectors without structure on a sphere, the hardest case there is for a projection
    assert recall >= 0.9 and share <= 0.7


def test_clustered_vectors_need_few_verifications():
    rng = np.random.default_rng(8)
    v = rng.standard_normal((100, 64))[np.arange(8000) % 100] + 0.1 * rng.standard_normal((8000, 64))
    found = list(ann.search(v, np.arange(8000), v[:50], np.arange(50), 10))
    assert np.mean([n for *_, n in found]) < 0.03 * 8000


def test_neighbours_come_in_order_of_projected_distance():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.standard_normal((900, 5)), np.ones((200, 5))])
    tree = ann.Tree(points)
    for at in (np.zeros(5), np.ones(5), points[3]):
        parts = list(tree.near(at))
        d, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        assert sorted(rows.tolist()) == list(range(1100)) and (np.diff(d) >= -1e-12).all()
        assert np.allclose(d, ((points[rows] - at) ** 2).sum(1))


def in_plain_order(v, ids, at, own, k=10, dims=ann.DIMS, sure=ann.SURE):
    """Distances of the k nearest when neighbours are verified singly, in order of projected distance, with a test before each."""
    plane, tree, *_ = ann.index(v, dims)
    bound, best = ann.chi_square_bound(sure, dims), []
    for far, rows in tree.near(at @ plane):
        for f, r in zip(far, rows, strict=True):
            if len(best) == k and f > 1e-9 and f >= bound * best[-1] ** 2:
                return best
            if ids[r] != own:
                best = sorted([*best, np.sqrt(((v[r] - at) ** 2).sum())])[:k]
    return best


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6])
def test_queries_together_find_what_each_finds_alone(scale):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.standard_normal((1500, 64)), rng.standard_normal((15, 64))[np.arange(1500) % 15] + 0.1 * rng.standard_normal((1500, 64))])
    v[rng.permutation(3000)[:100]] = v[0]
    # lengths that differ much, so that rounding does
    v[rng.permutation(3000)[:30]] *= 1e5
    v *= scale
    asked = np.concatenate([[0], rng.permutation(3000)[:199]])
    got = {q: (d, n) for q, _, d, n in ann.search(v, np.arange(3000), v[asked], asked, 10)}
    assert got.keys() == set(range(200))
    for q, a in enumerate(asked):
        assert (got[q][0] <= in_plain_order(v, np.arange(3000), v[a], a)).all()


@pytest.mark.parametrize("k", [1, 10, 100, 700])
def test_any_number_of_neighbours(k):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((600, 16))
    for q, found, d, _ in ann.search(v, np.arange(600), v[:9], np.arange(9), k):
        true = np.sort(np.delete(np.sqrt(((v - v[q]) ** 2).sum(1)), q))[:k]
        assert len(set(found.tolist())) == len(d) == min(k, 599) and q not in found
        assert (d <= true[-1] + 1e-12).mean() >= 0.9


def test_vectors_too_large_to_square_are_found():
    v = np.array([[1e200, 0], [1e200, 1], [-1e200, 1], [3, 4], [3, 5]])
    for q, found, d, _ in ann.search(v, np.arange(5), v, np.arange(5), 1):
        assert (q, found[0], d[0]) in {(0, 1, 1.0), (1, 0, 1.0), (3, 4, 1.0), (4, 3, 1.0)} or (q == 2 and d[0] == np.inf)


def test_a_block_takes_less_time_than_comparing_all_vectors():
    from time import process_time

    rng = np.random.default_rng(4)
    v = rng.standard_normal((8192, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    built, took = ann.index(v), []
    for run in (lambda: list(ann.search(v, np.arange(8192), v[:128], np.arange(128), 10, built=built)), lambda: [np.sort(np.sqrt(((v - x) ** 2).sum(1)))[:10] for x in v[:128]]):
        start = process_time()
        run()
        took.append(process_time() - start)
    assert took[0] < took[1]


def test_the_order_of_arrival_changes_nothing(spark):
    rng = np.random.default_rng(12)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((4000, 64)))]
    got, key = [], "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    try:
        # the queries are stored in one file, then in several
        for joined in ("true", "false"):
            spark.conf.set(key, joined)
            got.append(found(ann.nearest(table(spark, rows), every=4, sure=0.5)))
            rng.shuffle(rows)
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1]


def test_columns_may_have_any_names(spark):
    from pyspark.sql import functions as F

    df = table(spark, [(0, [1, 0]), (1, [1, 1])])
    for c in ("v", "width", "block", "is_query", "rank", "score", "query_id"):
        df = df.withColumn(c, F.lit("own"))
    assert found(ann.nearest(df)) == {0: [(1.0, 1)]}


def test_edge_rows(spark):
    rows = [(0, [1, 0]), (100, [0, 0]), (200, None), (300, []), (400, [1, None]), (500, [float("nan"), 1]), (600, [float("inf"), 1]), (1, [1, 1]), (2, [1, 1]), (3, [0, 1, 2]), (None, [1, 0]), (4, [1, 0]), (4, [1, 0]), (0, [1, 0])]
    assert found(ann.nearest(table(spark, rows))) == {0: [(0.0, 4), (0.0, 4), (1.0, 1), (1.0, 2)]}
    assert ann.nearest(table(spark, rows).limit(0)).count() == 0
    assert found(ann.nearest(table(spark, [(7, [1, 2])]))) == {}


def test_many_equal_vectors(spark):
    rows = [(i, [1, 2, 3]) for i in range(500)]
    got = found(ann.nearest(table(spark, rows)))
    assert got == {q: [(0.0, i) for i in [x for x in range(12) if x != q][:10]] for q in (0, 100, 200, 300, 400)}


@pytest.mark.parametrize("block_rows", [100_000, 900])
@pytest.mark.parametrize("copies", [150, 1000])
def test_copies_over_many_leaves_and_blocks(spark, block_rows, copies):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 64))
    vectors[[100, 200, *rng.permutation(3000)[:copies]]] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    got, want = found(ann.nearest(table(spark, rows), block_rows=block_rows)), plain(rows)
    alike = [q for q in want if want[q][-1][0] == 0]
    assert len(alike) > 1 and all(got[q] == want[q] for q in alike)


def test_chi_square():
    assert abs(ann.chi_square(ann.chi_square_bound(0.95, 8), 8) - 0.95) < 1e-9
    assert abs(ann.chi_square_bound(0.95, 2) - 5.991464547) < 1e-6
    x = np.random.default_rng(0).standard_normal((20_000, 8))
    assert abs(((x**2).sum(1) <= ann.chi_square_bound(0.9, 8)).mean() - 0.9) < 0.01
