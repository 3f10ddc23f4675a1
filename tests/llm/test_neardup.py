import random
import re

import pytest

from palimpsest.llm import neardup
from palimpsest.llm.components import components


def plain(rows, n, percent):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        component = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None) if sets[i] else d
        out.append((d, len(sets[i]), component, d == component))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=str)


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "".join(rng.choice("qrstuv") for _ in range(5))
    return " ".join(words)


@pytest.mark.parametrize("n", [2, 5])
def test_against_all_pairs(documents, prose, clashing, n):
    rng = random.Random(n)
    rows = [(i, prose(i, 80)) for i in range(25)]
    rows += [(100 + i, edited(prose(i % 6, 80), rng, i % 8)) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "ONE two"), (206, "É x"), (207, "é x"), (3, rows[3][1]), (8, rows[3][1]), (210, rows[4][1].upper())]
    rows += [(220, " ".join(f"w{i}" for i in range(60_000))), (221, " ".join(f"w{i}" for i in range(60_001)))]
    rng.shuffle(rows)
    assert found(neardup.near_duplicates(clashing(documents(*rows)), n)) == plain(rows, n, 80)


def test_large_buckets_of_several_components(documents, prose, monkeypatch):
    # Near copies around the threshold share buckets without being one component, and buckets and blocks are small.
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(9)
    base = prose(5, 120)
    rows = [(i, edited(base, rng, rng.randrange(2, 16))) for i in range(120)]
    want = plain(rows, 2, 80)
    assert len({r[2] for r in want}) > 5
    assert found(neardup.near_duplicates(documents(*rows), 2, small=3)) == want


def test_a_common_passage_links_nothing(documents, prose):
    rows = [(i, f"{prose(50 + i, 30)} {prose(1, 40)}") for i in range(60)]
    assert all(r[3] for r in found(neardup.near_duplicates(documents(*rows), 2)))


def test_null_ids_and_empty_tables(documents, prose):
    docs = documents((None, prose(1)), (None, prose(1)), (5, prose(2)), (None, ""))
    assert found(neardup.near_duplicates(docs)) == sorted([(None, 56, None, True)] * 2 + [(5, 56, 5, True), (None, 0, None, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    rng = random.Random(1)
    rows = [(None if i % 3 else i, edited(prose(i % 5, 60), rng, i % 4)) for i in range(40)] + [(None, edited(prose(77, 60), rng, 2)) for _ in range(4)]
    want = plain(rows, 5, 80)
    assert len({r[2] for r in want}) > 4 and found(neardup.near_duplicates(documents(*rows))) == want
    kept = neardup.deduplicated(documents((2, prose(1)), (1, prose(1)), (3, prose(2)), (4, None)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and kept.columns == docs.columns


def test_one_row_of_each_component_stays_where_ids_repeat_or_are_null(documents, prose, clashing):
    a, b, c, d, e = (prose(i) for i in range(10, 15))
    rows = [(3, b), (5, b), (5, a), (9, a), (5, c), (5, c.upper()), (None, b), (None, d), (None, d), (7, ""), (7, e), (7, f"{e} more"), (None, ""), (8, None), (8, None)]
    docs = clashing(documents(*rows))
    kept = neardup.deduplicated(docs)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    sevens = [x for x in got if x[0] == 7 and x[1]]
    assert len(sevens) == 1 and sevens[0] in rows
    assert sorted([x for x in got if x not in sevens], key=str) == sorted([(3, b), (5, a), (5, c.upper()), (None, d), (7, ""), (None, ""), (8, None), (8, None)], key=str)
    assert kept.dtypes == docs.dtypes and {r["kept"] for r in kept.collect()} == {"own kept"}


def test_sketches_estimate_the_similarity(prose):
    rng = random.Random(2)
    for edits in (0, 1, 3, 6, 30):
        a, b = prose(3, 200), edited(prose(3, 200), rng, edits)
        apart = int(sum(int(x).bit_count() for x in neardup.odd_sketch(neardup.minhash(neardup.shingles(a, 2))) ^ neardup.odd_sketch(neardup.minhash(neardup.shingles(b, 2)))))
        if neardup.similarity(a, b, 2) >= 0.8:
            assert apart <= neardup.furthest()
        if neardup.similarity(a, b, 2) < 0.5:
            assert apart > neardup.furthest()


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
