import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import substr


def plain(rows, n):
    """(n_words, n_removed, kept) of rows (doc_id, text), by comparing windows as they are."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - n + 1) if i is not None else ():
            k = tuple(w[j : j + n])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j + d for j in range(len(w) - n + 1) if i is not None and first[tuple(w[j : j + n])] < i for d in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def check(documents, rows, n, change=lambda df: df):
    got = substr.dedup(change(documents(*rows)), n).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == plain(rows, n)


def test_against_plain_windows(documents, prose, clashing):
    rng = random.Random(1)
    passage = prose(99, 30)
    rows = [(i, prose(i % 40, 50)) for i in range(60)]
    rows += [(100 + i, f"{prose(1000 + i, 20)} {passage} {prose(2000 + i, 15)}") for i in range(90)]
    rows += [(300 + i, " ".join(rng.choice("ab") for _ in range(40))) for i in range(15)]
    rows += [(400, None), (401, ""), (402, passage), (402, passage), (402, "other " + passage), (None, passage), (50, passage), (403, "z " * 300), (404, "z " * 200), (405, passage.replace(" ", " "))]
    rng.shuffle(rows)
    check(documents, rows, 13)
    check(documents, rows, 5, clashing)


def test_often_repeated_windows_and_small_groups(documents, prose, monkeypatch):
    # OFTEN is met by few pieces here, so all repeated windows take the path of partial aggregates.
    monkeypatch.setattr(substr, "OFTEN", 1)
    monkeypatch.setattr(substr, "GROUP_CHARS", 500)
    rows = [(i, f"{prose(i, 12)} {prose(7, 25)} {prose(-i, 5)}") for i in range(30)]
    check(documents, rows, 13)


@pytest.mark.parametrize("broadcast", [32_000_000, 0])
def test_many_slices_and_groups_are_dealt_by_digits(spark, documents, prose, monkeypatch, broadcast):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    # Five slices or more and as many groups by threes: two or three dealings each way; often repeated windows in parts.
    for name, value in {"FAN": 3, "SLICE_WINDOWS": 60, "GROUP_CHARS": 400, "HELD": 50, "OFTEN": 4, "BROADCAST_BYTES": broadcast, "PARTS": 2, "PART_ROWS": 3}.items():
        monkeypatch.setattr(substr, name, value)
    assert substr.widths(1) == [1] and substr.widths(3) == [1] and substr.widths(4) == [3, 1] and substr.widths(10) == [9, 3, 1]
    rows = [(i, f"{prose(i, 12)} {prose(7, 25)} {prose(-i, 5)}") for i in range(20)] + [(50 + i, prose(i, 40)) for i in range(9)] + [(80 + i, prose(3, 40)) for i in range(9)]
    check(documents, rows + [(81, prose(3, 40))] * 3 + [(None, prose(3, 40)), (90, None)], 13)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_go_through_the_sketch(documents, prose):
    rows = [(i, prose(i // 30, 40)) for i in range(120)] + [(7, prose(9, 40))] * 5
    check(documents, rows, 13)


def test_columns_may_have_any_names(documents, prose):
    names = ("grp", "tk", "h1", "h2", "first", "runs", "row", "part", "listed", "more", "starts", "places", "often", "kind", "__id", "__runs")
    docs = documents((1, prose(1, 30)), (2, prose(1, 30))).selectExpr("*", *[f"'own' AS {c}" for c in names])
    got = sorted(substr.dedup(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["n_removed"] for r in got] == [0, 30] and all(r[c] == "own" for r in got for c in names)


def test_empty_table(documents):
    assert substr.dedup(documents((1, "a")).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=50, unique=True), st.data())
def test_packed_cells_come_back(values, data):
    values = np.array(sorted(values), np.uint64)
    cut = data.draw(st.integers(0, len(values) - 1))
    raw, at = substr.packed(values, np.array([0, cut]))
    assert substr.unpacked(raw[: at[cut]]).tolist() == values[:cut].tolist() and substr.unpacked(raw[at[cut] :]).tolist() == values[cut:].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**24 - 1), max_size=30, unique=True), max_size=6))
def test_parts_come_back_together(parts):
    parts = [np.array(sorted(p), np.uint64) for p in parts]
    values, sizes = substr.unpacked_each([substr.packed(p, np.zeros(1, np.int64))[0] if len(p) else b"" for p in parts])
    assert sizes.tolist() == [len(p) for p in parts] and values.tolist() == [x for p in parts for x in p.tolist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 14))
def test_windows_are_equal_where_their_words_are(words, n):
    h = substr.rolled(substr.word_hashes([b"%d" % w for w in words])[:, 0] if words else np.zeros(0, np.uint64), n, substr._ODD[0])
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    assert len(h) == len(windows) and len(set(h.tolist())) == len(set(windows)) == len(set(zip(h.tolist(), windows, strict=True)))
