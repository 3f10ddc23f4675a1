import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import slots
from palimpsest.llm.bpe import pattern, vocabulary


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 3000), st.text(max_size=5))
def test_the_permutation_is_one(count, key):
    out = slots.permuted(np.arange(count), count, key)
    assert sorted(out.tolist()) == list(range(count))


def test_keys_give_different_orders():
    a, b = (slots.permuted(np.arange(1000), 1000, k) for k in "ab")
    assert (a != b).mean() > 0.9 and np.corrcoef(a, np.arange(1000))[0, 1] < 0.2


@pytest.fixture
def tokens():
    import public_tokenizers

    return lambda t: slots._encoding(vocabulary(public_tokenizers.path(slots.VOCABULARY)), pattern()).encode_ordinary(t or "")


def walked(number, count, key):
    """The slot of one number by the plain definition: rounds on two halves, again while the result is no slot."""
    mask64, half = 2**64 - 1, max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    x = number
    while True:
        left, right = x >> half, x % 2**half
        for r in range(6):
            k = int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")
            f = right ^ k
            f = (f ^ (f >> 30)) * 0xBF58476D1CE4E5B9 & mask64
            f = (f ^ (f >> 27)) * 0x94D049BB133111EB & mask64
            left, right = right, left ^ ((f ^ (f >> 31)) % 2**half)
        x = left << half | right
        if x < count:
            return x


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**9), st.text(max_size=5), st.lists(st.integers(0, 10**9), min_size=1, max_size=5))
def test_slots_are_those_of_a_plain_feistel_walk(count, key, numbers):
    numbers = [n % count for n in numbers]
    assert slots.permuted(np.array(numbers), count, key).tolist() == [walked(n, count, key) for n in numbers]


def plain(rows, tokens, length, end=50256):
    """[(n_tokens, doc_ids, ids)] by slot, from (doc_id, text) in the order of the stream."""
    ids, owner = [], []
    for i, t in rows:
        own = [*tokens(t), end]
        ids, owner = ids + own, owner + [i] * len(own)
    count = -(-len(ids) // length)
    out = [None] * count
    for n in range(count):
        own, who = ids[n * length : (n + 1) * length], owner[n * length : (n + 1) * length]
        out[walked(n, count, "order-1")] = (len(own), list(dict.fromkeys(who)), own + [end] * (length - len(own)))
    return out


def test_files_hold_all_sequences_in_slot_order(documents, prose, tokens, clashing, tmp_path):
    texts = {i: prose(i, 5 + 7 * i) for i in range(25)} | {30: None, 31: "", 32: prose(1, 3000), 33: "a"}
    want = plain(texts.items(), tokens, 32)
    docs = clashing(documents(*reversed(texts.items())))
    for dealt in (docs.repartition(7), docs.coalesce(1)):  # the order is not that of the table
        rows = slots.ordered(slots.stream(dealt, length=32), per_shard=16)
        got = sorted(rows.collect(), key=lambda r: r["slot"])
        assert [r["slot"] for r in got] == list(range(len(want)))
        for r, (_, _, ids) in zip(got, want, strict=True):
            assert (r["shard"], r["offset"]) == (r["slot"] // 16, r["slot"] % 16 * 64) and np.frombuffer(r["record"], "<u2").tolist() == ids
    folder = str(tmp_path / "shards")
    files = slots.write_shards(rows, folder).collect()
    assert sorted(f["shard"] for f in files) == list(range(-(-len(got) // 16))) and sum(f["records"] for f in files) == len(got)
    for start in (0, 17, len(got) - 1):
        assert list(slots.read_from(folder, start, 64, 16)) == [bytes(r["record"]) for r in got[start:]]
    assert {f["sha256"] for f in slots.write_shards(rows, folder).collect()} == {f["sha256"] for f in files}


def test_tasks_hold_many_shards(documents, prose, tokens, monkeypatch):
    monkeypatch.setattr(slots, "TASKS", 3)
    rows = slots.ordered(slots.stream(documents(*[(i, prose(i, 60)) for i in range(30)]), length=16), per_shard=8)
    assert rows.rdd.getNumPartitions() == 3
    parts = rows.rdd.glom().map(lambda p: [(r["shard"], r["slot"]) for r in p]).collect()
    assert sum(parts, []) == sorted(sum(parts, [])) and all(len({x for x, _ in p}) > 5 for p in parts)


def test_empty_table(documents):
    s = slots.stream(documents((1, "a")).limit(0))
    assert s.count == 0 and slots.ordered(s).count() == 0


def test_repeated_rows_and_null_ids(documents, tokens, tmp_path):
    rows = [(None, "b"), (1, "a"), (1, "a"), (2, None)]
    got = sorted(slots.token_slots(documents(*reversed(rows)), f"file://{tmp_path}/s", length=2).collect(), key=lambda r: r["slot"])
    want = plain(rows, tokens, 2)
    assert [(r["n_tokens"], list(dict.fromkeys(r["doc_ids"]))) for r in got] == [(n, who) for n, who, _ in want]
    assert [r["record_sha256"] for r in got] == [hashlib.sha256(np.array(ids, "<u2").tobytes()).hexdigest() for _, _, ids in want]


def test_the_query_writes_its_shards_and_reports_them(spark, documents, prose, tokens, tmp_path, monkeypatch):
    from palimpsest.llm.queries import op10_token_slots

    rows = [*{i: prose(i, 5 + 90 * i) for i in range(40)}.items(), (40, None), (41, prose(3, 20_000))]
    documents(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(slots, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    df = op10_token_slots(spark, str(tmp_path))
    got, want = sorted(df.collect(), key=lambda r: r["slot"]), plain(rows, tokens, slots.LENGTH)
    held = list(slots.read_from(df.schema["shard"].metadata["folder"], 0, 2 * slots.LENGTH))
    assert [np.frombuffer(x, "<u2").tolist() for x in held] == [ids for _, _, ids in want]
    for n, (r, x, (size, who, _)) in enumerate(zip(got, held, want, strict=True)):
        assert (r["slot"], r["shard"], r["offset"], r["n_tokens"], r["doc_ids"], r["record_sha256"]) == (n, n // 4096, n % 4096 * 2 * slots.LENGTH, size, who, hashlib.sha256(x).hexdigest())


def test_shards_go_to_any_path_of_spark(spark, documents, prose, tmp_path):
    docs, folder = documents(*{i: prose(i, 300) for i in range(9)}.items()), f"file://{tmp_path}/some/where"
    got = sorted(slots.token_slots(docs, folder, per_shard=8, length=32).collect(), key=lambda r: r["slot"])
    held = list(slots.read_from(folder, 3, 64, 8))
    assert len({r["shard"] for r in got}) > 3 and [r["slot"] for r in got] == list(range(len(got)))
    assert [hashlib.sha256(x).hexdigest() for x in held] == [r["record_sha256"] for r in got[3:]]
    assert slots.token_slots(docs.limit(0), f"file://{tmp_path}/none").collect() == []
