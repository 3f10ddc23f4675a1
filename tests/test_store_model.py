import random

import pytest

from palimpsest.schema import BusyError
from palimpsest.sources.store import Store

KEYS = [b"a", b"a\x00", b"\x80", b"\xff\xff", b"longer key"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_follow_a_dict(spark, tmp_path, seed):
    """Puts, gets, deletions, compactions, reopenings and snapshots at random, against dicts."""
    rng = random.Random(seed)
    path = (tmp_path / "store").as_uri()
    store, model, snapshots = Store.open(spark, path), {}, []
    for _ in range(14):
        op = rng.choice(["put", "put", "put", "delete", "get", "compact", "open", "snapshot", "look", "release"])
        if op == "put":
            pairs = [(rng.choice(KEYS), bytes(rng.randrange(256) for _ in range(rng.randrange(3)))) for _ in range(rng.randrange(1, 5))]
            store.put(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key binary, value binary, at int"), order="at")
            model.update(pairs)
        elif op == "delete":
            key = rng.choice(KEYS)
            store.delete(spark.createDataFrame([(key,)], "key binary"))
            model.pop(key, None)
        elif op == "get":
            key = rng.choice(KEYS)
            assert store.get(key) == model.get(key)
        elif op == "compact":
            if snapshots:
                with pytest.raises(BusyError):
                    store.compact()
            else:
                store.compact()
                store.vacuum()
        elif op == "open":
            store = Store.open(spark, path)
        elif op == "snapshot":
            snapshots.append((store.snapshot(), dict(model)))
        elif op == "look" and snapshots:
            snap, then = rng.choice(snapshots)
            assert {bytes(r["key"]): bytes(r["value"]) for r in snap.live().collect()} == then
        elif op == "release" and snapshots:
            snapshots.pop(rng.randrange(len(snapshots)))[0].release()
    assert {bytes(r["key"]): bytes(r["value"]) for r in store.scan().collect()} == model
    assert [bytes(r["key"]) for r in store.scan().collect()] == sorted(model)
