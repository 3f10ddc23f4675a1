import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid, queries

PIECES = {"en": "the and ing er th on", "de": "der und sch ein ß ung", "fr": "le que é eau ment ç", "es": "el que ñ ción os ado"}


def text(lang, seed, words=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(PIECES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture
def labelled(documents):
    return documents(*[(i, text(lang, i), lang) for i, lang in enumerate(list(PIECES) * 60)])


def test_held_out_accuracy_on_the_table(spark, sf_dir):
    got = queries.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).collect()[0]
    assert n > 200 and right >= 0.97


def test_held_out_rows_and_labels_are_not_learned_from(labelled):
    assert [zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in labelled.collect()] == [r["h"] for r in labelled.select(langid.held_out(F.col("doc_id")).alias("h")).collect()]
    changed = labelled.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = langid.fit(labelled), langid.fit(changed)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights)


def test_family_first_then_pairs(labelled):
    model = langid.fit(labelled)
    assert [[model.langs[i] for i in f] for f in model.families] == [["de", "en"], ["es", "fr"]]
    assert [tuple(model.langs[i] for i in p) for p in model.pairs] == [("de", "en"), ("es", "fr")]
    langs, scores = model.predict([text(x, 999) for x in PIECES])
    assert langs == list(PIECES) and (scores > 0.5).all() and (scores <= 1).all()


def test_edge_rows(labelled, documents, clashing):
    model = langid.fit(labelled)
    docs = clashing(documents((1, None), (2, ""), (3, "123 !? \n"), (4, text("fr", 1)), (4, text("fr", 1)), (None, text("de", 1)), (5, "é"), (6, text("es", 2, 400_000))))
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, model).collect()}
    assert {x for x in got if x[0] != 5} == {(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (None, "de"), (6, "es")}
    rows = langid.identify(docs, model).where("lang_pred = 'und'").collect()
    assert [r["score"] for r in rows] == [0.0] * 3 and rows[0]["kept"] == "own kept"
    assert langid.fit(labelled.limit(0)) is None
    assert [r["lang_pred"] for r in langid.identify(docs.limit(3), None).collect()] == ["und"] * 3
    assert langid.identify(docs.limit(0), model).count() == 0
    one = langid.fit(labelled.where("lang = 'en'"))
    assert one.predict(["anything", "1"]) [0] == ["en", "und"]


def test_long_texts_are_counted_whole(monkeypatch):
    s = text("de", 3, 500)
    whole = sum(h.shape[1] for h, _, _ in langid.hashed([s]))
    monkeypatch.setattr(langid, "CHUNK", 70)
    parts = [h for h, _, _ in langid.hashed([s])]
    assert len(parts) > 10 and sum(h.shape[1] for h in parts) == whole


def test_every_label_is_learned(documents):
    rng = random.Random(4)
    words = {f"x{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(170)}
    rows = [(i * 200 + k, " ".join(rng.choices(words[x], k=12)), x) for k, x in enumerate(words) for i in range(12 if k < 150 else 7)]
    docs = documents(*rows)
    model = langid.fit(docs)
    assert model.langs == sorted(words)
    got = [(r["lang"], r["lang_pred"]) for r in langid.identify(docs, model).collect() if r["lang"] >= "x150"]
    assert len(got) == 140 and sum(x == y for x, y in got) >= 0.9 * len(got)


def test_predictions_equal_a_plain_version(labelled):
    """Features by a dictionary, margins by sums, the family first, then votes; with the weights of the model."""
    from collections import Counter

    def plain_features(t):
        s = "".join(c.lower() if c.isalpha() else " " for c in "  " + t)
        out = Counter()
        for i in range(2, len(s)):
            if s[i] == s[i - 1] == " ":
                continue
            a, b, x = (ord(c) for c in s[i - 2 : i + 1])
            one, two = x * 2654435761, (b * 1000003 + x + 17) * 2246822519
            three = (((a * 1000003 + b) % 2**32 * 16777619 + x + 29) % 2**32) * 3266489917
            out.update(v % 2**32 >> 32 - langid.BITS for v in (one, two, three))
        return out, sum(out.values()) / 3

    model = langid.fit(labelled)
    texts = [text(x, 500 + i, 1 + i % 7) for i in range(60) for x in PIECES] + ["a", "the que", "ß 12 ñ!", "und  und"]
    langs, _ = model.predict(texts)
    for t, got in zip(texts, langs, strict=True):
        counts, n = plain_features(t)
        margin = [sum(c * float(model.weights[k, j]) for k, c in counts.items()) / n + float(model.bias[j]) for j in range(len(model.bias))]
        family = max(range(len(model.families)), key=lambda f: margin[f])
        votes = {m: [0, 0.0] for m in model.families[family]}
        for j, (a, b) in enumerate(model.pairs):
            if a in votes:
                own = margin[len(model.families) + j]
                votes[a if own >= 0 else b][0] += 1
                votes[a][1] += own
                votes[b][1] -= own
        assert got == model.langs[max(votes, key=lambda m: (*votes[m], -m))]


def test_enough_passes_reach_the_optimum(monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 2000)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)) + 0.8 * np.sign(np.arange(60) % 2 - 0.5)[:, None]
    y = np.where(np.arange(60) % 2, 1, -1)
    w = langid.svm([(np.arange(8), r) for r in x], y)[:8]
    loss = lambda v: 0.5 * v @ v + langid.COST * np.maximum(0, 1 - y * (x @ v)).sum()
    # the objective is convex: if nothing near is lower, nothing is
    best = min(loss(w + s * d) for s in (1e-3, 1e-2, 0.1) for d in rng.standard_normal((200, 8)))
    assert loss(w) <= best + 1e-3 * loss(w)


def test_the_sample_is_bounded_by_bytes(labelled, monkeypatch):
    monkeypatch.setattr(langid, "BYTES", 0)
    monkeypatch.setattr(langid, "D", langid.D)
    assert langid.fit(labelled).langs == sorted(PIECES)
