import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as p
from palimpsest.llm import bpe, mix
from tests.llm import test_neardup, test_substr


@pytest.fixture
def small(documents, prose, tmp_path):
    passage = prose(77, 60)
    rows = [(i, prose(i, 70), "en", f"s{i % 3}") for i in range(40)]
    rows += [(50 + i, prose(i, 70), "en", "s1") for i in range(5)] + [(60 + i, f"{prose(500 + i, 60)} {passage} {prose(600 + i, 50)}", "en", "s0") for i in range(6)]
    rows += [(70, None, "en", "s0"), (71, "123 ...", "en", "s1"), (72, passage, None, None)]
    documents(*rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_stages_against_plain_versions(spark, small):
    sf_dir, rows = small
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    one = p.language(spark, docs, sf_dir)
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {r[0] for r in rows} - {70, 71}
    assert one.where("doc_id = 72").collect()[0]["lang"] == "en"
    two = p.near_duplicates(spark, one, sf_dir)
    left = sorted((r["doc_id"], r["text"]) for r in one.collect())
    want = {r[0] for r in test_neardup.plain(left, 5, 80) if r[3]}
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == want and not want & {50, 51, 52, 53, 54}
    three = p.repeated_passages(spark, two, sf_dir)
    left = sorted((r["doc_id"], r["text"]) for r in two.collect())
    want = {d: (n, kept) for d, _, n, kept in test_substr.plain(left, 13)}
    got = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == columns and got.keys() == {d for d, (n, kept) in want.items() if not n or kept} and 72 not in got
    assert all(r["text"] == (dict(left)[d] if not want[d][0] else want[d][1]) and r["n_chars"] == len(r["text"]) for d, r in got.items())
    four = p.mixture(spark, three, sf_dir)
    taken = {r["doc"]["doc_id"]: r["copies"] for r in mix.with_copies(three).collect()}
    assert four.columns == columns and {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()} == {d: n for d, n in taken.items() if n}
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.vocabulary().splitlines())}
    encode = tiktoken.Encoding("test", pat_str=bpe.pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    text = {r["doc_id"]: r["text"] for r in four.collect()}
    for r in p.tokens(spark, four, sf_dir).collect():
        ids = np.array(encode(text[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    both = [sorted(map(str, df.select("doc_id", "n_tokens", "ids_sha256").collect())) for df in (p.run(spark, sf_dir), p.tokens(spark, four, sf_dir))]
    assert both[0] == both[1]


def test_empty_documents(spark, small, tmp_path):
    sf_dir, _ = small
    spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lit(False)).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_odd_rows_and_other_columns(spark, documents, prose, clashing, tmp_path):
    rows = [(i % 20, prose(i, 60), None if i % 4 else "en", f"s{i % 2}") for i in range(30)]  # ids repeat with other texts
    rows += [(None, prose(100 + i % 2, 60), "en", None) for i in range(5)] + [(3, prose(3, 60), "en", "s1")] * 3 + [(50, prose(9, 30_000), "en", "s0"), (51, None, None, None), (52, "", "en", "s0"), (None, None, None, None)]
    docs = clashing(documents(*rows)).selectExpr("*", "'own' AS lang_pred", "'own' AS n_removed", "'own' AS row", "'own' AS __own_2")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf_dir, now, seen = str(tmp_path), docs, []
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
        got = now.collect()
        assert {r["kept"] for r in got} == {"own kept"} and {r["lang_pred"] for r in got} == {"own"} and {r["n_removed"] for r in got} == {"own"}
        seen.append(got)
    one, two, three, _ = seen
    assert len(one) == len(rows) - 3 and all(r["lang"] for r in one)
    assert sorted(r["text"] for r in two) == sorted({r["text"] for r in one})  # one row of each text, whatever its id
    assert {r["text"][:50] for r in two if r["doc_id"] is None} == {prose(100 + i, 60)[:50] for i in range(2)}
    assert max(len(r["text"]) for r in three) > 100_000
    out = p.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(seen[3])
