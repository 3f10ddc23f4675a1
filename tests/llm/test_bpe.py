import base64
import hashlib
import random
import time

import numpy as np
import pytest

from palimpsest.llm import bpe

TEXTS = ["", None, "Hello world's 123 !!", "  \n\n x\t", "<|endoftext|>", "naïve Größe été 中文字符 😀🏳️‍🌈", "a" * 5000, "ab" * 700, " " * 300, "x" * 97 + " " + "y" * 96]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.vocabulary().splitlines())}
    return tiktoken.Encoding("test", pat_str=bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_and_decodes_back(documents, reference, clashing):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("etaoinéß \n.,") for _ in range(rng.randrange(200))) for _ in range(40)] + ["Hello world's 123 !!"]
    docs = clashing(documents(*enumerate(texts)))
    got = bpe.decode(bpe.encode(docs)).collect()
    assert len(got) == len(texts) and got[0]["kept"] == "own kept"
    for r in got:
        want = reference.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    for r in bpe.round_trip(docs).collect():
        t = texts[r["doc_id"]] or ""
        assert r["ids_sha256"] == hashlib.sha256(np.array(reference.encode_ordinary(t), "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_texts_longer_than_a_block(monkeypatch, reference):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "STEP_ROWS", 400)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    codec = bpe.Codec(bpe.vocabulary(), bpe.pattern())
    texts = ["word " * 60 + "unbelievableness " * 9, "", "q" * 130 + " etaoinshrdlu" * 3, "tail"]
    out = [b""] * len(texts)
    for block in codec.blocks(texts):
        for i, ids in block:
            out[i] += ids
    assert [np.frombuffer(x, "<u4").tolist() for x in out] == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("word", [2, 5, 32])
def test_words_of_a_piece_join_as_the_whole_piece_does(monkeypatch, reference, word):
    monkeypatch.setattr(bpe, "WORD", word)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10_000)
    codec, rng = bpe.Codec(bpe.vocabulary(), bpe.pattern()), random.Random(word)
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 150))) for alphabet in ("ab", "a", "etaoin", "\u4e2d\u6587\u5b57", "abcdefghijklmnopqrstuvwxyz", "-=", "ing") for _ in range(25)]
    pieces += ["x" + "a" * n for n in (63, 64, 65, 200)] + [u * 40 for u in ("abc", "tion", "ment", "xyzzy", "\u00e9a")] + ["internationalisation" * 7]
    codec.learn(set(pieces))
    for p in pieces:
        assert np.frombuffer(codec.kept[p], "<u4").tolist() == reference._encode_single_piece(p.encode())


@pytest.mark.parametrize("kind", ["letters", "cjk", "runs", "bytes"])
def test_very_long_pieces_take_seconds(reference, kind):
    rng = random.Random(kind)
    text = {
        "letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)),
        "cjk": lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(100_000)),
        "runs": lambda: "x" + "a" * 100_000,
        "bytes": lambda: "".join(rng.choice("!#$%&()*+,-./:;<=>?@[]^_{|}~") for _ in range(100_000)),
    }[kind]()
    codec = bpe.Codec(bpe.vocabulary(), bpe.pattern())
    began = time.process_time()
    got = np.frombuffer(b"".join(ids for block in codec.blocks([text]) for _, ids in block), "<u4").tolist()
    took = time.process_time() - began
    assert got == reference.encode_ordinary(text) and took < 5


def test_unknown_ids_are_an_error():
    with pytest.raises(ValueError):
        bpe.Codec.of(bpe.vocabulary(), bpe.pattern()).decoded([np.array([1, 999_999], "<u4").tobytes()])


def test_empty_table(documents):
    assert bpe.round_trip(documents((1, "a")).limit(0)).count() == 0
