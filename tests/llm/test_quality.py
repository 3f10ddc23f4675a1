import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.quality import judged, line_fails, listed, quality, repeated_words


def plain_repeats(words, n=5):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    seen = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(n)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(2, 7))
def test_repeated_words(words, n):
    assert repeated_words([w.encode() for w in words], n) == plain_repeats(words, n)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é#*|<\n\t  \x1c\x85", max_size=60))
def test_base_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, chars, symbols, dups, again, failed, *_ = judged(text)
    assert (n, chars, symbols, dups, again) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, plain_repeats(words))
    assert failed == (n < 10 or 100 * again > 20 * n)


def test_lines():
    fails = lambda s: line_fails(s, s.encode().split())
    assert fails("home | about | news | contact") and fails("BUY!! NOW!! CHEAP!!") and fails("some*** words### here$$$") and fails("All rights reserved.")
    assert not fails("A plain sentence, with words.") and not fails("It costs 5% of a | pipe among many other words of this line here.")


@pytest.mark.parametrize("line", [
    "Home About Contact Login Register", "Home > Products > Shoes", "Home|About|Contact", "Startseite » Produkte » Schuhe", "<< Previous  Next >>", "About · Press · Jobs", "Read more", "Read more…", "Accept all cookies",
    "var x = {a:1}; function(){}", "total = price * 2;", "http://a.example/x https://b.example/y see", "www.example.com", "=====================", "*** --- ***", "12:30 ::: --- ::: ---", "THIS IS ALL IN CAPITALS HERE",
    "ВСЁ НАПИСАНО БОЛЬШИМИ БУКВАМИ ЗДЕСЬ", "Tous droits réservés.", "Alle Rechte vorbehalten", "Released under the MIT License.", "We use cookies to improve your visit.", "© 2021 Example", "Weiterlesen", "Leer más »",
])
def test_lines_of_forms_that_the_tables_do_not_hold_fail(line):
    assert line_fails(line, line.encode().split())


@pytest.mark.parametrize("line", [
    "The Great Gatsby was written in 1925.", "• Buy some milk at the store.", "Il a dit : « Tout va bien. »", "中文的句子没有空格。", "यह एक वाक्य है।", "Chapter One", "He wrote to NASA and the FBI about it.", "3.14159 is near 22/7, he said.",
    "It is 5 < 7 and 9 > 8, as everybody who counts on ten fingers knows.", "Look at www.example.com for more of what we wrote about this.", "a lower case line that ends without any mark",
])
def test_lines_of_prose_stay(line):
    assert not line_fails(line, line.encode().split())


def test_short_lines_in_a_row_are_a_list():
    text = "Home\nAbout us\n\nContact\nLog\n" + "One plain sentence of words that differ.\nMore\nAnother follows it here, as sentences do.\nAn end\nOf two"
    assert judged(text)[-1].split("\n") == ["", "One plain sentence of words that differ.", "More", "Another follows it here, as sentences do.", "An end", "Of two"]
    assert listed([True, True, False, True, True, True, True]) == [False] * 3 + [True] * 4 and listed([]) == []


def test_rules_equal_their_sql_on_any_lines():
    import duckdb

    from palimpsest.llm.oracles import OP7

    rng = random.Random(3)
    words = "Home about Us, the . end. THE BIG Ünder ÉTÉ > < / :: | » « › • · {x} x=1; a;b http://x www.y !! no!! $$$ ### a*** 中文 文。 हिन्दी ١٢ ½ Ǆ ⅷ \u00a0 \x1c © cookies use Released under MIT license Read more Next page \U0001f600 ’s end.) 12 3,5 - –".split(" ")
    rows = []
    for i in range(600):
        lines = [rng.choice(["", " ", "\t", "\r"]).join(rng.choice(["", " "]) + rng.choice(words) + " " for _ in range(rng.randrange(rng.choice([3, 9, 50])))) + rng.choice(["", "\r", ".", "  "]) for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(lines + rng.choices(lines, k=rng.randrange(2)))))
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    want = {r[0]: tuple(r[1:]) for r in db.execute(OP7).fetchall()}
    assert len({r[6:] for r in want.values()}) > 50
    for i, t in rows:
        assert judged(t)[:8] == want[i], t


def test_documents(documents, clashing):
    clean = "One plain sentence of words that differ. Another one follows it here.\nAnd a third line."
    docs = documents((1, clean), (2, None), (3, ""), (4, "a " * 50), (5, "x | y | z | w | v | u | t | s | r | q | p | o\n" + clean), (None, clean), (1, clean), (6, "WIN!! " * 3 + "\n" + "a!! b!! c!! d!! e!! f!! g!! h!! i!! j!! k!!"), (7, "w%d " * 1 % 1 + " ".join(f"w{i}" for i in range(200_000))))
    got = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality(clashing(docs)).collect()}
    assert got == {(1, 16): True, (2, 0): False, (3, 0): False, (4, 50): False, (5, 39): False, (None, 16): True, (6, 14): False, (7, 200_001): True}
    assert quality(docs.limit(0)).count() == 0
    cleaned = {r["doc_id"]: r["cleaned"] for r in quality(docs, texts=True).collect()}
    assert cleaned[5] == clean and cleaned[2] == ""
