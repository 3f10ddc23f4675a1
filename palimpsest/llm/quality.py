"""Quality rules, line first: lines that fail are removed, then documents that lose too much text are rejected.

A line fails if
- it is navigation: items between separators, a menu of capitalised items, links, a call to click on, or one of three short lines
  or more in a row that end no sentence;
- its punctuation or spelling is not that of prose: symbols or shouting on most words, few letters, mostly capitals, code;
- it is boilerplate: a short line with a phrase of licences, rights, cookies or terms, in a few languages;
- it repeats an earlier line.
Then a document is rejected whose remaining lines hold less than `least_kept` of its words.

Null texts count as texts without words: they fail the base rules and are not kept; so do empty ones. Blank lines are never judged
and stay. Very long texts are judged whole, by one task, in memory in proportion to the text. A share of exactly `least_kept`
is enough. Rows that repeat are judged alike, each for itself; a null doc_id is a row as others. An empty table gives an empty
one. Of other columns than doc_id and text none is read, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import lean

LEAST_KEPT = 0.5
#: Characters that count as symbols; what boilerplate lines of so many words at most say; what short ones ask for.
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "licensed under|released under|under the .{1,40} licen[cs]e|all rights reserved|copyright \\(c\\)|©|cookie policy|privacy policy|privacy notice|terms of (use|service)|subscribe to|sign up for|click here"
    "|use cookies|accept (all )?cookies|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados|utilise des cookies|verwendet cookies|utiliza cookies"
    "|mentions légales|politique de confidentialité|datenschutzerklärung|nutzungsbedingungen|política de privacidad|términos y condiciones"
)
BOILERPLATE_WORDS = 40
ACTIONS = (
    "^ *((read|learn|show|see|load|view) (more|all)|(next|previous|prev)( page)?|back to top|skip to (main )?content|(log|sign) ?(in|up|out)|share( this| on .*)?|(accept|reject) all.*"
    "|add to cart|leave a (comment|reply)|(print|email) this.*|weiterlesen|mehr erfahren|lire la suite|en savoir plus|leer más|más información)[ .…»>]*$"
)
ACTION_WORDS = 6
#: Characters between items (and », where no « shows that it is a quotation mark), and words that stand there; what a sentence, a
#: clause or an item of a list ends with.
SEPARATORS = "|›‹•·→←"
SEPARATOR_WORDS = (">", ">>", "<", "<<", "/", "::")
ENDING = "[.!?…:;,。！？；：、؟۔।॥][)\\]\"'»”’」』 \u00a0\\t\\r\\x0b\\x0c]*$"
#: Words of a short line, and how many in a row are a list of items.
SHORT_WORDS, SHORT_LINES = 4, 3

_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_SYMBOL_WORD = re.compile(rf"[^ \t-\r]*[#*$%&<>]{{3}}[^ \t-\r]*")
_SHOUT_WORD = re.compile(r"[^ \t-\r]*!![^ \t-\r]*")
_BOILERPLATE, _ACTIONS, _ENDING = re.compile(f"(?i){BOILERPLATE}"), re.compile(f"(?i){ACTIONS}"), re.compile(ENDING)
_SEPARATOR, _CODE = re.compile(f"[{SEPARATORS}]"), re.compile(r"[{}]|=.*;[ \t\r]*$")
_LINK = re.compile(r"(?:[^ \t-\r]*://|(?<![^ \t-\r])www\.)[^ \t-\r]*")
_LETTER, _LETTER_OR_DIGIT, _CAPITAL = regex.compile(r"\p{L}"), regex.compile(r"[\p{L}\p{M}\p{N}]"), regex.compile(r"\p{Lu}")
_CAPITAL_WORD = regex.compile(r"(?<![^ \t-\r])\p{Lu}")
#: What is left of a line's bytes without these is its letters and digits, its letters, its capitals.
_ASCII = bytes(range(128))
_NO_ALNUM, _NO_LETTER, _NO_CAPITAL = (bytes(x for x in _ASCII if not f(bytes([x]))) for f in (bytes.isalnum, bytes.isalpha, bytes.isupper))


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words within windows of n words that occur twice or more in the text; exact, in memory in proportion to the text."""
    if len(words) <= n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(ids):
        return 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    code, span = ids, 1
    while span * 2 <= n:
        code, span = joined(code[:-span], code[span:]), span * 2
    while span < n:
        code, span = joined(code[: len(ids) - span], ids[span:]), span + 1
    twice = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_fails(line: str, words: list[bytes], raw: bytes | None = None) -> bool:
    """Whether a rule for navigation, punctuation or boilerplate removes a line with these words (one at least)."""
    n = len(words)
    raw = line.encode("utf-8", "surrogatepass") if raw is None else raw
    plain = len(raw) == len(line)
    ends = _ENDING.search(line) is not None
    separators = len(_SEPARATOR.findall(line)) + ("«" not in line) * line.count("»") if b"|" in raw or not plain else 0
    separators += sum(map(words.count, _SEPARATOR_WORDS)) if b">" in raw or b"<" in raw or b"/" in raw or b"::" in raw else 0
    if separators > 1 and 5 * separators >= n or separators == 1 and n <= 5 and not ends:
        return True
    if not ends and n >= 4 and 5 * len(_CAPITAL_WORD.findall(line)) >= 4 * n:
        return True
    if (b"://" in raw or b"www." in raw) and 2 * len(_LINK.findall(line)) >= n:
        return True
    if n <= ACTION_WORDS and _ACTIONS.search(line):
        return True
    if 2 * (len(_SYMBOL_WORD.findall(line)) + len(_SHOUT_WORD.findall(line) if b"!!" in raw else ())) > n:
        return True
    count = lambda rest, pattern: len(raw.translate(None, rest)) if plain else len(pattern.findall(line))
    if 2 * count(_NO_ALNUM, _LETTER_OR_DIGIT) < len(line) - sum(map(line.count, " \t\v\f\r")):
        return True
    if n >= 5 and (capitals := count(_NO_CAPITAL, _CAPITAL)) >= 14 and 10 * capitals >= 7 * count(_NO_LETTER, _LETTER):
        return True
    if (b"{" in raw or b"}" in raw or b"=" in raw) and _CODE.search(line):
        return True
    return n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line) is not None


_SEPARATOR_WORDS = [x.encode() for x in SEPARATOR_WORDS]


def listed(short: list[bool]) -> list[bool]:
    """Which of the lines with words are in a run of short ones that is long enough to be a list of items."""
    out, run = [False] * len(short), 0
    for i, x in enumerate([*short, False]):
        if x:
            run += 1
            continue
        if run >= SHORT_LINES:
            out[i - run : i] = [True] * run
        run = 0
    return out


def judged(text: str | None, least_kept: float = LEAST_KEPT) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_kept_words, kept, cleaned text."""
    text, words = text or "", []
    lines = []
    for line in text.split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        own = raw.split()  # of bytes: at space and U+0009 to U+000D only
        words += own
        lines.append((line, raw, own))
    items = iter(listed([len(own) <= SHORT_WORDS and not _ENDING.search(line) for line, _, own in lines if own]))
    dup, kept_words, kept_lines, seen = 0, 0, [], set()
    for line, raw, own in lines:
        if own:
            item = next(items)
            if line in seen:
                dup += 1
                continue
            seen.add(line)
            if item or line_fails(line, own, raw):
                continue
            kept_words += len(own)
        kept_lines.append(line)
    n, again = len(words), repeated_words(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    failed = n < 10 or 100 * again > 20 * n
    return n, chars, len(_SYMBOL.findall(text)), dup, again, failed, kept_words, not failed and kept_words >= least_kept * n, "\n".join(kept_lines)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_kept_words long, kept boolean"


def quality(docs: DataFrame, least_kept: float = LEAST_KEPT, texts: bool = False) -> DataFrame:
    """doc_id, the base figures, n_kept_words and kept for each row of docs; with texts also cleaned, what is left of the text."""
    schema = SCHEMA + ", cleaned string" * texts
    kinds = [pa.bool_() if x.endswith("boolean") else pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judged(t.as_py(), least_kept) for t in b.column("text")]
            cols = [[r[i] for r in rows] for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)
