"""Byte-level BPE: encoding by recursive DuckDB queries in each partition, decoding by ordered aggregation.

A text is cut by the tokenizer's pattern. A piece that is a token is that token; the others go through words of at most `WORD`
bytes. Each distinct word becomes rows (word, position, token), one a byte at first. A recursive query joins adjacent rows with
the table of merges and contracts each word's leftmost pair of lowest rank, until no pair of the word is in the table.

A piece of several words needs one thing more, which is the same for all lengths. Let a be the last token of a word and b the
first of the next. The contraction of both words together never crosses their border if, and only if, that of the bytes of a and b
alone does not: what happens within a, within b and at their border depends on nothing else, and the order of the rest does not
change the order of these. So each border is checked by contracting a and b. Where it does not hold, the two tokens before it
and a word's bytes after it are contracted as one word, whose two borders are then checked in turn, until all hold. A piece's
cost is in proportion to its length; if its borders move on for very many rounds, its words are made longer.

A query's rows are bounded: words come in batches by their squared length, and a batch too long for one query goes through
several, each of so many steps as fit. Decoding joins ids with the table of tokens and aggregates their bytes in order.

Null texts count as empty: no tokens, empty bytes. Special tokens are ordinary text. Very long texts go through in parts, and
very long pieces in words. Null ids decode to empty bytes; an unknown id raises an error. Repeated rows are encoded alike, an
empty table gives an empty one, and columns other than those read pass through, but for those of a result's name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.shared import held, lean, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Rows that one recursive query may make; characters of text held as pieces at once; pieces whose ids are kept.
STEP_ROWS, BLOCK_CHARS, KEPT_PIECES = 2_000_000, 1_000_000, 600_000
#: Bytes of a word at first; words of a piece that may move its borders, for each word it has, before its words are made longer.
WORD, ROUNDS = 32, 4
DUCKDB_MEMORY = "250MB"

#: One contraction a word: its lowest rank, of these the leftmost position, and the position that goes, in one number. Word and
#: position, which has 20 bits, are one number too, so that neighbours come from a sort by one key.
BITS = 20
_MASK = (1 << BITS) - 1
_CONTRACT = f"""WITH RECURSIVE state AS (
  SELECT 0 AS step, (CAST(word AS BIGINT) << {BITS}) + pos AS spot, token, false AS done FROM start
  UNION ALL SELECT * FROM (
    WITH pairs AS (SELECT step, spot, spot >> {BITS} AS word, token, lead(token) OVER w AS right_token, lead(spot) OVER w AS right_spot
      FROM state WHERE NOT done AND step < $most WINDOW w AS (ORDER BY spot)),
    best AS (SELECT word, min((CAST(merged AS BIGINT) << {2 * BITS}) + ((spot & {_MASK}) << {BITS}) + (right_spot & {_MASK})) AS k
      FROM pairs JOIN merges ON pair = (CAST(token AS BIGINT) << 32) + right_token WHERE right_spot >> {BITS} = word GROUP BY word)
    SELECT step + 1, spot, CASE WHEN (spot & {_MASK}) = (k >> {BITS}) & {_MASK} THEN CAST(k >> {2 * BITS} AS INTEGER) ELSE token END, k IS NULL
    FROM pairs p LEFT JOIN best ON best.word = p.word WHERE k IS NULL OR (spot & {_MASK}) <> (k & {_MASK}))
) SELECT spot >> {BITS} AS word, (spot & {_MASK}) AS pos, token, done FROM state WHERE done OR step = $most ORDER BY spot"""


def vocabulary(path: str | None = None) -> bytes:
    """The rank file's bytes, read on the driver and sent to the executors: under a megabyte."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encoder and decoder of one Python process, with its own DuckDB."""

    @classmethod
    def of(cls, ranks: bytes, pat: str) -> Codec:
        return held(("bpe", hashlib.sha256(ranks + pat.encode()).hexdigest()), lambda: cls(ranks, pat))

    def __init__(self, ranks: bytes, pat: str):
        import duckdb
        import regex

        self.find = regex.compile(pat)
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.bytes_of = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.kept: dict[str, bytes] = {}
        merges = [(left, right, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (left := self.ranks.get(t[:i])) is not None and (right := self.ranks.get(t[i:])) is not None]
        a = np.array(merges, np.int64).reshape(-1, 3)
        #: Nothing is spilled: what a query holds is bounded by STEP_ROWS.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self._table("merges", {"pair": (a[:, 0] << 32) + a[:, 1], "merged": a[:, 2].astype(np.int32)})
        self._table("tokens", {"id": np.fromiter(self.ranks.values(), np.int64, len(self.ranks)), "hex": [t.hex() for t in self.ranks]})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contracted(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(index of the word, its ids) of each of a batch, in several queries if one would make too many rows."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        pos = (np.arange(len(word)) - np.repeat(ends - lens, lens)).astype(np.int32)
        token = self.bytes_of[np.frombuffer(b"".join(words), np.uint8)]
        while len(word):
            self._table("start", {"word": word, "pos": pos, "token": token})
            most = max(1, STEP_ROWS // len(word))
            got = self.db.execute(_CONTRACT, {"most": most}).fetchnumpy()
            done = np.asarray(got["done"])
            ready, ids = np.asarray(got["word"])[done], np.asarray(got["token"])[done].astype("<u4")
            cuts = np.flatnonzero(np.diff(ready, prepend=-1, append=-1))
            flat = ids.tobytes()
            for at, i, j in zip(ready[cuts[:-1]].tolist(), (cuts[:-1] * 4).tolist(), (cuts[1:] * 4).tolist(), strict=True):
                yield at, flat[i:j]
            word, pos, token = (np.asarray(got[k])[~done].astype(np.int32) for k in ("word", "pos", "token"))

    def contracted(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words."""
        found = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")  # words of a length need about as many steps
        batch = np.cumsum(lens[order] ** 2 // 2) // STEP_ROWS
        for own in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
            own = own.tolist()
            for at, ids in self._contracted([words[i] for i in own]) if own else ():
                found[own[at]] = ids
        return found

    def _joined(self, pieces: list[list[list[int]]]) -> None:
        """Changes pieces (the tokens of each word of each piece) until all borders between words hold."""
        known: dict[tuple[int, int], bool] = {}
        seen: dict[bytes, list[int]] = {}
        holds = [[False] * (len(p) - 1) for p in pieces]  # border i, between word i and i + 1, is known to hold
        size, rounds, todo = [WORD] * len(pieces), [0] * len(pieces), list(range(len(pieces)))
        while todo:
            asked = {(p[i][-1], p[i + 1][0]) for n in todo for p in (pieces[n],) for i, h in enumerate(holds[n]) if not h}
            new = [x for x in asked if x not in known]
            for x, ids in zip(new, self.contracted([self.bytes[a] + self.bytes[b] for a, b in new]), strict=True):
                known[x] = ids == np.array(x, "<u4").tobytes()
            for n in todo:
                pieces[n], holds[n] = self._moved(pieces[n], holds[n], size[n], known, seen)
                rounds[n] += 1
                if rounds[n] > 20 + ROUNDS * len(pieces[n]):
                    size[n], rounds[n] = min(2 * size[n], _MASK // 4), 0
            raw = list({w for n in todo for w in pieces[n] if isinstance(w, bytes)})
            for w, ids in zip(raw, self.contracted(raw), strict=True):
                seen[w] = np.frombuffer(ids, "<u4").tolist()
            for n in todo:
                pieces[n] = [seen[w] if isinstance(w, bytes) else w for w in pieces[n]]
            todo = [n for n in todo if not all(holds[n])]

    def _moved(self, words: list[list[int]], holds: list[bool], size: int, known: dict, seen: dict) -> tuple[list, list[bool]]:
        """The words with the tokens around each border that doesn't hold as one word, and which borders are known to hold.

        A word that has been contracted before has its tokens at once, so that what repeats moves on within one round; others are
        bytes yet.
        """
        out, borders, moves = [], [], 4 * len(words) + 100
        rest = [*zip(reversed(words), [*reversed(holds), True], strict=True)]  # each with whether the border before it holds
        while rest:
            word, border = rest.pop()
            if out and not border and not isinstance(out[-1], bytes):
                border = known.get((out[-1][-1], word[0]))
                if border is False and moves:
                    left, k, held = out[-1], 0, 0
                    while k < len(word) and held < size:
                        held, k = held + len(self.bytes[word[k]]), k + 1
                    both = b"".join(self.bytes[t] for t in left[-2:] + word[:k])
                    if rest:
                        rest[-1] = (rest[-1][0], rest[-1][1] and k < len(word))
                    if word[k:]:
                        rest.append((word[k:], False))
                    if left[:-2]:
                        out[-1] = left[:-2]
                    else:
                        out.pop()
                        if borders:
                            borders.pop()
                    moves -= 1
                    if both in seen:
                        rest.append((seen[both], False))
                        continue
                    word = both
            if out:
                borders.append(bool(border))
            out.append(word)
        return out, borders

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into kept."""
        new = list(pieces.difference(self.kept))
        if len(self.kept) + len(new) > KEPT_PIECES:  # those in use stay
            self.kept = {p: self.kept[p] for p in pieces.intersection(self.kept)}
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        whole = list(map(self.ranks.get, raw))
        self.kept.update((p, r.to_bytes(4, "little")) for p, r in zip(new, whole, strict=True) if r is not None)
        short = [i for i, (b, r) in enumerate(zip(raw, whole, strict=True)) if r is None and len(b) <= WORD]
        self.kept.update(zip([new[i] for i in short], self.contracted([raw[i] for i in short]), strict=True))
        long = [i for i, (b, r) in enumerate(zip(raw, whole, strict=True)) if r is None and len(b) > WORD]
        if not long:
            return
        cut = [[raw[i][k : k + WORD] for k in range(0, len(raw[i]), WORD)] for i in long]
        words = list(set(itertools.chain.from_iterable(cut)))
        ids = dict(zip(words, self.contracted(words), strict=True))
        joined = [[np.frombuffer(ids[w], "<u4").tolist() for w in c] for c in cut]
        self._joined(joined)
        for i, tokens in zip(long, joined, strict=True):
            self.kept[new[i]] = np.array(list(itertools.chain.from_iterable(tokens)), "<u4").tobytes()

    def blocks(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, bytes]]]:
        """Lists of (index of the text, ids of the next part of it), in order; each text has at least one part."""
        held, size = [], 0

        def flush() -> list[tuple[int, bytes]]:
            self.learn(set(itertools.chain.from_iterable(x for _, x in held)))
            return [(i, b"".join(map(self.kept.__getitem__, x))) for i, x in held]

        for i, text in enumerate(texts):
            text = text or ""
            if len(text) <= BLOCK_CHARS:
                parts = [self.find.findall(text)]
            else:
                found = (m.group() for m in self.find.finditer(text))
                parts = iter(lambda: list(itertools.islice(found, BLOCK_CHARS // 5)), [])
            for part in parts:
                held.append((i, part))
                size += min(len(text), BLOCK_CHARS)
                if size >= BLOCK_CHARS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def decoded(self, parts: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids, packed as little-endian unsigned 32-bit integers."""
        counts = [len(p) // 4 for p in parts]
        ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
        out = [b""] * len(parts)
        if not len(ids):
            return out
        self.db.register("given", pa.table({"part": np.repeat(np.arange(len(parts), dtype=np.int32), counts), "i": np.arange(len(ids)), "id": ids}))
        got = self.db.execute("SELECT part, string_agg(hex, '' ORDER BY i), count(*) FROM given JOIN tokens USING (id) GROUP BY part").fetchall()
        self.db.unregister("given")
        for part, text, n in got:
            if n != counts[part]:
                raise ValueError("an id is not in the vocabulary")
            out[part] = bytes.fromhex(text)
        return out


def _schema(df: DataFrame, more: str) -> T.StructType:
    added = T.StructType.fromDDL(more)
    return T.StructType([f for f in df.schema if f.name not in added.names] + added.fields)


def _mapped(df: DataFrame, more: str, make) -> DataFrame:
    """df with the columns of `more`, which replace those of the same name; make(batch) gives them as lists."""
    small_batches(df.sparkSession)
    schema = _schema(df, more)
    names = T.StructType.fromDDL(more).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = [(n, b.column(k)) for k, n in enumerate(b.schema.names) if n not in names]
            new = zip(names, make(b), strict=True)
            yield pa.RecordBatch.from_pydict(dict(old) | dict(new))

    return df.mapInArrow(lean(run, keeps=True), schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens and ids (packed little-endian unsigned 32-bit integers) of the column text."""
    ranks, pat = docs.sparkSession.sparkContext.broadcast(vocabulary(path)), pattern()

    def make(b: pa.RecordBatch) -> tuple:
        ids = [b""] * b.num_rows
        for block in Codec.of(ranks.value, pat).blocks(t.as_py() for t in b.column("text")):
            for i, part in block:
                ids[i] += part
        return pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())

    return _mapped(docs, "n_tokens long, ids binary", make)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded: the bytes that the column ids stands for."""
    ranks, pat = encoded.sparkSession.sparkContext.broadcast(vocabulary(path)), pattern()

    def make(b: pa.RecordBatch) -> tuple:
        return (pa.array(Codec.of(ranks.value, pat).decoded([x or b"" for x in b.column("ids").to_pylist()]), pa.binary()),)

    return _mapped(encoded, "decoded binary", make)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs without text, with n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass over the partition."""
    ranks, pat = docs.sparkSession.sparkContext.broadcast(vocabulary(path)), pattern()

    def make(b: pa.RecordBatch) -> tuple:
        codec, n = Codec.of(ranks.value, pat), b.num_rows
        counts, of_ids, of_bytes = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        for block in codec.blocks(t.as_py() for t in b.column("text")):
            for (i, ids), back in zip(block, codec.decoded([x for _, x in block]), strict=True):
                counts[i] += len(ids) // 4
                of_ids[i].update(ids)
                of_bytes[i].update(back)
        return pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in of_ids]), pa.array([h.hexdigest() for h in of_bytes])

    return _mapped(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make).drop("text")
