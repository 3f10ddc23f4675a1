"""Substring dedup: windows of words that also start in a document with a smaller id are removed.

A count-min prefilter comes first. Each task counts its windows' cells, in two rows of cells, by document group; the counts of
all tasks meet by slice of the cells, and each group gets back those of its cells that two or more documents reach, so a
window whose cells are both among them may be repeated, and no repeated one is missed: counts are only ever too large. The
second pass looks up the windows of each group and passes on those that may be repeated. These alone are grouped exactly, by
96 bits of two hashes of their words, and lose to the smallest id. The number of slices follows the input, so a slice, and the
share of windows that pass wrongly, stay the same at every size; no sketch is broadcast or collected.

Cells travel in packed lists, each with its group, and a batch of them is dealt into at most `FAN` parts at once: with more
slices (or, on the way back, more groups) than that, the parts are gathered and dealt again, by one digit in base `FAN` after
the other. So the number of rows is in proportion to the windows at every size: `2 * FAN` for each `HELD` of them and digit.

Windows that very many pieces hold (an often repeated passage) are marked in the reply; for them the smallest id is found by a
partial aggregate. If the table of these windows is counted to be small, it is broadcast, and each task looks its rows up in it;
else it meets them in parts of each window's documents. Either way no task gets all documents of a passage.

Null texts have no words, and texts shorter than a window stay as they are. Rows with a null id lose nothing and take nothing
from others. Rows that repeat an id, with the same text or another, are neither source nor loser to each other. Of documents
with equal texts, or equal windows, that with the smallest id keeps its words. Very long texts are one row as others are, held
whole by one task. An empty table gives an empty one. Other columns pass through, whatever they are called; columns called
n_words, n_removed and kept are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.shared import lean, rows_of, scratch, stored

WINDOW = 13
#: Windows a slice is meant for, and its cells in each of the two rows; characters of a document group; windows held by a task.
SLICE_WINDOWS, SLICE_CELLS, GROUP_CHARS, HELD = 1_000_000, 1 << 23, 24_000_000, 800_000
#: Parts that a batch of cells is dealt into at once; tasks that document groups are dealt to, at most.
FAN, TASKS = 256, 16_384
#: A cell that so many pieces hold is often repeated. Bytes of removed runs, or of often repeated windows, that may be broadcast.
OFTEN, BROADCAST_BYTES = 64, 32_000_000
#: Parts that an often repeated window's documents are dealt into, at least; documents of a window in a part, about.
PARTS, PART_ROWS = 16, 100_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits of each word, as two numbers."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """Hashes of all windows of n words: a polynomial in odd, put together from windows of powers of two."""
    out, span, power, by, length = None, 0, h, odd, 1
    while True:
        if n & length:  # the part so far stands before this one
            out = power if out is None else out[: len(out) - length] * by + power[span : span + len(out) - length] if len(out) > length else out[:0]
            span += length
        length *= 2
        if length > n:
            return mixed(out)
        power = power[: -(length // 2)] * by + power[length // 2 :] if len(power) > length // 2 else power[:0]
        with np.errstate(over="ignore"):
            by = by * by


def cells(windows: np.ndarray, row: int, slices: int) -> np.ndarray:
    """The cell of each window in a row: slice * SLICE_CELLS + place in the slice."""
    x = mixed(windows ^ _ODD[row + 1])
    part = ((x >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    return part * np.uint64(SLICE_CELLS) + (x & np.uint64(SLICE_CELLS - 1))


def packed(values: np.ndarray, firsts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ascending values as differences in 7-bit bytes, counted anew from each of firsts; also the byte where each starts."""
    gap = np.diff(values, prepend=np.uint64(0))
    gap[firsts] = values[firsts]
    size = np.ones(len(gap), np.int64)
    for k in range(1, 10):
        size += gap >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[at[own] + k] = (gap[own] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127) | np.where(size[own] > k + 1, np.uint8(128), np.uint8(0))
    return out.tobytes(), at


def unpacked_each(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values of several packed parts, one after the other, and how many each has."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    last = raw < 128
    done = np.concatenate([[0], np.cumsum(last)])
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    sizes = np.diff(done[edges])
    if not len(raw):
        return np.zeros(0, np.int64), sizes
    ends = np.flatnonzero(last)
    gap = (raw[ends] & np.uint8(127)).astype(np.int64)
    length = np.diff(ends, prepend=-1)
    gap <<= 7 * (length - 1)
    for k in range(1, int(length.max())):  # k bytes before the last
        own = length > k
        gap[own] |= (raw[ends[own] - k] & np.uint8(127)).astype(np.int64) << (7 * (length[own] - 1 - k))
    values = np.cumsum(gap)
    first = np.cumsum(sizes) - sizes
    there = sizes > 0
    values -= np.repeat((values[first[there]] - gap[first[there]]), sizes[there])
    return values, sizes


def unpacked(data: bytes) -> np.ndarray:
    return unpacked_each([data])[0]


def widths(count: int) -> list[int]:
    """How many of `count` slices or groups a part holds after each dealing; the last is 1."""
    steps = 1
    while FAN**steps < count:
        steps += 1
    return [FAN**k for k in reversed(range(steps))]


#: A part's packed values, and those of them that count twice (of counts) or are often repeated (of replies).
PARTS_OF = "part long, row int, listed binary, more binary"


def _lists(part: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    """The packed values of each part; both arrays ascend, by part first."""
    first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    if not len(first):
        return {}
    data, at = packed(values, first)
    edges = np.append(at[first], len(data)).tolist()
    return {p: data[i:j] for p, i, j in zip(part[first].tolist(), edges[:-1], edges[1:], strict=True)}


def _batch(row: int, listed: tuple, more: tuple) -> pa.RecordBatch:
    """Rows of PARTS_OF from (part, values) of each list."""
    a, b = _lists(*listed), _lists(*more)
    return pa.RecordBatch.from_pydict({
        "part": pa.array(list(a), pa.int64()), "row": pa.array([row] * len(a), pa.int32()),
        "listed": pa.array(list(a.values()), pa.binary()), "more": pa.array([b.get(p, b"") for p in a], pa.binary()),
    })


def _ordered(part: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by part, then value. They are not one number, which would need more than 64 bits with very many slices and groups."""
    order = np.argsort(part.astype(np.uint16), kind="stable")
    part, values = part[order], values[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        values[i:j].sort()
    return part, values


def _fresh(part: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places where a part's value differs from the one before."""
    return np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)


def _pieces(windows: list[np.ndarray], owners: list[np.ndarray], slices: int, groups: int, span: int) -> Iterator[pa.RecordBatch]:
    """The counts of these windows (each once a document); a value is the cell's place among its part's `span`, times groups, plus the group."""
    h, g = np.concatenate(windows), np.concatenate(owners).astype(np.uint64)
    for row in (0, 1):
        c = cells(h, row, slices)
        part, values = _ordered(c // np.uint64(span), c % np.uint64(span) * np.uint64(groups) + g)
        first = _fresh(part, values)
        twice = first[np.diff(first, append=len(part)) > 1]
        yield _batch(row, (part[first], values[first]), (part[twice], values[twice]))


def sketch(docs: DataFrame, slices: int, groups: int, n: int = WINDOW) -> DataFrame:
    """docs (grp, text) -> the tasks' partial counts, dealt by the first digit of the slice; see PARTS_OF."""
    span = SLICE_CELLS * widths(slices)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, owners, held = [], [], 0
        for b in batches:
            for grp, text in zip(b.column("grp").to_pylist(), b.column("text"), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                if len(words) >= n:
                    own = np.sort(rolled(word_hashes(words)[:, 0], n, _ODD[0]))
                    own = own[np.append(True, own[1:] != own[:-1])]
                    windows.append(own)
                    owners.append(np.full(len(own), grp, np.int32))
                    held += len(own)
                    if held >= HELD:
                        yield from _pieces(windows, owners, slices, groups, span)
                        windows, owners, held = [], [], 0
        if held:
            yield from _pieces(windows, owners, slices, groups, span)

    return docs.select("grp", "text").mapInArrow(lean(run), PARTS_OF)


def _finer(parts: DataFrame, width: int, tasks: int) -> DataFrame:
    """Rows of PARTS_OF dealt by the next digit: a part's values are gathered, up to HELD at once, and cut into FAN parts by `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, listed, more, held = None, [], [], 0

        def dealt() -> pa.RecordBatch:
            both = (np.sort(unpacked_each(x)[0].astype(np.uint64)) for x in (listed, more))
            return _batch(key[1], *((np.uint64(key[0] * FAN) + v // np.uint64(width), v % np.uint64(width)) for v in both))

        for b in batches:
            for part, row, x, y in zip(*(b.column(c).to_pylist() for c in ("part", "row", "listed", "more")), strict=True):
                if listed and (key != (part, row) or held >= 3 * HELD):  # a value has about three bytes
                    yield dealt()
                    listed, more, held = [], [], 0
                key = (part, row)
                listed.append(x)
                more.append(y)
                held += len(x) + len(y)
        if listed:
            yield dealt()

    salt = F.pmod(F.xxhash64("listed"), F.lit(tasks))
    return parts.withColumn("salt", salt).repartition("part", "row", "salt").sortWithinPartitions("part", "row").drop("salt").mapInArrow(lean(run), PARTS_OF)


def _dealt(parts: DataFrame, count: int, unit: int, windows: int) -> DataFrame:
    """Rows of PARTS_OF by slice, or by group: dealt by all digits after the first; `unit` values are one slice's, or one group's."""
    for k, width in enumerate(widths(count)[1:]):
        parts = _finer(parts, width * unit, max(1, windows // (FAN ** (k + 1) * 16 * HELD)))
    return parts


def _blocks(column: pa.ChunkedArray, size: int = 4_000_000) -> Iterator[np.ndarray]:
    """The values of packed lists, some megabytes of lists at once."""
    held, n = [], 0
    for x in column:
        held.append(x.as_py())
        n += len(held[-1])
        if n >= size:
            yield unpacked_each(held)[0]
            held, n = [], 0
    if held:
        yield unpacked_each(held)[0]


def repeated_cells(parts: DataFrame, slices: int, groups: int) -> DataFrame:
    """Partial counts by slice -> those of each group's cells with a count of two or more, dealt by the group's first digit.

    A value is the group's place in its part, times the cells of all slices, plus the cell. The counts are walked twice in
    blocks, so what a task holds is the slice's array and the packed lists.
    """
    span, every = widths(groups)[0], slices * SLICE_CELLS

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        low = key[0].as_py() * SLICE_CELLS
        count = np.zeros(SLICE_CELLS, np.uint32)
        for column in ("listed", "more"):
            for values in _blocks(table[column]):
                np.add.at(count, values // groups, np.uint32(1))
        owner, at = [], []
        for values in _blocks(table["listed"]):
            own = values[count[values // groups] >= 2]
            owner.append((own % groups).astype(np.uint64))
            at.append((own // groups).astype(np.uint64))
        g, at = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (owner, at))
        part, values = _ordered(g // np.uint64(span), g % np.uint64(span) * np.uint64(every) + at + np.uint64(low))
        first = _fresh(part, values)
        part, values = part[first], values[first]
        often = count[(values % np.uint64(every)).astype(np.int64) - low] >= OFTEN
        return pa.Table.from_batches([_batch(key[1].as_py(), (part, values), (part[often], values[often]))])

    return parts.groupBy("part", "row").applyInArrow(merge, PARTS_OF)


class _Found:
    """The repeated cells of one group, to look windows up in."""

    def __init__(self):
        self.parts: dict[tuple[int, str], list[np.ndarray]] = {}

    def add(self, row: int, at: bytes, often: bytes) -> None:
        for kind, data in (("cells", at), ("often", often)):
            if data:
                self.parts.setdefault((row, kind), []).append(unpacked(data))

    def table(self, row: int, kind: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The sorted cells, and a small table of their last bits that tells most others apart."""
        parts = self.parts.get((row, kind))
        if isinstance(parts, list):
            cells = np.sort(np.concatenate(parts)).astype(np.uint64)
            low = np.zeros(1 << 23, bool)
            low[(cells & np.uint64((1 << 23) - 1)).astype(np.int64)] = True
            parts = self.parts[row, kind] = (cells, low)
        return parts

    def has(self, kind: str, windows: np.ndarray, slices: int) -> np.ndarray:
        """Places of the windows whose cells are repeated in both rows."""
        at = np.arange(len(windows))
        for row in (0, 1):
            if (found := self.table(row, kind)) is None:
                return at[:0]
            table, low = found
            c = cells(windows[at], row, slices)
            may = low[(c & np.uint64((1 << 23) - 1)).astype(np.int64)]
            at, c = at[may], c[may]
            spot = np.minimum(np.searchsorted(table, c), len(table) - 1)
            at = at[table[spot] == c]
        return at


CANDIDATES = "h1 long, h2 int, doc_id long, tk long, places array<int>, often boolean"


def candidates(docs: DataFrame, replies: DataFrame, slices: int, groups: int, n: int = WINDOW) -> DataFrame:
    """The windows of docs (grp, doc_id, tk, text) that the sketches say may be repeated: once a document, with their places.

    Rows that repeat id and text are one document, so that none is held more than once from here on.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    a = replies.select(F.col("part").cast("int").alias("grp"), F.lit(0).alias("kind"), nothing("long").alias("doc_id"), nothing("long").alias("tk"), nothing("string").alias("text"), "row", "listed", "more")
    b = docs.select("grp", F.lit(1).alias("kind"), "doc_id", "tk", "text", nothing("int").alias("row"), nothing("binary").alias("listed"), nothing("binary").alias("more"))

    def looked_up(found: _Found, held: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch | None:
        """The candidates of a block of documents (id, tk, words) of one group."""
        h = word_hashes(list(itertools.chain.from_iterable(words for _, _, words in held)))
        lens = np.fromiter((len(words) for _, _, words in held), np.int64, len(held))
        end, doc = np.cumsum(lens), np.repeat(np.arange(len(held)), lens)
        w = rolled(h[:, 0], n, _ODD[0])
        starts = np.flatnonzero(np.arange(len(w)) + n <= end[doc[: len(w)]])  # those that do not cross into the next document
        at = starts[found.has("cells", w[starts], slices)]
        if not len(at):
            return None
        # a window's places in a document side by side, so that a document gives one row for each window
        at = at[np.lexsort((w[at], doc[at]))]
        first = np.flatnonzero((np.diff(w[at], prepend=w[at[0]] + np.uint64(1)) != 0) | (np.diff(doc[at], prepend=-1) != 0))
        one, own = at[first], doc[at[first]]
        often = np.zeros(len(one), bool)
        often[found.has("often", w[one], slices)] = True
        h2 = (rolled(h[:, 1], n, _ODD[2])[one] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        ids, tks = (np.fromiter((x[k] for x in held), kind, len(held))[own] for k, kind in ((0, np.int64), (1, np.int64)))
        places = (at - (end - lens)[doc[at]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(places))
        return pa.RecordBatch.from_arrays([*map(pa.array, (w[one].view(np.int64), h2, ids, tks)), lists, pa.array(often)], ["h1", "h2", "doc_id", "tk", "places", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, found, held, size, last = None, _Found(), [], 0, None
        for batch in batches:
            rows = {c: batch.column(c) for c in ("text", "listed", "more")}
            light = zip(*(batch.column(c).to_pylist() for c in ("grp", "kind", "doc_id", "tk", "row")), strict=True)
            for i, (g, kind, doc_id, tk, row) in enumerate(light):
                if held and (g != grp or size > 200_000):
                    if (out := looked_up(found, held)) is not None:
                        yield out
                    held, size = [], 0
                if g != grp:
                    grp, found = g, _Found()
                if kind == 0:
                    found.add(row, rows["listed"][i].as_py(), rows["more"][i].as_py())
                    continue
                if last == (doc_id, tk):  # a row that repeats id and text
                    continue
                last = (doc_id, tk)
                words = rows["text"][i].as_py().encode("utf-8", "surrogatepass").split()
                if len(words) >= n:
                    held.append((doc_id, tk, words))
                    size += len(words)
        if held and (out := looked_up(found, held)) is not None:
            yield out

    tasks = min(groups, TASKS)
    return a.unionByName(b).repartitionById(tasks, F.pmod("grp", F.lit(tasks))).sortWithinPartitions("grp", "kind", "doc_id", "tk").mapInArrow(lean(run), CANDIDATES)


def _looked_up(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, tk, places of the rows (h1, h2, doc_id, tk, places) with a smaller id in firsts (h1, h2, first), which is broadcast.

    A document's rows come one after the other, so their places go into one row, and what is shuffled next is rows of documents.
    """
    table = firsts.toArrow()
    h1, h2, first = (table[c].combine_chunks().to_numpy() for c in ("h1", "h2", "first"))
    order = np.lexsort((h2, h1))
    sent = rows.sparkSession.sparkContext.broadcast((h1[order], h2[order], first[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, first = sent.value
        for b in batches:
            x, y, doc_id, tk = (b.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "tk"))
            at, end, lost = np.searchsorted(h1, x), np.searchsorted(h1, x, "right"), np.zeros(len(x), bool)
            while (some := np.flatnonzero(at < end)).size:  # twice only if two windows share h1
                lost[some] |= (h2[at[some]] == y[some]) & (first[at[some]] < doc_id[some])
                at[some] += 1
            if lost.any():
                ids, tks, places = doc_id[lost], tk[lost], b.column("places").filter(pa.array(lost))
                new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tks[1:] != tks[:-1])))
                ends = np.append(0, np.cumsum(places.value_lengths().to_numpy()))
                merged = pa.ListArray.from_arrays(pa.array(ends[np.append(new, len(ids))].astype(np.int32)), places.flatten())
                yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(tks[new]), merged], ["doc_id", "tk", "places"])

    return rows.select("h1", "h2", "doc_id", "tk", "places").mapInArrow(lean(run), "doc_id long, tk long, places array<int>")


def _often(rows: DataFrame) -> DataFrame:
    """Candidates of often repeated windows -> doc_id, tk, places of those that a smaller id has too.

    The smallest ids come from a partial aggregate. Their table is broadcast if it is small, else each goes to every part of its
    window's documents, in which case more documents make more parts.
    """
    firsts = stored(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"), "substr-often")
    if 20 * rows_of(firsts) <= BROADCAST_BYTES:
        return _looked_up(rows, firsts.select("h1", "h2", "first"))
    most = firsts.agg(F.max("n")).collect()[0][0]
    dealt = max(PARTS, most // PART_ROWS)
    firsts = firsts.drop("n").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
    parted = rows.select("h1", "h2", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(dealt)).cast("int").alias("part"), "doc_id", "tk", "places")
    both = parted.unionByName(firsts, allowMissingColumns=True)
    first = F.min("first").over(Window.partitionBy("h1", "h2", "part"))
    return both.withColumn("first", first).where("doc_id > first").select("doc_id", "tk", "places")


def _runs(starts: DataFrame, n: int) -> DataFrame:
    """doc_id, tk, starts (sorted) -> doc_id, tk, runs: first word and length of each covered stretch, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = []
            for x in b.column("starts"):
                s = np.asarray(x.values, np.int64)
                cut = np.flatnonzero(np.diff(s, prepend=-n - 1) > n)
                end = s[np.append(cut[1:], len(s)) - 1] + n
                runs.append(np.stack([s[cut], end - s[cut]], 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), pa.array(runs, pa.binary())], ["doc_id", "tk", "runs"])

    return starts.mapInArrow(run, "doc_id long, tk long, runs binary")


def dedup(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept: its words that stay, joined by one space."""
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0][0]
    windows = chars // 6
    groups, slices = max(1, -(-chars // GROUP_CHARS)), max(1, -(-windows // SLICE_WINDOWS))
    own = docs.where(doc_id.isNotNull()).select(doc_id.alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    own = own.select(F.pmod(F.xxhash64("doc_id", "tk"), F.lit(groups)).cast("int").alias("grp"), "doc_id", "tk", "text")
    with scratch() as keep:
        with scratch() as kept:
            parts = _dealt(sketch(own, slices, groups, n), slices, SLICE_CELLS * groups, windows)
            replies = stored(_dealt(repeated_cells(parts, slices, groups), groups, slices * SLICE_CELLS, windows), "substr-cells")
            found = kept(stored(candidates(own, replies, slices, groups, n), "substr-windows"))
        smallest = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
        rare = found.where("NOT often").withColumn("first", smallest).where("doc_id > first").select("doc_id", "tk", "places")
        often = _often(found.where("often"))
        starts = rare.unionByName(often).groupBy("doc_id", "tk").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("starts"))
        runs = keep(stored(_runs(starts, n), "substr-runs"))
    size = runs.agg(F.coalesce(F.sum(F.length("runs") + 40), F.lit(0))).collect()[0][0]
    return _cut(docs, F.broadcast(runs) if size <= BROADCAST_BYTES else runs, n)


def _cut(docs: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    names = ("n_words", "n_removed", "kept")
    row = docs.drop(*names)
    # the row as one column, so that its columns may have any names
    own = row.select(F.struct(*[row[f"`{c}`"] for c in row.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"))
    own = own.join(runs, ["doc_id", "tk"], "left").select("row", "runs")
    schema = T.StructType([own.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept string").fields])
    place = row.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            counts, removed, texts = [], [], []
            for t, r in zip(b.column("row").flatten()[place], b.column("runs"), strict=True):
                left = words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                counts.append(len(words))
                if r.is_valid:
                    left, at = [], 0
                    for start, size in np.frombuffer(r.as_py(), "<i4").reshape(-1, 2).tolist():
                        left += words[at:start]
                        at = start + size
                    left += words[at:]
                removed.append(len(words) - len(left))
                texts.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["row", *names])

    return own.mapInArrow(lean(run), schema).select("row.*", *names)
