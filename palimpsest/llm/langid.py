"""Language identification in two steps: the family first, then one-versus-one linear SVMs among its languages.

Features are the shares of hashed character n-grams (1 to 3) over lower-cased letters, with anything else as a blank. The
family is the largest of one-versus-rest SVMs; within it each pair of languages has an SVM, votes decide, then margins.
A model is fitted on a bounded sample of labelled rows: about `sample` rows in all, the same number of each language, drawn
by a hash of the id. Every label is learned, however rare: with more than `sample` / `EACH` of them, about `EACH` rows of each are
drawn, or all that there are. The model is a table of weights by feature, sent to the executors; its size depends on the languages
only: 256 KB a family, and as much for each pair of languages in one.

A text that is null or has no letter is `und`, with score 0; so is any text if there is nothing to learn from. Null labels
and null ids are never learned from. With one language all texts with a letter are that, with score 1. Labels are used as
they are; those not in FAMILIES are families of their own. Rows that repeat are predicted alike, whatever their ids. Very long texts
are counted whole, in parts of a bounded size. Of languages with as many votes and margins alike the first by name wins, and of families.
An empty table gives an empty one. Other columns pass through, whatever they are called; lang_pred and score are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.shared import lean, small_batches, stored

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
#: Rows learned from, but for more languages; rows of a language, at least; bits of a feature's number; passes of the fit.
SAMPLE, EACH, BITS, EPOCHS, COST = 2400, 16, 16, 12, 4.0
D = 1 << BITS
#: Bytes of the sample's features, which the driver fits, for all languages.
BYTES = 200_000_000
CHUNK = 1_000_000

_letters: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """By code point: the lower-case letter, or a blank for what is no letter."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features of order 1, 2 and 3 by position, text number by position, letters by text) for parts of the texts, in order.

    A part is about CHUNK characters; of a text that is longer, the next part starts two characters back, uncounted.
    """
    todo, size = [], 0

    def part(pieces: list[tuple[int, str, bool]]) -> tuple:
        own = ["\n\n" + s if fresh else s for _, s, fresh in pieces]
        c = _lower()[np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)]
        lens = np.fromiter(map(len, own), np.int64, len(own))
        text = np.repeat(np.fromiter((i for i, _, _ in pieces), np.int64, len(pieces)), lens)
        first = np.cumsum(lens) - lens
        counted = np.ones(len(c), bool)
        counted[first], counted[first + 1] = False, False
        counted[1:] &= (c[1:] != 32) | (c[:-1] != 32)
        at = np.flatnonzero(counted)
        a, b, x = c[at - 2], c[at - 1], c[at]
        with np.errstate(over="ignore"):
            one = x * np.uint32(2654435761)
            two = (b * np.uint32(1000003) + x + np.uint32(17)) * np.uint32(2246822519)
            three = ((a * np.uint32(1000003) + b) * np.uint32(16777619) + x + np.uint32(29)) * np.uint32(3266489917)
        shift = np.uint32(32 - BITS)
        return np.stack([one >> shift, two >> shift, three >> shift]), text[at], x != 32

    for i, s in enumerate(texts):
        fresh = True
        while True:
            head, s = s[:CHUNK], s[CHUNK - 2 :] if len(s) > CHUNK else ""
            todo.append((i, head, fresh))
            size += len(head)
            fresh = False
            if size >= CHUNK:
                yield part(todo)
                todo, size = [], 0
            if not s:
                break
    if todo:
        yield part(todo)


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers of the features of a text and their shares; None without a letter."""
    total, n, letters = np.zeros(D, np.int64), 0, 0
    for h, _, is_letter in hashed([text]):
        total += np.bincount(h.ravel(), minlength=D)
        n, letters = n + h.shape[1], letters + int(is_letter.sum())
    if not letters:
        return None
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / n).astype(np.float32)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights of a linear SVM by dual coordinate descent; classes weigh alike. The last weight is the bias."""
    w, alpha = np.zeros(D + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    cost = np.where(y > 0, COST * len(y) / max(1, 2 * (y > 0).sum()), COST * len(y) / max(1, 2 * (y < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            new = min(max(alpha[i] - (y[i] * float(w[at] @ v) - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


@dataclass
class Model:
    langs: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # by feature: an entry for each family, then for each pair
    bias: np.ndarray

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(margins by text and classifier, whether the text has a letter)."""
        total, n, letters = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for h, text, is_letter in hashed(texts):
            if not len(text):
                continue
            cuts = np.flatnonzero(np.diff(text, prepend=-1))
            own = text[cuts]
            for order in h:
                total[own] += np.add.reduceat(self.weights[order], cuts, axis=0, dtype=np.float64)
            n[own] += np.diff(np.append(cuts, len(text)))
            letters[own] += np.add.reduceat(is_letter, cuts, dtype=np.int64)
        return total / np.maximum(n, 1)[:, None] + self.bias, letters > 0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(languages, scores)."""
        m, has = self.margins(texts)
        best, sure = np.zeros(len(texts), np.int64), np.ones(len(texts))
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(4 * x, -60, 60)))
        if len(self.families) > 1:
            top = m[:, : len(self.families)]
            best = top.argmax(1)
            two = np.sort(top, axis=1)[:, -2:]
            sure = sigmoid((two[:, 1] - two[:, 0]) / 2)
        langs = np.zeros(len(texts), np.int64)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            votes, summed = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    own = m[rows, len(self.families) + k]
                    i, j = members.index(a), members.index(b)
                    votes[:, i] += own >= 0
                    votes[:, j] += own < 0
                    summed[:, i] += own
                    summed[:, j] -= own
            won = np.array([max(range(len(members)), key=lambda i: (v[i], s[i], -i)) for v, s in zip(votes, summed, strict=True)], np.int64)
            langs[rows] = np.array(members)[won] if len(rows) else 0
            if len(members) > 1 and len(rows):
                sure[rows] *= sigmoid(summed[np.arange(len(rows)), won] / (len(members) - 1))
        names = [self.langs[k] if h else "und" for k, h in zip(langs, has, strict=True)]
        return names, np.where(has, sure, 0.0)


def fitted(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """A model of (language, feature numbers, shares)."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    lang = np.array([langs.index(r[0]) for r in rows])
    groups: dict[str, list[int]] = {}
    for i, x in enumerate(langs):
        groups.setdefault(FAMILY_OF.get(x, f"only {x}"), []).append(i)
    families = [groups[k] for k in sorted(groups)]
    mean = np.zeros(D)
    for _, at, v in rows:
        mean[at] += v
    scale = 1 / np.sqrt(mean / len(rows) + 1e-5)
    scaled = [(at, v * scale[at]) for _, at, v in rows]
    norm = np.mean([np.sqrt(v @ v) for _, v in scaled]) or 1.0
    scaled = [(np.append(at, D), np.append(v / norm, 0.3)) for at, v in scaled]

    def raw(w: np.ndarray) -> tuple[np.ndarray, float]:
        return (w[:D] * scale / norm).astype(np.float32), 0.3 * w[D]

    found, pairs = [], [p for f in families for p in itertools.combinations(f, 2)]
    for f in families:
        found.append(raw(svm(scaled, np.where(np.isin(lang, f), 1, -1))) if len(families) > 1 else (np.zeros(D, np.float32), 0.0))
    for a, b in pairs:
        own = np.flatnonzero((lang == a) | (lang == b))
        found.append(raw(svm([scaled[i] for i in own], np.where(lang[own] == a, 1, -1))))
    return Model(langs, families, pairs, np.stack([w for w, _ in found], 1), np.array([b for _, b in found]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of docs (doc_id, text, lang) that are not held out."""
    own = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    if len(counts) * EACH > SAMPLE:
        sample = max(sample, len(counts) * EACH)
    each = -(-sample // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 32))
    below = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1 << 32, int(each / r["count"] * (1 << 32)))))])
    drawn = own.where(draw < F.element_at(below, F.col("lang"))).orderBy(draw, "lang").limit(2 * sample).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                if (f := features(text.as_py())) is not None:
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "at": [f[0]], "share": [f[1]]}, schema)

    table = stored(drawn.repartition(8).mapInArrow(lean(run), "lang string, at array<int>, share array<float>"), "langid-sample")
    # A row has D features at most; of texts so long that the sample of a language takes more than its share of BYTES, fewer are taken.
    share = Window.partitionBy("lang").orderBy(F.size("at"), F.xxhash64("at", "share")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = table.withColumn("taken", F.sum(8 * F.size("at")).over(share)).where(F.col("taken") <= max(8 * D, BYTES // len(counts))).drop("taken").toArrow()
    rows = [(x, np.asarray(a.values), np.asarray(s.values)) for x, a, s in zip(table["lang"].to_pylist(), table["at"], table["share"], strict=True)]
    return fitted(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    names = ("lang_pred", "score")
    schema = T.StructType([f for f in docs.schema if f.name not in names]).add("lang_pred", "string").add("score", "double")
    kept = schema.names[:-2]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of D rows and a column a classifier

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            langs, scores = sent.value.predict(texts) if sent.value else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in kept} | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.drop(*names).mapInArrow(lean(run), schema)
