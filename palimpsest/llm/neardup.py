"""MinHash near-dedup with odd sketches: documents whose shingle sets are similar enough are linked; links make components.

1. A text becomes its set of word shingles, `SAMPLES` MinHash samples of it, keys of `BANDS` bands of them, and an odd sketch:
   a bitmap in which each sample flips one bit. Texts with the same set are one node, so copies cost no pairs.
2. Nodes that share a band are candidates. The sketches of a pair, XORed, have a population count that tells the share of
   samples that differ; pairs too far apart for any similarity near the threshold are dropped, at five deviations.
3. Candidates are confirmed on the full sets. A link counts if 100 * intersection >= percent * union.
Band buckets are not expanded into all pairs. First each member meets its bucket's smallest node, its nearest such pair
first: most near copies then are one component, and no pair within a component is looked at again. Buckets still of several
components follow. Those of a few members give their pairs across components. Larger ones that share members make a cluster;
its nodes outside its largest component are a query set that goes against all its nodes in blocks of bounded size, where
sketches are compared first and full sets then, and each query gives one link for each component that it finds. So no bucket
is capped, and what is lost is what banding loses: at a similarity of exactly 0.8 three pairs in a million, less above.

Lower case is of A-Z only. A text with fewer words than a shingle has the sequence of them all as its one shingle; without words,
or null, its set is empty, it links with nothing and is its own component. The component's id is the smallest id in it, nulls
aside; a document is kept if its own id is that, or if its component has none. Rows with a null id link as others do. Rows that
repeat an id with the same text are alike, kept or not; with another text they are two documents. A very long text is one row as
others are; its set is held by one task. An empty table gives an empty one. Of other columns than doc_id and text none is read by
near_duplicates(), and deduplicated() passes all on, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from palimpsest.llm.components import components
from palimpsest.llm.shared import lean, rows_of, scratch, small_side, stored
from palimpsest.llm.substr import _ODD, mixed, word_hashes

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Members of a bucket whose pairs across components are looked at directly; nodes in a block of a cluster.
SMALL_BUCKET, BLOCK = 8, 256

_rng = np.random.default_rng(7)
_TIMES = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAMPLE_SEED = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The set of a text's shingles, as ascending 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, space and U+0009 to U+000D only
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)[:, 0]
    out = np.zeros(max(1, len(h) - n + 1), np.uint64)
    for j in range(min(n, len(h))):
        out = out * _ODD[0] + mixed(h[j : j + len(out)] ^ _ODD[1])
    return np.unique(mixed(out + np.uint64(min(n, len(h)))))


def minhash(s: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        np.minimum(low, (s[i : i + 256, None] * _TIMES).min(0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bit j is the parity of the samples that fall on it."""
    at = (mixed(samples ^ _SAMPLE_SEED) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    bits = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def furthest(percent: int = PERCENT, deviations: float = 5.0) -> int:
    """The population count of two XORed sketches that pairs at the threshold reach with a probability under one in a million."""
    p = 1 - percent / 100
    keep = 1 - 2 / SKETCH_BITS
    mean = SKETCH_BITS / 2 * (1 - keep ** (2 * SAMPLES * p))
    spread = 2 * math.sqrt(SAMPLES * p * (1 - p)) * keep ** (2 * SAMPLES * p)
    return math.ceil(mean + deviations * math.hypot(spread, math.sqrt(mean) / 2))


def _key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketches(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, set_key (null for the empty set), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64)
        for b in batches:
            sizes, keys, bands, marks = [], [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                keys.append(_key(s))
                if len(s):
                    m = minhash(s)
                    band = np.zeros(BANDS, np.uint64)
                    for r in m.reshape(BANDS, ROWS).T:
                        band = mixed(band * _ODD[0] + r)
                    bands.append(mixed(band + number * _ODD[2]).view(np.int64))
                    marks.append(odd_sketch(m).view(np.int64))
                else:
                    bands.append(None)
                    marks.append(None)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            cols = [pa.array(c, k) for c, k in zip((sizes, keys, bands, marks), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, n: int, nulls: bool = True) -> DataFrame:
    """node, set (ascending hashes) of nodes (node, set_key, first): worked out once more from the texts of those documents.

    nulls: some nodes may have no id (first), so that the texts without one are looked at as well.
    """
    ids = small_side(nodes.where("first IS NOT NULL").select("first").distinct(), rows=rows_of(nodes))
    every = docs.select(F.col("doc_id").cast("long").alias("first"), "text")
    own = every.join(ids, "first", "left_semi").select("text")
    if nulls:
        own = own.unionByName(every.where("first IS NULL").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), n) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["set_key", "set"])

    sets = own.select("text").mapInArrow(lean(run), "set_key binary, set array<long>").where("set_key IS NOT NULL")
    return sets.join(small_side(nodes.select("node", "set_key"), rows=rows_of(nodes)), "set_key").select("node", "set").dropDuplicates(["node"])


def _apart(x: str, y: str) -> Column:
    """The population count of two XORed sketch columns."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))


class _Linker:
    """Confirms pairs of nodes and keeps the links found so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, percent: int):
        self.docs, self.nodes, self.n, self.percent = docs, nodes, n, percent
        self.nulls = not nodes.where("first IS NULL").isEmpty()
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def marks(self, x: str) -> DataFrame:
        return self.nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_s"))

    def fits(self) -> Column:
        """Whether sizes and sketches allow a and b to be similar."""
        return (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * self.percent) & (_apart("a_s", "b_s") <= furthest(self.percent))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that may be similar, with their distance."""
        out = pairs.join(self.marks("a"), "a").join(self.marks("b"), "b")
        return out.where(self.fits()).select("a", "b", _apart("a_s", "b_s").alias("apart"))

    def across(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose nodes aren't in one component yet."""
        if self.labels is None:
            return pairs
        root = lambda x: small_side(self.labels).select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
        out = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return out.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).drop("a_root", "b_root")

    def sets(self, named: DataFrame, rows: int) -> DataFrame:
        """node, set of the nodes in named (node; at most so many), stored."""
        named = small_side(named.distinct(), rows=rows)
        return stored(full_sets(self.docs, stored(self.nodes.select("node", "set_key", "first").join(named, "node", "left_semi"), "named-nodes"), self.n, self.nulls), "sets")

    def confirm(self, pairs: DataFrame) -> None:
        """Adds those of pairs (a, b) to the links that are similar on the full sets."""
        pairs = stored(pairs.select("a", "b"), "pairs")
        if not rows_of(pairs):
            return
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), 2 * rows_of(pairs))
        side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"))
        both = F.size(F.array_intersect("a_set", "b_set"))
        similar = both * 100 >= (F.size("a_set") + F.size("b_set") - both) * self.percent
        self.add(pairs.join(side("a"), "a").join(side("b"), "b").where(similar).select("a", "b"))

    def add(self, links: DataFrame) -> None:
        self.links = stored(links if self.links is None else self.links.unionByName(links), "links")
        self.labels = stored(components(self.links), "labels")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows (node, ...) with the root of node's component."""
        if self.labels is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(small_side(self.labels), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def mixed(self, rows: DataFrame) -> DataFrame:
        """rows (key, node) -> key, members: the keys whose members are of several components."""
        keys = self.labelled(rows).groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
        return stored(keys.where("low <> high").select("key", "members"), "mixed")


def _with_smallest(rows: DataFrame) -> DataFrame:
    """rows (key, node) -> pairs (a, b) of each bucket's smallest node and each other member."""
    smallest = stored(rows.groupBy("key").agg(F.min("node").alias("a")), "smallest")
    return rows.join(small_side(smallest), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _few(linker: _Linker, rows: DataFrame) -> DataFrame:
    """rows (key, node) of buckets of a few members -> their pairs across components that may be similar."""
    marked = linker.labelled(rows).join(linker.marks("node"), "node")
    side = lambda x: marked.select("key", F.col("node").alias(x), F.col("root").alias(f"{x}_root"), F.col("node_n").alias(f"{x}_n"), F.col("node_s").alias(f"{x}_s"))
    a, b = side("a"), side("b")
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & linker.fits()).select("a", "b").distinct()


def _clusters(linker: _Linker, rows: DataFrame) -> DataFrame:
    """rows (key, node) of large buckets of several components -> links (a, b), at least one for each two components that have any.

    Each cluster's nodes outside its largest component meet all its nodes, both in blocks of about BLOCK nodes.
    """
    cluster = stored(components(_with_smallest(rows)).withColumnRenamed("root", "cluster"), "clusters")
    nodes = stored(linker.labelled(cluster), "cluster-nodes")
    sizes = nodes.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.sum("n").alias("members"), F.max("n").alias("most"))
    sizes = stored(sizes.where("members > most"), "cluster-sizes")
    nodes = nodes.join(small_side(sizes), "cluster").join(linker.sets(nodes.select("node"), rows_of(nodes)), "node").join(linker.nodes.select("node", "sketch"), "node")
    blocks, queries = F.ceil(F.col("members") / BLOCK).cast("int"), F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ("node", "root", "sketch", "set")
    all_of = nodes.select("cluster", place(blocks).alias("block"), every(queries).alias("query"), F.lit(False).alias("asks"), *columns)
    asking = nodes.where("root <> main").select("cluster", every(blocks).alias("block"), place(queries).alias("query"), F.lit(True).alias("asks"), *columns)
    percent, most_apart = linker.percent, furthest(linker.percent)

    def links(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        node, root = (np.asarray(table[c]) for c in ("node", "root"))
        sketch = np.stack([np.asarray(x.values).view(np.uint64) for x in table["sketch"]])
        sets = [np.asarray(x.values).view(np.uint64) for x in table["set"]]
        size = np.array([len(x) for x in sets])
        rest, out = np.flatnonzero(~asks), []
        for q in np.flatnonzero(asks):
            may = rest[(root[rest] != root[q]) & (np.bitwise_count(sketch[rest] ^ sketch[q]).sum(1) <= most_apart)]
            linked = set()
            for m in may.tolist():
                if root[m] not in linked and 100 * min(size[m], size[q]) >= percent * max(size[m], size[q]):
                    spot = np.minimum(np.searchsorted(sets[q], sets[m]), size[q] - 1)
                    both = int((sets[q][spot] == sets[m]).sum())
                    if 100 * both >= percent * (size[m] + size[q] - both):
                        linked.add(root[m])
                        out.append((node[q], node[m]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return all_of.unionByName(asking).groupBy("cluster", "block", "query").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, small: int = SMALL_BUCKET) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept, a row each."""
    return _judged(docs, n, percent, small).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, n: int, percent: int, small: int = SMALL_BUCKET) -> DataFrame:
    """What near_duplicates returns, with set_key and root: which tell documents and components of one id apart."""
    with scratch() as keep:
        own = docs.select("doc_id", "text")
        marks = keep(stored(sketches(own, n), "sketches"))
        first = F.min_by(F.struct("doc_id", "n_shingles", "bands", "sketch"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("x")
        nodes = marks.where("set_key IS NOT NULL").groupBy("set_key").agg(first)
        nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("x.doc_id").alias("first"), "x.n_shingles", "x.bands", "x.sketch"), "nodes")
        linker = _Linker(own, nodes, n, percent)
        rows = nodes.select(F.explode("bands").alias("key"), "node")
        shared = stored(rows.groupBy("key").count().where("count > 1").select("key"), "shared-bands")
        rows = stored(rows.join(small_side(shared), "key"), "buckets")

        near = stored(linker.near(_with_smallest(rows)), "near")
        linker.confirm(near.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")))
        linker.confirm(linker.across(near))

        keys = linker.mixed(rows)
        of = lambda which: rows.join(small_side(keys.where(which).select("key"), rows=rows_of(keys)), "key")
        linker.confirm(_few(linker, of(F.col("members") <= small)))
        large = stored(of(F.col("members") > small), "large-buckets")
        if rows_of(large):
            linker.add(_clusters(linker, large))

        roots = stored(linker.labelled(nodes.select("node", "set_key", "first")), "roots")
        lowest = stored(roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "lowest")
        ids = roots.join(small_side(lowest), "root", "left").select("set_key", "root", F.coalesce("component_id", "first").alias("component_id"))
        ids = keep(stored(ids, "components"))
    out = marks.select("doc_id", "n_shingles", "set_key").join(ids, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "set_key", "root")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are kept: one of each component, of a document with the smallest id. Rows with the empty set all stay.

    Rows are told by their ids where these are theirs alone. Null and repeated ones are told by id and set: of several sets
    with the smallest id in a component the one with the smallest key stays, and of the rows that repeat it that with the
    smallest text.
    """
    rows = stored(_judged(docs, n, percent).select("doc_id", "set_key", "root", "kept"), "judged")
    loose = stored(rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"), "loose-ids")
    if not rows_of(loose):
        dropped = stored(rows.where("NOT kept").select("doc_id"), "dropped")
        return docs.join(small_side(dropped), "doc_id", "left_anti")
    dropped = stored(rows.where("NOT kept").select("doc_id").unionByName(loose).where("doc_id IS NOT NULL").distinct(), "dropped")
    own = docs.where("doc_id IS NOT NULL").join(small_side(dropped), "doc_id", "left_anti")

    ids = small_side(loose)
    among = rows.where("kept AND set_key IS NOT NULL").withColumnRenamed("doc_id", "id").join(ids, F.col("id").eqNullSafe(ids["doc_id"]), "left_semi")
    stays = stored(among.groupBy("root").agg(F.min(F.struct("set_key", "id")).alias("x")).select("x.*"), "staying")
    others = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    others = others.join(ids, F.col("id").eqNullSafe(ids["doc_id"]), "left_semi")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([_key(shingles(t.as_py(), n)) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], [*b.schema.names, "set_key"])

    schema = StructType([*others.schema.fields, StructField("set_key", BinaryType())])
    others = stored(others.mapInArrow(lean(keyed), schema), "told-by-set")
    side = small_side(stays.select(F.col("set_key").alias("k"), F.col("id").alias("i")))
    found = others.join(side, (F.col("set_key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    found = found.groupBy("set_key", "id").agg(F.min_by("row", "text").alias("row")).select("row")
    bare = others.where("set_key IS NULL").select("row")
    return own.unionByName(found.unionByName(bare).select("row.*"))


def similarity(a: str | None, b: str | None, n: int = SHINGLE) -> float:
    """The similarity of two texts, for tests and for looking at single pairs."""
    x, y = shingles(a, n), shingles(b, n)
    return len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y)))


