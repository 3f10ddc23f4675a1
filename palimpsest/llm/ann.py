"""Approximate nearest neighbours: stable low-dimensional projections in kd-trees, searched until a chi-square test holds.

Vectors are dealt into blocks at random. In each, a Gaussian (2-stable) projection to `dims` dimensions goes into a kd-tree whose
nodes know the tight boxes of their points. A query verifies its projected neighbours, nearest first: their true distances are
computed until the next one's projected distance is so large beside the query's k-th true distance that a closer vector is left
with a probability under 1 - `sure`: the squared ratio of a pair's projected and true distances follows a chi-square distribution
with `dims` degrees of freedom. Neighbours no further away than the projection's rounding are verified in any case, so all exact
copies of a query are seen. Each block's k best then meet per query.

Queries go through a tree in batches of neighbouring ones, so that distances come from products of matrices: those at its home in
the tree give a query a first bound on the projected distance at which its test holds, the tree leaves out nodes beyond the bounds
of all of the batch, and the bounds fall as the leaves left, nearest first, are verified by parts that grow. What is within its
bound is verified for a query: all that comes out before the test holds when neighbours are verified singly, with a test before
each, and some more. A part's product is made for all queries of the batch and the columns that any of them verifies. Products
lose digits, so they give lower and upper bounds only, and the distances of all that may be among the k best are computed from
the differences.

A block is built once, by the task that holds it, and all queries stream past it; neither side is broadcast. A block holds about
`block_rows` vectors, whatever the input. The index holds every vector; nothing is fitted to a sample.

Vectors that are null, zero, of no components, or that hold null or non-finite components take no part, nor do rows with a
null vec_id. Only vectors of a query's own length are its candidates; very long ones are as others. All rows with the query's
vec_id count as its own row, and of several such rows with an id divisible by `every` the query is the smallest vector. Rows
that repeat are candidates of their own. Ties go to the smaller vec_id. An empty table gives an empty result. Columns other than
vec_id and embedding are not read, whatever they are called.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import lean, stored

DIMS, SURE, LEAF, BLOCK_ROWS, SEED = 24, 0.95, 32, 8_192, 20_240
#: Neighbours that come out together, at least, in the plain order.
STEP = 16
#: Queries that go through a tree together; rows at a query's home; rows that a batch verifies before its first test, and at most
#: between two; numbers held at once for exact distances.
BATCH, HOME, FIRST, MOST, EXACT = 128, 32, 128, 512, 1 << 20


def chi_square(x: float, dims: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_bound(sure: float, dims: int) -> float:
    """The x with chi_square(x) = sure, by bisection."""
    low, high = 0.0, 1.0
    while chi_square(high, dims) < sure:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < sure else (low, mid)
    return high


class Tree:
    """A kd-tree over projected points. A node is a span of `rows` with the tight box of its points; a leaf's children are -1."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.rows = points, np.arange(len(points))
        nodes = []
        self._build(nodes, 0, len(points), leaf)
        self.spans, self.children, self.low, self.high = (np.array(x) for x in zip(*nodes, strict=True))

    def _build(self, nodes: list, start: int, stop: int, leaf: int) -> int:
        rows = self.rows[start:stop]
        own = self.points[rows]
        low, high = own.min(0, initial=np.inf), own.max(0, initial=-np.inf)
        n, children = len(nodes), (-1, -1)
        nodes.append(None)
        if len(rows) > leaf:
            axis = int(np.argmax(high - low))
            if low[axis] < high[axis]:
                self.rows[start:stop] = rows[np.argsort(own[:, axis], kind="stable")]
                mid = start + len(rows) // 2
                children = self._build(nodes, start, mid, leaf), self._build(nodes, mid, stop, leaf)
        nodes[n] = (start, stop), children, low, high
        return n

    def boxes(self, at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each place from each node's box."""
        out = np.zeros((len(at), len(nodes)))
        for x, low, high in zip(at.T, self.low[nodes].T, self.high[nodes].T, strict=True):
            gap = np.maximum(low - x[:, None], x[:, None] - high)
            np.maximum(gap, 0, out=gap)
            gap *= gap
            out += gap
        return out

    def homes(self, at: np.ndarray, size: int) -> np.ndarray:
        """For each place the node that going down to the nearer child leads to, until one has at most `size` points."""
        out = np.zeros(len(at), np.int64)
        while len(go := np.flatnonzero((self.children[out, 0] >= 0) & (self.spans[out, 1] - self.spans[out, 0] > size))):
            both = self.children[out[go]]
            gap = np.maximum(np.maximum(self.low[both] - at[go, None], at[go, None] - self.high[both]), 0)
            out[go] = both[np.arange(len(go)), (gap * gap).sum(2).argmin(1)]
        return out

    def reach(self, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The leaves that are no further than `far` (squared) from any of the places, those nearest to one first; goes down level by level."""
        nodes, leaves, near = np.zeros(1, np.int64), [], []
        while len(nodes):
            d = self.boxes(at, nodes)
            left = ~(d > far[:, None]).all(0)
            nodes, d = nodes[left], d[:, left].min(0)
            leaf = self.children[nodes, 0] < 0
            leaves.append(nodes[leaf])
            near.append(d[leaf])
            nodes = self.children[nodes[~leaf]].ravel()
        return np.concatenate(leaves)[np.argsort(np.concatenate(near), kind="stable")]

    def near(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(squared projected distances, row numbers) of all points, nearest first, some at a time: the plain order for one place."""
        heap = [(0.0, 0)]
        far, rows, waiting = [], [], 0
        while heap:
            _, n = heapq.heappop(heap)
            if self.children[n, 0] >= 0:
                for child, d in zip(self.children[n].tolist(), self.boxes(at[None], self.children[n])[0].tolist(), strict=True):
                    heapq.heappush(heap, (d, child))
                continue
            node = self.rows[slice(*self.spans[n])]
            gap = self.points[node] - at
            far.append((gap * gap).sum(1))
            rows.append(node)
            waiting += len(node)
            if waiting >= STEP or not heap:
                d, r = np.concatenate(far), np.concatenate(rows)
                # Rounding may put a box's distance a little above that of its own points, which is as good for the test.
                out = np.flatnonzero(d <= heap[0][0]) if heap else np.arange(len(d))
                if len(out) >= STEP or not heap:
                    out = out[np.lexsort((r[out], d[out]))]
                    yield d[out], r[out]
                    left = np.ones(len(d), bool)
                    left[out] = False
                    far, rows = [d[left]], [r[left]]
                    waiting = len(far[0])
                else:
                    far, rows = [d], [r]


class Rows:
    """Vectors as a side of products that give lower bounds of squared distances; adding both rows' `slack` makes them upper ones."""

    def __init__(self, x: np.ndarray, asked: bool = False):
        with np.errstate(over="ignore"):
            square, one = (x * x).sum(1)[:, None], np.ones((len(x), 1))
        # what a sum of so many products may lose, twice over
        part = 4 * (x.shape[1] + 4) * np.finfo(float).eps
        self.slack = 2 * part * square[:, 0]
        self.side = np.hstack([-2 * x, one, square * (1 - part)] if asked else [x, square * (1 - part), one])
        self.width = x.shape[1]


def smallest(who: np.ndarray, x: np.ndarray, best: np.ndarray) -> np.ndarray:
    """best (some ascending numbers for each of 0, 1, ...) after more numbers x, each for one of these."""
    who, x = np.concatenate([np.repeat(np.arange(len(best)), best.shape[1]), who]), np.concatenate([best.ravel(), x])
    order = np.lexsort((x, who))
    return x[order][who[order].searchsorted(np.arange(len(best)))[:, None] + np.arange(best.shape[1])]


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, dims: int = DIMS, sure: float = SURE, built: tuple | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query (row number, ids of its k nearest found, their distances, vectors verified, where those at its home may count twice).

    Vectors and queries are doubles.
    """
    plane, tree, far_of, true_of = built or index(vectors, dims)
    bound = chi_square_bound(sure, dims)
    at = queries @ plane
    homes = tree.homes(at, max(HOME, 4 * k))
    order = np.argsort(homes, kind="stable")
    with np.errstate(over="ignore", invalid="ignore"):  # what is too large to be compared so is verified
        # equal vectors may be projected this far apart, squared, as products of matrices round by place: copies lie in many leaves
        slack = dims * (4 * len(plane) * np.finfo(float).eps * np.linalg.norm(plane, axis=0).max() * np.linalg.norm(queries, axis=1)) ** 2
        for i in range(0, len(order), BATCH):
            q = order[i : i + BATCH]
            yield from _search(vectors, ids, queries[q], own[q], k, bound, (tree, far_of, true_of), at[q], homes[q], slack[q], q)


def _search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, bound: float, built: tuple[Tree, Rows, Rows], at: np.ndarray, homes: np.ndarray, slack: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """search for one batch of queries, in the order of their homes.

    The test holds for a query at the k-th smallest of max(projected distance, bound * true distance), all squared, over the block's
    vectors, as there k of them are so near that all further ones may be left. Over some of the vectors that number is no smaller:
    it begins with those at the query's home and falls as others are verified, nearest leaves first.
    """
    tree, far_of, true_of = built
    far_q, true_q, every = Rows(at, True), Rows(queries, True), np.arange(len(queries))

    def bounds(side: Rows, of: Rows, who: np.ndarray, rows: np.ndarray, low: np.ndarray) -> np.ndarray:
        return low + (side.slack[who] + of.slack[rows])

    limit, verified = np.full(len(queries), np.inf), np.zeros(len(queries), np.int64)
    for home in np.unique(homes):
        some = tree.rows[slice(*tree.spans[home])]
        q = np.flatnonzero(homes == home)
        far, true = (bounds(a, b, q[:, None], some, a.side[q] @ b.side[some].T) for a, b in ((far_q, far_of), (true_q, true_of)))
        both = np.where(ids[some] == own[q, None], np.inf, np.maximum(far, bound * true))
        if len(some) >= k:
            limit[q] = np.fmin(limit[q], np.partition(both, k - 1, axis=1)[:, k - 1])
        verified[q] += len(some)

    rows = np.concatenate([np.zeros(0, np.int64), *(tree.rows[slice(*s)] for s in tree.spans[tree.reach(at, np.maximum(limit, slack))])])
    least, found, i, size = np.full((len(queries), k), np.inf), [], 0, FIRST
    while i < len(rows):
        some = rows[i : i + size]
        i, size = i + size, min(2 * size, MOST)
        far = far_q.side @ far_of.side[some].T
        left = ~(far > np.maximum(limit, slack)[:, None])
        need = np.flatnonzero(left.any(0))
        if 2 * len(need) < len(some):
            some, far, left = some[need], far[:, need], left[:, need]
        verified += np.count_nonzero(left, axis=1)
        true = true_q.side @ true_of.side[some].T
        left &= ~(true > (limit / bound)[:, None])
        who, which = np.nonzero(left)
        other = ids[some[which]] != own[who]
        who, which = who[other], which[other]
        row, far, low = some[which], far[who, which], true[who, which]
        high = bounds(true_q, true_of, who, row, low)
        least = smallest(who, np.maximum(bounds(far_q, far_of, who, row, far), bound * high), least)
        limit = np.fmin(limit, least[:, -1])
        found.append((who, row, low, high))

    who, row, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    near = ~(low > smallest(who, high, np.full((len(queries), k), np.inf))[who, -1])
    who, row = who[near], row[near]
    d, step = np.empty(len(who)), max(1, EXACT // max(1, vectors.shape[1]))
    for i in range(0, len(who), step):
        gap = vectors[row[i : i + step]] - queries[who[i : i + step]]
        d[i : i + step] = np.sqrt((gap * gap).sum(1))
    best = np.lexsort((ids[row], d, who))
    cuts = who[best].searchsorted([*every, len(every)])
    for j in every:
        some = best[cuts[j] : min(cuts[j] + k, cuts[j + 1])]
        yield int(numbers[j]), ids[row[some]], d[some], int(verified[j])


def index(vectors: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, Tree, Rows, Rows]:
    """The projection, which depends on the vectors' length only, the tree over the projected vectors, and both for products."""
    plane = np.random.default_rng(SEED).standard_normal((vectors.shape[1], dims))
    points = vectors @ plane
    return plane, Tree(points), Rows(points), Rows(vectors)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(fine & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, k: int = 10, every: int = 100, dims: int = DIMS, sure: float = SURE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df (vec_id, embedding) -> query_id, rank, vec_id, score for each query: each row with vec_id divisible by every."""
    rows = usable(df).select("vec_id", "v", F.size("v").alias("width"))
    queries = stored(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v")), "ann-queries")
    blocks = max(1, -(-rows.count() // block_rows))
    # The row's number in its file deals rows that are alike in all else.
    block = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    # A stated query set against all rows, in blocks: each query goes to each block once.
    dealt = rows.select("width", block.alias("block"), F.lit(False).alias("is_query"), "vec_id", "v")
    asked = queries.select("width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = None, [], None
        for b in batches:
            width, number, asks, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("width", "block", "is_query", "vec_id"))
            cuts = np.flatnonzero(np.diff(width, prepend=-1) | np.diff(number, prepend=-1) | np.diff(asks.astype(int), prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if at != (width[i], number[i]):
                    at, held, built = (width[i], number[i]), [], None
                own = b.column("v").slice(i, j - i).flatten().to_numpy().reshape(j - i, -1)
                if not asks[i]:
                    held.append((own, ids[i:j]))
                    continue
                if not held:
                    continue
                if built is None:
                    vectors, names = (np.concatenate(x) for x in zip(*held, strict=True))
                    built = index(vectors, dims)
                    # the side of products holds them too
                    vectors, held = built[-1].side[:, : built[-1].width], [None]
                for q, found, d, _ in search(vectors, names, own, ids[i:j], k, dims, sure, built):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ids[i + q])), pa.array(found), pa.array(d)], schema=schema)

    # By a number of partitions, which Spark leaves so: it would put many blocks into a task by their bytes, not by the work they make.
    # In order of ids, as what is verified beyond the test follows from which queries are in a batch: reruns agree.
    both = dealt.unionByName(asked).repartition(2 * blocks, "width", "block").sortWithinPartitions("width", "block", "is_query", "vec_id", "v")
    found = both.mapInArrow(lean(run), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
