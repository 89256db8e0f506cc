"""Exact top-k by inner product with a paged M-tree and best-first search.

Vectors become integers, floor(scale * x). With M the largest norm, a vector x gets one more coordinate
sqrt(M^2 - |x|^2) and a query q gets 0 there: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest
inner products are the nearest points and the triangle inequality holds.

The tree has two levels of nodes. Root entries are routing objects from a bounded, documented sample; each
vector goes to its nearest one. A page holds at most ``page`` of a router's vectors, close in distance to it, with a
routing object of its own, a covering radius, its distance to the parent router, and each entry's
distance to the page's object. Pages are dealt into groups of bounded size; each task holds one group's
pages and the query blocks that stream past it. Per query, pages wait in a queue by their lower bound, the nearest first;
a page's or an entry's distance is computed only if the stored distances alone
cannot exclude it. The groups' top-k lists are merged by (score, vec_id), k rows per query and group.

Defined cases: vectors that are null or hold null or non-finite components take no part; short vectors
count as padded with zeros; ties go to the smaller vec_id; rows that share a query's vec_id are not its candidates, and repeated
query rows give one list; with fewer candidates than k all are returned; an empty table gives an empty result;
rows without a vec_id take no part. Large vectors, whose scores doubles cannot hold, are scored in whole numbers of any size
and found with a wider margin; a score beyond a long is NULL, its rank is exact. Squared norms above 1e37 raise.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written


@dataclass(frozen=True)
class Tree:
    """scale: of the integers; routers, sample: root entries and the rows they are chosen from; page: entries in
    a page; group: vectors that one task's tree holds; block: queries in a block."""
    scale: int = 1024
    routers: int = 32
    sample: int = 2000
    page: int = 128
    group: int = 16_384
    block: int = 256


def vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v: whole numbers as array<double>, n2: squared norm) of the rows that take part."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.filter(F.col(id_col).isNotNull()).filter(F.coalesce(good, F.lit(False)))

    def whole(x):  # a double of 2^53 or more is a whole number already
        y = x.cast("double") * scale
        return F.when(F.abs(y) >= 2.0 ** 53, y).otherwise(F.floor(y).cast("double"))

    return out.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("v")) \
        .withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _matrix(col, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` doubles, short ones padded with zeros."""
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    """Rows with the coordinate that makes inner products distances."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(axis=1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def spread_out(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to k rows, each the farthest from those before it."""
    at, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(at) < k and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[at[-1]], axis=1))
    return sample[at]


ROUTED = "grp long, router int, dist double, vec_id long, v array<double>"


def _route(it, routers, m2, dim, groups):
    for batch in it:
        if not batch.num_rows:
            continue
        x = lifted(_matrix(batch.column(1), dim), m2)
        d = distances(x, routers)
        r = d.argmin(axis=1)
        ids = batch.column(0).to_numpy()
        grp = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(groups)
        yield pa.RecordBatch.from_arrays([pa.array(grp.astype(np.int64)), pa.array(r.astype(np.int32)), pa.array(d[np.arange(len(r)), r]), batch.column(0), batch.column(1)], names=["grp", "router", "dist", "vec_id", "v"])


PAGES = "grp long, router int, parent_dist double, radius double, obj binary, n int, vec_ids binary, entry_dist binary, entries binary"


def _page(grp, router, routers, ids, x):
    """A page's row: the routing object is the entry nearest the mean."""
    obj = x[int(np.linalg.norm(x - x.mean(axis=0), axis=1).argmin())]
    d = np.linalg.norm(x - obj, axis=1)
    return grp, router, float(np.linalg.norm(obj - routers[router])), float(d.max()), obj.tobytes(), len(ids), ids.tobytes(), d.tobytes(), np.ascontiguousarray(x).tobytes()


def _pages(it, routers, m2, dim, page):
    """Sorted rows (grp, router, dist) to pages; holds one page at a time besides its batch."""
    key, ids, xs = None, [], []
    types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in PAGES.split(", ")]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 9, types)], names=names)
    for batch in it:
        rows = []
        if not batch.num_rows:
            continue
        x, i = lifted(_matrix(batch.column(4), dim), m2), batch.column(3).to_numpy()
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for j, k in enumerate(keys):
            if k != key or len(ids) >= page:
                if ids:
                    rows.append(_page(*key, routers, np.array(ids, np.int64), np.array(xs)))
                key, ids, xs = k, [], []
            ids.append(i[j])
            xs.append(x[j])
        yield out(rows)
    if ids:
        yield out([_page(*key, routers, np.array(ids, np.int64), np.array(xs))])


@dataclass
class Index:
    pages: DataFrame
    routers: np.ndarray
    m2: float
    dim: int
    groups: int
    tree: Tree


def build(vecs: DataFrame, tree: Tree = Tree()) -> Index | None:
    """Index every row of ``vecs`` (vec_id, v, n2); None for an empty table."""
    n, m2, dim = vecs.agg(F.count(F.lit(1)), F.max("n2"), F.max(F.size("v"))).first()
    if not n:
        return None
    if not m2 <= 1e37:
        raise ValueError("components too large for exact scores")
    rows = vecs.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(tree.sample).select("v").collect()
    sample = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        sample[i, :len(r[0])] = r[0]
    m2 = float(m2)
    routers = spread_out(lifted(sample, m2), tree.routers)
    groups = -(-n // tree.group)
    # a router's rows are dealt over the groups by vec_id: a very common vector is split like any other
    routed = vecs.select("vec_id", "v").mapInArrow(lambda it: _route(it, routers, m2, dim, groups), ROUTED)
    parts = max(1, min(groups * 4, 4096))
    ordered = routed.repartition(parts, "grp", "router").sortWithinPartitions("grp", "router", "dist", "vec_id")
    pages = ordered.mapInArrow(lambda it: _pages(it, routers, m2, dim, tree.page), PAGES)
    return Index(written(pages, "mtree-pages"), routers, m2, dim, groups, tree)


def large(m2: float) -> bool:
    """Whether sums of products may be beyond the whole numbers that doubles hold."""
    return m2 * 4 >= 2 ** 53


class Best:
    """A query's k best (score, -vec_id) so far; ``slack`` covers the rounding of distances."""

    def __init__(self, k, q2m2, slack):
        self.k, self.c, self.slack, self.heap, self.reach = k, q2m2, slack, [], np.inf

    def add(self, scores, ids):
        for s, i in zip(scores, ids.tolist()):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -i))
            elif (s, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -i))
        if len(self.heap) == self.k:  # farther points than this score worse than the k-th
            self.reach = np.sqrt(max(0.0, self.c - 2 * float(self.heap[0][0]))) * (1 + 1e-9) + self.slack


def search(q: np.ndarray, q_id: int, k: int, nodes, routers: np.ndarray, m2: float) -> list[tuple[int, int]]:
    """Best-first search of one query in a group's pages; [(score, vec_id)], best first."""
    qx = np.append(q, 0.0)
    exact = large(m2)
    best = Best(k, float(q @ q) + m2, 1e-6 * np.sqrt(m2) if exact else 1e-6)
    ints = [int(c) for c in q] if exact else None
    to_router = np.linalg.norm(routers - qx, axis=1)
    # what the parent distances alone say of each page; its own distance is computed when it is taken
    bound = np.maximum(0.0, np.abs(to_router[nodes.router] - nodes.parent) - nodes.radius)
    queue = [(b, 0, p) for p, b in enumerate(bound.tolist())]
    heapq.heapify(queue)
    while queue:
        low, known, p = heapq.heappop(queue)
        if low > best.reach:
            break
        d = float(np.linalg.norm(nodes.obj[p] - qx))
        if not known:
            own = max(0.0, d - nodes.radius[p])
            if queue and own > queue[0][0]:
                if own <= best.reach:
                    heapq.heappush(queue, (own, 1, p))
                continue
            if own > best.reach:
                continue
        ids, near, x = nodes.entries[p]
        take = (np.abs(d - near) <= best.reach) & (ids != q_id)
        if take.any():
            scores = [sum(a * int(b) for a, b in zip(ints, r)) for r in x[take, :-1]] if exact else np.rint(x[take, :-1] @ q).astype(np.int64).tolist()
            best.add(scores, ids[take])
    return [(s, -i) for s, i in sorted(best.heap, reverse=True)]


class Nodes:
    """A group's pages in memory."""

    def __init__(self, rows: list[dict], width: int):
        self.router = np.array([r["router"] for r in rows], int)
        self.parent = np.array([r["parent_dist"] for r in rows])
        self.radius = np.array([r["radius"] for r in rows])
        self.obj = np.array([np.frombuffer(r["obj"]) for r in rows]).reshape(-1, width)
        self.entries = [(np.frombuffer(r["vec_ids"], np.int64), np.frombuffer(r["entry_dist"]), np.frombuffer(r["entries"]).reshape(-1, width)) for r in rows]


def _search(it, k, routers, m2, dim):
    """Rows by grp, pages before query blocks: the group's pages are held, the blocks stream past."""
    grp, rows, nodes = None, [], None
    for batch in it:
        found = []
        for r in batch.to_pylist():
            if r["grp"] != grp:
                grp, rows, nodes = r["grp"], [], None
            if r["kind"] == 0:
                rows.append(r)
                continue
            nodes = nodes or Nodes(rows, dim + 1)
            for q_id, q in zip(np.frombuffer(r["vec_ids"], np.int64).tolist(), np.frombuffer(r["entries"]).reshape(-1, dim)):
                found += [(q_id, i, s) for s, i in search(q, q_id, k, nodes, routers, m2)]
        types = [pa.int64(), pa.int64(), pa.decimal128(38) if large(m2) else pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(v) for v in c] if pa.types.is_decimal(t) else c, t) for c, t in zip(list(zip(*found)) or [[]] * 3, types)], names=["query_id", "vec_id", "score"])


def _blocks(it, dim, size):
    for batch in it:
        x, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
        rows = [(ids[i:i + size].tobytes(), np.ascontiguousarray(x[i:i + size]).tobytes()) for i in range(0, len(ids), size)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (list(zip(*rows)) or [[]] * 2)], names=["vec_ids", "entries"])


def top_k(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tree: Tree = Tree()) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``queries`` holds, the k best of all others."""
    vecs = vectors(rows, id_col, vec_col, tree.scale)
    index = build(vecs, tree)
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if index is None:
        return empty
    dim, m2, routers = index.dim, index.m2, index.routers
    asked = vecs.filter(queries).select("vec_id", "v").distinct().mapInArrow(lambda it: _blocks(it, dim, tree.block), "vec_ids binary, entries binary")
    cols = [c.split()[0] for c in PAGES.split(", ")]
    pages = index.pages.select(*cols, F.lit(0).alias("kind"))
    # the stated query set meets every group of pages, a block at a time
    null = {"router": "int", "parent_dist": "double", "radius": "double", "obj": "binary", "n": "int", "entry_dist": "binary"}
    blocks = asked.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.groups - 1).cast("long"))))
    blocks = blocks.withColumns({c: F.lit(None).cast(t) for c, t in null.items()}).select(*cols, F.lit(1).alias("kind"))
    both = pages.unionByName(blocks).repartition(max(1, min(index.groups, 4096)), "grp").sortWithinPartitions("grp", "kind")
    score = "decimal(38,0)" if large(m2) else "long"
    found = both.mapInArrow(lambda it: _search(it, k, routers, m2, dim), f"query_id long, vec_id long, score {score}")
    # each group has at most k rows a query
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
