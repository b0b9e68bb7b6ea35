"""Exact top-k by integer inner product through dual-tree search over cover trees.

Queries and candidates are dealt into blocks; each block of queries meets each block of candidates in a task of its
own, which holds the two blocks only. Blocks have at most ``query_rows`` and ``block_rows`` rows, so that few copies
of either side are shuffled, and fewer where there would otherwise be less than ``TASKS`` tasks. In a task both get a
cover tree: a node has a centre and a covering radius, its children's centres lie apart by more than half its radius
and cover it; where ``CHILDREN`` of them don't, rows go to the nearest and radii are what they are. The trees are searched together: for nodes
with centres q, p and radii r, s no inner product below them exceeds ``q.p + r|p| + s|q| + r s``; a pair of nodes
whose bound stays below the worst k-th score in the query node is dropped, the likeliest pairs are opened first, and
leaves are scored by a matrix product. Where data have no structure to prune, that is a blocked product of all rows,
so the work is never more than brute force plus the trees. Equal vectors are one leaf, however many: its scores are
equal, so only the smallest ids of it can be among the k best, and queries are scored some rows at a time.

Each task returns k rows per query; the k best of those are taken first per run of candidate blocks, then overall.

Scores are exact: below 2**53 in double precision (checked from the largest components), in whole numbers of any
size otherwise; results beyond a long are held at its ends, as are components that ``floor`` takes beyond a long.
Defined results: vectors that are null or hold null or non-finite components, and rows with a null ``vec_id``, take
no part; a query meets vectors of its own length only, vectors without components score 0; a query's own rows are those with its id;
each different row with a query's id is a query; ties go to the smaller id; fewer candidates than k give all; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF, CHILDREN = 48, 64
#: Rows of queries that are scored at once.
AT_ONCE = 1024
#: Blocks of candidates get smaller, down to so many rows, while there are fewer tasks than this.
LEAST_ROWS, TASKS = 2048, 128
LONG = (1 << 63) - 1


class CoverTree:
    """Nodes over the rows of ``x``: centre row, radius, rows below (a range of ``order``) and children."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.centre, self.radius, self.begin, self.end, self.children = [], [], [], [], []
        if len(x):
            self._node(0, len(x))

    def _node(self, a: int, b: int) -> int:
        rows = self.order[a:b]
        c = rows[0]
        far = np.sqrt(((self.x[rows] - self.x[c]) ** 2).sum(1))
        me, radius = len(self.centre), float(far.max())
        self.centre.append(c)
        self.radius.append(radius)
        self.begin.append(a)
        self.end.append(b)
        self.children.append([])
        if b - a <= LEAF or radius == 0:
            return me
        # centres more than half the radius apart, each row with the nearest
        nearest, owner, k, found = far, np.zeros(len(rows), np.int64), 0, [0]
        most = min(CHILDREN, 2 * len(rows) // LEAF)  # children of half a leaf on average at least
        while len(found) < most and (nearest > radius / 2).any():
            k = int(nearest.argmax())
            d = np.sqrt(((self.x[rows] - self.x[rows[k]]) ** 2).sum(1))
            owner = np.where(d < nearest, len(found), owner)
            nearest = np.minimum(nearest, d)
            found.append(k)
        if np.bincount(owner).max() > 0.9 * len(rows) and (nearest > radius / 2).any():  # rows far from all alike: cut evenly
            self.children[me] = [self._node(i, min(b, i + LEAF)) for i in range(a, b, LEAF)]
            return me
        by = np.lexsort((np.arange(len(rows)) != np.array(found)[owner], owner))  # a child's centre comes first
        self.order[a:b] = rows[by]
        at = a + np.searchsorted(owner[by], np.arange(len(found) + 1))
        self.children[me] = [self._node(int(s), int(e)) for s, e in zip(at[:-1], at[1:])]
        return me


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), LONG)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score >= self.score[rows, -1:]).any(1)
        if not better.any():
            return
        rows, score = rows[better], score[better]
        score = np.hstack([self.score[rows], score])
        ids = np.hstack([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def smallest(ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest ids whichever one id is left out, each id k times at most."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    nth = np.arange(len(own)) - np.searchsorted(own, own)
    return order[nth < k][: 2 * k]


def search(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> Best:
    """The k best of ``p`` for each row of ``q`` (whole numbers in doubles), other ids than its own."""
    best = Best(len(q), k)
    if not len(q) or not len(p):
        return best
    a, b = CoverTree(q), CoverTree(p)
    q_len, p_len = np.sqrt((q * q).sum(1)), np.sqrt((p * p).sum(1))

    def bounds(i: int, js: np.ndarray) -> np.ndarray:
        c, d = a.centre[i], np.array([b.centre[j] for j in js])
        r, s = a.radius[i], np.array([b.radius[j] for j in js])
        top = p[d] @ q[c] + r * p_len[d] + s * q_len[c] + r * s
        return top + 1e-9 * np.abs(top) + 1e-6  # never below the bound in spite of rounding

    stack = [(0, 0, float(bounds(0, np.array([0]))[0]))]
    while stack:
        i, j, top = stack.pop()
        rows = a.order[a.begin[i] : a.end[i]]
        if top < best.score[rows, -1].min():
            continue
        if not a.children[i] and not b.children[j]:
            cols = b.order[b.begin[j] : b.end[j]]
            if b.radius[j] == 0 and len(cols) > 2 * k:
                cols = cols[smallest(p_ids[cols], k)]
            for some in np.array_split(rows, len(rows) // AT_ONCE + 1):
                score = q[some] @ p[cols].T
                score[q_ids[some][:, None] == p_ids[cols][None, :]] = -np.inf
                best.add(some, score, p_ids[cols])
            continue
        below = b.children[j] or [j]
        opened = []
        for c in a.children[i] or [i]:
            found = bounds(c, np.array(below))
            opened += [(c, d, t) for d, t in zip(below, found.tolist())]
        opened.sort(key=lambda x: x[2])  # the likeliest is opened first
        stack += opened
    return best


def _search_whole(q: list, q_ids: np.ndarray, p: list, p_ids: np.ndarray, k: int):
    """The same in whole numbers of any size, for components whose products don't fit a double."""
    for i, x in enumerate(q):
        found = sorted((-sum(s * t for s, t in zip(x, y)), int(n)) for y, n in zip(p, p_ids) if n != q_ids[i])[:k]
        yield [(max(-LONG - 1, min(LONG, -s)), n) for s, n in found]


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, query_rows: int = 16384, block_rows: int = 32768) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose ``vec_id`` is divisible by ``every`` against all rows."""
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.forall("v", plain), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable)
    whole = written(rows.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v")), "whole")
    queries = whole.where(F.col("vec_id") % every == 0).distinct()
    n, m = queries.count(), whole.count()
    q_blocks = max(1, -(-n // query_rows))
    p_blocks = max(1, -(-m // block_rows), min(-(-m // LEAST_ROWS), -(-TASKS // q_blocks)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(deal(q_blocks).alias("qb"), copies(p_blocks).alias("pb"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    right = whole.select(copies(q_blocks).alias("qb"), deal(p_blocks).alias("pb"), F.col("vec_id").alias("p_id"), F.col("v").alias("p"))

    def pair(_, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_key", "vec_id", "score")})
        if not len(l) or not len(r):
            return none
        out = []
        for d, q in l.groupby(l["q"].map(len)):
            p = r[r["p"].map(len) == d]
            if not len(p):
                continue
            q_ids, p_ids = q["q_id"].to_numpy(), p["p_id"].to_numpy()
            key = pd.util.hash_array(np.array([v.tobytes() for v in q["q"]], object), categorize=False).view(np.int64)
            x, y = np.stack(q["q"].to_numpy()), np.stack(p["p"].to_numpy())
            most = [float(np.abs(m.astype(float)).max(initial=0)) for m in (x, y)]
            if most[0] * most[1] * d < 2**53 and max(most) < 2**26:
                best = search(x.astype(float), q_ids, y.astype(float), p_ids, k)
                i, j = np.nonzero(best.score > -np.inf)
                out.append(pd.DataFrame({"query_id": q_ids[i], "query_key": key[i], "vec_id": best.id[i, j], "score": best.score[i, j].astype(np.int64)}))
            else:
                for i, found in enumerate(_search_whole(x.tolist(), q_ids, y.tolist(), p_ids, k)):
                    out.append(pd.DataFrame({"query_id": q_ids[i], "query_key": key[i], "vec_id": [n for _, n in found], "score": [s for s, _ in found]}))
        out = [o for o in out if len(o)]
        return pd.concat(out) if out else none

    found = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(pair, "query_id long, query_key long, vec_id long, score long")
    best_first = [F.desc("score"), F.asc("vec_id")]
    part = Window.partitionBy("query_id", "query_key", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(*best_first)
    overall = Window.partitionBy("query_id", "query_key").orderBy(*best_first)
    few = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
    return few.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
