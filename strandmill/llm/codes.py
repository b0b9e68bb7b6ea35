"""Vector codes: each vector becomes one code per part, the nearest of that part position's codebook entries.

Components are whole numbers, ``floor(scale * x)``, so sums and distances are exact and reruns agree to the digit. A
round broadcasts one kd-tree per codebook (``entries`` rows each, whatever the table's size). A task searches its
batches of parts in each tree: the nearer child first, then the other where its bounding box is no farther than the best
so far; equally far boxes are visited as well, so of equally near entries the lowest index is found. Each task sums its
parts by entry, one row per entry and position, and Spark sums those rows to the entries of the next round.

Defined results: null vectors, those that hold null or non-finite components, and those of another length than the first
kept row's (by ``vec_id``, nulls last, then vector) have no row; lengths that the parts don't divide are filled with
zeros; empty vectors have error 0. With fewer kept rows than ``entries`` there are as many entries as rows. Repeated
rows count again; an empty table gives an empty result; components of 2^24 or more in size after scaling are an error, as
their distances could leave 64 bits. Columns other than ``vec_id``, ``embedding`` and ``label`` are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries of a leaf at most.
LEAF = 8
#: Rows that a task searches at once.
ROWS = 4096
LARGEST = 1 << 24
#: Labels whose sums are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 200_000


class KdTree:
    """Rows of whole numbers split at the median of their widest component; each node keeps its bounding box."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.nodes: list[tuple] = []
        self._build(np.arange(len(rows)))

    def _build(self, at: np.ndarray) -> int:
        me, own = len(self.nodes), self.rows[at]
        low, high = own.min(axis=0), own.max(axis=0)
        self.nodes.append((low, high, at, None))
        if len(at) > LEAF and (high > low).any():
            order = np.argsort(own[:, (high - low).argmax()], kind="stable")
            half = len(at) // 2
            children = self._build(np.sort(at[order[:half]])), self._build(np.sort(at[order[half:]]))
            self.nodes[me] = (low, high, at, children)
        return me

    def _bound(self, node: int, q: np.ndarray) -> np.ndarray:
        """Squared distance from the node's box."""
        low, high, *_ = self.nodes[node]
        out = np.maximum(low - q, 0) + np.maximum(q - high, 0)
        return (out * out).sum(axis=1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest row to each row of ``q``; of equally near ones the lowest index."""
        index, best = np.full(len(q), len(self.rows)), np.full(len(q), np.iinfo(np.int64).max)
        stack = [(0, np.arange(len(q)), np.zeros(len(q), np.int64))]
        while stack:
            node, of, bound = stack.pop()
            # a box as far as the best so far may hold a lower index
            of = of[bound <= best[of]]
            if not len(of):
                continue
            _, _, at, children = self.nodes[node]
            if children is None:
                apart = q[of, None, :] - self.rows[at]
                d = (apart * apart).sum(axis=2)
                k = d.argmin(axis=1)  # the first of equal ones, and ``at`` ascends
                d, k = d[np.arange(len(of)), k], at[k]
                better = (d < best[of]) | ((d == best[of]) & (k < index[of]))
                best[of[better]], index[of[better]] = d[better], k[better]
                continue
            left, right = (self._bound(c, q[of]) for c in children)
            first = left <= right
            for rows, near, far, near_bound, far_bound in ((of[first], *children, left[first], right[first]), (of[~first], *children[::-1], right[~first], left[~first])):
                stack.append((far, rows, far_bound))
                stack.append((near, rows, near_bound))
        return index, best


def _usable(vectors: DataFrame) -> DataFrame:
    # NaN and infinities don't lie between the bounds
    finite = F.forall("embedding", lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    return vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & finite)


def _whole(column: pa.Array, rows: int, dims: int, parts: int, scale: int) -> np.ndarray:
    """(row, part, component) of one batch, in whole numbers."""
    x = np.asarray(column.flatten(), np.float64).reshape(rows, dims)
    x = np.floor(scale * x)
    if rows and dims and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST} or more after scaling")
    width = -(-dims // parts)
    out = np.zeros((rows, parts * width), np.int64)
    out[:, :dims] = x
    return out.reshape(rows, parts, width)


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def updated(kept: DataFrame, books: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """The codebooks (part, entry, component) after one round; entries without parts stay."""
    parts, entries, width = books.shape
    trees = kept.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])

    def run(batches):
        sums, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in _slices(batches):
            x = _whole(b.column(0), b.num_rows, dims, parts, scale)
            for p, tree in enumerate(trees.value):
                index, _ = tree.nearest(x[:, p])
                np.add.at(sums[p], index, x[:, p])
                n[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(n)
        yield pa.record_batch([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = kept.select("embedding").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    books = books.copy()
    for row in total.collect():  # one row per entry at most
        books[row.part, row.entry] = [s // row.n for s in row[3:]]
    trees.unpersist()
    return books


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: entry numbers in part order, two hexadecimal digits each;
    squared distances from those entries, summed over parts, and summed over rows of equal labels."""
    usable = _usable(vectors)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = [row.embedding for row in usable.orderBy(*order).limit(entries).collect()]
    dims = len(first[0]) if first else 0
    kept = usable.where(F.size("embedding") == dims)
    if any(len(v) != dims for v in first):
        first = [row.embedding for row in kept.orderBy(*order).limit(entries).collect()]
    books = np.ascontiguousarray(_whole(pa.array(first, pa.list_(pa.float64())), len(first), dims, parts, scale).transpose(1, 0, 2))
    kept = written(kept, "vectors")
    for _ in range(rounds if first else 0):
        books = updated(kept, books, dims, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    trees = kept.sparkSession.sparkContext.broadcast([KdTree(b) for b in books] if first else [])

    def run(batches):
        for b in _slices(batches):
            x = _whole(b.column(1), b.num_rows, dims, parts, scale)
            code, error = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for p, tree in enumerate(trees.value):
                code[:, p], apart = tree.nearest(x[:, p])
                error += apart
            yield pa.record_batch([b.column(0), b.column(2), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    types = dict(kept.dtypes)
    coded = written(kept.select("vec_id", "embedding", "label").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = sums.count() <= BROADCAST_LABELS
    sums = sums.withColumnRenamed("label", "of")
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
