"""Near-duplicate vectors by lattice hashing.

Each of several tables projects a unit vector at random to so many blocks of eight dimensions and decodes each block
to the nearest point of the E8 lattice; the points are the vector's cell. A vector is also filed under the
``PROBES`` neighbouring cells that it is nearest to, taken from the next best points of both of E8's cosets. Two
vectors with the same label meet where a cell is the home of at least one of them, and their cosine is then computed
in double precision. Blocks and tables grow with the vectors of a label (``shape_for``), so that about as many unlike
vectors meet at every size and 98 of 100 pairs at cosine 0.93, more of closer ones; the tests measure it against brute
force.

Equal vectors of a label are one class with a count, so copies are never expanded into pairs; rows know theirs by the
label and 128 bits of hash. Cells and class numbers alone are dealt out first: a cell of one class, or that is nobody's
home, ends there, and vectors join what is left. A task takes some cells at a time. A cell with over ``cell_rows``
vectors is dealt by a salt into sub-cells in which each two salts meet, and a pair of different salts
counts there only. A pair that meets more than once counts where it meets first, which both vectors' cells tell. Out
of a task come a vector's number of links and a spanning forest of the links, never the pairs.

Defined results: a null label, null or zero vectors, vectors with null or non-finite components and rows with a null
``vec_id`` link with nothing (``n_links`` 0, own component); vectors of different lengths don't link; repeated rows
are copies and link with each other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, whole_groups, written
from .simhash import Labels

PROBES = 2
#: The lattice's scale against unit vectors.
SCALE = 1.1
#: Measured with two blocks at this scale: pairs at cosine 0.93 that meet in a table, and unlike ones; and what is left
#: of either with each block more.
MEET, MEET_MORE, UNLIKE, UNLIKE_MORE = 0.635, 0.6, 0.0053, 0.04
#: Pairs at 0.93 that meet, and unlike vectors that one may meet.
RECALL, UNLIKE_ROWS = 0.98, 256
SEED = 7


def d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of D8 (whole coordinates, even sum) to each row, and the next best one."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(1) % 2 != 0
    order = np.argsort(-np.abs(off), axis=1, kind="stable")
    step = np.where(off >= 0, 1.0, -1.0)

    def other(base: np.ndarray, k: int, rows: np.ndarray) -> np.ndarray:
        """``base`` with the k-th most doubtful coordinate rounded the other way in some rows."""
        out, at = base.copy(), order[rows, k]
        out[rows, at] += step[rows, at]
        return out

    o, e = np.flatnonzero(odd), np.flatnonzero(~odd)
    return other(near, 0, o), other(other(other(near, 1, o), 0, e), 1, e)


def e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four E8 points near each row, nearest first, doubled to be whole; and their squared distances."""
    a, b = d8(x)
    c, d = d8(x - 0.5)
    points = np.stack([a, b, c + 0.5, d + 0.5], axis=1)
    far = ((x[:, None] - points) ** 2).sum(2)
    order = np.argsort(far, axis=1, kind="stable")
    return np.rint(2 * np.take_along_axis(points, order[:, :, None], 1)).astype(np.int64), np.take_along_axis(far, order, 1)


def shape_for(n: int) -> tuple[int, int]:
    """Tables and blocks for ``n`` vectors of a label: the fewest blocks with which a vector meets few unlike ones, and
    tables that keep the recall."""
    blocks = 2
    while True:
        tables = ceil(log(1 - RECALL) / log(1 - MEET * MEET_MORE ** (blocks - 2)))
        if n * tables * UNLIKE * UNLIKE_MORE ** (blocks - 2) <= UNLIKE_ROWS:
            return tables, blocks
        blocks += 1


@lru_cache(maxsize=8)
def projections(dims: int, tables: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices (tables, blocks, dims, 8), shifts, and multipliers that hash a cell's coordinates."""
    r = np.random.default_rng([SEED, dims])
    m = np.empty((tables, blocks, dims, 8))
    for t in range(tables):
        for b in range(blocks):
            g = r.standard_normal((dims, 8))
            # eight orthonormal directions where there are so many, lengthened so that lengths are kept on average
            m[t, b] = np.linalg.qr(g)[0] * np.sqrt(dims / 8) if dims >= 8 else g / np.sqrt(8)
    return m / SCALE, r.random((tables, blocks, 8)), r.integers(1, 1 << 62, (blocks, 8)) * 2 + 1


def cells(unit: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Hashed cells (row, table, 1 + probes) of unit vectors, the home cell first."""
    m, shift, mix = projections(unit.shape[1], *shape)
    out = np.empty((len(unit), shape[0], 1 + PROBES), np.int64)
    for t in range(shape[0]):
        part, extra = [], []
        for b in range(shape[1]):
            points, far = e8(unit @ m[t, b] + shift[t, b])
            part.append((points * mix[b]).sum(2))  # wraps around
            extra.append(far[:, 1:] - far[:, :1])
        home = sum(p[:, 0] for p in part)
        moved = np.concatenate([p[:, 1:] - p[:, :1] for p in part], axis=1)
        order = np.argsort(np.concatenate(extra, axis=1), axis=1, kind="stable")[:, :PROBES]
        out[:, t, 0] = home
        out[:, t, 1:] = home[:, None] + np.take_along_axis(moved, order, 1)
    return out


def unit_rows(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, cell: int) -> np.ndarray:
    """For rows of cells of two vectors each: whether they meet in no table before ``table`` and in it at ``cell``
    first. They meet where a cell of both is home of one."""
    met = np.zeros(len(a), bool)
    for t in range(table):
        met |= (a[:, t, :1] == b[:, t]).any(1) | (a[:, t] == b[:, t, :1]).any(1)
    home_a, home_b = a[:, table, 0], b[:, table, 0]
    at_a, at_b = (b[:, table] == home_a[:, None]).any(1), (a[:, table] == home_b[:, None]).any(1)
    first = np.where(at_a & at_b, np.minimum(home_a, home_b), np.where(at_a, home_a, home_b))
    return ~met & (first == cell)


def _group(unit, home, salt, copies, table, cell, one_salt, shape, threshold, count, labels, rows, step=1024):
    """Adds one group's links to ``count`` and ``labels``; ``rows`` are the group's places in those."""
    known = None
    for i in range(0, len(unit), step):
        for j in range(i, len(unit), step):
            near = unit[i : i + step] @ unit[j : j + step].T >= threshold
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            keep = (x < y) & (home[x] | home[y])
            if not one_salt:
                keep &= salt[x] != salt[y]
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if known is None:
                known = cells(unit, shape)
            for k in range(0, len(x), 1 << 17):
                u, v = x[k : k + (1 << 17)], y[k : k + (1 << 17)]
                mine = first_meeting(known[u], known[v], table, cell)
                u, v = u[mine], v[mine]
                count[rows] += np.bincount(u, copies[v], len(unit)).astype(np.int64) + np.bincount(v, copies[u], len(unit)).astype(np.int64)
                labels.link(rows[u], rows[v])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 4096) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("v"))
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", plain) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = rows.withColumns({"usable": usable, "k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(SEED), "v")})
    same = ["label", "k1", "k2"]
    classes = rows.where("usable").groupBy(*same).agg(F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vectors")
    # the label as one number, so that groups are keyed alike whatever its type
    keyed = classes.select("class", F.xxhash64("label", F.size("v")).alias("kind"), "v")
    shape = shape_for(keyed.groupBy("kind").count().agg(F.max("count")).first()[0] or 0)

    def file(batches):
        for b in batches:
            v = b.column(2)
            size = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(size)]
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                found = cells(unit_rows(flat[at[own][:, None] + np.arange(d)]), shape)
                again = pa.array(np.repeat(own, shape[0] * (1 + PROBES)))
                columns = [
                    b.column(1).take(again), pa.array(np.tile(np.repeat(np.arange(shape[0]), 1 + PROBES), len(own)), pa.int32()), pa.array(found.ravel()),
                    pa.array(np.tile(np.arange(1 + PROBES) == 0, len(own) * shape[0])), b.column(0).take(again),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "tab", "cell", "home", "class"])

    group = ["kind", "tab", "cell"]
    filed = written(keyed.select("class", "kind", "v").mapInArrow(file, "kind long, tab int, cell long, home boolean, class long"), "filed")
    met = filed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    met = written(met.select(*group, F.ceil(F.col("n") / cell_rows).cast("int").alias("salts")), "cells")
    dealt = (
        filed.join(met, group).join(classes.select("class", "copies", "v"), "class")
        .withColumn("s", F.pmod(F.xxhash64("class"), F.col("salts").cast("long")).cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select(*group, (F.least("s", "t") * F.col("salts") + F.greatest("s", "t")).alias("sub"), (F.least("s", "t") == F.greatest("s", "t")).alias("same"), "s", "home", "class", "copies", "v")
    )

    def verify(batches):
        for t in whole_groups(batches, 4):
            yield links_of(t)

    def links_of(t):
        kind, tab, cell, sub, s, cls, copies = (t.column(c).to_numpy() for c in ("kind", "tab", "cell", "sub", "s", "class", "copies"))
        home, same = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "same"))
        v = t.column("v").chunk(0)
        begin = v.offsets.to_numpy()
        flat = v.values.to_numpy(zero_copy_only=False)
        order = np.lexsort((cls, sub, cell, tab, kind))
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in (kind, tab, cell, sub):
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        starts = np.r_[np.flatnonzero(new), len(order)]
        names, place = np.unique(cls, return_inverse=True)
        count, labels = np.zeros(len(names), np.int64), Labels(np.arange(len(names)))
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a < 2:
                continue
            g = order[a:b]
            d = begin[g[0] + 1] - begin[g[0]]
            unit = unit_rows(flat[begin[g][:, None] + np.arange(d)])
            _group(unit, home[g], s[g], copies[g], tab[g[0]], cell[g[0]], same[g[0]], shape, threshold, count, labels, place[g])
        linked = np.flatnonzero((count > 0) | (labels.of != np.arange(len(names))))
        return pa.record_batch([pa.array(names[linked]), pa.array(names[labels.of[linked]]), pa.array(count[linked])], names=["a", "b", "n"])

    found = written(dealt.repartition(*group, "sub").sortWithinPartitions(*group, "sub").mapInArrow(verify, "a long, b long, n long"), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    reached = components(found.select("a", "b"))
    named = (
        classes.join(counts, classes["class"] == counts.a, "left").join(reached, F.col("class") == reached.node, "left")
        .select(*same, "first_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select(*same, "n_links", "component_id")
    linked = rows.where("usable").join(named, same).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
