"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint of ``bits`` bits is the bitwise majority of its word shingles' hashes; documents link when
their fingerprints differ in at most ``max_diff`` bits. Distinct fingerprints only are compared: copies share one.

Distribution: each fingerprint goes once to every route, under the value that a set of its bits has there.
``block_routes`` are such that no link is lost: the bits are cut into blocks, and fingerprints within ``max_diff``
bits agree on all but ``max_diff`` blocks. ``sampled_routes`` take bits at random and find links with a known
probability, for differences that are too large for blocks. Keys get longer and routes more with the number of
fingerprints, so that groups stay as large while as many links are found. A group of over ``cell_rows`` rows is dealt
into cells that hold two salts each, so that each two salts meet and no task gets a whole group.

Within a group the fingerprints are sorted by Gray rank, which keeps similar ones together. Runs of ``FANOUT``
become nodes that keep the bits all of them share (a mask and its pattern), runs of nodes become upper nodes, up to
one root. The tree is joined with itself from the root: a pair of nodes carries the differences counted so far, a
level adds those in the bits that it newly fixes, and a pair beyond ``max_diff`` is dropped with all below it. A task
takes some groups at a time, and only a spanning forest of their links leaves it. Connected components of those give the classes.

Defined results: null and empty texts have fingerprint zero and link like others; a text of fewer words than a
shingle has one shingle, the whole; a null ``doc_id`` gets its class's id; repeated rows stay; an empty table gives
an empty result; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, whole_groups, written

FANOUT = 16
#: Child pairs that one step of the traversal makes at most: bounds a task's memory.
STEP = 1 << 19
SEED = 42
#: Bits of one place that a byte can count.
RUN = 255


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole where there are fewer words."""
    shingles = max(1, len(words) - width + 1)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(shingles)), np.uint64, shingles)


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """Rows of so many 64-bit words, of which each depends on all of a hash's bits."""
    x = h[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def majority(h: np.ndarray, bits: int) -> bytes:
    """The bits that over half the hashes have, most significant first. Of 64 bits they are the hashes' own, of
    multiples of that they are mixed from them."""
    votes = np.zeros(bits, np.int64)
    for at in range(0, len(h), 32 * RUN):
        part = h[at : at + 32 * RUN]
        part = (part[:, None] if bits == 64 else _mixed(part, bits // 64)).astype(">u8")
        bit = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1)
        full = len(bit) // RUN * RUN
        votes += bit[:full].reshape(-1, RUN, bits).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bit[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(h)).tobytes()


def fingerprint(text: str | None, width: int = 4, bits: int = 64, distinct: bool = False) -> bytes:
    """The fingerprint of one text. With ``distinct`` a repeated shingle counts once."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return bytes(bits // 8)
    h = _hashes(words, width)
    return majority(np.unique(h) if distinct else h, bits)


def fingerprints(docs: DataFrame, width: int = 4, bits: int = 64, distinct: bool = False) -> DataFrame:
    """``(doc_id, fp)``, ``fp`` the fingerprint's bytes."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(t.as_py(), width, bits, distinct) for t in b.column(1)], pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary")


def share_of_bits(similarity: float) -> float:
    """Of the bits that differ between texts whose shingle sets are large and have this Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def expected_diff(share: float, bits: int, deviations: float = 0.0) -> int:
    """Differing bits where this share of them differs, and so many standard deviations more."""
    return int(bits * share + deviations * sqrt(bits * share * (1 - share)))


def block_routes(bits: int, max_diff: int, blocks: int) -> list[list[int]]:
    """Bit places of each route; more blocks than ``max_diff + 1`` give more routes with longer keys."""
    if blocks <= max_diff:
        raise ValueError("blocks must exceed max_diff")
    cut = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(c).tolist() for c in combinations(cut, blocks - max_diff)]


def block_routes_for(n: int, bits: int, max_diff: int, rows: int = 2048) -> list[list[int]]:
    """The fewest such routes whose groups have ``rows`` of ``n`` rows on average; all of them lose no link."""
    blocks = max_diff + 1
    while blocks < bits and n >> (blocks - max_diff) * (bits // blocks) > rows:
        blocks += 1
    return block_routes(bits, max_diff, blocks)


def sampled_routes(bits: int, routes: int, key_bits: int) -> list[list[int]]:
    """Places drawn at random, none twice before all have been: fingerprints that differ in a share p of their bits
    meet in a route with probability ``(1 - p) ** key_bits``, and somewhere with ``1 - (1 - that) ** routes``."""
    r, whole = np.random.default_rng(SEED), bits // key_bits
    drawn = np.concatenate([r.permutation(bits)[: whole * key_bits] for _ in range(ceil(routes / whole))])
    return [sorted(x) for x in drawn.reshape(-1, key_bits)[:routes].tolist()]


def sampled_routes_for(n: int, bits: int, share: float, recall: float = 0.98, rows: int = 512) -> list[list[int]]:
    """Routes whose groups have ``rows`` of ``n`` rows on average and in which so many pairs meet that differ in this
    share of their bits."""
    key_bits = min(bits, max(8, ceil(log2(max(1, n) / rows))))
    meet = (1 - share) ** key_bits
    return sampled_routes(bits, ceil(log(1 - recall) / log(1 - meet)), key_bits)


def gray_order(fp: np.ndarray) -> list[np.ndarray]:
    """Sort keys, most significant first, that order rows of words by their place in the reflected Gray sequence."""
    keys, odd = [], np.zeros(len(fp), bool)
    for word in fp.T:
        x = word.copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        keys.append(np.where(odd, ~x, x))
        odd = odd ^ (np.bitwise_count(word) % 2 == 1)
    return keys


class Labels:
    """Row classes under growing links; a class is known by its smallest row. ``of`` may begin with classes."""

    def __init__(self, of: np.ndarray):
        self.of, self.changes = of, 0

    def link(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Joins the classes of each pair and gives the places of pairs that span what was joined."""
        left, used = np.arange(len(u)), []
        while True:
            a, b = self.of[u[left]], self.of[v[left]]
            apart = a != b
            left, a, b = left[apart], a[apart], b[apart]
            if not len(left):
                return np.concatenate(used) if used else left
            # each larger class joins one smaller, so the pairs make no ring
            high, one = np.unique(np.maximum(a, b), return_index=True)
            self.of[high] = np.minimum(a, b)[one]
            used.append(left[one])
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of[:] = up
            self.changes += 1


def near_rows(fp: np.ndarray, group: np.ndarray, max_diff: int, labels: Labels) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of pairs ``x < y`` of fingerprints (row, word) of one group that differ in at most ``max_diff`` bits and
    are not of one class. Rows come sorted by group, then Gray rank; the labels may grow between batches."""
    if len(fp) < 2:
        return
    low, high, of = [fp], [fp], [group]  # by level: bits set in all rows below, bits set in any, the group
    first: list[np.ndarray] = []  # first child of each node of the level above, and the end
    while True:
        g = of[-1]
        new = np.r_[True, g[1:] != g[:-1]]
        if new.all():
            break
        at = np.arange(len(g))
        begins = np.maximum.accumulate(np.where(new, at, 0))
        start = np.flatnonzero((at - begins) % FANOUT == 0)
        first.append(np.r_[start, len(g)])
        low.append(np.bitwise_and.reduceat(low[-1], start, axis=0))
        high.append(np.bitwise_or.reduceat(high[-1], start, axis=0))
        of.append(g[start])
    fixed = [~(a ^ b) for a, b in zip(low, high)]
    top = len(low) - 1
    if top == 0:
        return
    roots = np.arange(len(low[top]))
    stack = [(top, roots, roots, np.zeros(len(roots), np.int64))]
    seen = None
    while stack:
        level, a, b, so_far = stack.pop()
        if level == 1:
            if seen != labels.changes:
                seen, lowest, highest = labels.changes, np.minimum.reduceat(labels.of, first[0][:-1]), np.maximum.reduceat(labels.of, first[0][:-1])
            # rows already known to be of one class have nothing to add
            todo = ~((lowest[a] == highest[a]) & (lowest[b] == highest[b]) & (lowest[a] == lowest[b]))
            a, b, so_far = a[todo], b[todo], so_far[todo]
        if len(a) > (most := max(1, STEP // fp.shape[1] // FANOUT**2)):
            for k in range(0, len(a), most):
                stack.append((level, a[k : k + most], b[k : k + most], so_far[k : k + most]))
            continue
        begin, below = first[level - 1], level - 1
        n_b = begin[b + 1] - begin[b]
        each = (begin[a + 1] - begin[a]) * n_b
        parent = np.repeat(np.arange(len(a)), each)
        k = np.arange(len(parent)) - np.repeat(np.cumsum(each) - each, each)
        x, y = begin[a][parent] + k // n_b[parent], begin[b][parent] + k % n_b[parent]
        keep = (x < y) & (labels.of[x] != labels.of[y]) if below == 0 else (x <= y)
        x, y, parent = x[keep], y[keep], parent[keep]
        known = (fixed[level][a] & fixed[level][b])[parent]
        newly = fixed[below][x] & fixed[below][y] & ~known
        diff = so_far[parent] + np.bitwise_count((low[below][x] ^ low[below][y]) & newly).sum(axis=1, dtype=np.int64)
        keep = diff <= max_diff
        x, y, diff = x[keep], y[keep], diff[keep]
        if not len(x):
            continue
        if below:
            stack.append((below, x, y, diff))
        else:
            yield x, y


def linked_rows(fp: np.ndarray, group: np.ndarray, max_diff: int) -> np.ndarray:
    """The first row of each row's class among its group's links."""
    labels = Labels(np.arange(len(fp)))
    for x, y in near_rows(fp, group, max_diff, labels):
        labels.link(x, y)
    return labels.of


def _routed(classes: DataFrame, routes: list[list[int]], names: list[str]) -> DataFrame:
    """``route, key`` for each class and route, and with them the columns ``names``."""

    def run(batches):
        for b in batches:
            bit = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
            for r, places in enumerate(routes):
                key = bit[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))
                columns = [pa.array(np.full(b.num_rows, r, np.int32)), pa.array(key), *b.columns[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=["route", "key", *names])

    types = dict(classes.dtypes)
    return classes.select("fp", *names).mapInArrow(run, ", ".join(["route int, key long", *(f"{c} {types[c]}" for c in names)]))


def links(classes: DataFrame, max_diff: int, routes: list[list[int]], cell_rows: int = 4096) -> DataFrame:
    """``(a, b, sure)``: links between classes ``(class, fp)`` of distinct fingerprints that span what the links connect."""
    hot = _routed(classes, routes, []).groupBy("route", "key").count().where(F.col("count") > cell_rows)
    hot = written(hot.select("route", "key", F.ceil(F.col("count") / cell_rows).cast("int").alias("salts")), "groups")
    routed = _routed(classes, routes, ["class", "fp"]).join(hot, ["route", "key"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return linked(routed, max_diff)


def linked(routed: DataFrame, max_diff: int, sure: int = -1, ratio: float = 0.0) -> DataFrame:
    """The same for rows ``route, key, salts, class, fp`` whose groups are route and key, dealt into cells of two salts
    each; links of at most ``sure`` bits are taken first. With ``ratio`` rows have a ``size``, and those link of which the
    smaller is at least so many times the other."""
    names = ["class", "fp"] + ["size"] * (ratio > 0)
    cells = (
        routed.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("salts").cast("long")).cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("route", "key", (F.least("s", "t") * F.col("salts") + F.greatest("s", "t")).alias("cell"), *names)
    )

    def run(batches):
        for t in whole_groups(batches, 3):
            route, key, cell, cls = (t.column(i).to_numpy() for i in range(4))
            fp = np.frombuffer(b"".join(t.column(4).to_pylist()), ">u8").reshape(len(cls), -1).astype(np.uint64)
            order = np.lexsort((*gray_order(fp)[::-1], cell, key, route))
            route, key, cell, cls, fp = (x[order] for x in (route, key, cell, cls, fp))
            size = t.column("size").to_numpy()[order] if ratio else None
            group = np.cumsum(np.r_[0, (route[1:] != route[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
            _, begins, place = np.unique(cls, return_index=True, return_inverse=True)
            labels = Labels(begins[place])
            for limit in (sure, max_diff) if sure >= 0 else (max_diff,):
                for x, y in near_rows(fp, group, limit, labels):
                    if ratio:
                        fit = np.minimum(size[x], size[y]) >= ratio * np.maximum(size[x], size[y])
                        x, y = x[fit], y[fit]
                    one = labels.link(x, y)
                    a, b = cls[x[one]], cls[y[one]]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(one), limit == sure))], names=["a", "b", "sure"])

    by = ["route", "key", "cell"]
    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long, sure boolean").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 64, max_diff: int = 4, distinct: bool = False, routes: Callable[[int], list[list[int]]] | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: ``component_id`` is the smallest ``doc_id`` reachable by links.
    ``routes`` gets the number of different fingerprints; without it those are taken that lose no link."""
    fps = written(fingerprints(docs, width, bits, distinct), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "distinct")
    n = classes.count()
    found = components(links(classes, max_diff, routes(n) if routes else block_routes_for(n, bits, max_diff)))
    named = classes.join(found, F.col("class") == found.node, "left").select("fp", "first_id", F.coalesce("component", "class").alias("component"))
    named = written(named, "named")
    smallest = written(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    by_fp = written(named.join(smallest, "component").select("fp", "component_id"), "classes")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
