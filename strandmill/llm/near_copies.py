"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more link.

SimHash fingerprints of ``BITS`` bits propose pairs through the Gray-order index, and the whole sets, made from the
texts, decide. Rows of equal sets are one node, so copies are never expanded into pairs. The index's routes are ``BANDS``
bands of ``BAND`` minimum hashes of the sets each: sets of similarity s share a band's key with probability ``s ** BAND``,
so 999 of 1,000 pairs at 0.8 meet, more of closer ones, and unlike sets don't, however many there are. Bands and key
length are the same at every size. Keys and node numbers alone are dealt out first; keys of a single node, which are most,
end there, and fingerprints join what is left. In a group pairs are proposed that differ in no more than ``DEVIATIONS``
standard deviations over what is expected at 0.8 (all but one of 30,000). Sets of few shingles lie further apart, so
``SIZES`` gives the share of differing bits by size; sets of under four shingles are alike only where they are equal.

Only a spanning forest of the proposed pairs leaves the search, surely alike ones first. Those are checked one by one.
What the forest connects is a group; where a group holds several classes of checked links, the sets of its largest class
and of all others meet block by block, and every pair of different classes is compared. So groups of any size give no
more rows than sets and blocks, and no pair of a group is missed for the sake of another.

Defined results: null and empty texts have equal sets; a text of fewer words than a shingle has one shingle, the whole.
Shingles are known by 64-bit hashes, sets by 128-bit ones of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, components, drop_written, written
from .simhash import SEED, Labels, expected_diff, linked, majority

WIDTH, SIMILARITY = 5, 0.8
BITS, DEVIATIONS = 1024, 4.0
BANDS, BAND = 14, 4
#: Shingles whose minimum hashes are computed at once.
STEP = 4096
#: Sizes from, to (exclusive), and the most of their bits that differ on average between sets that link. Four shingles
#: that are 2 to 2 and a fifth against them: 6/16 / 2; 12 of 15 shingles and larger sets: less than 0.162.
SIZES = ((4, 6, 0.1875), (5, 1 << 62, 0.162))
#: Rows, of 8 bytes, that a join broadcasts at most.
BROADCAST_ROWS = 1_000_000
#: Sets and shingles of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def memory() -> Recent:
    """Hashes of frequent words."""
    return Recent(100_000, 40, lambda w: xxhash.xxh64_intdigest(w, SEED))


def shingle_set(text: str | None, known: Recent) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WIDTH + 1)
    out = np.full(n, SEED, np.uint64)
    for i in range(min(WIDTH, len(h))):
        out = ((out ^ out >> np.uint64(29)) + h[i : i + n]) * _STEP
    return np.unique(out ^ out >> np.uint64(32))


def node_of(own: np.ndarray) -> bytes:
    """What rows of equal sets have in common."""
    return xxhash.xxh3_128_digest(own.tobytes(), len(own))


def band_keys(own: np.ndarray) -> list[int]:
    """One key for each band: a hash of the band's minimum hashes over the set."""
    salt = np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for at in range(0, len(own), STEP):
        x = (own[at : at + STEP, None] ^ salt) * _STEP
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (x ^ x >> np.uint64(29)).min(axis=0))
    return [xxhash.xxh64_intdigest(b.tobytes(), SEED) - (1 << 63) for b in least.reshape(BANDS, BAND)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is 0.8 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


def _slices(batches, rows: int = 256):
    """Batches in parts, which bound what a worker holds."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _nodes(docs: DataFrame, names: list[str]) -> DataFrame:
    """``node, size, fp, keys, least``: different sets, numbered, and the smallest row of each by ``names``."""

    def run(batches):
        known = memory()
        for b in _slices(batches):
            own = [shingle_set(t, known) for t in b.column(0).to_pylist()]
            made = [
                pa.array([node_of(s) for s in own], pa.binary()), pa.array([len(s) for s in own], pa.int64()),
                pa.array([majority(s, BITS) for s in own], pa.binary()), pa.array([band_keys(s) for s in own], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(made + b.columns[1:], names=["digest", "size", "fp", "keys", *names])

    rows = docs.select(F.col("text").cast("string"), *names)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    rows = rows.mapInArrow(run, f"digest binary, size long, fp binary, keys array<long>, {types}")
    met = rows.groupBy("digest").agg(F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min(F.struct(*names)).alias("least"))
    return met.drop("digest").withColumn("node", F.monotonically_increasing_id())


def _sets(docs: DataFrame, row: str, nodes: DataFrame) -> DataFrame:
    """``node, own`` of some nodes, made from the texts of their least rows."""

    def run(batches):
        known = memory()
        for b in _slices(batches):
            own = [shingle_set(t, known) for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "own"])

    wanted = nodes.select(F.col(f"least.{row}").alias(row), "node")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(row, F.col("text").cast("string").alias("text")).join(wanted, row).dropDuplicates([row])
    return texts.select("text", "node").mapInArrow(run, "node long, own binary")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose whole sets are alike."""

    def run(batches):
        for b in _slices(batches):
            x, y = (b.column(i).to_pylist() for i in (2, 3))
            ok = pa.array([alike(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)) for u, v in zip(x, y)], pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked_sets(own: list[np.ndarray], label: np.ndarray, first: np.ndarray):
    """Pairs of rows that are alike and span what such pairs of different labels connect. Rows not in ``first`` are not
    compared with each other."""
    size = np.array([len(s) for s in own])
    names, place = np.unique(np.concatenate(own), return_inverse=True)
    begins = np.r_[0, np.cumsum(size)[:-1]]
    _, at, of = np.unique(label, return_index=True, return_inverse=True)
    labels, mark = Labels(at[of]), np.zeros(len(names), bool)
    for u in np.flatnonzero(first):
        if (labels.of == labels.of[u]).all():
            continue
        mine = place[begins[u] : begins[u] + size[u]]
        mark[mine] = True
        shared = np.add.reduceat(mark[place], begins, dtype=np.int64)
        mark[mine] = False
        v = np.flatnonzero(9 * shared >= 4 * (size + size[u]))
        one = labels.link(np.full(len(v), u), v)
        for k in v[one]:
            yield u, k


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: links between different labels of a group, from ``members`` (``node, size, group, label``)."""
    by = members.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    parts = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    plan = by.groupBy("group").agg(F.max(F.struct("n", "shingles", "label")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("n > main.n")
    plan = written(plan.select("group", F.col("main.label").alias("main"), parts(F.col("main.n"), F.col("main.shingles")).alias("mains"), parts(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("others")), "plan")
    dealt = members.join(plan, "group").withColumn("first", F.col("label") != F.col("main"))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("node"), F.when(F.col("first"), F.col("others")).otherwise(F.col("mains")).cast("long")).cast("int"))
    # all others meet each other and all of the main label; blocks of that come behind those of the others
    dealt = dealt.withColumn("t", F.explode(F.when(F.col("first"), F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") - 1))))
    dealt = dealt.withColumn("s", F.when(F.col("first"), F.col("s")).otherwise(F.col("others") + F.col("s")))
    cells = dealt.select("group", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"), "node", "label", "first").join(sets, "node")

    def run(batches):
        group: list = []
        cell = None
        for b in _slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != cell:
                    yield from found(group)
                    cell, group = row[:3], []
                group.append(row[3:])
        yield from found(group)

    def found(group):
        if len(group) > 1:
            node, label, first, own = zip(*group)
            pairs = list(linked_sets([np.frombuffer(x, np.uint64) for x in own], np.array(label), np.array(first)))
            if pairs:
                yield pa.record_batch([pa.array([node[u] for u, _ in pairs], pa.int64()), pa.array([node[v] for _, v in pairs], pa.int64())], names=["a", "b"])

    cells = cells.select("group", "x", "y", "node", "label", "first", "own").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")
    return cells.mapInArrow(run, "a long, b long")


def _routed(nodes: DataFrame, cell_rows: int) -> DataFrame:
    """``route, key, salts, class, fp, size`` of the nodes that share a band's key with another."""
    keys = nodes.where(F.col("size") >= SIZES[0][0]).select("node", F.posexplode("keys").alias("route", "key"))
    shared = keys.groupBy("route", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared.select("route", "key", F.ceil(F.col("n") / cell_rows).cast("int").alias("salts")), "groups")
    met = keys.join(shared, ["route", "key"]).select("route", "key", "salts", "node")
    return met.join(nodes.select("node", "fp", "size"), "node").select("route", "key", "salts", F.col("node").alias("class"), "fp", "size")


def classes(docs: DataFrame, row: str, order: list[str], cell_rows: int = 4096) -> DataFrame:
    """``first``: of each class of near copies of ``docs`` (with ``text``), the ``row`` of the row that is smallest by the
    columns ``order``. ``row`` is something that only equal rows share."""
    nodes = written(_nodes(docs, list(dict.fromkeys([*order, row]))), "nodes")
    routed = written(_routed(nodes, cell_rows), "routed")
    proposed = None
    for low, high, share in SIZES:
        sure, most = (expected_diff(share, BITS, d) for d in (-DEVIATIONS, DEVIATIONS))
        found = linked(routed.where((F.col("size") >= low) & (F.col("size") < high)), most, sure, SIMILARITY)
        proposed = found if proposed is None else proposed.unionByName(found)
    proposed = written(proposed, "proposed")
    drop_written(routed)
    groups = written(components(proposed).select("node", F.col("component").alias("group")).distinct(), "met")
    met = written(nodes.join(groups, "node"), "members")
    sets = written(_sets(docs, row, met), "sets")
    sure = written(_checked(proposed.where("sure").select("a", "b").distinct(), sets), "links")
    labels = components(sure).distinct()
    members = met.select("node", "size", "group").join(labels, "node", "left").select("node", "size", "group", F.coalesce("component", "node").alias("label"))
    more = written(_blocks(written(members, "labelled"), sets), "links")
    drop_written(sets)
    found = written(components(sure.unionByName(more)).distinct(), "components")
    ids = nodes.select("node", "least").join(found, "node", "left").withColumn("node", F.coalesce("component", "node"))
    return ids.groupBy("node").agg(F.min("least").alias("least")).select(F.col(f"least.{row}").alias("first"))
