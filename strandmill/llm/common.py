"""Helpers that several operators share: bounded memories, skew-proof ranks and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_written, new_path, written

__all__ = ["Recent", "components", "drop_written", "new_path", "salted_rank", "whole_groups", "written"]


def whole_groups(batches, keys: int, rows: int = 1 << 13):
    """Arrow batches of a sorted partition as tables of about ``rows`` rows that cut no group, a group being rows of equal
    first ``keys`` columns (numbers). So a worker holds some groups, and no partition."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(n - 1, bool)
        for c in table.columns[:keys]:
            new |= np.diff(c.to_numpy()) != 0
        cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Recent(dict):
    """A bounded memory of ``make(key)``: two tables of ``most`` keys, the older of which goes when the newer is
    full, so that keys in frequent use stay. Keys longer than ``longest`` are made anew each time."""

    def __init__(self, most: int, longest: int, make):
        self.most, self.longest, self.make, self.old = most, longest, make, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def salted_rank(df: DataFrame, keys: list[str], alike: list[str], at: str, seed: int = 0, name: str = "rank", per_task: int = 500) -> DataFrame:
    """Adds ``name``: each row's number (from 0) among the rows of its ``keys``, without gaps. ``at`` is a number that
    no two rows of ``df``, a written table, share.

    A key of any size is dealt by a hash of ``alike`` into groups of about ``per_task`` rows, and rows that are equal in
    ``alike``, if more than that, by ``at`` into groups of their own. Rows are numbered within a group, and a table of
    group sizes gives each group its first number. No task gets a whole key, nor all equal rows. Which numbers the
    rows of equal ``alike`` have depends on the rows alone, so reruns and retries agree on them.
    """
    null_safe = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    hashed = F.xxhash64(F.lit(seed), *alike)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > per_task).select(*keys, F.ceil(F.col("_n") / per_task).alias("_parts"))
    same = df.groupBy(*keys, *alike).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_task)
    same = same.select(*keys, *alike, F.ceil(F.col("_n") / per_task).alias("_own"), hashed.alias("_hash"))
    dealt = df.alias("d").join(large.alias("h"), null_safe("d", "h", keys), "left").join(same.alias("s"), null_safe("d", "s", keys + alike), "left")
    # groups are known by their hash part or by the hash of their equal rows, and a number among those
    part = F.when(F.col("s._own").isNull(), F.pmod(F.xxhash64(F.lit(seed), *[f"d.{c}" for c in alike]), F.coalesce("h._parts", F.lit(1)))).otherwise(F.col("s._hash"))
    number = F.when(F.col("s._own").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(f"d.{at}"), F.col("s._own")))
    dealt = dealt.select("d.*", part.alias("_part"), number.cast("long").alias("_no"))
    group = [*keys, "_part", "_no"]
    order = [F.xxhash64(F.lit(seed), *alike), *alike, at]
    dealt = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    counts = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part", "_no").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # groups that come first of their key need no row of the table
    before = before.where("_before > 0").select(*group, "_before")
    out = dealt.alias("d").join(before.alias("b"), [*null_safe("d", "b", keys), F.col("d._part") == F.col("b._part"), F.col("d._no") == F.col("b._no")], "left")
    return out.select("d.*", (F.col("d._in") + F.coalesce(F.col("b._before"), F.lit(0))).alias(name)).drop("_part", "_no", "_in")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)``: the smallest node that each reaches.

    Alternates large-star and small-star steps: each round is joins and minimum aggregates over the edge table,
    which is written between rounds; a star's hot centre is split by the adaptive skew join. Ends when a round
    leaves the edges as they were.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = written(small, "edges")
        drop_written(e)
        e, was, mark = after, mark, _mark(after)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
