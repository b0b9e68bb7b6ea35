"""Mixing of sources to target weights: exact length counts and subset sums choose how much of each document to take.

Targets: the sources, in code-point order with null last, have the given weights in turn and share ``share`` times
all words; no target passes ``most`` times its source's words, and what is over goes to the others by weight until
none is above. With the sources ordered by ``most * words / weight``, the capped ones are a prefix of that order, so
running sums give the common level at once.

Choice: every document is taken as often as the target holds the whole source; for the rest, documents are counted
by exact word count. Each count gives the same share of its documents, rounded down; then counts, in seeded order,
give one more each, and then as many as fit, until ``KEEP`` words or fewer are missing or no document fits;
bounded-knapsack dynamic programming over what is left finds the reachable sum nearest to the target from below. Within a count, documents are chosen by their rank
in a seeded hash order, which no task computes for a whole count. What a task holds is one source's histogram:
one row for each different word count.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source; sources without
words have target 0; documents with a null ``doc_id`` and repeated rows count and are chosen like others (equal
rows are interchangeable); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators.index import running
from .common import salted_rank, written

#: Words that the dynamic programming fits at most.
KEEP = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (``counts`` at most) come nearest to ``budget`` from below."""
    take = np.zeros(len(sizes), np.int64)
    if budget <= 0 or not len(sizes):
        return take
    by = np.full(budget + 1, -1, np.int64)  # the bundle that first reached a sum
    by[0] = 0
    bundles = [(0, 0)]
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist())):
        count, part = min(count, budget // size), 1
        while count > 0:
            n = min(part, count)
            new = (by[: budget + 1 - n * size] >= 0) & (by[n * size :] < 0)
            by[n * size :][new] = len(bundles)
            bundles.append((i, n))
            count, part = count - n, part * 2
        if by[budget] >= 0:
            break
    at = int(np.flatnonzero(by >= 0)[-1])
    while at:
        i, n = bundles[by[at]]
        take[i] += n
        at -= n * int(sizes[i])
    return take


def choose(sizes: np.ndarray, counts: np.ndarray, target: int, seed: int) -> tuple[int, np.ndarray]:
    """``(base, extra)``: all documents ``base`` times, and of each size ``extra`` documents once more."""
    none = np.zeros(len(sizes), np.int64)
    total = sum(int(s) * int(n) for s, n in zip(sizes, counts))
    if total == 0:
        return 0, none
    base, rest = divmod(target, total)
    if rest == 0:
        return base, none
    extra = np.array([int(n) * rest // total if s else 0 for s, n in zip(sizes, counts)], np.int64)
    missing = rest - sum(int(s) * int(n) for s, n in zip(sizes, extra))
    order = np.random.default_rng(seed).permutation(len(sizes))
    for most in (1, None):
        for i in order:
            if missing <= KEEP:
                break
            size, left = int(sizes[i]), int(counts[i] - extra[i])
            if size:
                n = min(left, missing // size, most or -((KEEP - missing) // size))
                extra[i] += n
                missing -= n * size
    open_ = order[(sizes[order] > 0) & (sizes[order] <= missing) & (extra[order] < counts[order])]
    extra[open_] += subset_sum(sizes[open_], (counts - extra)[open_], missing)
    return base, extra


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source. Sources are numbered and
    summed over all tasks; what the driver sees is the sums and the common level."""
    by_name = [F.col("source").isNull().alias("_none"), "source"]
    numbered = running(totals.select(*by_name, "source_size"), ["_none", "source"], place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    w = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    w = running(w.withColumn("level", F.col("cap") / F.col("weight")), ["level", "_none", "source"], capped="cap", weighed="weight")
    words, weighed = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    common = (F.lit(words * float(share)) - F.col("capped")) / (F.lit(weighed) - F.col("weighed"))
    # the first source whose cap is not below the common level of it and all after it ends the capped prefix
    first = w.withColumn("common", common).agg(F.min(F.when(F.col("level") >= F.col("common"), F.struct("level", "common")))["common"]).first()[0]
    level = F.col("level") if first is None else F.lit(first)
    return w.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per document; ``taken`` counts words, repeats included.
    ``doc_id`` may be a number or bytes."""
    doc_id = F.col("doc_id") if isinstance(docs.schema["doc_id"].dataType, BinaryType) else F.col("doc_id").cast("long").alias("doc_id")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(doc_id, F.col("source").cast("string").alias("source"), size.alias("size"))
    sized = written(sized.withColumn("at", F.monotonically_increasing_id()), "sizes")
    histogram = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = written(targets(totals, weights, share, most), "targets")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        base, extra = choose(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(pdf["target"].iloc[0]), seed)
        return pdf[["source", "size", "source_size", "target"]].assign(base=base, extra=extra)

    plan = (
        histogram.alias("h").join(goal.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source")))
        .select("h.source", "h.size", "h.n", "g.source_size", "g.target")
        .groupBy("source").applyInPandas(pick, "source string, size long, source_size long, target double, base long, extra long")
    )
    ranked = salted_rank(sized, ["source", "size"], ["doc_id"], "at", seed)
    return (
        ranked.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
        .select("doc_id", "d.size", "source_size", "target", (F.col("d.size") * (F.col("base") + (F.col("rank") < F.col("extra")).cast("long"))).alias("taken"))
    )
