"""Postings as spans: up to ``width`` consecutive k-mers of a sequence whose least m-mer is the same one.

A span is one row: ``kmer_min`` (that m-mer, a number), ``off`` (where it begins in the span), ``n`` (k-mers), ``bases`` (the
number of their symbols), ``pos`` of the first and ``ref_id``. Which m-mer is a k-mer's least follows from the k-mer alone, so
all postings of a k-mer lie under one ``kmer_min``, and in a span the k-mer can stand in one place only. Bases that k-mers
share are held once, so a span takes a fraction of the space of its postings; each can be had back (``expanded``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sequence as S

#: Columns of a span beside those that say where it is.
SPAN = ["kmer_min", "bases", "n", "off"]


def width(k: int) -> int:
    """M-mers in a k-mer, and k-mers in a span at most. Wider spans are fewer, but more of them share a least m-mer, and all of
    those are looked at for a k-mer."""
    return min(6, k // 2 + 1)


def least_length(k: int) -> int:
    return k - width(k) + 1


def rank(mmer: np.ndarray) -> np.ndarray:
    """The order of m-mers, below 2^31: scattered, so that the frequent ones are seldom the least."""
    return ((mmer.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(1)).astype(np.int64)


def spans_of(code: np.ndarray, k: int, sigma: int = 4, share: tuple[int, int] | None = None) -> tuple[np.ndarray, ...]:
    """``i, kmer_min, bases, n, off`` of an array of codes, ``i`` being the place of the first k-mer; of a share ``(r, of)``
    those whose least m-mers fall to it."""
    w, kmer = width(k), S.kmers_of(code, k, sigma)
    mmer = S.kmers_of(code, least_length(k), sigma)
    at = S.leftmost_minima(rank(mmer), w) if len(kmer) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(kmer) else at
    n = np.diff(np.r_[first, len(kmer)])
    if share:
        own = rank(mmer[at[first]]) // 8 % share[1] == share[0]
        first, n = first[own], n[own]
    high = np.int64(sigma) ** (n - 1)
    bases = kmer[first] * high + kmer[first + n - 1] % high
    return first.astype(np.int32), mmer[at[first]], bases, n.astype(np.int8), (at[first] - first).astype(np.int8)


def span_rows(pieces: DataFrame, k: int, reverse: bool | str = False, encoder: str = "dna", sigma: int = 4, share: tuple[int, int] | None = None) -> DataFrame:
    """The spans of every ``piece``, as ``sequence.kmer_rows`` has its k-mers."""
    kinds = T.StructType().add("i", T.IntegerType()).add("kmer_min", T.IntegerType()).add("bases", T.LongType()).add("n", T.ByteType()).add("off", T.ByteType())
    return S.piece_rows(pieces, kinds, lambda code: spans_of(code, k, sigma, share), reverse, encoder)


def with_least(rows: DataFrame, k: int, sigma: int = 4) -> DataFrame:
    """``rows`` with the least m-mer of their ``kmer`` as ``kmer_min`` and where it begins as ``at``."""
    w = width(k)

    def run(batches):
        for b in batches:
            kmer = b.column("kmer").to_numpy().astype(np.int64)
            mmer = np.stack([kmer // sigma ** (w - 1 - i) % sigma ** least_length(k) for i in range(w)])
            at = np.argmin(rank(mmer), axis=0)  # the leftmost of equals
            least = mmer[at, np.arange(len(kmer))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least), pa.array(at.astype(np.int8))], names=[*b.schema.names, "kmer_min", "at"])

    schema = T.StructType([*rows.schema.fields, T.StructField("kmer_min", T.IntegerType()), T.StructField("at", T.ByteType())])
    return rows.mapInArrow(run, schema)


def kmer_at(i: Column, k: int, sigma: int = 4) -> Column:
    """The k-mer at place ``i`` of a span, null where it has none."""
    powers = F.array(*[F.lit(sigma**j).cast("long") for j in range(width(k))])
    high = F.get(powers, F.when((i >= 0) & (i < F.col("n")), (F.col("n") - 1 - i).cast("int")))
    return F.call_function("div", F.col("bases"), high) % F.lit(sigma**k)


def first_bases(k: int, sigma: int = 4) -> Column:
    """The highest 32 bits that a span's ``bases`` can have: in their order equal spans lie together."""
    bits = (sigma ** (k + width(k) - 1) - 1).bit_length()
    return F.shiftright("bases", max(0, bits - 32))


def expanded(rows: DataFrame, k: int, sigma: int = 4) -> DataFrame:
    """``kmer, ref_id, pos, kmer_min, at`` and any other columns of each posting of spans."""
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    others = [c for c in rows.columns if c not in (*SPAN, "ref_id", "pos")]
    at = (F.col("off") - F.col("i")).cast("byte").alias("at")
    return each.select(kmer_at(F.col("i"), k, sigma).cast("int").alias("kmer"), "ref_id", (F.col("pos") + F.col("i")).alias("pos"), "kmer_min", at, *others)


def lone(rows: DataFrame) -> DataFrame:
    """Postings as of ``expanded`` as spans of one k-mer each."""
    others = [c for c in rows.columns if c not in ("kmer", "ref_id", "pos", "kmer_min", "at")]
    return rows.select("kmer_min", F.col("kmer").cast("long").alias("bases"), F.lit(1).cast("byte").alias("n"), F.col("at").alias("off"), "ref_id", "pos", *others)
