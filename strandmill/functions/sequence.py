"""Column functions on sequences, k-mers and postings.

Any byte is a base: its code is bits 1 and 2, so A, C, T, G are 0 to 3 in either case and N is 3. Quantised signals
are sequences too: texts of one hexadecimal digit per sample, whose codes are the digits' values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code of each low hexadecimal digit, and the letters and complements of the codes 0 to 3.
CODE_OF_HEX = ("0123456789ABCDEF", "0011223300112233")
LETTERS, COMPLEMENT_CODES = "ACTG", "2301"

#: K-mers that one stretch of a sequence has at most.
STRETCH = 1 << 20
#: K-mers that an Arrow batch has at most, and bytes of those pieces whose k-mers are held at once, or one piece.
BATCH = 1 << 18


def base_code(c: Column) -> Column:
    """The code of a one-byte character."""
    return F.shiftright(F.ascii(c), 1).bitwiseAND(F.lit(3))


def codes(seq: Column) -> Column:
    """All bytes' codes as a string of the digits 0 to 3."""
    low = F.regexp_replace(F.hex(F.encode(seq, "UTF-8")), ".(.)", "$1")
    return F.translate(low, *CODE_OF_HEX)


def complement(code_string: Column) -> Column:
    """Codes of the reverse complement."""
    return F.translate(F.reverse(code_string), "0123", COMPLEMENT_CODES)


def revcomp(seq: Column) -> Column:
    """The reverse complement in capital letters."""
    return F.translate(complement(codes(seq)), "0123", LETTERS)


def encode_kmer(code_string: Column, start, k: int, sigma: int = 4) -> Column:
    """The k-mer at ``start`` (from 0), first code most significant."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.conv(F.substr(code_string, start + 1, F.lit(k)), sigma, 10).cast("int")


def ipow(base: int, exponent: Column) -> Column:
    """``base`` to a power from 0, in whole numbers."""
    return F.aggregate(F.array_repeat(F.lit(base).cast("long"), exponent.cast("int")), F.lit(1).cast("long"), lambda a, b: a * b)


def pack_posting(ref_id: Column, pos: Column) -> Column:
    return F.shiftleft(ref_id.cast("long"), 44).bitwiseOR(pos.cast("long"))


def posting_ref(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 44)


def posting_pos(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << 44) - 1).cast("long"))


def shard(kmer: Column, bits: int) -> Column:
    return kmer.bitwiseAND(F.lit((1 << bits) - 1))


def shard_key(kmer: Column, bits: int) -> Column:
    return F.shiftright(kmer, bits)


def make64(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def high32(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def xxh64(x: Column) -> Column:
    """XXH64 of the eight bytes of a number, seed 42."""
    return F.xxhash64(x.cast("long"))


def diagonal_bin(pos: Column, j: Column, bw: int) -> Column:
    return F.floor(F.greatest(pos - j, F.lit(0)) / bw).cast("long")


def picoamps(raw: Column, digitisation: Column, offset: Column, range_: Column) -> Column:
    return (raw + offset) * (range_ / digitisation)


def rank_in(edges: Column, x: Column) -> Column:
    """How many of ``edges`` lie below ``x``: the first place where ``x`` could stand."""
    return F.size(F.filter(edges, lambda e: e < x))


def symbol_text(symbols: Column) -> Column:
    """Symbols from 0 to 15 as a text of one digit each."""
    return F.lower(F.array_join(F.transform(symbols, lambda s: F.hex(s.cast("long"))), ""))


def byte_codes(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, np.uint8) >> 1) & 3


def digit_codes(raw: bytes) -> np.ndarray:
    """Values of hexadecimal digits; letters lie above 63 and begin with 1."""
    b = np.frombuffer(raw, np.uint8)
    return (b & 15) + 9 * (b >> 6)


#: How the bytes of a sequence become codes.
ENCODERS = {"dna": byte_codes, "symbols": digit_codes}


def kmers_of(code: np.ndarray, k: int, sigma: int = 4) -> np.ndarray:
    """All k-mers of an array of codes, none if it is shorter than k; the lengths that k has in binary are joined."""
    n = len(code) - k + 1
    if n < 1:
        return np.zeros(0, np.int32)
    part, size, out, length = code.astype(np.int32), 1, None, 0
    while True:
        if k & size:
            out, length = (part, size) if out is None else (part[: len(part) - length] * np.int32(sigma**length) + out[size:], length + size)
        if length == k:
            return out
        part = part[: len(part) - size] * np.int32(sigma**size) + part[size:]
        size *= 2


def grouped(pieces: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``pieces`` (bytes) in groups of at most ``BATCH`` bytes, or of one: the first one's place, and each as an array."""
    first, held, size = 0, [], 0
    for row, piece in enumerate(pieces):
        piece = np.frombuffer(piece.as_buffer(), np.uint8)
        if held and size + len(piece) > BATCH:
            yield first, held
            first, held, size = row, [], 0
        held.append(piece)
        size += len(piece)
    if held:
        yield first, held


def kmer_rows(pieces: DataFrame, k: int, reverse: bool | str = False, encoder: str = "dna", sigma: int = 4) -> DataFrame:
    """Every k-mer of every ``piece`` (bytes), or of its reverse complement (a column's name: where that is true): the other
    columns, the place ``i`` in the piece and ``kmer``. Batches are bounded by k-mers, not by pieces, so a worker's memory doesn't grow with its task."""
    kinds = T.StructType().add("i", T.IntegerType()).add("kmer", T.IntegerType())

    def made(code):
        kmer = kmers_of(code, k, sigma)
        return np.arange(len(kmer), dtype=np.int32), kmer

    return piece_rows(pieces, kinds, made, reverse, encoder)


def piece_rows(pieces: DataFrame, kinds: T.StructType, made: Callable[[np.ndarray], tuple[np.ndarray, ...]], reverse: bool | str = False, encoder: str = "dna") -> DataFrame:
    """``kmer_rows``, with other rows ``made`` of a piece's codes: an array for each column of ``kinds``."""
    if reverse and encoder != "dna":
        raise ValueError("only bases have a complement")
    encode, kept, names = ENCODERS[encoder], [c for c in pieces.columns if c != "piece"], kinds.names
    schema = T.StructType([*pieces.select(*kept).schema.fields, *kinds.fields])

    def run(batches):
        for b in batches:
            others = b.select(kept).columns
            back = b.column(reverse).to_pylist() if isinstance(reverse, str) else [reverse] * b.num_rows
            for first, held in grouped(b.column("piece")):
                found = [made(c[::-1] ^ 2 if r else c) for c, r in zip(map(encode, held), back[first:])]
                rows = np.repeat(np.arange(first, first + len(held)), [len(f[0]) for f in found])
                columns = [np.concatenate(c) for c in zip(*found)]
                for at in range(0, len(rows), BATCH):
                    here = slice(at, at + BATCH)
                    row = pa.array(rows[here])
                    yield pa.RecordBatch.from_arrays([*(c.take(row) for c in others), *(pa.array(c[here]) for c in columns)], names=[*kept, *names])

    return pieces.select(*kept, "piece").mapInArrow(run, schema)


def leftmost_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``w`` consecutive keys, which are below 2^31."""
    least = keys.astype(np.int64) << 32 | np.arange(len(keys))
    reach = 1
    while reach < w:
        step = min(reach, w - reach)
        least = np.minimum(least[: max(0, len(least) - step)], least[step:])
        reach += step
    return least & 0xFFFFFFFF


def kmers(seq: Column, k: int, reverse: bool = False, encoder: str = "dna", sigma: int = 4) -> Column:
    """All k-mers of a sequence (text or bytes), or of its reverse complement, as an array in order of position. In
    time linear in the sequence's length, which substrings of one long string are not."""
    if reverse and encoder != "dna":
        raise ValueError("only bases have a complement")
    encode = ENCODERS[encoder]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            c = encode(t if isinstance(t, bytes) else t.encode("utf-8", "replace"))
            return kmers_of(c[::-1] ^ 2 if reverse else c, k, sigma)

        return texts.map(one)

    return run(seq)


def stretches(rows: DataFrame, k: int, size: int | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """``rows`` with ``seq`` cut into ``piece``s (bytes) of ``size`` k-mers, which begin at byte ``at`` and overlap by
    k - 1 bytes, so that each k-mer lies in exactly one; pieces of one sequence can go to different tasks. A piece has
    ``before`` and ``after`` more bytes on its sides where there are so many. Null sequences have none, sequences that are
    too short for a k-mer have one."""
    size = size or STRETCH
    last = F.greatest(F.octet_length("seq") - k, F.lit(0))
    cut = rows.where(F.col("seq").isNotNull()).withColumn("at", F.explode(F.sequence(F.lit(0), last, F.lit(size))))
    begin = F.greatest(F.col("at") - before, F.lit(0))
    return cut.withColumn("piece", F.substring(F.col("seq").cast("binary"), begin + 1, F.col("at") - begin + F.lit(size + k - 1 + after))).drop("seq")
