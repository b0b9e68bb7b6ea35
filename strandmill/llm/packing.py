"""Packing of tokenized documents into fixed-length sequences by shortest-pack-first over the length histogram.

A document's ids are cut into full pieces of the sequence length, which are sequences by themselves, and a rest.
The rests' length histogram (at most ``seq_len - 1`` rows, whatever the corpus) goes to the driver; lengths are
placed longest first, each into the packs with the most room left, and only counts of packing patterns change. The
patterns come back as slots: for a length, the range of ranks that a pattern takes, its first sequence and offset.
Pieces get a rank within their length without any task seeing a whole length, and find their slot by a join.

Size of the broadcast slot table: each length opens at most one pattern and splits at most one, so there are at most
``2 * seq_len`` patterns, and a pattern has at most ``sqrt(2 * seq_len)`` different lengths: 262,144 rows of 40 bytes
at 2048, for any corpus.

Tokenizing: the tokenizer drops white space and treats what stands between spaces by itself, so each run of
non-space bytes is encoded once per worker while it is remembered, and a document's ids are the runs' ids in order.

Defined results: null and empty texts are the end id alone; any length of text is taken whole; pieces with a null
``doc_id`` are packed as well; repeated rows are packed as often as they occur; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, salted_rank, written

#: Runs of up to so many bytes are remembered, twice so many per worker.
REMEMBER_BYTES, REMEMBER = 40, 300_000
# small letters of ASCII and Latin-1
_plain = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# marks at the end of a run, after such a letter or an ASCII digit
_closing = re.compile(rb"[.,!?;:#$%&*|](?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))[.,!?;:#$%&*|]*(?!\S)")
# Byte-level BPE's signs for the bytes of those letters that don't stand for themselves.
_byte_signs = {0x9F: 321, 0xA0: 322, 0xAD: 323}


class RunEncoder:
    """Token ids of whole texts, as bytes of little-endian unsigned 32-bit numbers.

    A text is lower-cased first where that changes nothing (the tokenizer does so itself, but finds its special
    tokens before), and marks that end a run after a letter or digit are set off, where the tokenizer splits anyway:
    fewer different runs are left.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.known = Recent(REMEMBER, REMEMBER_BYTES, self._encode)

    def _encode(self, run: bytes) -> bytes:
        if _plain.fullmatch(run):  # the tokenizer's normalizing and splitting leave it whole
            found = [t.id for t in self.tokenizer.model.tokenize(run.decode("latin-1").translate(_byte_signs))]
        else:
            found = self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids
        ids = array("I", found)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str | None) -> bytes:
        raw = text.encode("utf-8", "replace") if text else b""
        if b"<|" not in raw:
            raw = raw.lower()
        return b"".join(map(self.known.__getitem__, _closing.sub(rb" \g<0>", raw).split()))


_encoders: dict[str, RunEncoder] = {}


def pieces(docs: DataFrame, tokenizer_file: str, seq_len: int, end_id: int) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: the documents' ids cut at multiples of ``seq_len``."""

    def run(batches):
        if tokenizer_file not in _encoders:
            _encoders[tokenizer_file] = RunEncoder(tokenizer_file)
        encoder, end = _encoders[tokenizer_file], end_id.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.ids(text.as_py()) + end
                for k in range(0, len(ids), 4 * seq_len):
                    piece = ids[k : k + 4 * seq_len]
                    rows.append((doc_id, k // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``[(packs, [(length, copies), ...]), ...]``: the patterns and how many packs follow each."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # patterns by the room left in them
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: dict[int, list] = {}
        for space in sorted((s for s in room if s >= length), reverse=True):
            while left and room.get(space):
                n, parts = room[space].pop()
                if n > left:
                    room[space].append((n - left, parts))
                    n = left
                placed.setdefault(space - length, []).append((n, [*parts, (length, 1)]))
                left -= n
            if not left:
                break
        while left:
            # every pack with room has one more now: again the roomiest of those, or new packs
            again = max((s for s in placed if s >= length and placed[s]), default=None)
            if again is None:
                copies = seq_len // length
                full, rest = divmod(left, copies)
                if full:
                    placed.setdefault(seq_len - copies * length, []).append((full, [(length, copies)]))
                if rest:
                    placed.setdefault(seq_len - rest * length, []).append((1, [(length, rest)]))
                break
            n, parts = placed[again].pop()
            if n > left:
                placed[again].append((n - left, parts))
                n = left
            placed.setdefault(again - length, []).append((n, [*parts[:-1], (length, parts[-1][1] + 1)]))
            left -= n
        for space, patterns in placed.items():
            room.setdefault(space, []).extend(patterns)
    return [p for patterns in room.values() for p in patterns if p[0]]


def slots(histogram: dict[int, int], seq_len: int, first_sequence: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first_rank, end_rank, copies, first_sequence, offset)`` for each length of each pattern."""
    rank: dict[int, int] = {}
    rows = []
    for n, parts in sorted(shortest_pack_first(histogram, seq_len), key=lambda p: (p[1], p[0])):
        offset = 0
        for length, copies in parts:
            begin = rank.get(length, 0)
            rank[length] = begin + n * copies
            rows.append((length, begin, rank[length], copies, first_sequence, offset))
            offset += copies * length
        first_sequence += n
    return rows


def pack(docs: DataFrame, tokenizer_file: str, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_file, seq_len, end_id).withColumn("at", F.monotonically_increasing_id()), "pieces")
    ranked = salted_rank(cut, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "at")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # seq_len rows at most
    full = histogram.pop(seq_len, 0)
    table = [(seq_len, 0, full, 1, 0, 0), *slots(histogram, seq_len, full)]
    s = spark.createDataFrame(table, "s_length long, first_rank long, end_rank long, copies long, first_sequence long, first_offset long")
    at = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(s), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("first_offset") + at % F.col("copies") * F.col("length")).cast("long").alias("offset"))
    )
