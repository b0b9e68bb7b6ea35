"""Repeated passages: removes each byte that a string of ``window`` bytes covers which also starts in a document with a
smaller ``doc_id``. Strings are judged on the documents as they came, byte by byte.

A sparse suffix array over the corpus finds them. Of the strings of ``GRAM`` bytes in a window the one with the smallest
hash (the leftmost, of several) is the window's anchor, so equal windows have their anchors at the same place, and the
suffixes that begin at anchors are enough: about one in eighteen. Windows compare by an anchor's suffix, up to ``window``
bytes, and by the bytes before it, up to ``window - GRAM``.

1. Documents are packed into compressed blocks, written once.
2. A sieve drops anchors whose gram no second document has: blocks send each of their grams' hashes once to a bucket,
   which sends back those that come from several blocks or documents. Hashes decide here only what is surely unique.
3. Sampled splitters range-partition the remaining suffixes by their leading bytes, then by what goes before, then by
   document. Equal ones of a block travel as one record, with all their places.
4. A bucket sorts its suffixes by multikey quicksort, and the bytes before them as well. From common prefixes of
   neighbours follow, for each offset of the anchor in a window, the records of equal windows and the smallest document
   among them. No pair is made, so large groups cost what sorting them costs.
5. Groups of one gram that a splitter cuts are compared across the boundary: their records meet by gram. A group of over
   ``group_rows`` records is split by the offset: windows whose anchor lies in one half of the offsets share more bytes
   behind it, those of the other half more before it, so each half's records meet by a longer string; at one offset
   that is the whole window, and a minimum is all that is asked.
6. Spans go back to the blocks, where the documents are cut.

Defined results: null texts are empty; texts shorter than the window stay whole; a null ``doc_id`` counts as larger than
all others; rows of one ``doc_id`` don't remove each other's bytes; repeated rows are rows like others; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Bytes that anchors are chosen by.
GRAM = 16
#: Bytes and documents of a block at most, save where one text has more.
BLOCK_BYTES, BLOCK_DOCS = 2 << 20, 1 << 15
#: Positions whose hashes are computed at once.
STEP = 1 << 18
#: Bytes of hashes in a bucket of the sieve, and records in a bucket of suffixes, on average.
SIEVE_BYTES, BUCKET_ROWS = 6 << 20, 80_000
#: Sampled records for each splitter.
SAMPLES = 16
NO_ID = (1 << 63) - 1
LARGER = 1 << 31  # marks places in documents larger than their record's smallest


def _squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def anchors(raw: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows of the texts that end at ``ends`` in ``raw``."""
    size, w = len(raw), window - GRAM + 1
    padded = np.concatenate([raw, np.zeros(window + 8, np.uint8)])
    begins = np.r_[0, ends[:-1]]
    some = ends - begins >= window
    change = np.zeros(size + 1, np.int8)
    np.add.at(change, begins[some], 1)
    np.add.at(change, ends[some] - window + 1, -1)
    whole = np.cumsum(change[:-1], dtype=np.int8).astype(bool)  # a window begins here
    places, hashes, last = [], [], -1
    for a in range(0, size, STEP):
        m = min(STEP, size - a)
        of = np.flatnonzero(whole[a : a + m])
        if not len(of):
            continue
        word = lambda s: np.ndarray((m + w - 1,), "<u8", padded, a + s, (1,))  # noqa: B023, E731
        h = _mix(word(0))
        for s in range(8, GRAM, 8):
            h = _mix(h + word(s))
        least = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach < w:
            step = min(reach, w - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        at = (least[of] & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = at[np.r_[True, at[1:] != at[:-1]]]
        new = at[at + a > last]
        if len(new):
            places.append(new + a)
            hashes.append(h[new])
            last = new[-1] + a
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def multikey_order(tokens: np.ndarray) -> np.ndarray:
    """The order of rows of words: rows that are equal so far are sorted by their next word, and only runs that stay
    equal go one word deeper."""
    order = np.argsort(tokens[:, 0], kind="stable")
    at, of = np.arange(len(order)), np.zeros(len(order), np.int64)
    for depth in range(tokens.shape[1]):
        key = tokens[order[at], depth]
        if depth:
            inner = np.lexsort((key, of))
            order[at], key, of = order[at][inner], key[inner], of[inner]
        same = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
        tied = np.r_[False, same] | np.r_[same, False] if len(at) else np.zeros(0, bool)
        at, of = at[tied], np.cumsum(np.r_[True, ~same])[tied] if len(at) else of
        if not len(at):
            break
    return order


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of words that compare alike."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of bytes shares with the row before; none for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def equal_windows(rows: np.ndarray, least: np.ndarray, window: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """For records (bytes of the suffix, bytes before it from the anchor backwards, how many of each there are) and
    their smallest documents: the smallest document with equal bytes throughout, and the first and last offset from
    ``low`` to ``high`` whose window a smaller document has than that (none: first above last)."""
    n, back = len(rows), window - GRAM
    first, last, whole = np.full(n, window), np.full(n, -1), least.copy()
    if n < 2:
        return whole, first, last
    order = multikey_order(words_of(rows))
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    shared = common_prefix(rows[order])
    new = shared < rows.shape[1]
    new[0] = True
    start = np.flatnonzero(new)
    of = np.cumsum(new) - 1  # class of equal records, by place in the order
    smallest = np.minimum.reduceat(least[order], start)
    whole[order] = smallest[of]
    # classes of one gram are compared where there are several
    reps = rows[order[start]]
    group = np.r_[True, (reps[1:, :GRAM] != reps[:-1, :GRAM]).any(axis=1)]
    alone = group & np.r_[group[1:], True]
    some = np.flatnonzero(~alone)
    if len(some):
        reps, least_of = reps[some], smallest[some]
        ahead, behind = reps[:, window + back].astype(np.int64), reps[:, window + back + 1].astype(np.int64)
        forward = common_prefix(reps[:, :window])
        before = multikey_order(words_of(reps[:, window : window + back]))
        backward = common_prefix(reps[before, window : window + back])
        from_, to, c = np.full(len(reps), window), np.full(len(reps), -1), np.empty(len(reps), np.int64)
        for offset in range(low, high + 1):
            c[before] = np.cumsum(backward < offset)
            fit = np.flatnonzero((behind >= offset) & (ahead >= window - offset))
            if len(fit) < 2:
                continue
            key = np.cumsum(forward < window - offset)[fit] * (len(reps) + 1) + c[fit]
            by = np.argsort(key, kind="stable")
            key = key[by]
            begin = np.r_[True, key[1:] != key[:-1]]
            low_doc = np.minimum.reduceat(least_of[fit][by], np.flatnonzero(begin))[np.cumsum(begin) - 1]
            found = fit[by[low_doc < least_of[fit][by]]]
            from_[found], to[found] = np.minimum(from_[found], offset), offset
        spread = np.full((2, len(start)), window)
        spread[1] = -1
        spread[0, some], spread[1, some] = from_, to
        first, last = spread[0, of[inverse]], spread[1, of[inverse]]
    return whole, first, last


def union(of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch as one, in order of ``of``, a number below 2^31, and place."""
    base = of.astype(np.int64) << 32
    order = np.argsort(base + begin, kind="stable")
    b, e = (base + begin)[order], np.maximum.accumulate((base + end)[order])
    new = np.r_[True, b[1:] > e[:-1]] if len(b) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(b) - 1] if len(first) else first
    return b[first] >> 32, b[first] & 0xFFFFFFFF, e[last] & 0xFFFFFFFF


class Records:
    """Suffix records: ``rows`` of bytes, ``least`` documents, ``block``s, and ``n`` places each in ``place`` (document's
    number in the block, marked where it is larger than the least one, and byte)."""

    def __init__(self, rows, least, block, n, place):
        self.rows, self.least, self.block, self.n, self.place = rows, least, block, n, place

    def pack(self) -> bytes:
        head = np.array([len(self.n), len(self.place), self.rows.shape[1]], "<u8").tobytes()
        body = head + b"".join(x.tobytes() for x in (self.rows, self.least.astype("<i8"), self.block.astype("<i8"), self.n.astype("<u4"), self.place.astype("<u4")))
        return np.uint64(len(body)).tobytes() + _squeezed(body)

    @staticmethod
    def unpack(packed: list[bytes]) -> Records:
        parts: list[list] = [[], [], [], [], []]
        for raw in packed:
            body = pa.decompress(raw[8:], int(np.frombuffer(raw, np.uint64, 1)[0]), "zstd", asbytes=True)
            n, places, width = np.frombuffer(body, "<u8", 3).astype(int)
            at = 24
            for out, kind, count, shape in zip(parts, (np.uint8, "<i8", "<i8", "<u4", "<u4"), (n * width, n, n, n, 2 * places), ((n, width), n, n, n, (places, 2))):
                out.append(np.frombuffer(body, kind, count, at).reshape(shape))
                at += out[-1].nbytes
        return Records(*map(np.concatenate, parts))

    def take(self, which: np.ndarray) -> Records:
        ends = np.cumsum(self.n.astype(np.int64))
        n = self.n[which].astype(np.int64)
        at = np.repeat(ends[which] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return Records(self.rows[which], self.least[which], self.block[which], self.n[which], self.place[at])

    def spans(self, whole, first, last, window: int, low: int, high: int):
        """``(block, spans)`` of what is covered: where a place's document is larger than the smallest one with equal bytes
        throughout, all its windows are, else those from the ``first`` to the ``last`` offset found."""
        back = window - GRAM
        ahead, behind = self.rows[:, window + back].astype(np.int64), self.rows[:, window + back + 1].astype(np.int64)
        n = self.n.astype(np.int64)
        each = np.repeat(np.arange(len(n)), n)
        all_ = (self.place[:, 0] & LARGER).astype(bool) | (self.least > whole)[each]
        begin = np.where(all_, np.maximum(low, window - ahead)[each], first[each])
        end = np.where(all_, np.minimum(high, behind)[each], last[each])
        some = begin <= end
        each, doc, at = each[some], (self.place[some, 0] & (LARGER - 1)).astype(np.int64), self.place[some, 1].astype(np.int64)
        begin, end = at - end[some], at - begin[some] + window
        block = self.block[each]
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else ():
            yield int(block[part[0]]), np.stack(union(doc[part], begin[part], end[part]), 1).astype("<u4").tobytes()


def _texts(z: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's bytes, and where its texts end."""
    if not sizes.sum():
        return np.zeros(0, np.uint8), np.cumsum(sizes)
    return np.frombuffer(pa.decompress(z, int(sizes.sum()), "zstd", asbytes=True), np.uint8), np.cumsum(sizes)


def blocks(docs: DataFrame) -> DataFrame:
    """``block, ids, sizes, bytes, z``: documents together, their texts compressed."""

    def row(block, ids, texts):
        sizes = [len(t) for t in texts]
        z = _squeezed(b"".join(texts)) if texts else b""
        return pa.record_batch([pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([sum(sizes)]), pa.array([z], pa.binary())], names=["block", "ids", "sizes", "bytes", "z"])

    def run(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or b""
                if texts and (held + len(text) > BLOCK_BYTES or len(texts) == BLOCK_DOCS):
                    yield row(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if texts:
            yield row(number, ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "block long, ids array<long>, sizes array<long>, bytes long, z binary")


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes, in the hashes' order."""
    return (h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)


def _short(h: np.ndarray) -> bytes:
    """The low six bytes of each hash; a bucket's number stands for higher ones."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def sieve(packed: DataFrame, window: int, buckets: int) -> DataFrame:
    """``block, bucket, n, hashes``: each block's grams that another of its documents or another block may have, too."""

    def deal(batches):
        for b in batches:
            for block, sizes, z in zip(*(c.to_pylist() for c in b.columns)):
                raw, ends = _texts(z, np.array(sizes, np.int64))
                at, h = anchors(raw, ends, window)
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, doc = h[order], np.searchsorted(ends, at[order], side="right")
                new = np.r_[True, h[1:] != h[:-1]]
                first = np.flatnonzero(new)
                many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                h = h[first]
                bucket = _bucket(h, buckets)
                cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(h)]
                rows = [(int(bucket[x]), block, _short(h[x:y]), np.packbits(many[x:y]).tobytes()) for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "hashes", "many"])

    def find(batches):
        held, bucket = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != bucket:
                    yield from several(bucket, held)
                    bucket, held = row[0], []
                held.append(row[1:])
        yield from several(bucket, held)

    def several(bucket, held):
        if not held:
            return
        each = [_long(h) for _, h, _ in held]
        sizes = np.array([len(h) for h in each])
        h = np.concatenate(each)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for (_, _, m), n in zip(held, sizes)]).astype(bool)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        out = [(block, bucket, int(keep.sum()), _short(x[keep])) for (block, *_), x, keep in zip(held, each, np.split(many, np.cumsum(sizes)[:-1])) if keep.any()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "bucket", "n", "hashes"])

    dealt = packed.select("block", "sizes", "z").mapInArrow(deal, "bucket int, block long, hashes binary, many binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(find, "block long, bucket int, n long, hashes binary")


def suffixes_of(raw, ends, ids, wanted: list[tuple[int, bytes]], block: int, window: int, buckets: int) -> Records:
    """A block's records at those anchors whose hashes are ``wanted``, in order of their bytes and smallest documents."""
    at, h = anchors(raw, ends, window)
    named = lambda bucket, low: (bucket & np.uint64(0xFFFF)) << np.uint64(48) | low
    asked = np.concatenate([named(np.uint64(b), _long(short)) for b, short in wanted])
    at = at[np.isin(named(_bucket(h, buckets), h & np.uint64((1 << 48) - 1)), asked)]
    doc, back = np.searchsorted(ends, at, side="right"), window - GRAM
    begins = np.r_[0, ends[:-1]][doc]
    padded = np.concatenate([np.zeros(back, np.uint8), raw, np.zeros(window, np.uint8)])
    rows = np.zeros((len(at), window + back + 2), np.uint8)
    ahead, behind = np.minimum(window, ends[doc] - at), np.minimum(back, at - begins)
    rows[:, :window] = np.lib.stride_tricks.sliding_window_view(padded, window)[at + back] * (np.arange(window) < ahead[:, None])
    rows[:, window : window + back] = np.lib.stride_tricks.sliding_window_view(padded, back)[at][:, ::-1] * (np.arange(back) < behind[:, None])
    rows[:, window + back], rows[:, window + back + 1] = ahead, behind
    id_of = ids[doc]
    order = multikey_order(words_of(rows))
    rows, id_of, doc, at = rows[order], id_of[order], doc[order], (at - begins)[order]
    first = np.flatnonzero(np.r_[True, common_prefix(rows)[1:] < rows.shape[1]]) if len(rows) else np.zeros(0, int)
    n = np.diff(np.r_[first, len(rows)])
    least = np.minimum.reduceat(id_of, first) if len(first) else np.zeros(0, np.int64)
    larger = np.where(id_of > np.repeat(least, n), LARGER, 0)
    return Records(rows[first], least, np.full(len(first), block), n, np.stack([doc | larger, at], 1))


def sort_keys(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What splitters compare: a record's bytes, then its smallest document."""
    number = (least.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.concatenate([rows, number], 1)).view(f"S{rows.shape[1] + 8}").ravel()


def _suffixes(joined: DataFrame, window: int, buckets: int, splitters=None, samples: int = 0) -> DataFrame:
    """Records of each block: packed by bucket, or with ``samples`` so many sort keys."""

    def run(batches):
        for b in batches:
            for block, ids, sizes, z, wanted in zip(*(c.to_pylist() for c in b.columns)):
                raw, ends = _texts(z, np.array(sizes, np.int64))
                found = suffixes_of(raw, ends, np.array([NO_ID if i is None else i for i in ids], np.int64), [(w["bucket"], w["hashes"]) for w in wanted], block, window, buckets)
                keys = sort_keys(found.rows, found.least)
                if samples:
                    picked = keys[np.unique(np.linspace(0, len(keys) - 1, samples).astype(int))] if len(keys) else keys
                    yield pa.record_batch([pa.array([bytes(k).ljust(keys.itemsize, b"\0") for k in picked], pa.binary())], names=["key"])
                    continue
                cut = np.r_[0, np.searchsorted(keys, splitters.value, side="left"), len(keys)]
                for bucket in np.flatnonzero(np.diff(cut)):
                    part = found.take(np.arange(cut[bucket], cut[bucket + 1]))
                    yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([part.pack()], pa.binary())], names=["bucket", "records"])

    return joined.mapInArrow(run, "key binary" if samples else "bucket int, records binary")


#: Of step 4: spans found, or records of a group that goes on in another bucket, by the string that they share.
FOUND = "block long, spans binary, low int, high int, shared binary, n long, least long, records binary"


def _found(spans) -> pa.RecordBatch | None:
    rows = [(block, s, None, None, None, None, None, None) for block, s in spans]
    return _table(rows) if rows else None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in FOUND.split(", ")])


def _groups(records: Records, shared: np.ndarray, low: int, high: int):
    """Rows of records by equal ``shared`` bytes."""
    order = multikey_order(words_of(shared))
    cut = np.r_[0, np.flatnonzero(common_prefix(shared[order])[1:] < shared.shape[1]) + 1, len(order)]
    for x, y in zip(cut[:-1], cut[1:]):
        part = records.take(order[x:y])
        yield None, None, low, high, shared[order[x]].tobytes(), y - x, int(part.least.min()), part.pack()


def _sorted(dealt: DataFrame, window: int, n: int, splitters) -> DataFrame:
    """Each bucket's suffixes sorted and compared."""

    def run(batches):
        held, bucket = [], None
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1)):
                if row[0] != bucket:
                    yield from compared(bucket, held)
                    bucket, held = row[0], []
                held.append(row[1].as_py())
        yield from compared(bucket, held)

    def compared(bucket, held):
        if not held:
            return
        records = Records.unpack(held)
        gram = np.ascontiguousarray(records.rows[:, :GRAM]).view(f"S{GRAM}").ravel()
        borders = splitters.value[max(0, bucket - 1) : bucket + 1].astype(f"S{GRAM}")
        cut = np.isin(gram, borders)
        own = records.take(np.flatnonzero(~cut))
        found = _found(own.spans(*equal_windows(own.rows, own.least, window, 0, window - GRAM), window, 0, window - GRAM))
        if found:
            yield found
        if cut.any():
            over = records.take(np.flatnonzero(cut))
            yield _table(list(_groups(over, over.rows[:, :GRAM], 0, window - GRAM)))

    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def shared_bytes(rows: np.ndarray, window: int, low: int, high: int) -> np.ndarray:
    """The bytes that equal windows with an offset from ``low`` to ``high`` all share: those before the anchor, from it
    backwards, and those from it on."""
    return np.concatenate([rows[:, window : window + low], rows[:, : window - high]], 1)


def _halved(hot: DataFrame, window: int) -> DataFrame:
    """Groups' records by longer shared strings, one for each half of the offsets."""

    def run(batches):
        for b in batches:
            for low, high, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                records, middle = Records.unpack([packed.as_py()]), (low + high) // 2
                ahead, behind = (records.rows[:, 2 * window - GRAM + k].astype(int) for k in (0, 1))
                for x, y in ((low, middle), (middle + 1, high)):
                    part = records.take(np.flatnonzero((behind >= x) & (ahead >= window - y)))
                    if len(part.n):
                        yield _table(list(_groups(part, shared_bytes(part.rows, window, x, y), x, y)))

    return hot.select("low", "high", "records").mapInArrow(run, FOUND)


def _met(groups: DataFrame, window: int) -> DataFrame:
    """Spans of groups that fit into a task."""

    def run(batches):
        held, group = [], None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if row[:3] != group:
                    yield from compared(group, held)
                    group, held = row[:3], []
                held.append(row[3].as_py())
        yield from compared(group, held)

    def compared(group, held):
        if held:
            records = Records.unpack(held)
            found = _found(records.spans(*equal_windows(records.rows, records.least, window, *group[:2]), window, *group[:2]))
            if found:
                yield found

    by = ["low", "high", "shared"]
    return groups.select(*by, "records").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, FOUND)


def _single(groups: DataFrame, window: int) -> DataFrame:
    """Spans of groups of one offset, whose records all have the same window."""

    def run(batches):
        for b in batches:
            for offset, whole, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                records = Records.unpack([packed.as_py()])
                n = len(records.n)
                found = _found(records.spans(np.full(n, whole), np.full(n, window), np.full(n, -1), window, offset, offset))
                if found:
                    yield found

    by = ["low", "high", "shared"]
    smallest = groups.groupBy(*by).agg(F.min("least").alias("whole"))
    return groups.select(*by, "records").join(smallest, by).select("low", "whole", "records").mapInArrow(run, FOUND)


def _across(found: DataFrame, window: int, group_rows: int) -> DataFrame:
    """``block, spans``: what buckets have found, and what their cut groups give where they meet."""
    by = ["low", "high", "shared"]
    done, groups = found.where("shared is null").select("block", "spans"), found.where("shared is not null")
    while not groups.isEmpty():
        sizes = groups.groupBy(*by).agg(F.sum("n").alias("rows"))
        hot = written(sizes.where(F.col("rows") > group_rows).select(*by), "hot")
        if hot.isEmpty():
            return done.unionByName(_met(groups, window).select("block", "spans"))
        done = done.unionByName(_met(groups.join(hot, by, "left_anti"), window).select("block", "spans"))
        large = groups.join(hot, by, "left_semi")
        done = done.unionByName(_single(large.where("low = high"), window).select("block", "spans"))
        groups = written(_halved(large.where("low < high"), window), "groups")
    return done


def repeated_spans(packed: DataFrame, window: int, group_rows: int = 200_000) -> DataFrame:
    """``block, spans``: the covered spans of the documents of ``blocks``, in lists by document number and bytes."""
    spark = packed.sparkSession
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least_tasks, ceil(total * 2 / (window - GRAM + 2) * 6 / SIEVE_BYTES))
    kept = written(sieve(packed, window, buckets), "grams")
    by_block = kept.groupBy("block").agg(F.collect_list(F.struct("bucket", "hashes")).alias("wanted"))
    count = kept.agg(F.sum("n")).first()[0]
    if not count:
        return spark.createDataFrame([], "block long, spans binary")
    joined = packed.select("block", "ids", "sizes", "z").join(by_block, "block")
    n = max(least_tasks, ceil(count / BUCKET_ROWS))
    # some blocks are enough for splitters, which decide on sizes of buckets alone
    some = [row.block for row in by_block.select("block").orderBy(F.xxhash64("block")).limit(max(16, SAMPLES * n // 2000)).collect()]
    sample = _suffixes(joined.where(F.col("block").isin(some)), window, buckets, samples=ceil(SAMPLES * n / len(some)))
    keys = np.sort(np.array([row.key for row in sample.collect()], dtype=f"S{2 * window - GRAM + 10}"))
    places = np.unique(np.linspace(0, len(keys), n + 1).astype(int)[1:-1])
    splitters = spark.sparkContext.broadcast(np.unique(keys[places]) if len(keys) else keys)
    found = written(_sorted(_suffixes(joined, window, buckets, splitters), window, n, splitters), "found")
    drop_written(kept)
    return _across(found, window, group_rows)


def without_repeats(docs: DataFrame, window: int = 50, group_rows: int = 200_000) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: each document's removed spans of bytes (start, end exclusive) and the bytes that
    are left, in order."""
    if window < GRAM or window > 250:
        raise ValueError(f"windows have from {GRAM} to 250 bytes")
    packed = written(blocks(docs), "blocks")
    spans = written(repeated_spans(packed, window, group_rows), "spans")
    by_block = spans.groupBy("block").agg(F.collect_list("spans").alias("spans"))

    def run(batches):
        for b in batches:
            for ids, sizes, z, found in zip(*(c.to_pylist() for c in b.columns)):
                raw, ends = _texts(z, np.array(sizes, np.int64))
                of, begin, end = union(*np.frombuffer(b"".join(found or []), "<u4").reshape(-1, 3).astype(np.int64).T)
                cut = np.searchsorted(of, np.arange(len(ids) + 1))
                removed, left = [], []
                for k, (at, size) in enumerate(zip(ends - sizes, sizes)):
                    own = slice(cut[k], cut[k + 1])
                    removed.append([{"begin": x, "end": y} for x, y in zip(begin[own].tolist(), end[own].tolist())])
                    edges = [0, *np.stack([begin[own], end[own]], 1).ravel().tolist(), size]
                    left.append(b"".join(raw[at + x : at + y].tobytes() for x, y in zip(edges[::2], edges[1::2])))
                kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, kinds), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = packed.select("block", "ids", "sizes", "z").join(by_block, "block", "left").select("ids", "sizes", "z", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
