"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under frequent forms.

Words are counted in one pass over the texts, with sums per Arrow batch before the shuffle. Pairs come from two sorted
dictionaries. Let a pair's longer word have ``M`` code points. One edit leaves one half of it intact: an edit in the
second half leaves both words in one block of the forward dictionary, which share the first half, an edit in the first
half leaves them in one block of the reversed dictionary, which share the second. A word stands in the blocks of its
own length, as a longer word, and of the next, as a shorter one. Blocks lie together where the dictionary is sorted, and
a task scans its range block by block and verifies.

A skewed block, of over ``block_rows`` words, is subdivided: the window in which its edit may lie is halved, and each
half fixes more of the shared prefix or of the shared suffix. A window of one code point leaves blocks no larger than
the alphabet, so every block gets small and no pair is lost. A pair is reported by the one window that holds the first
code point in which its words differ, so none comes twice.

Defined results: null and empty texts have no words; a null ``doc_id`` counts as an empty text before the colon; repeated
rows count again; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: UTF-8 of A-Z, a-z and U+00C0 to U+00FF, which are two bytes each with the first one this.
RUNS, LEAD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+"), b"\xc3"
#: Different words that a batch's sums hold before they are handed on.
HELD = 200_000
#: Bytes of word tables that one step of the verification holds.
STEP = 1 << 23


def _without(run: bytes, at: int) -> bytes:
    letters = run.decode("utf-8")
    return (letters[:at] + letters[at + 1 :]).encode("utf-8")


def occurrences(texts, ids, every: int, shortest: int) -> Counter:
    """How often each word of some texts (UTF-8) occurs. Of a run whose hash with the id is a multiple of ``every`` one
    letter is left out."""
    found: Counter = Counter()
    for text, doc in zip(texts, ids):
        if not text:
            continue
        begin = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
        for run, n in Counter(RUNS.findall(text)).items():
            run = run.lower()  # of bytes, that is A-Z alone
            if (h := zlib.crc32(run, begin)) % every == 0:
                run = _without(run, h % (len(run) - run.count(LEAD)))
            if len(run) - run.count(LEAD) >= shortest:
                found[run] += n
    return found


def words(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """``word, n``: words of at least ``shortest`` code points and ``least`` occurrences overall."""

    def batch(found: Counter):
        return pa.record_batch([pa.array([w.decode("utf-8") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        found: Counter = Counter()
        for b in batches:
            found.update(occurrences(b.column(1).to_pylist(), b.column(0).to_pylist(), every, shortest))
            if len(found) >= HELD:
                yield batch(found)
                found = Counter()
        yield batch(found)

    counted = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keyed(nodes: DataFrame) -> DataFrame:
    """The rows with the part of the word outside the window, which all words of a block share."""
    key = F.concat(F.expr("substring(word, 1, prefix)"), F.lit(" "), F.when(F.col("suffix") > 0, F.expr("substring(word, -suffix, suffix)")).otherwise(""))
    return nodes.withColumn("key", key)


def _halved(nodes: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its window, of which what follows is suffix, and with the second half."""
    width = F.col("size") - F.col("prefix") - F.col("suffix")
    first = F.ceil(width / 2).cast("int")
    halves = F.array(
        F.struct(F.col("prefix").alias("prefix"), (F.col("suffix") + width - first).alias("suffix")),
        F.struct((F.col("prefix") + first).alias("prefix"), F.col("suffix").alias("suffix")),
    )
    return nodes.select("word", "n", "size", F.explode(halves).alias("h")).select("word", "n", "size", "h.prefix", "h.suffix")


BLOCK = ["size", "prefix", "suffix", "key"]


def blocks(vocabulary: DataFrame, block_rows: int) -> DataFrame:
    """``word, n, size, prefix, suffix, key``: words by the blocks of both dictionaries, none over ``block_rows`` rows whose
    window could still be halved."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    open_ = _halved(vocabulary.select("word", "n", sizes).withColumn("prefix", F.lit(0)).withColumn("suffix", F.lit(0)))
    done = None
    while True:
        keyed = written(_keyed(open_), "blocks")
        counts = keyed.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("rows"))
        skewed = written(counts.where((F.col("rows") > block_rows) & (F.expr("size - prefix - suffix") > 1)).select(*BLOCK), "skewed")
        fit = keyed if skewed.isEmpty() else keyed.join(skewed, BLOCK, "left_anti")
        done = fit if done is None else done.unionByName(fit)
        if skewed.isEmpty():
            return done
        open_ = _halved(keyed.join(skewed, BLOCK, "left_semi"))


def _letters(words: list[str], width: int) -> np.ndarray:
    """One row of code points a word, which all are below 256; zeros follow."""
    raw = b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words)
    return np.frombuffer(raw, np.uint8).reshape(len(words), width)


def near(long: np.ndarray, short: np.ndarray, size: int, prefix: int, suffix: int) -> np.ndarray:
    """Whether pairs of words (rows of letters) of ``size`` letters, or of that and one less, that share ``prefix`` and
    ``suffix`` letters, are one edit apart, the first letter in which they differ lying between those."""
    differ = long[:, :size] != short[:, :size]
    at = differ.argmax(axis=1)
    # what follows that letter has to be equal, in the shorter word one place before
    equal_size = short[:, size - 1] != 0
    rest = np.where(equal_size[:, None], short[:, 1:size], short[:, : size - 1])
    behind = np.arange(1, size) > at[:, None]
    same = ((long[:, 1:size] == rest) | ~behind).all(axis=1)
    return differ.any(axis=1) & same & (at >= prefix) & (at < size - suffix)


def _verified(block: list[tuple], size: int, prefix: int, suffix: int):
    """``word, near, near_n`` both ways of the near pairs of one block, ``block`` being rows of word and count."""
    found, n = [w for w, _ in block], [c for _, c in block]
    length = np.array([len(w) for w in found])
    letters = _letters(found, size)
    full = np.flatnonzero(length == size)
    step = max(1, STEP // (size * max(1, len(found))))
    for k in range(0, len(full), step):
        # a word of the full size against shorter ones, and against full ones behind it
        x = np.repeat(full[k : k + step], len(found))
        y = np.tile(np.arange(len(found)), len(full[k : k + step]))
        keep = (length[y] < size) | (y > x)
        x, y = x[keep], y[keep]
        ok = near(letters[x], letters[y], size, prefix, suffix)
        for a, b in zip(x[ok].tolist(), y[ok].tolist()):
            yield found[a], found[b], n[b]
            yield found[b], found[a], n[a]


def near_words(dealt: DataFrame) -> DataFrame:
    """``word, near, near_n``: near words of each word, from the sorted blocks."""

    def run(batches):
        out: list[tuple] = []
        block: list[tuple] = []
        at = None
        for b in batches:
            for key in zip(*(c.to_pylist() for c in b.columns)):
                if key[:4] != at:
                    if len(block) > 1:
                        out.extend(_verified(block, *at[:3]))
                    at, block = key[:4], []
                    if len(out) > 20_000:
                        yield batch(out)
                        out = []
                block.append(key[4:])
        if len(block) > 1:
            out.extend(_verified(block, *at[:3]))
        yield batch(out)

    def batch(rows):
        w, v, n = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(w, pa.string()), pa.array(v, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    ordered = dealt.select(*BLOCK, "word", "n").repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK)
    return ordered.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form (``word, form``): where following forms ends. Each round joins what has been
    reached with itself, so chains get half as long; a form is more frequent than its word, so there are no rings."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reached.join(further, "root", "left_semi").isEmpty():
            return reached
        after = written(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        drop_written(reached)
        reached = after


def group_variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5, block_rows: int = 256) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: ``form`` is the near word of largest ``n`` (ties: smallest) if that is at
    least ``ratio`` times the word's."""
    vocabulary = written(words(docs, every, shortest, least), "words")
    pairs = near_words(blocks(vocabulary, block_rows))
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best"))
    joined = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.neg")).alias("near_n"), "best.near")
    frequent = F.col("near_n") >= ratio * F.col("n")
    named = written(joined.select("word", F.when(frequent, F.col("near")).alias("form"), "n", "n_near", F.when(frequent, F.col("near_n")).alias("form_n")), "forms")
    root = roots(named.where("form is not null"))
    return named.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
