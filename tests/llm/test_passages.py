import random

import numpy as np
import pytest

from strandmill.llm import passages

DOCS = "doc_id long, text string, block long, spans string, n int, shared string, kept int"


def by_definition(rows, window=50):
    """``doc_id, bytes, spans, kept`` of rows of id and text, from a table of all strings."""
    big = float("inf")
    first = {}
    texts = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - window + 1):
            first[t[k : k + window]] = min(first.get(t[k : k + window], big), i)
    out = []
    for (i, _), (order, t) in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if first[t[k : k + window]] < order:
                gone[k : k + window] = b"\1" * window
        spans, k = [], 0
        while (k := gone.find(1, k)) >= 0:
            end = gone.find(0, k)
            spans.append((k, end := len(t) if end < 0 else end))
            k = end
        out.append((i, len(t), tuple(spans), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "s", 1, "x", 2) for i, t in rows], DOCS).repartition(parts)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.begin, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=str)


def mixed(seed, n, letters="ab c"):
    """Texts that share passages of lengths around the window, many of them repetitive."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    pool = [word(r.choice([20, 48, 49, 50, 51, 52, 70, 99, 100, 150])) for _ in range(12)] + ["ab" * 40, "a" * 120, "é" * 40]
    rows = []
    for i in range(n):
        parts = [r.choice(pool) if r.random() < 0.6 else word(r.randint(0, 60)) for _ in range(r.randint(0, 5))]
        text = "".join(parts)
        if r.random() < 0.3:
            a = r.randint(0, len(text))
            text = text[a : a + r.randint(0, 200)]
        rows.append((r.randint(0, n) if r.random() < 0.2 else i, text))
    return rows


@pytest.mark.parametrize("letters", ["ab c", "abcdefghijklmnopqrstuvwxyz é中"])
def test_repeats_by_definition(spark, letters):
    rows = mixed(1, 150, letters)
    want = by_definition(rows)
    assert sum(len(w[2]) for w in want) > 30
    assert found(passages.without_repeats(docs_of(spark, rows))) == want


def test_many_small_buckets_and_cut_groups(spark, monkeypatch):
    """One common passage between differing neighbours: its suffixes fill several buckets, its group is split by offset."""
    monkeypatch.setattr(passages, "BUCKET_ROWS", 20)
    r = random.Random(4)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    common, near = word(70), [word(3) for _ in range(4)]
    rows = [(i, word(r.randint(0, 40)) + r.choice(near) + common[r.choice([0, 0, 5, 20]) : r.choice([70, 70, 60, 55])] + r.choice(near) + word(r.randint(0, 60))) for i in range(120)] + mixed(5, 60)
    packed = passages.blocks(docs_of(spark, rows, 8))
    cut = passages.repeated_spans(packed, 50, group_rows=7)
    assert cut.count() > 0
    want = by_definition(rows)
    monkeypatch.setattr(passages, "BLOCK_DOCS", 9)
    for group_rows in (7, 200_000):
        assert found(passages.without_repeats(docs_of(spark, rows, 8), group_rows=group_rows)) == want


def test_odd_rows(spark):
    line = "A line that many documents share, of more than fifty bytes in all. "
    rows = [(3, None), (4, ""), (None, line), (None, "x" + line), (5, line), (5, line), (2, line[:50]), (1, line[:49]), (9, "é" * 30), (8, "aé" + "é" * 26), (6, "\0" * 60), (7, "\0" * 55 + "b"), (10, line * 3), (11, "y" * 400_000 + line)]
    assert found(passages.without_repeats(docs_of(spark, rows))) == by_definition(rows)
    assert passages.without_repeats(docs_of(spark, [])).collect() == []
    assert found(passages.without_repeats(docs_of(spark, [(1, "short"), (2, None)]))) == by_definition([(1, "short"), (2, None)])


def test_sorts_and_anchors():
    r = np.random.default_rng(0)
    rows = r.integers(0, 3, (3000, 21)).astype(np.uint8)
    order = passages.multikey_order(passages.words_of(rows))
    assert [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)
    texts = [bytes(r.integers(97, 100, n).astype(np.uint8)) for n in (0, 49, 50, 51, 3000, 300_000)]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    at, h = passages.anchors(raw, ends, 50)
    assert (np.diff(at) > 0).all() and len(h) == len(at)
    # each window holds an anchor's gram, and equal grams have equal hashes
    begins = np.concatenate([np.arange(e - len(t), e - 49) for e, t in zip(ends, texts) if len(t) >= 50])
    place = np.searchsorted(at, begins)
    assert (at[place] <= begins + 50 - passages.GRAM).all()
    grams = {}
    for p, x in zip(at.tolist(), h.tolist()):
        assert grams.setdefault(raw[p : p + passages.GRAM].tobytes(), x) == x
