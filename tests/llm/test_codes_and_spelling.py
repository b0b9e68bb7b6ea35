import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandmill.llm import codes, spelling

VECTORS = "vec_id long, embedding array<float>, label int, part int, code string, error long, of int"
DOCS = "doc_id long, text string, word string, n int, size int, prefix int, key string, root string"


def encoded(rows, parts=16, entries=64, rounds=2, scale=256):
    """The same codes by comparing every part with every entry; ``rows`` are id, vector, label in order of id."""
    x = np.floor(scale * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        apart = [((x[:, p, None, :] - books[p]) ** 2).sum(-1) for p in range(parts)]
        code = np.stack([d.argmin(1) for d in apart], 1)
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                if (mine := code[:, p] == e).any():
                    books[p, e] = x[mine, p].sum(0) // mine.sum()
    error = sum(d.min(1) for d in apart)
    total = Counter()
    for (_, _, label), e in zip(rows, error.tolist()):
        total[label] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in k), e, total[label], digest) for (i, _, label), k, e in zip(rows, code.tolist(), error.tolist())]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2, 3) for i, v, lab in rows], VECTORS)


def test_vector_codes_against_every_entry(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 0.1, (700, 48)).astype("f4")
    x[300:500] = x[r.integers(0, 5, 200)]  # repeats, so entries of no parts and ties
    x[500:600] = np.round(x[500:600] * 8) / 8
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(x)]
    found = codes.encode(vectors_of(spark, rows)).collect()
    assert sorted(map(tuple, found)) == encoded(rows)


def test_vector_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [0.5] * 16
    rows = [(1, one, 1), (1, one, 1), (2, [-0.001] + one[1:], None), (3, None, 1), (4, [nan] + one[1:], 1), (5, [inf] + one[1:], 1), (6, [-inf] + one[1:], 1), (7, [None] + one[1:], 1), (8, [1.0], 1), (9, [], 1), (None, one, 1)]
    found = codes.encode(vectors_of(spark, rows)).collect()
    assert sorted((r.vec_id for r in found if r.vec_id is not None)) == [1, 1, 2] and len(found) == 4
    assert sorted(map(tuple, found), key=str) == sorted(encoded([(1, one, 1), (1, one, 1), (2, [-0.001] + one[1:], None), (None, one, 1)]), key=str)
    assert codes.encode(vectors_of(spark, [])).collect() == []
    empty = codes.encode(vectors_of(spark, [(1, [], 1), (2, [], None)])).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in empty) == [(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)]
    short = codes.encode(vectors_of(spark, [(i, [float(i % 2)] * 5, 1) for i in range(4)])).collect()  # filled with zeros
    assert {r.error for r in short} == {0}


def test_tree_visits_equally_far_boxes():
    rows = np.array([[10 - abs(i % 21 - 10), i % 3] for i in range(64)])
    tree = codes.KdTree(rows)
    q = np.array([[a, b] for a in range(-3, 14) for b in range(-2, 6)])
    index, best = tree.nearest(q)
    d = ((q[:, None] - rows) ** 2).sum(-1)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_definition(docs, every=199, shortest=6, least=5, ratio=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}

    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, "k", "r") for i, t in rows], DOCS)


def result(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("block_rows", [256, 3])
def test_variants_by_definition(spark, block_rows):
    r = random.Random(3)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        drawn = []
        for _ in range(20):
            w = stems[min(r.randrange(60), r.randrange(60))]
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1 :]])
            drawn.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "-", "ß1"]).join(drawn)))
    rows.append((400, "qrstuvw " * 150 + "qrstuvwx " * 30 + "qrstuvwxy " * 5))  # a chain
    want = variants_by_definition(rows)
    assert sum(x[1] is not None for x in want) > 20 and any(x[2] not in (x[0], x[1]) for x in want)
    assert result(spelling.group_variants(docs_of(spark, rows), block_rows=block_rows)) == sorted(want, key=str)


def test_variants_of_odd_rows(spark):
    long = "x" * 30_000
    rows = [(1, None), (2, ""), (None, "letters letters"), (3, "letters " * 8), (3, "letters " * 8), (4, "lettters " * 5), (5, f"{long} {long}y " * 5), (6, "×÷×÷×÷ " * 6), (7, "İK 123 中文"), (8, "let" * 2 + " " + "ZÉBRES Zébres " * 5)]
    assert result(spelling.group_variants(docs_of(spark, rows))) == sorted(variants_by_definition(rows), key=str)
    assert spelling.group_variants(docs_of(spark, [])).collect() == []


def test_pairs_come_once_and_blocks_stay_small(spark):
    words = ["aaaa" + a + b + "aaaa" for a in "abcdefghij" for b in "abcdefghij"] + ["a" * 9, "a" * 11]
    dealt = spelling.blocks(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 12)
    assert dealt.groupBy(*spelling.BLOCK).count().agg({"count": "max"}).first()[0] <= 12
    pairs = [tuple(r)[:2] for r in spelling.near_words(dealt).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if one_edit(a, b))
