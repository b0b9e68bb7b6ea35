import base64
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmill.llm import common, lattice, queries, topk, warc

VECTORS = "vec_id long, embedding array<float>, label int, n long, v int, class string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, 1, 2, "c") for i, v, lab in rows], VECTORS)


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    one = [1.0] + [0.0] * 9
    return [(1, one, 1), (2, one, 1), (3, [2.0] + [0.0] * 9, 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [0.0] * 10, 1), (8, [nan] + one[1:], 1), (9, [inf] + one[1:], 1), (10, [None] + one[1:], 1), (11, [], 1), (12, [1.0, 0.0], 1), (2, one, 1), (None, one, 1), (100, [-1.0] + one[1:], 1)]


def brute_links(ids, x, labels, threshold=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(near))):
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return near.sum(1), np.array([ids[find(i)] for i in range(len(ids))])


@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_lattice_links_against_brute_force(spark, cell_rows, monkeypatch):
    if cell_rows == 40:  # more blocks and tables, as for many vectors
        monkeypatch.setattr(lattice, "shape_for", lambda n, shape=lattice.shape_for(60_000): shape)
    r = np.random.default_rng(0)
    x = r.standard_normal((700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((700, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = r.uniform(0.9, 0.99, (700, 1))
    dense = x[:1] + 0.01 * r.standard_normal((150, 64))
    z = np.vstack([x, c * x + np.sqrt(1 - c * c) * y, x[:30], dense]).astype("f4")
    labels = np.r_[np.tile([1, 2], 700), np.ones(180, int)]
    labels[700:1400] = labels[:700]
    ids = np.arange(len(z))
    links, component = brute_links(ids, z.astype(float), labels)
    found = lattice.near_duplicates(vectors_of(spark, zip(ids.tolist(), z.tolist(), labels.tolist())), cell_rows=cell_rows).toPandas().sort_values("vec_id")
    assert (found.n_links.to_numpy() <= links).all()
    assert found.n_links.sum() >= 0.97 * links.sum()
    assert (found.component_id.to_numpy() == component).mean() > 0.97
    assert (found.kept == (found.vec_id == found.component_id)).all()


@pytest.mark.parametrize("n", [1_000, 10_000, 40_000, 160_000, 10**6])
def test_lattice_recall_by_cosine_and_unlike_vectors(n):
    shape, r = lattice.shape_for(n), np.random.default_rng(3)

    def units(many):
        x = r.standard_normal((many, 64))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def meet(a, b):
        a, b = lattice.cells(a, shape), lattice.cells(b, shape)
        return ((a[:, :, :1] == b) | (a == b[:, :, :1])).any(2)

    for cosine, least in ((0.93, 0.96), (0.94, 0.97), (0.96, 0.99), (0.99, 0.995)):
        x, y = units(1500), units(1500)
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        assert meet(x, cosine * x + np.sqrt(1 - cosine**2) * y).any(1).mean() >= least
    many = 100_000
    assert n * meet(units(many), units(many)).any(1).mean() <= 512


def test_e8_points_are_nearest():
    r = np.random.default_rng(1)
    x = r.uniform(-2, 2, (300, 8))
    got, far = lattice.e8(x)
    assert ((got.sum(2) % 4) == 0).all() and (np.ptp(got % 2, axis=2) == 0).all()  # doubled: all even or all odd, sum divisible by 4
    near = np.rint(x[:, None, :] + r.integers(-1, 2, (300, 4000, 8)))
    for shift in (0.0, 0.5):
        p = near + shift
        ok = near.sum(2) % 2 == 0
        d = np.where(ok, ((p - x[:, None]) ** 2).sum(2), np.inf).min(1)
        assert (far[:, 0] <= d + 1e-9).all()


def test_lattice_of_odd_vectors(spark):
    found = {}
    for r in lattice.near_duplicates(vectors_of(spark, odd_vectors())).collect():
        found.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert found[1] == [(3, 1, True)] and found[2] == [(3, 1, False)] * 2 and found[3] == [(3, 1, False)]
    for alone in (4, 5, 6, 7, 8, 9, 10, 11, 12, 100):
        assert found[alone] == [(0, alone, True)]
    assert found[None] == [(0, None, None)]
    assert lattice.near_duplicates(vectors_of(spark, [])).count() == 0


def test_search_prunes_and_is_exact():
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 16)) * 300
    for p in (np.floor(base[r.integers(0, 40, 1500)] + r.standard_normal((1500, 16)) * 5), np.floor(r.standard_normal((800, 16)) * 9), np.zeros((60, 16))):
        q = np.floor(base[r.integers(0, 40, 150)] + r.standard_normal((150, 16)) * 5)
        best = topk.search(q, np.arange(150), p, np.arange(len(p)), 10)
        s = q @ p.T
        s[np.arange(min(150, len(p))), np.arange(min(150, len(p)))] = -np.inf
        expected = np.lexsort((np.broadcast_to(np.arange(len(p)), s.shape), -s), axis=1)[:, :10]
        assert (best.id == expected).all()


def test_equal_candidates_of_a_dual_tree_search():
    """Thousands of equal vectors on both sides, one id on many of them, against brute force."""
    r = np.random.default_rng(5)
    p = np.vstack([np.full((4000, 6), 3.0), r.integers(-5, 6, (500, 6)).astype(float)])
    ids = np.r_[np.full(40, 7), r.permutation(4460) + 8]
    q, q_ids = np.vstack([p[:2500], p[4000:4100]]), np.r_[ids[:2500], ids[4000:4100]]
    best = topk.search(q, q_ids, p, ids, 10)
    for i in [*range(0, 60), *range(2400, 2600)]:
        s = q[i] @ p.T
        rows = sorted((-s[j], ids[j]) for j in np.flatnonzero(ids != q_ids[i]))[:10]
        assert list(zip(-best.score[i], best.id[i])) == rows
    assert topk.smallest(np.array([5, 1, 1, 1, 9, 2]), 2).tolist() == [1, 2, 5, 0]


def test_cover_tree_covers():
    r = np.random.default_rng(2)
    x = np.vstack([r.standard_normal((300, 5)) + c for c in (0, 40, 90)])
    t = topk.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(900)) and len(t.centre) > 10
    for i in range(len(t.centre)):
        rows = t.order[t.begin[i] : t.end[i]]
        assert np.linalg.norm(x[rows] - x[t.centre[i]], axis=1).max() <= t.radius[i] + 1e-9
        assert sorted(k for c in t.children[i] for k in t.order[t.begin[c] : t.end[c]]) == (sorted(rows.tolist()) if t.children[i] else [])


@pytest.mark.parametrize("blocks", [{}, {"query_rows": 2, "block_rows": 60}])
def test_top_k_equals_sql(spark, small, blocks):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    expected = con.sql(queries.ORACLE_SQL["op8_topk"]).df().sort_values(["query_id", "rank"], ignore_index=True)
    found = topk.top_k(spark.read.parquet(f"{small}/embeddings.parquet"), **blocks).toPandas().sort_values(["query_id", "rank"], ignore_index=True)
    assert found.equals(expected[found.columns].astype(found.dtypes.to_dict()))


def test_top_k_of_odd_vectors(spark):
    rows = topk.top_k(vectors_of(spark, odd_vectors())).orderBy("rank").collect()
    assert {r.query_id for r in rows} == {100} and [(r.vec_id, r.score) for r in rows] == [(7, 0), (1, -(1024**2)), (2, -(1024**2)), (2, -(1024**2)), (4, -(1024**2)), (5, -(1024**2)), (3, -2 * 1024**2)]
    assert topk.top_k(vectors_of(spark, [])).count() == 0
    none = topk.top_k(vectors_of(spark, [(200, [], 1), (4, [], 1), (3, [], 2), (2, [1.0], 1)])).orderBy("rank")
    assert [tuple(r) for r in none.collect()] == [(200, 1, 3, 0), (200, 2, 4, 0)]
    huge = vectors_of(spark, [(100, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [-3e38, 0.0], 1), (3, [1e9, 1.0], 1)])
    assert [(r.vec_id, r.score) for r in topk.top_k(huge).orderBy("rank").collect()][0] == (1, topk.LONG)


def test_warc_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    again = pages.where("page_id % 5 = 0").withColumn("page_id", F.col("page_id") + 1000)
    both = pages.unionByName(again)
    found = warc.round_trip(spark, both).toPandas().set_index("page_id")
    rows = {r.page_id: r.html for r in both.collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    assert sorted(found.index) == sorted(rows)
    for i, html in rows.items():
        r, raw = found.loc[i], html.encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to if r.refers_to == r.refers_to else None) == (("response", None) if first[html] == i else ("revisit", first[html]))
        assert r.html == (html if first[html] == i else None)
    longer = warc.round_trip(spark, both, min_bytes=1 << 30)
    assert longer.where("record_type = 'revisit'").count() == 0


def test_warc_query_equals_sql(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    again = pages.where("page_id % 5 = 0").withColumn("page_id", F.col("page_id") + 1000)
    none = spark.createDataFrame([(5001, "u", None), (5002, "u", "é")], "page_id long, url string, html string")
    pages.unionByName(again).unionByName(none.select(*pages.columns)).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = con.sql(queries.ORACLE_SQL["op6_warc"]).df().sort_values("page_id", ignore_index=True)
    found = queries.QUERIES["op6_warc"](spark, str(tmp_path)).toPandas().sort_values("page_id", ignore_index=True)
    assert sorted(found.columns) == sorted(expected.columns) and (expected.record_type == "revisit").sum() == 10
    assert found.astype(object).where(found.notna(), None).equals(expected[found.columns].astype(object).where(expected[found.columns].notna(), None))


def test_warc_of_odd_pages_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 2)
    rows = [(5, "http://A.com/x", "same"), (3, "http://b.org", "same"), (9, None, None), (None, "http://a.com/x", "same"), (3, "http://b.org", "same"), (7, "bad url\n[", "é"), (1, "http://a.com/x", ""), (8, "http://a.com:99/?q=1#f", "long " * 40_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, offset int")
    root = common.new_path(spark, "warc")
    captures = warc.write_archives(pages, f"{root}/a")
    index = warc.build_index(captures, f"{root}/i")
    found = warc.read_records(warc.lookup(warc.keys_of(pages), index), f"{root}/a").collect()
    kinds = sorted(((r.page_id is None, r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found), key=repr)
    assert kinds == sorted([(False, 5, "revisit", 3, 4), (False, 3, "response", None, 4), (False, 3, "response", None, 4), (False, 9, "revisit", 1, 0), (True, None, "revisit", 3, 4), (False, 7, "response", None, 2), (False, 1, "response", None, 0), (False, 8, "response", None, 200_000)], key=repr)
    one = spark.createDataFrame([(warc.url_key("http://a.com/x"),), ("none",), ("",), ("~",)], "url_key string")
    assert sorted((r.page_id is None, r.page_id) for r in warc.lookup(one, index, every_id=True).collect()) == [(False, 1), (False, 5), (True, None)]
    assert warc.url_key("http://www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b#c"
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_archives_are_gzip_members_of_records(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://h{i}.org/", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    captures = warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    for c in captures:
        raw = (tmp_path / "w" / c.file).read_bytes()[c.offset : c.offset + c.length]
        head, http, body = warc.parse(gzip.decompress(raw))
        assert body == f"page {c.page_id}".encode() and head["WARC-Target-URI"] == f"http://h{c.page_id}.org/" and http["Content-Length"] == str(len(body))


def test_searcher_finds_every_capture(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    r = random.Random(0)
    rows = [(f"k{r.randrange(9)}", r.randrange(6), "f", i, 1, "response") for i in range(200)]
    captures = spark.createDataFrame(rows, warc.CAPTURES).repartition(3)
    index = warc.build_index(captures, common.new_path(spark, "index"))
    s = warc.Searcher(index)
    for key in [f"k{i}" for i in range(10)]:
        for n in range(6):
            assert sorted(c[3] for c in s.find((key, n), (key, n))) == [x[3] for x in rows if x[:2] == (key, n)]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000)] + [(3000, 3000 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    found = {row.node: row.component for row in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_ranks_have_no_gaps(spark):
    rows = [(k, i) for k, n in (("a", 900), ("b", 3), (None, 250)) for i in range(n)] + [("b", 1)] * 3 + [("a", None)] * 700 + [(None, 7)] * 120
    df = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "k string, i long, at long")
    got = common.salted_rank(df, ["k"], ["i"], "at", per_task=100).toPandas()
    for k in ("a", "b", None):
        own = got[got.k.isna() if k is None else got.k == k]
        assert sorted(own["rank"]) == list(range(len(own)))
    # other numbers of the rows leave each value's ranks as they are
    again = common.salted_rank(df.withColumn("at", 5000 - F.col("at")), ["k"], ["i"], "at", per_task=100).toPandas()
    ranks = lambda t: t.fillna(-1).groupby(["k", "i"])["rank"].agg(sorted).to_dict()
    assert ranks(got) == ranks(again)


def test_equal_rows_are_dealt_to_many_tasks(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two").alias("text"))
    from strandmill.llm import mixing

    at = common.salted_rank(docs.withColumn("at", F.monotonically_increasing_id()), ["source"], ["doc_id"], "at")
    assert at.agg(F.countDistinct("rank"), F.max("rank")).first() == (100_000, 99_999)
    taken = mixing.mix(docs).groupBy("taken").count().collect()
    assert {r.taken: r["count"] for r in taken} == {2: 50_000, 4: 50_000}


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from strandmill.llm import packing, pii, simhash
    from strandmill.storage import written

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("kept", F.lit(1))
    columns, before = docs.columns, docs.count()
    quality, copies, personal, mix, pack = (f for _, f in pipeline.STAGES)
    docs = written(quality(spark, docs, d), "a")
    labels = spark.read.parquet(f"{d}/labels.parquet").join(docs.select("doc_id").withColumn("in", F.lit(1)), "doc_id", "left")
    share = labels.groupBy("quality").agg(F.count("in") / F.count(F.lit(1))).collect()
    assert docs.columns == columns and docs.count() < before and dict(map(tuple, share))[1] > 0.98 and dict(map(tuple, share))[0] < 0.1
    exact = simhash.near_duplicates(docs).select("component_id").distinct().count()
    docs = written(copies(spark, docs.unionByName(docs.limit(5)), d), "b")
    classes = docs.count()
    assert docs.columns == columns and exact - 60 < classes <= exact and classes == docs.select("doc_id").distinct().count()
    docs = written(personal(spark, docs, d), "c")
    assert docs.columns == columns and docs.count() == classes and pii.find(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    mixed = written(mix(spark, docs, d), "d")
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    packed = pack(spark, mixed, d)
    assert packed.where("start = 0").count() == mixed.count()
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        empty = stage(spark, empty, d)
        assert empty.count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y z", "en", "a", 5), (3, "w " * 5000, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        odd = written(stage(spark, odd, d), name)
    assert odd.count() > 0


def similarities(rows):
    """``(a, b): Jaccard similarity`` of the five-word shingles of all texts that share one, and whose set each row has."""
    shingles, holders, shared = {}, {}, {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        shingles[i] = frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    first = {}
    for i, own in sorted(shingles.items()):
        if first.setdefault(own, i) == i:
            for s in own:
                for j in holders.setdefault(s, []):
                    shared[j, i] = shared.get((j, i), 0) + 1
                holders[s].append(i)
    return {(a, b): n / (len(shingles[a]) + len(shingles[b]) - n) for (a, b), n in shared.items()}, {i: first[own] for i, own in shingles.items()}


@pytest.mark.parametrize("data", ["sf0.01", "sf0.1"])
def test_copies_stage_against_brute_force(spark, data):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"/root/testdata/{data}/documents.parquet")
    kept = {r.doc_id for r in dict(pipeline.STAGES)["near_copies"](spark, docs, "").select("doc_id").collect()}
    similar, first = similarities((r.doc_id, r.text) for r in docs.collect())
    root = dict(first)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [p for p, x in similar.items() if x >= 0.8]
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {find(i) for i in first}
    assert links and kept >= want and len(kept - want) <= 0.01 * len(set(first.values()) - want)


def copies_at(r, n, similarity, first, many):
    """Pairs of texts of ``n`` words whose shingles have about this similarity."""
    out = []
    for k in range(many):
        words = [f"w{r.randrange(10**9)}" for _ in range(n)]
        other = words[round((1 - similarity) / (1 + similarity) * (n - 4)) :] + [f"v{r.randrange(10**9)}" for _ in range(round((1 - similarity) / (1 + similarity) * (n - 4)))]
        out += [(first + 2 * k, " ".join(words)), (first + 2 * k + 1, " ".join(other))]
    return out


def test_copies_are_found_in_every_bin_of_similarity(spark):
    import corpus_pipeline as pipeline

    r, rows = random.Random(8), []
    for k, similarity in enumerate((0.76, 0.78, 0.81, 0.83, 0.86, 0.9, 0.95)):
        for j, n in enumerate((40, 200, 900)):
            rows += copies_at(r, n, similarity, 10_000 * k + 1000 * j, 60)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in pipeline.keep_one_of_copies(spark, docs, "").select("doc_id").collect()}
    bins = {}
    for (a, b), x in similarities(rows)[0].items():
        bins.setdefault((b // 10_000, x >= 0.8), []).append(b not in kept)
    assert all(not any(gone) for (_, near), gone in bins.items() if not near)
    assert len(bins) >= 7 and all(sum(gone) >= 0.97 * len(gone) for (_, near), gone in bins.items() if near)


def test_false_pairs_and_blocks_hide_no_link(spark, monkeypatch):
    from strandmill.llm import near_copies

    r = random.Random(9)
    rows = [x for k, s in enumerate((0.7, 0.75, 0.85, 0.9)) for x in copies_at(r, 300, s, 100 * k, 20)]
    base = [f"b{k}" for k in range(204)]
    star = []
    for k in range(60):  # edits of one text: most pairs lie on both sides of the limit
        words = list(base)
        for at in r.sample(range(204), r.choice((1, 2, 3, 6, 9))):
            words[at] = f"x{k}_{at}"
        star.append((1000 + k, " ".join(words)))
    rows += star
    similar, first = similarities(rows)
    reach = {i: i for i, _ in rows}
    for _ in rows:
        for (a, b), x in similar.items():
            if x >= 0.8:
                reach[a] = reach[b] = min(reach[a], reach[b])
    assert len({reach[i] for i, _ in star}) > 1
    keyed = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.col("doc_id"))
    want = {reach[first[i]] for i, _ in rows}
    for sure, block in ((True, 512), (False, 512), (False, 7)):
        # every pair that may be alike counts as surely alike, or none does, and blocks are small
        monkeypatch.setattr(near_copies, "expected_diff", lambda share, bits, deviations: 260 if sure or deviations > 0 else 0)
        monkeypatch.setattr(near_copies, "BLOCK", block)
        assert {x.first for x in near_copies.classes(keyed, "_row", ["doc_id"]).collect()} == want


def test_share_of_bits_between_small_sets():
    from math import comb

    from strandmill.llm import near_copies

    def share(both, a, b):
        """Bits that are a majority of one of two sets only, which share so many shingles and have ``a`` and ``b`` more."""
        out = 0
        for c in range(both + 1):
            for x in range(a + 1):
                for y in range(b + 1):
                    if (2 * (c + x) > both + a) != (2 * (c + y) > both + b):
                        out += comb(both, c) * comb(a, x) * comb(b, y)
        return out / 2 ** (both + a + b)

    most = {}
    for both in range(1, 60):
        for a in range(16):
            for b in range(a, 16):
                if a + b and 5 * both >= 4 * (both + a + b):
                    low = both + a
                    most[low] = max(most.get(low, 0), share(both, a, b))
    assert min(most) == 4 and most[4] == near_copies.SIZES[0][2] and max(s for n, s in most.items() if n > 4) <= near_copies.SIZES[1][2]
    assert simhash_share(0.8) < near_copies.SIZES[1][2]


def simhash_share(similarity):
    from strandmill.llm import simhash

    return simhash.share_of_bits(similarity)


def test_registered_queries_have_their_columns(spark, small):
    expected = {
        "op2_simhash": "doc_id fingerprint component_id", "op4_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op6_warc": "page_id payload_bytes payload_digest record_type refers_to", "op7_lattice": "vec_id n_links component_id kept", "op8_topk": "query_id rank vec_id score", "op9_mixing": "doc_id size source_size target taken",
        "op11_vector_codes": "vec_id code error label_error codebooks_sha256", "op12_repeated_passages": "doc_id n_bytes n_removed n_spans kept_sha256", "op13_spelling": "word form root n n_near form_n",
    }
    for name, columns in expected.items():
        assert queries.QUERIES[name](spark, small).columns == columns.split(), name
    assert len(queries.QUERIES) == 13
    assert pd.DataFrame(queries.op7_lattice(spark, small).dtypes).loc[3, 1] == "boolean"


def edited(r, n, changed):
    """Two texts of ``n`` different words, the second with so many words changed that lie far apart."""
    words = [f"w{r.randrange(10**9)}" for _ in range(n)]
    other = list(words)
    for k in range(changed):
        other[(2 * k + 1) * n // (2 * changed)] = "changed"
    return " ".join(words), " ".join(other)


def test_near_copies_are_exact_on_both_sides_of_the_limit(spark):
    import corpus_pipeline as pipeline
    from strandmill.llm import near_copies

    r, rows, linked = random.Random(5), [], set()
    for n, changed in [(225, k) for k in (4, 5, 6)] + [(104, 2), (104, 3), (46, 1), (44, 1), (500, 11), (500, 12)]:
        for _ in range(8):
            i = len(rows)
            a, b = edited(r, n, changed)
            rows += [(i, a), (i + 1, b)]
            x, y = (near_copies.shingle_set(t, near_copies.memory()) for t in (a, b))
            if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                linked.add(i + 1)
    assert 0 < len(linked) < len(rows) // 2
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in pipeline.keep_one_of_copies(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for i, _ in rows} - linked


def test_near_copies_of_short_texts_and_large_groups(spark):
    import corpus_pipeline as pipeline
    from strandmill.llm import near_copies

    r, rows = random.Random(6), []
    for n in (8, 9, 10, 11, 24):  # one word more: n - 4 of n - 3 shingles
        for _ in range(10):
            words = [f"w{r.randrange(10**9)}" for _ in range(n + 1)]
            rows += [(len(rows), " ".join(words[:n])), (len(rows) + 1, " ".join(words))]
    short = len(rows)
    base = [f"w{k}" for k in range(60)]
    rows += [(short + k, " ".join([*base, f"end{k}"])) for k in range(150)]  # one class
    line = " ".join(f"l{k}" for k in range(12))
    rows += [(short + 150 + k, line + " " + " ".join(f"o{k}_{x}" for x in range(10))) for k in range(150)]  # a line in common
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {*range(0, short, 2), short, *range(short + 150, short + 300)}
    assert {x.doc_id for x in pipeline.keep_one_of_copies(spark, docs, "").select("doc_id").collect()} == want
    keyed = docs.withColumn("_row", F.col("doc_id"))
    assert {x.first for x in near_copies.classes(keyed, "_row", ["doc_id"], cell_rows=16).collect()} == want


def test_rows_under_null_and_repeated_ids_stay(spark):
    import corpus_pipeline as pipeline

    text = lambda k: " ".join(f"w{k}_{i}" for i in range(30))
    rows = [(None, text(k)) for k in range(4)] + [(7, text(k)) for k in range(4, 8)] + [(1, text(9)), (7, text(9)), (None, text(0)), (None, text(9)), (8, text(4)), (1, text(9))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.keep_one_of_copies(spark, docs, "")
    found = sorted(((x.doc_id or 0, x.text) for x in kept.collect()))
    assert found == sorted([(0, text(k)) for k in range(4)] + [(7, text(k)) for k in range(4, 8)] + [(1, text(9))])
    mixed = [x.text for x in pipeline.mix(spark, kept, "").collect()]
    assert set(mixed) == {text(k) for k in (*range(8), 9)} and max(map(mixed.count, mixed)) == 2


#: Names that stages use beside the documents' columns.
BESIDE = "row first doc of times none id hash a b at size fp node keys least key route salts rank group label base extra n own kept judged _row _key _copy _times col".split()


def test_stages_carry_columns_of_any_name(spark):
    import corpus_pipeline as pipeline

    text = lambda k: " ".join(f"w{k}_{i}" for i in range(40))
    plain = [(k, text(k % 9), "en", f"s{k % 2}", 1) for k in range(12)] + [(None, None, None, None, None), (30, "", "en", "s1", 0), (5, text(5), "en", "s1", 1)]
    extra = [f"`{c}` string" for c in BESIDE] + ["`with space` map<string,int>", "`a.b` int"]
    rows = [(*x, *(f"{c}{i}" for c in BESIDE), {"k": i}, i) for i, x in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(extra))
    given = {x[5]: x[5:] for x in rows}
    for name, stage in pipeline.STAGES[1:4]:
        found = stage(spark, docs, "")
        assert found.columns == docs.columns, name
        found = found.collect()
        assert found and all(tuple(x)[5:] == given[x[5]] for x in found), name
        if name == "near_copies":
            assert sorted((x.doc_id is None, x.doc_id) for x in found) == [(False, k) for k in range(9)] + [(False, 30)]


@pytest.mark.parametrize("bands", [3, 14])
def test_band_keys_meet_as_often_as_they_should(bands, monkeypatch):
    from strandmill.llm import near_copies

    monkeypatch.setattr(near_copies, "BANDS", bands)
    r = np.random.default_rng(2)
    for similarity in (0.3, 0.8):
        met = []
        for _ in range(400):
            both, alone = round(300 * similarity), round(300 * (1 - similarity) / 2)
            x = r.integers(0, 1 << 63, both + 2 * alone, dtype=np.uint64)
            a, b = np.sort(x[: both + alone]), np.sort(np.r_[x[:both], x[both + alone :]])
            met.append(any(p == q for p, q in zip(near_copies.band_keys(a), near_copies.band_keys(b))))
        assert abs(np.mean(met) - (1 - (1 - similarity**near_copies.BAND) ** bands)) < 0.08


def test_whole_groups_cut_no_group():
    import pyarrow as pa

    r = np.random.default_rng(1)
    a, b = np.sort(r.integers(0, 5, 1000)), np.zeros(1000, int)
    for k in range(5):
        b[a == k] = np.sort(r.integers(0, 30, (a == k).sum()))
    batches = [pa.record_batch([pa.array(a[i : i + n]), pa.array(b[i : i + n])], names=["a", "b"]) for i, n in zip(range(0, 1000, 37), [37] * 100)]
    parts = list(common.whole_groups(batches, 2, 50))
    assert sum(t.num_rows for t in parts) == 1000 and len(parts) > 8
    keys = [set(zip(t.column(0).to_pylist(), t.column(1).to_pylist())) for t in parts]
    assert all(not x & y for x, y in zip(keys, keys[1:])) and list(common.whole_groups([], 2)) == []


def test_simhash_components_on_a_table(spark):
    from strandmill.llm import simhash

    rows = queries.op2_simhash(spark, "/root/testdata/sf0.01").collect()
    fp = np.array([int(x.fingerprint, 16) for x in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    reach = np.array([x.doc_id for x in rows])
    while True:
        least = np.where(near, reach[None], reach.max()).min(axis=1)
        if (least == reach).all():
            break
        reach = least
    assert [x.component_id for x in rows] == reach.tolist() and len(set(reach.tolist())) < len(rows)
    assert all(simhash.fingerprint(r.text).hex() == x.fingerprint for r, x in zip(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").sort("doc_id").limit(50).collect(), sorted(rows, key=lambda x: x.doc_id)))
