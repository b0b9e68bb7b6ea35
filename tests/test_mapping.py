import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from simulator import Simulator, kmers, revcomp

from strandmill.config import MapConfig, size_in_bytes
from strandmill.functions import sequence as S
from strandmill.mapper import Aligner, Index, main, map_reads
from strandmill.operators import index as X
from strandmill.operators import search
from strandmill.operators.dynamic import DynamicIndex

RNG = random.Random(5)
SEQ = "".join(RNG.choice("ACGT") for _ in range(178))


def refs_of(spark, pairs):
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(pairs)], "ref_id long, name string, seq string")


def queries_of(spark, seqs):
    return spark.createDataFrame([(i, f"q{i}", s) for i, s in enumerate(seqs)], "q_id long, name string, seq string")


def mapped(df):
    return [(r.ref, r.fwd, r.pos, np.float32(r.support)) for r in df.orderBy("q_id").collect()]


def rc(s):
    return revcomp(s.encode()).decode()


def test_codes_and_reverse_complement(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("ACTGNacgt", "ACGTN")], "a string, b string").select(S.codes(F.col("a")).alias("c"), S.revcomp(F.col("b")).alias("r")).first()
    assert (row.c, row.r) == ("012330132", "CACGT")


def test_kmers_equal_direct_ones(spark):
    from pyspark.sql import functions as F

    seqs = [SEQ, "AC", "", None, "é" * 20]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i long, s string").select("i", S.kmers(F.col("s"), 10).alias("k"), S.kmers(F.col("s"), 10, reverse=True).alias("r")).orderBy("i").collect()
    for s, row in zip(seqs, rows):
        assert row.k == (None if s is None else kmers(s.encode(), 10))
        assert row.r == (None if s is None else kmers(revcomp(s.encode()), 10))


def test_single_queries(spark):
    index = Index.of(refs_of(spark, [("r0", SEQ)]), MapConfig(k=10))
    queries = [SEQ[30:90], rc(SEQ[30:90]), SEQ[100:160], SEQ[30:50], SEQ[30:51], "ACGT" * 10, "", None]
    found = mapped(index.query_batch(queries_of(spark, queries)))
    sim = Simulator([("r0", SEQ.encode())], k=10)
    assert found == [sim.search((q or "").encode()) for q in queries]
    assert found[0][:3] == ("r0", True, 30) and found[1][:3] == ("r0", False, 30)
    assert found[3] == ("*", True, 0, 0)


def test_repeats_give_support_above_one_and_the_first_copy_wins(spark):
    index = Index.of(refs_of(spark, [("a", "A" * 100)]), MapConfig(k=10))
    ref, fwd, pos, support = index.query("A" * 60)
    assert (ref, fwd, pos) == ("a", True, 0) and abs(support - 39.98040) < 1e-4
    thrice = Index.of(refs_of(spark, [("s", SEQ * 3)]), MapConfig(k=10))
    sim = Simulator([("s", (SEQ * 3).encode())], k=10)
    q = (SEQ * 3)[300:360]
    assert thrice.query(q)[:3] == sim.search(q.encode())[:3]


@pytest.mark.parametrize("cfg", [MapConfig(k=5, bw=3), MapConfig(k=4, bw=2, pf=0.3), MapConfig(k=5, jaccard=True, jc_frag_len=12, jc_frag_ovlp_len=7)])
def test_random_against_simulator(spark, cfg):
    r = random.Random(cfg.k + cfg.bw)
    refs = [(f"r{i}", "".join(r.choice("ACG") for _ in range(r.randrange(5, 120)))) for i in range(12)]
    queries = []
    for _ in range(60):
        _, s = r.choice(refs)
        a = r.randrange(len(s))
        q = s[a : a + r.randrange(40)]
        queries.append(rc(q) if r.random() < 0.4 else q + r.choice(["", "ACG"]))
    frag = (cfg.jc_frag_len, cfg.stride) if cfg.fragments else None
    sim = Simulator([(n, s.encode()) for n, s in refs], cfg.k, cfg.bw, cfg.pf, frag)
    assert mapped(Index.of(refs_of(spark, refs), cfg).query_batch(queries_of(spark, queries))) == [sim.search(q.encode()) for q in queries]


def test_both_reference_strands(spark):
    refs = [("a", SEQ), ("b", SEQ[::-1])]
    sim = Simulator([p for n, s in refs for p in ((n + "+", s.encode()), (n + "-", revcomp(s.encode())))], k=10)
    queries = [SEQ[20:100], rc(SEQ[20:100])]
    found = mapped(Index.of(refs_of(spark, refs), MapConfig(k=10, fr=True)).query_batch(queries_of(spark, queries)))
    assert found == [sim.search(q.encode(), both=False) for q in queries]
    assert [f[0] for f in found] == ["a+", "a-"]


def test_fragment_numbers_and_the_literal_name_rule(spark):
    refs = [("a", SEQ), ("b", SEQ[::-1])]
    rows = X.fragment_table(refs_of(spark, refs), MapConfig(k=10, jaccard=True)).orderBy("ref_id").collect()
    assert [(r.frag_start, r.n_frags) for r in rows] == [(0, 3), (3, 3)]
    # the best fragment is b's first: the literal rule takes the name before it; a's first has none
    literal = Index.of(refs_of(spark, refs), MapConfig(k=10, jaccard=True, compat=True))
    assert literal.query(SEQ[::-1])[0] == "a"
    assert literal.query(SEQ)[0] == "*"
    assert Index.of(refs_of(spark, refs), MapConfig(k=10, jaccard=True)).query(SEQ[::-1])[0] == "b"


def test_saved_index_answers_alike(spark, tmp_path):
    refs = refs_of(spark, [("a", SEQ), ("b", SEQ[::-1])])
    for cfg in (MapConfig(k=10, pf=0.2), MapConfig(k=10, compressed=True)):
        index = Index.of(refs, cfg)
        path = str(tmp_path / f"x{cfg.compressed}.cidx")
        index.dump(path)
        loaded = Index(spark, path)
        q = queries_of(spark, [SEQ[30:90], rc(SEQ[50:150]), "ACGT" * 9])
        assert loaded.cfg == cfg and mapped(loaded.query_batch(q)) == mapped(index.query_batch(q))


def test_empty_index_and_empty_queries(spark):
    index = Index.of(refs_of(spark, []), MapConfig(k=10))
    assert index.query(SEQ) == ("*", True, 0, 0.0)
    assert index.stats.first().p99_occ is None
    assert index.query_batch(queries_of(spark, [])).count() == 0


def test_dynamic_index(spark):
    index = DynamicIndex(spark, MapConfig(k=10, num_shard_bits=3, fr=True))
    index.add("a", SEQ)
    assert index.query(SEQ[30:90])[0] == "*"
    index.merge()
    assert index.query(SEQ[30:90])[:3] == ("a", True, 30)
    other = SEQ[::-1]
    index.add_batch(spark.createDataFrame([(0, "b", other), (1, "a", other[:60])], "ord long, name string, seq string"))
    index.merge()
    index.merge()
    assert index.query(rc(other[70:150]))[:2] == ("b", False)
    assert index.query(SEQ[30:90])[:3] == ("a", True, 30)
    grown = DynamicIndex(spark, MapConfig(k=10, num_shard_bits=0), append_offsets=True)
    for part in (SEQ[:90], SEQ[90:]):
        grown.add("a", part)
        grown.merge()
    assert grown.query(SEQ[90:178])[:3] == ("a", True, 90)


def test_dynamic_index_opens_again_and_survives_a_failed_merge(spark, tmp_path, monkeypatch):
    from strandmill.operators import dynamic

    cfg, path = MapConfig(k=10, num_shard_bits=2), str(tmp_path / "index")
    index = DynamicIndex(spark, cfg, path)
    index.add("a", SEQ)
    index.merge()
    index = DynamicIndex(spark, cfg, path)
    assert index.query(SEQ[30:90])[:3] == ("a", True, 30)
    other = SEQ[::-1]
    index.add("b", other)
    whole = dynamic.positions
    monkeypatch.setattr(dynamic, "positions", lambda rows, k: whole(rows, k).withColumn("pos", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        index.merge()
    monkeypatch.undo()
    (tmp_path / "index/names/2-1").mkdir()  # names that were not written to the end
    again = DynamicIndex(spark, cfg, path)
    assert again.query(other[30:110])[0] == "*" and again.names.count() == 1
    index.merge()
    index.merge()
    for found in (index, DynamicIndex(spark, cfg, path)):
        assert found.query(other[30:110])[0] == "b" and found.query(SEQ[30:90])[:3] == ("a", True, 30)
        assert sorted(r.ref_id for r in found.names.collect()) == [0, 1]


def test_compaction_gives_equal_answers(spark, tmp_path):
    r, cfg = random.Random(8), MapConfig(k=8, num_shard_bits=2)
    seqs = ["".join(r.choice("ACGT") for _ in range(150)) for _ in range(11)]
    index = DynamicIndex(spark, cfg, str(tmp_path / "index"), append_offsets=True)
    for i, s in enumerate(seqs):
        index.add(f"n{i % 10}", s)  # the last goes behind the first
        index.merge()
    asked = queries_of(spark, [s[20:90] for s in seqs] + [rc(seqs[3][10:100])])
    before = mapped(index.query_batch(asked))
    assert [x[:3] for x in before[:3]] == [("n0", True, 15), ("n1", True, 15), ("n2", True, 15)] and before[10][:3] == ("n0", True, 165)
    rows = sorted(map(tuple, index.postings().collect()))
    index.compact(drop=True)
    for found in (index, DynamicIndex(spark, cfg, str(tmp_path / "index"), append_offsets=True)):
        assert (found.first, found.merges, found.known) == (12, 12, 10)
        assert sorted(map(tuple, found.postings().collect())) == rows and mapped(found.query_batch(asked)) == before
        assert len(found.postings().inputFiles()) <= 4 + spark.sparkContext.defaultParallelism
    assert [x.name for x in (tmp_path / "index/postings").iterdir() if x.is_dir()] == ["merge=12"]
    index.add("n0", seqs[5][::-1])
    index.merge()
    again = DynamicIndex(spark, cfg, str(tmp_path / "index"), append_offsets=True)
    assert again.query(seqs[5][::-1][30:120])[:3] == ("n0", True, 330) and mapped(again.query_batch(asked)) == before


def test_hot_shards_are_many_tasks_and_unasked_ones_are_not_read(spark, tmp_path):
    index = DynamicIndex(spark, MapConfig(k=8, num_shard_bits=8), str(tmp_path / "index"))
    index.add_batch(spark.createDataFrame([(0, "polyA", "A" * 200_000), (1, "other", SEQ)], "ord long, name string, seq string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if they were large
    index.merge()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "index/postings/merge=1/shard=0").glob("*.parquet"))) >= 3
    wanted = {f"shard={int(digit * 8, 4) % 256}" for digit in "13"}  # of C and of its complement
    folders = [x for x in (tmp_path / "index/postings/merge=1").iterdir() if x.is_dir()]
    assert len(folders) > 10
    for folder in folders:
        for file in () if folder.name in wanted else folder.iterdir():
            file.write_bytes(b"") if file.name.endswith(".crc") else file.write_bytes(b"not to be read")
    assert mapped(index.query_batch(queries_of(spark, ["C" * 40])))[0][0] == "*"
    with pytest.raises(Exception, match="(?i)parquet|checksum"):
        index.query("A" * 40)


@pytest.mark.parametrize("heavy", [4_000_000, 30])
def test_saved_postings_are_not_shuffled(spark, tmp_path, heavy, monkeypatch):
    from strandmill.sources import store

    monkeypatch.setattr(store, "HEAVY", heavy)
    r = random.Random(3)
    refs = refs_of(spark, [("poly", "A" * 90 + SEQ), *((f"r{i}", "".join(r.choice("ACGT") for _ in range(120))) for i in range(20))])
    index, path = Index.of(refs, MapConfig(k=7, pf=0.05)), str(tmp_path / "it's.cidx")
    index.dump(path, buckets=3)
    index.dump(path, buckets=5)  # again, over what is there
    tables = spark.catalog.listTables()
    loaded = Index(spark, path)
    assert len(loaded.tables) == (2 if heavy == 30 else 1) and spark.catalog.listTables() == tables
    assert sorted(map(tuple, loaded.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    asked = queries_of(spark, ["A" * 60, SEQ[10:90], rc(SEQ[30:120]), "ACGT" * 12])
    assert mapped(loaded.query_batch(asked, broadcast=0)) == mapped(loaded.query_batch(asked)) == mapped(index.query_batch(asked))
    joined = search.hits(asked, loaded.tables[0], loaded.cfg, True, None, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(kmer") == 1 and "Bucketed: true" in plan and "5 out of 5" in plan


def test_reads_keep_columns_of_any_name(spark):
    index = Index.of(refs_of(spark, [("a", SEQ)]), MapConfig(k=10))
    names = "_k _q alignment key q_id data read name alignment_data".split()
    reads = spark.createDataFrame([(1, "r", SEQ[20:90], *names), (2, "s", "", *names)], "channel int, read_id string, seq string, " + ", ".join(f"{n} string" for n in names))
    found = map_reads(reads, index)
    assert found.columns == [*reads.columns[:-1], "alignment_data"]
    rows = sorted(found.collect())
    assert [len(x.alignment_data) for x in rows] == [1, 0] and all(x[3:-1] == tuple(names[:-1]) for x in rows)


def test_fastq(spark, tmp_path):
    from strandmill.sources import fasta

    a, b = tmp_path / "a.fastq", tmp_path / "b.fa"
    a.write_text("".join(f"@r{k} more\nACGT{'N' * k}\n+\n{'>@+I'[k % 4]}III{'@' * k}\n" for k in range(30)))
    rows = fasta.read_reads(spark, str(a)).orderBy("q_id").collect()
    assert [(r.q_id, r.name, r.seq) for r in rows] == [(k, f"r{k}", "ACGT" + "N" * k) for k in range(30)]
    fa, out = tmp_path / "r.fa", tmp_path / "out"
    fa.write_text(f">r0\n{SEQ}\n")
    (tmp_path / "q.fq").write_text(f"@x\n{SEQ[30:90]}\n+\n{'I' * 60}\n")
    assert main(["--ref", str(fa), "--qry", str(tmp_path / "q.fq"), "--out", str(out), "--k", "10"], spark) == 0
    assert spark.read.text(str(out)).first().value == "x\t60\tr0\t+\t30\t0.980392"
    b.write_text(a.read_text())
    with pytest.raises(Exception, match="FASTQ"):
        fasta.read_reads(spark, str(b)).collect()
    a.write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="four lines"):
        fasta.read_reads(spark, str(a)).collect()


@pytest.mark.parametrize(("range_bytes", "piece_bytes"), [(1 << 26, 1 << 20), (7, 3), (40, 11), (1, 1)])
def test_fasta_by_ranges_of_bytes(spark, tmp_path, range_bytes, piece_bytes):
    from strandmill.sources import fasta

    r = random.Random(2)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    (tmp_path / "in").mkdir()
    texts = ["left out\n>r0 a comment > here\nAC GT\r\nAC\n\n>r1\n>r2\n" + word(90) + "\nN>N\n" + word(5), "", ">s0\n" + word(60) + "\n>\nACGT\n>s2 last"]
    for i, text in enumerate(texts):
        (tmp_path / f"in/{i}.fa").write_text(text)
    want = []
    for text in texts:
        for record in ("\n" + text).split("\n>")[1:]:
            head, _, body = record.partition("\n")
            want.append(((head.split() or [""])[0], "".join(body.split())))
    refs, pieces = fasta.read_pieces(spark, str(tmp_path / "in"), range_bytes, piece_bytes)
    assert [(x.name, x.bases) for x in refs.orderBy("ref_id").collect()] == [(n, len(s)) for n, s in want]
    found = {}
    for x in pieces.orderBy("ref_id", "at").collect():
        assert len(found.setdefault(x.ref_id, b"")) == x.at and 0 < len(x.piece) <= piece_bytes
        found[x.ref_id] += x.piece
    assert [found.get(i, b"").decode() for i in range(len(want))] == [s for _, s in want]
    whole = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(want)], "ref_id long, name string, seq string")
    for cfg in (MapConfig(k=5), MapConfig(k=1), MapConfig(k=4, fr=True)):
        direct = X.postings(X.both_strands(whole) if cfg.fr else whole, cfg)
        assert sorted(map(tuple, X.piece_postings(pieces, refs, cfg).collect())) == sorted(map(tuple, direct.select("kmer", "ref_id", "pos").collect()))


def test_long_record_is_read_by_many_tasks(spark, tmp_path):
    from strandmill.sources import fasta

    (tmp_path / "one.fa").write_bytes(b">chromosome\n" + b"ACGTTGCA" * (40 << 17))  # one line of 40 MB
    refs, pieces = fasta.read_pieces(spark, str(tmp_path / "one.fa"), 8 << 20)
    assert refs.first().bases == 40 << 20 and pieces.agg(F.max(F.octet_length("piece"))).first()[0] == 1 << 20
    assert spark.read.format("fasta_ranges").options(path=str(tmp_path / "one.fa"), range_bytes=8 << 20, piece_bytes=1 << 20).load().rdd.getNumPartitions() == 6
    rows = X.piece_postings(pieces, refs, MapConfig(k=8)).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("pos") % 8), F.max("pos")).collect()
    assert len(rows) == 8 and sum(x.n for x in rows) == (40 << 20) - 7 and {x[2] for x in rows} == {1}


def test_fragment_index_stores_positions(spark):
    refs = refs_of(spark, [("a", SEQ), ("b", SEQ[::-1])])
    cfg = MapConfig(k=10, jaccard=True, jc_frag_len=30, jc_frag_ovlp_len=20)
    index = Index.of(refs, cfg)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, Index.of(refs, MapConfig(k=10)).postings.collect()))
    frags = [(k, f) for s in (SEQ, SEQ[::-1]) for i, k in enumerate(kmers(s.encode(), 10)) for f in range(17) if 10 * f <= i < 10 * f + 30]
    assert index.stats.first().max_occ == max(sum(1 for x, _ in frags if x == k) for k, _ in frags)


def test_files_and_command_line(spark, tmp_path):
    fa, q, out = tmp_path / "r.fa", tmp_path / "q.fa", tmp_path / "out"
    fa.write_text(f">r0 first\n{SEQ[:70]}\n{SEQ[70:]}\n>r1\n{SEQ[::-1]}\n")
    q.write_text(f">x\n{SEQ[30:90]}\n>y\n{rc(SEQ[::-1][40:120])}\n>z\nACGT\n")
    assert main(["--ref", str(fa), "--qry", str(q), "--out", str(out), "--k", "10"], spark) == 0
    lines = [r.value for r in spark.read.text(str(out)).collect()]
    assert lines[0] == "x\t60\tr0\t+\t30\t0.980392" and lines[1].split("\t")[2:4] == ["r1", "-"] and lines[2] == "z\t4\t*\t+\t0\t0.000000"
    assert main(["--ref", str(fa), "--k", "10"], spark) == 0
    assert main(["--idx", str(fa), "--qry", str(q), "--out", str(out)], spark) == 0
    assert [r.value for r in spark.read.text(str(out)).collect()] == lines
    assert main(["--ref", str(fa), "--qry", str(q)], spark) == 1


def test_aligner_and_stream(spark, tmp_path):
    from strandmill.streaming import reads as R

    fa = tmp_path / "r.fa"
    fa.write_text(f">r0\n{SEQ}\n")
    with pytest.raises(AttributeError):
        Aligner(spark)
    aligner = Aligner(spark, input=str(fa), k=10, n_threads=2)
    aligner.validate()
    assert aligner.initialised and "r.fa" in aligner.describe()
    rows = [(1, "a", SEQ[30:90]), (2, "b", ""), (3, "c", None), (4, "d", "ACGT" * 9), (5, "a", SEQ[30:90])]
    reads = spark.createDataFrame(rows, "channel int, read_id string, seq string")
    found = {r.channel: r.alignment_data for r in aligner.map_reads(reads).collect()}
    assert len(found) == 5 and found[2] == found[3] == found[4] == []
    assert (found[1][0].ctg, found[1][0].r_st, found[1][0].r_en, found[1][0].strand) == ("r0", 30, 90, 1) and found[1] == found[5]
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    R.query_stream(stream, aligner.index, R.to_parquet(str(tmp_path / "mapped")), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "mapped"))
    assert {r.channel: r.alignment_data for r in R.responses(got)} == found


def test_settings():
    assert size_in_bytes("64M") == 64 << 20 and size_in_bytes("2k") == 2048
    assert MapConfig.of("fr", "--jaccard", k=9, **{"jc-frag-len": 50, "jc_frag_ovlp_len": 10}) == MapConfig(fr=True, jaccard=True, k=9, jc_frag_len=50, jc_frag_ovlp_len=10)
    for bad in ({"k": 16}, {"k": 0}, {"jc_frag_len": 10, "jc_frag_ovlp_len": 10}, {"bw": 0}):
        with pytest.raises(ValueError):
            MapConfig(**bad)
    with pytest.raises(ValueError):
        MapConfig.of(speed=9)
    assert MapConfig.from_json(MapConfig(k=7, fr=True).to_json()) == MapConfig(k=7, fr=True)


def test_occupancy_places(spark):
    for n in (1, 2, 99, 100, 101, 200):
        rows = spark.createDataFrame([(i,) for i in range(n) for _ in range(i + 1)], "kmer int")
        got = X.occupancy(rows).first()
        assert tuple(got) == (1, n // 2 + 1, n * 99 // 100 + 1, n)


def test_hash_is_xxh64(spark):
    import xxhash
    from pyspark.sql import functions as F

    for x in (0, 1, -5, 1 << 40):
        expected = np.uint64(xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), 42)).astype(np.int64)
        assert spark.range(1).select(S.xxh64(F.lit(x))).first()[0] == expected


@pytest.mark.parametrize("stretch", [1, 7, 169, 170])
def test_kmers_and_searches_by_stretches(spark, stretch, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", stretch)
    seqs = [SEQ, SEQ[:10], SEQ[:9], "", None, "é" * 20]
    found = sorted((r.ref_id, r.pos, r.kmer) for r in X.positions(refs_of(spark, [(f"r{i}", s) for i, s in enumerate(seqs)]), 10).collect())
    assert found == [(i, p, v) for i, s in enumerate(seqs) for p, v in enumerate(kmers((s or "").encode(), 10))]
    refs = [("a", SEQ), ("b", SEQ[::-1])]
    sim = Simulator([(n, s.encode()) for n, s in refs], 10, 5, 0.1)
    queries = [SEQ[20:100], rc(SEQ[11:130]), rc(SEQ[::-1][40:77]), SEQ]
    assert mapped(Index.of(refs_of(spark, refs), MapConfig(k=10, bw=5)).query_batch(queries_of(spark, queries))) == [sim.search(q.encode()) for q in queries]


def test_long_sequence_goes_to_many_tasks(spark):
    n, k = 3_000_000, 15
    seq = np.random.default_rng(0).choice(np.frombuffer(b"ACGT", np.uint8), n).tobytes()
    rows = X.positions(spark.createDataFrame([(1, seq.decode())], "ref_id long, seq string"), k, stretch=1 << 17)
    total = rows.agg(F.count(F.lit(1)), F.sum(F.col("pos") * (F.col("kmer") % 1000)), F.countDistinct("pos")).first()
    code = S.kmers_of(S.byte_codes(seq), k).astype(np.int64)
    assert tuple(total) == (len(code), int((np.arange(len(code)) * (code % 1000)).sum()), len(code))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few MB would be read by one task
    try:
        assert rows.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("stretch", [1, 5, 1 << 16])
def test_run_offsets_by_stretches(spark, stretch):
    values = {1: [3, 3, 3, 1, 1, 2], 2: [5], None: [None, None, 1, 1], 4: [7] * 11}
    rows = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "key int, i long, v int")
    found = sorted(((r.key or 0, r.run, r.start) for r in X.run_offsets(rows, "key", "i", "v", stretch).collect()))
    expected = []
    for k, vs in values.items():
        starts = [i for i, v in enumerate(vs) if i == 0 or v != vs[i - 1]] + [len(vs)]
        expected += [(k or 0, n, s) for n, s in enumerate(starts)]
    assert found == sorted(expected)


def test_index_over_symbols(spark):
    r = np.random.default_rng(4)
    signals = r.integers(0, 16, (5, 60)).tolist()
    rows = spark.createDataFrame([(i, f"s{i}", x) for i, x in enumerate(signals)], "ref_id long, name string, x array<int>").withColumn("seq", S.symbol_text(F.col("x")))
    assert [r.seq for r in rows.orderBy("ref_id").collect()] == ["".join(f"{v:x}" for v in x) for x in signals]
    cfg = MapConfig(k=5, bw=3, encoder="symbols", sigma=16)
    index = Index.of(rows, cfg)
    found = sorted((r.ref_id, r.pos, r.kmer) for r in index.postings.collect())
    assert found == [(i, p, int("".join(f"{v:x}" for v in x[p : p + 5]), 16)) for i, x in enumerate(signals) for p in range(56)]
    queries = queries_of(spark, ["".join(f"{v:x}" for v in signals[3][12:50]), "0" * 30])
    assert [m[:3] for m in mapped(index.query_batch(queries))] == [("s3", True, 12), ("*", True, 0)]
    for bad in ({"k": 9, "encoder": "symbols", "sigma": 16}, {"sigma": 5}, {"encoder": "sound"}, {"k": 5, "encoder": "symbols", "fr": True}):
        with pytest.raises(ValueError):
            MapConfig(**bad)


def test_scalars(spark):
    row = spark.range(1).select(
        S.ipow(4, F.lit(0)).alias("a"), S.ipow(4, F.lit(14)).alias("b"), S.base_code(F.lit("g")).alias("c"),
        S.low32(S.make64(F.lit(7), F.lit(-1))).alias("d"), S.high32(S.make64(F.lit(7), F.lit(-1))).alias("e"), S.picoamps(F.lit(90), F.lit(8192.0), F.lit(10.0), F.lit(1400.0)).alias("f"),
    ).first()
    assert tuple(row) == (1, 4**14, 3, 0xFFFFFFFF, 7, 100 * 1400 / 8192)


@pytest.mark.parametrize("stretch", [6, 25, 1 << 16])
def test_minimizers_by_stretches(spark, stretch):
    k, w, seqs = 4, 6, [SEQ, SEQ[:9], SEQ[:8], "", "A" * 70]
    refs = refs_of(spark, [(f"r{i}", s) for i, s in enumerate(seqs)])
    found = sorted(map(tuple, X.minimizers(X.positions(refs, k), w, stretch).select("ref_id", "pos").collect()))
    expected = []
    for i, s in enumerate(seqs):
        codes = kmers(s.encode(), k)
        chosen = [min(range(a, a + w), key=lambda p: (codes[p], p)) for a in range(len(codes) - w + 1)]
        expected += [(i, p) for n, p in enumerate(chosen) if n == 0 or chosen[n - 1] != p]
    assert found == sorted(expected) and len(found) > 40


@pytest.mark.parametrize("stretch", [1, 3, 7, None])
def test_minimizers_and_runs_of_sequences(spark, stretch):
    r = random.Random(7)
    seqs = ["".join(r.choice("AC") for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 9, 40, 41)] + ["A" * 30, SEQ]
    refs = spark.createDataFrame([*enumerate(seqs), (None, "ACGT" * 3), (99, None)], "ref_id long, seq string")
    for k, w in ((4, 1), (4, 3), (2, 6)):
        want, runs = [], []
        for i, s in [*enumerate(seqs), (None, "ACGT" * 3)]:
            keys = kmers(s.encode(), k)
            last = None
            for a in range(len(keys) - w + 1):
                at = min(range(a, a + w), key=lambda j: (keys[j], j))
                want += [(i, at)] if at != last else []
                last = at
            starts = [j for j in range(len(keys)) if j == 0 or keys[j] != keys[j - 1]] + [len(keys)] * bool(keys)
            runs += [(i, j, at) for j, at in enumerate(starts)]
        assert sorted(map(tuple, X.sequence_minimizers(refs, k, w, stretch).collect()), key=str) == sorted(want, key=str)
        assert sorted(map(tuple, X.sequence_runs(refs, k, stretch).collect()), key=str) == sorted(runs, key=str)


def test_workers_hold_few_kmers_at_once(spark, monkeypatch):
    """A task of 40 MB of sequences, whose k-mers are 160 MB: what its worker holds doesn't grow with them."""
    began = []

    def watched(raw):
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * 4096
        began.append(held)
        if held - began[0] > 80 << 20:
            raise MemoryError(f"{(held - began[0]) >> 20} MB more than at the beginning")
        return S.byte_codes(raw)

    monkeypatch.setitem(S.ENCODERS, "dna", watched)
    refs = spark.range(100, numPartitions=1).select(F.col("id").alias("ref_id"), F.repeat(F.lit("ACGTTGCA"), 50_000).alias("seq"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert X.positions(refs, 15).agg(F.count("kmer"), F.max("pos")).first() == (100 * 399_986, 399_985)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stored_index_writes_postings_once(spark, tmp_path):
    """Beside the folder of the index nothing of its size is written, and its statistics are those of all postings."""
    from strandmill.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    refs = refs_of(spark, [("a", SEQ * 3), ("b", SEQ[::-1])])
    index = Index.of(refs, MapConfig(k=10))
    index.dump(str(tmp_path / "x.cidx"))
    assert set(folder.iterdir()) == before
    assert Index(spark, str(tmp_path / "x.cidx")).stats.first() == index.stats.first()


def test_postings_of_both_strands_come_from_one_reading(spark):
    refs = refs_of(spark, [("a", SEQ), ("é", "é" + SEQ[::-1]), ("short", "ACG")])
    cfg = MapConfig(k=10, fr=True)
    found = X.strand_postings(refs, cfg)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, X.postings(X.both_strands(refs), cfg).collect()))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_merges_sort_by_one_number(spark, tmp_path):
    """Two columns are sorted by comparisons, one number is not."""
    index = DynamicIndex(spark, MapConfig(k=10, num_shard_bits=3), str(tmp_path / "index"))
    index.add("a", SEQ)
    orders = []
    kind = type(spark.range(0))
    plain = kind.sortWithinPartitions
    kind.sortWithinPartitions = lambda self, *by, **k: orders.append((by, dict(self.dtypes).get(by[0]))) or plain(self, *by, **k)
    try:
        index.merge()
    finally:
        kind.sortWithinPartitions = plain
    assert orders[-1] == (("key",), "bigint")
    assert sorted(map(tuple, index.postings().select("kmer", "ref_id", "pos").collect())) == sorted(map(tuple, X.positions(refs_of(spark, [("a", SEQ)]), 10).collect()))


def test_batches_of_runs_are_bounded(spark, monkeypatch):
    """A task of 5 MB of bases, nearly each of which begins a run: starts leave its worker some at a time."""
    whole, most = type(spark.range(0)).mapInArrow, 16 * S.BATCH

    def watched(self, run, *args, **more):
        def bounded(batches):
            for b in run(batches):
                if b.nbytes > most:
                    raise MemoryError(f"a batch of {b.nbytes >> 20} MB")
                yield b

        return whole(self, bounded, *args, **more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    refs = spark.range(100, numPartitions=1).select(F.col("id").alias("ref_id"), F.repeat(F.lit("ACGT"), 12_500).alias("seq"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert X.sequence_runs(refs, 1).agg(F.count("run"), F.max("start")).first() == (100 * 50_001, 50_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stored_index_takes_less_than_its_postings(spark, tmp_path):
    """Neighbouring k-mers are stored together: less than 4 bytes for a posting, and a row for several of them."""
    seq = np.random.default_rng(1).choice(np.frombuffer(b"ACGT", np.uint8), 300_000).tobytes().decode()
    refs = refs_of(spark, [(f"r{i}", seq[a : a + 3000]) for i, a in enumerate(range(0, len(seq), 3000))])
    path = tmp_path / "x.cidx"
    Index.of(refs, MapConfig()).dump(str(path))
    loaded, n = Index(spark, str(path)), 100 * 2986
    assert sum(f.stat().st_size for f in (path / "postings").rglob("*.parquet")) < 4 * n
    assert 3 * sum(t.count() for t in loaded.tables) < n and loaded.postings.count() == n


@pytest.mark.parametrize("cfg", [MapConfig(k=10), MapConfig(k=9, fr=True, compressed=True), MapConfig(k=3, max_occ=40), MapConfig(k=1), MapConfig(k=5, encoder="symbols", sigma=11)])
def test_indexes_made_in_shares_are_whole(spark, tmp_path, cfg, monkeypatch):
    from strandmill.sources import store

    r = random.Random(6)
    seqs = ["".join(r.choice("0123456789a" if cfg.encoder == "symbols" else "ACGT") for _ in range(n)) for n in (300, 4, 0, 41, 150)] + ["A" * 80]
    refs = refs_of(spark, [(f"r{i}", s) for i, s in enumerate(seqs)])
    want, path = sorted(map(tuple, X.strand_postings(refs, cfg).collect())), str(tmp_path / "x.cidx")
    monkeypatch.setattr(store, "SHARE_ROWS", 20)
    index = Index.of(refs, cfg)
    shares, found = [], index._found
    monkeypatch.setattr(index, "_found", lambda share=None: shares.append(share) or found(share))
    index.dump(path, buckets=3)
    loaded = Index(spark, path)
    assert sorted(map(tuple, loaded.postings.collect())) == want and loaded.stats.first() == X.occupancy(X.strand_postings(refs, cfg), cfg).first()
    assert [s for s in shares if s] == [(i, len(shares) - 1) for i in range(len(shares) - 1)]
    loaded.dump(str(tmp_path / "again.cidx"), buckets=2)  # of an index that was loaded
    assert sorted(map(tuple, Index(spark, str(tmp_path / "again.cidx")).postings.collect())) == want


def test_merges_take_less_than_their_postings(spark, tmp_path, monkeypatch):
    """Less than 5 bytes for a posting, in one share or several, and nothing staged stays."""
    from strandmill.operators import dynamic
    from strandmill.storage import shared_dir

    seq = np.random.default_rng(2).choice(np.frombuffer(b"ACGT", np.uint8), 200_000).tobytes().decode()
    batch = spark.createDataFrame([(i, f"r{i}", seq[a : a + 4000]) for i, a in enumerate(range(0, len(seq), 4000))], "ord long, name string, seq string")
    direct = X.positions(batch.select((F.col("ord") + 1).alias("ref_id"), "seq"), 15).agg(F.count("kmer"), F.sum(F.xxhash64("kmer", "ref_id", "pos").cast("decimal(38,0)"))).first()
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    for most in (dynamic.SHARE_BASES, 70_000):
        monkeypatch.setattr(dynamic, "SHARE_BASES", most)
        index = DynamicIndex(spark, MapConfig(num_shard_bits=2), str(tmp_path / f"index{most}"))
        index.add_batch(batch)
        index.merge()
        lowest = index.names.agg(F.min("ref_id")).first()[0]
        found = index.postings().select("kmer", (F.col("ref_id") + (1 - lowest)).alias("ref_id"), "pos")
        assert found.agg(F.count("kmer"), F.sum(F.xxhash64("kmer", "ref_id", "pos").cast("decimal(38,0)"))).first() == direct
        assert sum(f.stat().st_size for f in (tmp_path / f"index{most}/postings").rglob("*.parquet")) < 5 * direct[0]
    assert not [f.name for f in set(folder.iterdir()) - before if f.name.startswith(("staged", "placed"))]


def test_runs_are_not_written_or_shuffled(spark):
    """Starts, eight bytes for most bases, go from where they are made to what reads them; only stretches are dealt."""
    from strandmill.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    refs = spark.createDataFrame([(0, SEQ), (None, SEQ[:50]), (2, "ACG"), (3, "A" * 40)], "ref_id long, seq string")
    for stretch in (None, 30):
        found = X.sequence_runs(refs, 1, stretch)
        assert found.count() == sum(1 + sum(a != b for a, b in zip(" " + s, s)) for s in (SEQ, SEQ[:50], "ACG", "A" * 40))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        dealt = plan[: plan.index("MapInArrow")]
        assert "Repartition" not in dealt and "Join" not in dealt and "Window" not in dealt
    assert not [f.name for f in set(folder.iterdir()) - before]


def test_spans_of_pieces_are_their_postings(spark, tmp_path):
    from strandmill.functions import spans
    from strandmill.sources import fasta

    (tmp_path / "r.fa").write_text(f">a\n{SEQ}\n>b\nAC\n>c\n{SEQ[::-1]}{'A' * 30}\n")
    refs, pieces = fasta.read_pieces(spark, str(tmp_path / "r.fa"), 70, 40)
    cfg = MapConfig(k=7, fr=True)
    found = spans.expanded(X.piece_spans(pieces, refs, cfg), cfg.k).select("kmer", "ref_id", "pos")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, X.piece_postings(pieces, refs, cfg).collect()))
