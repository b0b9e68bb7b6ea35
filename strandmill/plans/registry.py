"""The registered queries, and the DuckDB SQL that gives the same rows.

References are the documents and queries the benchmark passages, any byte being a base; signals are the events'
values by user, or the embeddings' components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MapConfig
from ..functions import sequence as S
from ..mapper import INDEX_SUFFIX, Index, map_reads
from ..operators import index as X
from ..operators import search
from ..operators import signal as N
from ..operators.dynamic import DynamicIndex
from ..sources import fasta, pore_model
from ..storage import new_path
from ..streaming import reads as streaming
from . import oracles


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("seq"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.concat(F.lit("b"), "item_id").alias("name"), F.col("text").alias("seq"))


def _both_ways(spark: SparkSession, d: str) -> DataFrame:
    q = _passages(spark, d)
    back = q.select((F.col("q_id") * 2 + 1).alias("q_id"), F.concat("name", F.lit("r")).alias("name"), S.revcomp(F.col("seq")).alias("seq"))
    return q.withColumn("q_id", F.col("q_id") * 2).unionByName(back)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("seq"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Samples numbered over all tasks, so that no user's events are in one task whole."""
    rows = _table(spark, d, "events").select(F.col("user_id").alias("read_id"), "ts", "event_id", F.col("value").alias("x"))
    return X.numbered(rows, "read_id", ["ts", "event_id"], "i").select("read_id", "i", "x")


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("read_id"), F.posexplode("embedding").alias("i", "x")).select("read_id", "i", (F.col("x").cast("double") * 8).alias("x"))


def _map(refs: DataFrame, queries: DataFrame, cfg: MapConfig) -> DataFrame:
    postings = X.strand_postings(refs, cfg)
    refs = X.both_strands(refs) if cfg.fr else refs
    named = X.fragment_table(refs, cfg) if cfg.compat else refs.select("ref_id", "name")
    return search.map_queries(queries, postings, named, cfg)


def _rounded(mapped: DataFrame) -> DataFrame:
    return mapped.withColumn("support", F.round(F.col("support").cast("double"), 6))


def encode_bytes(spark, d):
    return _table(spark, d, "benchmark").select("item_id", S.codes(F.col("text")).alias("codes"))


def revcomp(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.md5(S.revcomp(F.col("text"))).alias("revcomp_md5"))


def kmer_extract(spark, d):
    return X.positions(_items(spark, d), 15).select(F.col("ref_id").alias("item_id"), "pos", "kmer")


def kmer_sql_equal(spark, d):
    """Whether the Arrow k-mers of each passage equal those of the SQL functions."""
    c = S.codes(F.col("text"))
    rows = _table(spark, d, "benchmark").select("item_id", c.alias("c"), S.kmers(F.col("text"), 15).alias("fast"))
    n = F.length("c") - 14
    slow = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: S.encode_kmer(F.col("c"), i, 15))).otherwise(F.array().cast("array<int>"))
    return rows.select("item_id", (F.col("fast") == slow).alias("equal"))


def _digest(rows: DataFrame, n: str, **sums: str) -> DataFrame:
    """Per document the rows with ``n``, and sums."""
    return rows.groupBy(F.col("ref_id").alias("doc_id")).agg(F.count(n).alias("n"), *[F.sum(F.expr(e)).alias(name) for name, e in sums.items()])


def pack_posting(spark, d):
    """Checksums of each document's packed postings and of what they are unpacked to."""
    packed = X.positions(_refs(spark, d), 15).select(S.pack_posting(F.col("ref_id"), F.col("pos")).alias("packed"))
    both = packed.select("packed", S.posting_ref(F.col("packed")).alias("ref_id"), S.posting_pos(F.col("packed")).alias("pos"))
    return _digest(both, n="packed", packed="packed % 1000003", places="pos")


def shard_key(spark, d):
    """Checksums of the shards and keys of each document's k-mers."""
    both = X.positions(_refs(spark, d), 15).select("ref_id", "pos", S.shard(F.col("kmer"), 10).alias("shard"), S.shard_key(F.col("kmer"), 10).alias("skey"))
    return _digest(both, n="pos", shards="shard * (pos % 1009)", skeys="skey * (pos % 1009)")


def ipow(spark, d):
    return _table(spark, d, "part").select("p_partkey", S.ipow(3, F.col("p_partkey") % 33).alias("power"))


def split64(spark, d):
    both = _table(spark, d, "orders").select("o_orderkey", S.make64(F.col("o_orderkey"), F.col("o_custkey")).alias("packed"))
    return both.select("o_orderkey", "packed", S.high32(F.col("packed")).alias("high"), S.low32(F.col("packed")).alias("low"))


def picoamps(spark, d):
    """Event values as raw samples of a device with a range of 1,400 pA."""
    current = S.picoamps(F.col("value"), F.lit(8192.0), F.lit(10.0), F.lit(1400.0))
    return _table(spark, d, "events").select("event_id", F.round(current, 6).alias("pa"))


def xxh64(spark, d):
    return _table(spark, d, "benchmark").select("item_id", S.xxh64(F.col("item_id")).alias("hash"))


def index_histogram(spark, d):
    return X.histogram(X.positions(_refs(spark, d), 8))


def index_offsets(spark, d):
    return X.offsets(X.positions(_refs(spark, d), 8))


def occ_profile(spark, d):
    return X.occupancy(X.positions(_refs(spark, d), 15))


def minimizers(spark, d):
    """Each document's number of minimizers and a checksum of their places."""
    found = X.sequence_minimizers(_refs(spark, d), 10, 5)
    return _digest(found, n="pos", places="pos * (pos % 1009)")


def run_offsets(spark, d):
    """Each document's number of runs and a checksum of where they begin."""
    found = X.sequence_runs(_refs(spark, d), 1)
    return _digest(found, n="run", starts="start * (run % 1009 + 1)")


def map_coordinate(spark, d):
    return _rounded(_map(_refs(spark, d), _passages(spark, d), MapConfig()))


def map_both_strands(spark, d):
    return _rounded(_map(_refs(spark, d), _both_ways(spark, d), MapConfig()))


def map_coordinate_fr(spark, d):
    return _rounded(_map(_refs(spark, d), _both_ways(spark, d), MapConfig(fr=True)))


def map_fragment(spark, d):
    return _rounded(_map(_refs(spark, d), _passages(spark, d), MapConfig(jaccard=True)))


def map_fragment_compressed(spark, d):
    """By way of an index that is stored with the denser codec and loaded again."""
    return _rounded(_saved(spark, d, MapConfig(compressed=True)).query_batch(_passages(spark, d)))


def map_saved_index(spark, d):
    """By way of a stored index, whose buckets the queries' k-mers are shuffled to."""
    return _rounded(_saved(spark, d, MapConfig()).query_batch(_passages(spark, d), broadcast=0))


def _saved(spark: SparkSession, d: str, cfg: MapConfig) -> Index:
    path = new_path(spark, "index") + INDEX_SUFFIX
    Index.of(_refs(spark, d), cfg).dump(path)
    return Index(spark, path)


def map_fragment_compat(spark, d):
    return _rounded(_map(_refs(spark, d), _passages(spark, d), MapConfig(jaccard=True, compat=True)))


def fragment_table(spark, d):
    return X.fragment_table(_refs(spark, d), MapConfig(jaccard=True))


def guard_short(spark, d):
    q = _refs(spark, d).withColumnRenamed("ref_id", "q_id")
    return search.long_enough(q, 15).select(F.col("q_id").alias("doc_id"), F.octet_length("seq").alias("bytes"))


def support_threshold(spark, d):
    return _rounded(_map(_refs(spark, d), _passages(spark, d), MapConfig(pf=0.6))).where("ref <> '*'").select("q_id", "ref", "fwd", "pos", "support")


def strand_choice(spark, d):
    return map_both_strands(spark, d).groupBy("fwd").agg(F.count(F.lit(1)).alias("n"))


def dyn_two_batches(spark, d):
    """Documents added in two batches, searched after the second merge."""
    index = DynamicIndex(spark, MapConfig(num_shard_bits=4))
    docs = _refs(spark, d).withColumnRenamed("ref_id", "ord")
    middle = docs.agg(F.expr("max(ord) div 2")).first()[0]
    for half in (docs.where(F.col("ord") <= middle), docs.where(F.col("ord") > middle)):
        index.add_batch(half)
        index.merge()
    return _rounded(index.query_batch(_passages(spark, d)))


def tsv_sink(spark, d):
    return fasta.tsv_lines(_map(_refs(spark, d), _passages(spark, d), MapConfig()))


def alignments(spark, d):
    found = search.alignments(_map(_refs(spark, d), _passages(spark, d), MapConfig()))
    return found.select("q_id", "alignment.*").withColumn("pres_frac", F.round(F.col("pres_frac").cast("double"), 6))


def map_reads_query(spark, d):
    reads = _table(spark, d, "benchmark").select(F.lit(1).alias("channel"), F.col("item_id").cast("string").alias("read_id"), F.col("text").alias("seq"), "item_id")
    return map_reads(reads, Index.of(_refs(spark, d))).select("item_id", F.size("alignment_data").alias("n_alignments"))


def stream_reads(spark, d):
    """The passages as a stream of files, mapped batch by batch, written once each and read back."""
    folder = new_path(spark, "stream")
    reads = _table(spark, d, "benchmark").select(F.lit(1).alias("channel"), F.col("item_id").cast("string").alias("read_id"), F.col("text").alias("seq"), F.col("item_id").alias("request"))
    reads.repartition(4, "request").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    streaming.query_stream(stream, Index.of(_refs(spark, d)), streaming.to_parquet(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    found = streaming.read_back(spark, f"{folder}/out").withColumn("a", F.get("alignment_data", F.lit(0)))
    return found.select("request", F.col("a.ctg").alias("ctg"), F.col("a.r_st").alias("r_st"), F.col("a.strand").alias("strand"))


def signal_normalise(spark, d):
    return N.normalise_long(_signals(spark, d)).withColumn("z", F.round("z", 4))


def signal_tstat(spark, d):
    return N.tstat(_signals(spark, d), 3).withColumn("t", F.round("t", 4))


def quantise_static16(spark, d):
    return _scaled(spark, d).select("read_id", "i", N.quantise_static(F.col("x")).alias("level"))


def quantise_static8(spark, d):
    return _scaled(spark, d).select("read_id", "i", N.quantise_static(F.col("x"), N.EDGES_8).alias("level"))


def quantise_dynamic(spark, d):
    return _scaled(spark, d).select("read_id", "i", N.quantise_dynamic(F.col("x")).alias("code"))


def quantise_deadband(spark, d):
    kept = N.dead_band_long(_signals(spark, d)).select("read_id", N.quantise_dynamic(F.col("x")).alias("code"))
    return kept.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("code_sum"))


def trimmed_means(spark, d):
    """Trimmed means of every twelve samples of a signal."""
    segments = _signals(spark, d).groupBy("read_id", F.expr("i div 12").alias("segment")).agg(F.collect_list("x").alias("xs"))
    return segments.select("read_id", "segment", F.round(N.trimmed(F.col("xs")), 6).alias("mean"))


def _quantised(spark: SparkSession, d: str) -> DataFrame:
    level = F.transform("embedding", lambda x: N.quantise_static(x.cast("double") * 8))
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("ref_id"), F.concat(F.lit("v"), "vec_id").alias("name"), S.symbol_text(level).alias("seq"))


def signal_kmers(spark, d):
    return X.positions(_quantised(spark, d), 6, "symbols", 16).select(F.col("ref_id").alias("read_id"), "pos", "kmer")


def map_signal(spark, d):
    """Quantised signals from their eleventh sample on, mapped to all whole ones."""
    refs = _quantised(spark, d)
    queries = refs.select(F.col("ref_id").alias("q_id"), "name", F.expr("substr(seq, 11)").alias("seq"))
    return _rounded(_map(refs, queries, MapConfig(k=6, bw=5, encoder="symbols", sigma=16)))


def segment_events(spark, d):
    return N.events_long(_signals(spark, d)).withColumn("mean", F.round("mean", 6))


def squiggle(spark, d):
    """Each document's number of levels and a checksum of them, by a made-up 6-mer model."""
    letters = lambda code: F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), 6, "0"), "0123", S.LETTERS)
    model = spark.range(4096).select(letters(F.col("id")).alias("kmer"), (F.col("id") * 7919 % 4096).cast("double").alias("level_mean"))
    scored, k = pore_model.normalised(model)
    levels = N.squiggles(_refs(spark, d), scored, k)
    return _digest(levels, n="pos", level_sum="cast(round(level * 1000000) as bigint) * (pos % 1009)")


QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        map_coordinate, map_both_strands, map_coordinate_fr, map_fragment, map_fragment_compressed, map_saved_index, map_fragment_compat, fragment_table,
        encode_bytes, revcomp, kmer_extract, kmer_sql_equal, pack_posting, shard_key, ipow, split64, picoamps, xxh64, index_histogram, index_offsets, occ_profile,
        minimizers, run_offsets, guard_short, support_threshold, strand_choice, dyn_two_batches, tsv_sink, alignments, map_reads_query, stream_reads,
        signal_normalise, signal_tstat, quantise_static16, quantise_static8, quantise_dynamic, quantise_deadband, trimmed_means, segment_events, squiggle,
        signal_kmers, map_signal,
    )
}

ORACLE_SQL: dict[str, str] = oracles.all_sql(N.EDGES_16, N.EDGES_8)
