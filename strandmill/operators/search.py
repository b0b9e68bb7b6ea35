"""Best reference, strand and position of each query by voting.

Each query k-mer votes for every posting of the same k-mer: for a diagonal bin of the reference, and once more for
the bin ``bw`` bins before where there is one; in fragment indexes for a fragment. A bin's support is one less than
its votes, over the query's k-mers. The bin with the most votes wins, of several the one that got its last vote
first, in the order query position, reference, posting. Votes are counted where they arise and combined by query,
strand and bin; the winner is a minimum aggregate, so no query's votes are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MapConfig
from ..functions import sequence as S
from ..functions import spans
from .index import fragments_of

#: Up to so many query k-mers (12 bytes each) are broadcast to the postings; more are joined by shuffle.
BROADCAST_KMERS = 2_000_000
#: So few query k-mers name the shards to be read before the search.
FEW_KMERS = 4096


def long_enough(queries: DataFrame, k: int) -> DataFrame:
    """Queries of more than 2k bytes; the others match nothing."""
    return queries.where(F.octet_length("seq") > 2 * k)


def query_kmers(queries: DataFrame, cfg: MapConfig, both: bool) -> DataFrame:
    """``q_id, fwd, j, kmer`` of the queries, and of their reverse complements if ``both``."""
    long = long_enough(queries, cfg.k).select("q_id", "seq", F.octet_length("seq").alias("n"))
    dealt = S.stretches(long, cfg.k).repartition("q_id", "at")

    def strand(fwd):
        found = S.kmer_rows(dealt.select("q_id", "at", "n", F.octet_length("piece").alias("m"), "piece"), cfg.k, not fwd, cfg.encoder, cfg.sigma)
        # what follows a piece comes before it on the other strand
        before = F.col("at") if fwd else F.col("n") - F.col("at") - F.col("m")
        return found.select("q_id", F.lit(fwd).alias("fwd"), (before + F.col("i")).alias("j"), "kmer")

    return strand(True).unionByName(strand(False)) if both else strand(True)


def hits(queries: DataFrame, postings: DataFrame | list[DataFrame], cfg: MapConfig, both: bool, on: list[str] | None = None, broadcast: int | None = None) -> DataFrame:
    """Query k-mers joined with equal k-mers' postings, of one table or several; of tables of spans (and then of all) with the
    spans of equal least m-mers, in each of which a k-mer can stand in one place."""
    asked = query_kmers(queries, cfg, both)
    size = (long_enough(queries, cfg.k).agg(F.sum(F.octet_length("seq"))).first()[0] or 0) * (2 if both else 1)
    small = size <= (BROADCAST_KMERS if broadcast is None else broadcast)
    tables = postings if isinstance(postings, list) else [postings]
    spanned = "kmer_min" in tables[0].columns
    if spanned:
        asked = spans.with_least(asked, cfg.k, cfg.sigma).withColumnRenamed("kmer", "asked")
    key = "kmer_min" if spanned else "kmer"
    if on:
        asked = asked.withColumn("shard", S.shard(F.col(key), cfg.num_shard_bits))
        if size < min(1 << cfg.num_shard_bits, FEW_KMERS):  # with more there is hardly a shard to leave out
            shards = [row.shard for row in asked.select("shard").distinct().collect()]
            tables = [rows.where(F.col("shard").isin(shards)) for rows in tables]
    found = reduce(DataFrame.unionByName, [rows.join(F.broadcast(asked) if small else asked, on or [key]) for rows in tables])
    if not spanned:
        return found
    place = F.col("off") - F.col("at")
    return found.where(spans.kmer_at(place, cfg.k, cfg.sigma) == F.col("asked")).select("q_id", "fwd", "j", F.col("asked").alias("kmer"), "ref_id", (F.col("pos") + place).alias("pos"))


def votes(found: DataFrame, cfg: MapConfig) -> DataFrame:
    """``q_id, fwd, ref_id, bin, cnt, last``: each bin's votes, and its last vote's place in the order."""
    if cfg.fragments:
        found = found.select("q_id", "fwd", "ref_id", "j", F.explode(fragments_of(F.col("pos"), cfg.jc_frag_len, cfg.stride)).alias("frag")).withColumn("bin", F.col("frag").cast("long"))
        rows = found.select("q_id", "fwd", "ref_id", "bin", F.struct("j", "ref_id", F.col("bin").alias("pos"), F.lit(0).alias("sub")).alias("at"))
    else:
        b = S.diagonal_bin(F.col("pos"), F.col("j"), cfg.bw)
        rows = found.withColumn("b", b)
        one = F.struct(F.col("b").alias("bin"), F.lit(0).alias("sub"))
        two = F.struct((F.col("b") - cfg.bw).alias("bin"), F.lit(1).alias("sub"))
        rows = rows.withColumn("x", F.explode(F.when(F.col("b") >= cfg.bw, F.array(one, two)).otherwise(F.array(one))))
        rows = rows.select("q_id", "fwd", "ref_id", F.col("x.bin").alias("bin"), F.struct("j", "ref_id", "pos", F.col("x.sub").alias("sub")).alias("at"))
    return rows.groupBy("q_id", "fwd", "ref_id", "bin").agg(F.count(F.lit(1)).alias("cnt"), F.max("at").alias("last"))


def top_bins(counted: DataFrame) -> DataFrame:
    """The winning bin of each query and strand among those with two votes or more."""
    order = F.struct((-F.col("cnt")).alias("neg"), "last", "ref_id", "bin")
    best = counted.where("cnt >= 2").groupBy("q_id", "fwd").agg(F.min(order).alias("b"))
    return best.select("q_id", "fwd", "b.ref_id", "b.bin", (-F.col("b.neg")).alias("cnt"))


def supported(best: DataFrame, queries: DataFrame, cfg: MapConfig) -> DataFrame:
    """Adds ``support`` (float) and keeps bins that reach the threshold, which is compared as a float too."""
    n = queries.select("q_id", (F.octet_length("seq") - cfg.k + 1).alias("n_kmers"))
    support = ((F.col("cnt") - 1) / F.col("n_kmers")).cast("float")
    return best.join(n, "q_id").withColumn("support", support).where(F.col("support") >= F.lit(cfg.pf).cast("float")).drop("n_kmers")


def better_strand(rows: DataFrame) -> DataFrame:
    """Of a query's strands the one with more support, forward on a tie."""
    order = F.struct((-F.col("support")).alias("neg"), (~F.col("fwd")).alias("rev"), "ref_id", "bin")
    best = rows.groupBy("q_id").agg(F.min(order).alias("b"))
    return best.select("q_id", (~F.col("b.rev")).alias("fwd"), "b.ref_id", "b.bin", (-F.col("b.neg")).alias("support"))


def map_queries(
    queries: DataFrame, postings: DataFrame | list[DataFrame], refs: DataFrame, cfg: MapConfig, both: bool | None = None, on: list[str] | None = None, broadcast: int | None = None
) -> DataFrame:
    """``q_id, name, qlen, ref, fwd, pos, support``, one row per query; ``*``, forward, 0, 0 where nothing matches.

    ``refs`` has ``ref_id`` and ``name`` as indexed, and with ``compat`` the fragment table's columns. ``broadcast`` takes
    the place of ``BROADCAST_KMERS``.
    """
    both = not cfg.fr and cfg.encoder == "dna" if both is None else both
    best = better_strand(supported(top_bins(votes(hits(queries, postings, cfg, both, on, broadcast), cfg)), queries, cfg))
    if cfg.fragments and cfg.compat:
        best, refs = _literal_fragment(best, refs, cfg), refs.select("ref_id", "name")
    else:
        best = best.withColumn("pos", F.col("bin") * (cfg.stride if cfg.fragments else cfg.bw))
    named = best.join(refs.select("ref_id", F.col("name").alias("ref")), "ref_id", "left" if cfg.compat else "inner")
    named = named.select("q_id", "fwd", "ref", "pos", "support").where("ref is not null")
    return queries.select("q_id", "name", F.octet_length("seq").alias("qlen")).join(named, "q_id", "left").select(
        "q_id", "name", "qlen", F.coalesce("ref", F.lit("*")).alias("ref"), F.coalesce("fwd", F.lit(True)).alias("fwd"),
        F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), F.coalesce("support", F.lit(0.0)).cast("float").alias("support"),
    )


def _literal_fragment(best: DataFrame, table: DataFrame, cfg: MapConfig) -> DataFrame:
    """The older rule: a reference's first fragment has the name before it, and positions count from the reference's
    ordinal instead of its first fragment; the very first fragment has no name."""
    own = best.join(table.select("ref_id", "ordinal", "frag_start"), "ref_id")
    place = F.when(F.col("bin") == 0, F.col("ordinal")).otherwise(F.col("ordinal") + 1)
    own = own.withColumn("place", place).withColumn("pos", (F.col("frag_start") + F.col("bin") - F.col("place")) * cfg.stride).drop("ref_id", "ordinal", "frag_start")
    names = table.select("ref_id", (F.col("ordinal") + 1).alias("place"))
    return own.join(names, "place", "left").drop("place")


def alignments(mapped: DataFrame) -> DataFrame:
    """``q_id, name, alignment``: struct of ``ctg, r_st, r_en, strand, pres_frac``; unmatched ones span 0 to the
    query's length."""
    a = F.struct(
        F.col("ref").alias("ctg"), F.col("pos").cast("int").alias("r_st"), (F.col("pos") + F.col("qlen")).cast("int").alias("r_en"),
        F.when(F.col("fwd"), 1).otherwise(-1).alias("strand"), F.col("support").alias("pres_frac"),
    )
    return mapped.select("q_id", "name", a.alias("alignment"))
