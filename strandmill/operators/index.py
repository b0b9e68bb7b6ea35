"""K-mer indexes over reference sequences and statistics of them.

References are ``ref_id INT, name STRING, seq STRING``; ``ref_id`` is the order of arrival. Postings are ``kmer, ref_id, pos``;
what is written holds them as spans (``functions.spans``). Fragments follow from positions, so those of a posting are derived where it votes and a
k-mer is stored once, not once for each fragment that holds it.

A sequence may also come in pieces, ``ref_id, at, piece``: bytes from ``at`` on, no piece being empty, so that none has to
fit into a row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MapConfig
from ..functions import sequence as S
from ..functions import spans as R
from ..storage import written


def both_strands(refs: DataFrame) -> DataFrame:
    """Each reference twice, ``name+`` and ``name-``, with ids in order of arrival."""
    last = [F.col("bases")] * 2 if "bases" in refs.columns else [F.col("seq"), S.revcomp(F.col("seq")).alias("seq")]
    plus = refs.select((F.col("ref_id") * 2).alias("ref_id"), F.concat("name", F.lit("+")).alias("name"), last[0])
    minus = refs.select((F.col("ref_id") * 2 + 1).alias("ref_id"), F.concat("name", F.lit("-")).alias("name"), last[1])
    return plus.unionByName(minus)


def positions(refs: DataFrame, k: int, encoder: str = "dna", sigma: int = 4, stretch: int | None = None) -> DataFrame:
    """``kmer, ref_id, pos`` for each k-mer of each reference. Stretches of the sequences are dealt out first: a file
    with a few row groups, or one long sequence, would otherwise be cut into k-mers by as few tasks."""
    dealt = S.stretches(refs.select("ref_id", "seq"), k, stretch).repartition("ref_id", "at")
    found = S.kmer_rows(dealt, k, encoder=encoder, sigma=sigma)
    return found.select("kmer", "ref_id", (F.col("at").cast("long") + F.col("i")).alias("pos"))


def fragments_of(pos: Column, length: int, stride: int) -> Column:
    """Fragments that hold the k-mer at ``pos``: they start every ``stride`` k-mers and the last ones are short."""
    first = F.greatest(F.lit(0), F.floor((pos - length) / stride).cast("int") + 1)
    return F.sequence(first, F.floor(pos / stride).cast("int"))


def running(rows: DataFrame, order: list[str], **amounts: Column | str) -> DataFrame:
    """``rows`` with the sum of each amount over all rows that come before. The rows are sorted over all tasks and
    written, each task sums its own, and the tasks' totals, of which there is one row each, are carried over."""
    values = {f"_{name}": F.col(c) if isinstance(c, str) else c for name, c in amounts.items()}
    ordered = rows.withColumns(values).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's
    ordered = written(ordered.withColumn("_at", at).withColumn("_task", F.shiftright("_at", 33)), "ordered")
    totals = ordered.groupBy("_task").agg(*[F.sum(c).alias(c) for c in values])
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_task", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_carried") for c in values])
    own = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = ordered.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in values})
    sums = [(F.col(f"_{name}_inside") + F.col(f"_{name}_carried")).alias(name) for name in amounts]
    return inside.join(F.broadcast(carried), "_task").select(*rows.columns, *sums)


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number (from 0) among those of equal ``key``, in order, counted over all tasks."""
    placed = running(rows, [key, *order], _place=F.lit(1))
    first = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_first"))
    return placed.join(first, F.col(key).eqNullSafe(F.col("_key"))).select(*rows.columns, (F.col("_place") - F.col("_first")).alias(name))


def fragment_table(refs: DataFrame, cfg: MapConfig) -> DataFrame:
    """``ref_id, name, ordinal, frag_start, n_frags``: the fragments of each reference in one global numbering."""
    n = F.greatest(bases_of(refs) - cfg.k + 1, F.lit(0))
    counted = refs.select("ref_id", "name", F.ceil(n / cfg.stride).cast("int").alias("n_frags"))
    return running(counted, ["ref_id"], ordinal=F.lit(1), frag_start="n_frags").select("ref_id", "name", "ordinal", "frag_start", "n_frags")


def bases_of(refs: DataFrame) -> Column:
    """The lengths of references with their sequences, or with ``bases``."""
    return F.col("bases") if "bases" in refs.columns else F.octet_length("seq")


def postings(refs: DataFrame, cfg: MapConfig) -> DataFrame:
    """The index's postings; ``refs`` as indexed, so with both strands already if those are wanted."""
    return _rare(positions(refs, cfg.k, cfg.encoder, cfg.sigma), cfg)


def strand_postings(refs: DataFrame, cfg: MapConfig) -> DataFrame:
    """``postings`` of references as they came, with ``fr`` of both strands, numbered as by ``both_strands``: the sequences are
    dealt out once and read in both directions, so no reverse complement is ever written as text."""
    if not cfg.fr:
        return postings(refs, cfg)
    cut = S.stretches(refs.select("ref_id", F.octet_length("seq").alias("n"), "seq"), cfg.k).repartition("ref_id", "at")
    dealt = cut.select("ref_id", "at", "n", F.octet_length("piece").alias("m"), "piece", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    found = S.kmer_rows(dealt, cfg.k, "back")
    begin = F.when(F.col("back"), F.col("n") - F.col("at") - F.col("m")).otherwise(F.col("at"))
    return _rare(found.select("kmer", (F.col("ref_id") * 2 + F.col("back").cast("int")).alias("ref_id"), (begin.cast("long") + F.col("i")).alias("pos")), cfg)


def _rare(rows: DataFrame, cfg: MapConfig) -> DataFrame:
    if cfg.max_occ:
        rare = histogram(rows, cfg).where(F.col("n") <= cfg.max_occ).select("kmer")
        rows = rows.join(rare, "kmer", "left_semi")
    return rows


def span_positions(refs: DataFrame, k: int, share: tuple[int, int] | None = None) -> DataFrame:
    """``positions`` of bases as spans; of a share ``(r, of)`` those that fall to it."""
    dealt = S.stretches(refs.select("ref_id", "seq"), k).repartition("ref_id", "at")
    return _placed(R.span_rows(dealt, k, share=share), "ref_id", F.col("at"))


def strand_spans(refs: DataFrame, cfg: MapConfig, share: tuple[int, int] | None = None) -> DataFrame:
    """``strand_postings`` as spans; of a share ``(r, of)`` those that fall to it."""
    cut = S.stretches(refs.select("ref_id", F.octet_length("seq").cast("long").alias("total"), "seq"), cfg.k).repartition("ref_id", "at")
    return _rare_spans(_dealt_spans(cut, cfg, share), cfg)


def piece_spans(pieces: DataFrame, refs: DataFrame, cfg: MapConfig, share: tuple[int, int] | None = None) -> DataFrame:
    """``piece_postings`` as spans; of a share ``(r, of)`` those that fall to it."""
    whole = whole_pieces(pieces, cfg.k).select("ref_id", "at", "piece")
    if cfg.fr:
        whole = whole.join(refs.select("ref_id", F.col("bases").alias("total")), "ref_id")
    return _rare_spans(_dealt_spans(whole, cfg, share), cfg)


def _dealt_spans(dealt: DataFrame, cfg: MapConfig, share: tuple[int, int] | None) -> DataFrame:
    """Spans of ``ref_id, at, piece``, and with ``fr`` ``total``, the bases of the whole reference."""
    if not cfg.fr:
        return _placed(R.span_rows(dealt.select("ref_id", "at", "piece"), cfg.k, False, cfg.encoder, cfg.sigma, share), "ref_id", F.col("at"))
    both = dealt.select("ref_id", "at", "total", F.octet_length("piece").alias("m"), "piece", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    begin = F.when(F.col("back"), F.col("total") - F.col("at") - F.col("m")).otherwise(F.col("at"))
    return _placed(R.span_rows(both, cfg.k, "back", share=share), F.col("ref_id") * 2 + F.col("back").cast("int"), begin)


def _placed(found: DataFrame, ref_id: Column | str, begin: Column) -> DataFrame:
    return found.select(*R.SPAN, (F.col(ref_id) if isinstance(ref_id, str) else ref_id).alias("ref_id"), (begin.cast("long") + F.col("i")).alias("pos"))


def _rare_spans(rows: DataFrame, cfg: MapConfig) -> DataFrame:
    return R.lone(_rare(R.expanded(rows, cfg.k, cfg.sigma), cfg)) if cfg.max_occ else rows


def whole_pieces(pieces: DataFrame, k: int) -> DataFrame:
    """``ref_id, at, own, piece``: pieces with the k - 1 bytes that follow them, ``own`` being the bytes before those. What
    meets in order is the beginnings of pieces, one short row each."""
    head = pieces.select("ref_id", "at", F.substring("piece", 1, max(1, k - 1)).alias("head"))
    later = Window.partitionBy("ref_id").orderBy("at").rowsBetween(1, max(1, k - 1))
    tails = head.select(F.col("ref_id").alias("of"), F.col("at").alias("of_at"), F.collect_list("head").over(later).alias("heads"))
    tail = F.substring(F.aggregate("heads", F.lit(bytearray()), lambda a, h: F.concat(a, h)), 1, k - 1)
    joined = pieces.join(tails, (F.col("ref_id") == F.col("of")) & (F.col("at") == F.col("of_at")))
    return joined.select("ref_id", "at", F.octet_length("piece").alias("own"), F.concat("piece", tail).alias("piece"))


def piece_postings(pieces: DataFrame, refs: DataFrame, cfg: MapConfig) -> DataFrame:
    """``postings`` of references in pieces, ``refs`` having their ``bases``; with ``fr`` of both strands, numbered as by
    ``both_strands``."""
    whole = whole_pieces(pieces, cfg.k)
    found = S.kmer_rows(whole.select("ref_id", "at", "piece"), cfg.k)
    plus = found.select("kmer", (F.col("ref_id") * 2 if cfg.fr else F.col("ref_id")).alias("ref_id"), (F.col("at") + F.col("i")).alias("pos"))
    if not cfg.fr:
        return _rare(plus, cfg)
    length = F.octet_length("piece")
    back = S.kmer_rows(whole.select("ref_id", "at", length.alias("m"), "piece"), cfg.k, True).join(refs.select("ref_id", "bases"), "ref_id")
    minus = back.select("kmer", (F.col("ref_id") * 2 + 1).alias("ref_id"), (F.col("bases") - F.col("at") - F.col("m") + F.col("i")).alias("pos"))
    return _rare(plus.unionByName(minus), cfg)


def histogram(rows: DataFrame, cfg: MapConfig | None = None) -> DataFrame:
    """``kmer, n``: postings of each k-mer that has any; in fragment indexes (``cfg``) each counts once for each fragment
    that holds it. Of spans (which need ``cfg``), those that are dealt by ``kmer_min`` are not dealt again."""
    keys = ["kmer"]
    if "kmer_min" in rows.columns:
        rows, keys = R.expanded(rows, cfg.k, cfg.sigma) if "bases" in rows.columns else rows, ["kmer_min", "kmer"]
    if cfg is None or not cfg.fragments:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("kmer", "n")
    return rows.groupBy(*keys).agg(F.sum(F.size(fragments_of(F.col("pos"), cfg.jc_frag_len, cfg.stride)).cast("long")).alias("n")).select("kmer", "n")


def offsets(rows: DataFrame) -> DataFrame:
    """``kmer, n, offset``: where each k-mer's run begins among all postings in k-mer order."""
    return running(histogram(rows), ["kmer"], offset="n")


def occupancy(rows: DataFrame | list[DataFrame], cfg: MapConfig | None = None) -> DataFrame:
    """Of one table or several that share no k-mer, one row: ``min_occ, median_occ, p99_occ, max_occ`` of the k-mers' posting counts; elements n/2 and 99n/100
    (from 0) of the sorted counts, nulls for an empty index. Counts are grouped first, so what is ordered is one row
    for each different count."""
    found = reduce(DataFrame.unionByName, [histogram(r, cfg) for r in (rows if isinstance(rows, list) else [rows])])
    by_count = found.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    ranked = by_count.select("n", F.sum("m").over(Window.orderBy("n")).alias("upto"), F.sum("m").over(Window.partitionBy()).alias("total"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("n")))
    return ranked.agg(F.min("n").alias("min_occ"), at(F.expr("total div 2")).alias("median_occ"), at(F.expr("total * 99 div 100")).alias("p99_occ"), F.max("n").alias("max_occ"))


def minimizers(rows: DataFrame, w: int, stretch: int = 1 << 16) -> DataFrame:
    """``ref_id, pos``: the leftmost smallest of each ``w`` consecutive k-mers, repeats of the one before left out.
    A reference is cut into stretches that share the k-mers at their edges, so no task gets a long one whole."""
    if w > stretch:
        raise ValueError("a window must fit into a stretch")
    part, at_edge = F.floor(F.col("pos") / stretch), F.col("pos") % stretch
    # windows that begin in the stretch before reach in here, and the first window here needs the one before it
    parts = F.array_compact(F.array(part, F.when(at_edge < w - 1, part - 1), F.when(at_edge == stretch - 1, part + 1)))
    dealt = rows.select("ref_id", "pos", "kmer", F.explode(parts).alias("part"))
    order = Window.partitionBy("ref_id", "part").orderBy("pos")
    full = order.rowsBetween(0, w - 1)
    chosen = dealt.select("ref_id", "part", F.col("pos").alias("at"), F.min(F.struct("kmer", "pos")).over(full)["pos"].alias("pos"), F.count(F.lit(1)).over(full).alias("n")).where(F.col("n") == w)
    before = F.lag("pos").over(Window.partitionBy("ref_id", "part").orderBy("at"))
    own = F.floor(F.col("at") / stretch) == F.col("part")
    return chosen.withColumn("before", before).where(own & (F.col("before").isNull() | (F.col("before") != F.col("pos")))).select("ref_id", "pos")


def sequence_minimizers(refs: DataFrame, k: int, w: int, stretch: int | None = None) -> DataFrame:
    """``minimizers`` of sequences' k-mers, found where the k-mers are made: stretches of sequences are dealt out, with a
    window more behind them and one k-mer before them, and minimizers alone come back."""
    size = stretch or S.STRETCH
    kind = refs.schema["ref_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for row, (at, piece) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                begin = max(0, at - 1)
                pos = S.leftmost_minima(S.kmers_of(S.byte_codes(piece.as_py()), k), w)[: at - begin + size]
                new = np.r_[begin == at, pos[1:] != pos[:-1]] if len(pos) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(new.sum(), row))), pa.array(begin + pos[new])], names=["ref_id", "pos"])

    dealt = S.stretches(refs.select("ref_id", "seq"), k, stretch, before=1, after=w - 1).repartition("ref_id", "at")
    return dealt.select("ref_id", "at", "piece").mapInArrow(run, f"ref_id {kind}, pos long")


def sequence_runs(refs: DataFrame, k: int, stretch: int | None = None) -> DataFrame:
    """``ref_id, run, start``: ``run_offsets`` of sequences' k-mers, found where the k-mers are made. Runs are numbered
    within stretches, and stretches' sums are carried over, one row a stretch: those of sequences of several stretches are made
    twice, first to be counted, so that no run is ever written or shuffled."""
    size = stretch or S.STRETCH
    kind = refs.schema["ref_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            others = b.select(["ref_id", "at", "before"]).columns
            ats, ns = b.column("at").to_pylist(), b.column("n").to_pylist()
            for first, held in S.grouped(b.column("piece")):  # starts are eight bytes each, and of most bases
                found = [_run_starts(piece, at, n, k, size) for at, n, piece in zip(ats[first:], ns[first:], held)]
                own = [c.slice(first, len(held)) for c in others]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.list_(pa.int64()))], names=["ref_id", "at", "before", "starts"])

    def count(batches):
        for b in batches:
            ats, ns = b.column("at").to_pylist(), b.column("n").to_pylist()
            found = [len(_run_starts(np.frombuffer(piece.as_buffer(), np.uint8), at, n, k, size)) for at, n, piece in zip(ats, ns, b.column("piece"))]
            yield pa.RecordBatch.from_arrays([b.column("ref_id"), b.column("at"), pa.array(found, pa.int64())], names=["ref_id", "at", "found"])

    n = F.octet_length("seq").cast("long") - (k - 1)
    rows = refs.select("ref_id", n.alias("n"), "seq").where(F.col("seq").isNotNull())
    cut = lambda some: S.stretches(some, k, stretch, before=1).withColumn("at", F.col("at").cast("long")).select("ref_id", "at", "n", "piece")
    long = cut(rows.where(F.col("n") > size)).repartition("ref_id", "at")
    counted = long.mapInArrow(count, f"ref_id {kind}, at long, found long")
    carried = F.sum("found").over(Window.partitionBy("ref_id").orderBy("at")) - F.col("found")
    before = counted.select(F.col("ref_id").alias("of"), F.col("at").alias("of_at"), carried.alias("before"))
    joined = long.join(before, F.col("ref_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("of_at"))).select("ref_id", "at", "n", "before", "piece")
    short = cut(rows.where(F.col("n") <= size)).repartition("ref_id", "at").select("ref_id", "at", "n", F.lit(0).cast("long").alias("before"), "piece")
    dealt = short.unionByName(joined).mapInArrow(run, f"ref_id {kind}, at long, before long, starts array<long>")
    dealt = dealt.select("ref_id", "before", F.posexplode("starts").alias("place", "start"))
    return dealt.select("ref_id", (F.col("before") + F.col("place")).alias("run"), "start")


def _run_starts(piece: np.ndarray, at: int, n: int, k: int, size: int) -> np.ndarray:
    """Where runs begin in a stretch of ``n`` k-mers that begins at ``at`` and has the base before it, and ``n`` in the last one."""
    begin = max(0, at - 1)
    kmer = S.kmers_of(S.byte_codes(piece), k)
    new = np.r_[begin == at, kmer[1:] != kmer[:-1]] if len(kmer) else np.zeros(0, bool)
    starts = begin + np.flatnonzero(new)
    return np.r_[starts, n] if 0 < n <= at + size else starts


def run_offsets(rows: DataFrame, key: str, order: str, value: str, stretch: int = 1 << 16) -> DataFrame:
    """``key, run, start``: where runs of equal values begin, and the number of values as the last start. ``order``
    counts each key's values from 0 without gaps. Values are compared within stretches that share a value at their
    edges, and runs are numbered over all tasks, so no task gets a long key whole."""
    part, at_edge = F.floor(F.col(order) / stretch), F.col(order) % stretch == stretch - 1
    dealt = rows.select(key, F.col(order).alias("start"), F.col(value).alias("v"), F.explode(F.array_compact(F.array(part, F.when(at_edge, part + 1)))).alias("part"))
    w = Window.partitionBy(key, "part").orderBy("start")
    marked = dealt.select(key, "start", "v", "part", F.lag("v").over(w).alias("before"))
    own = F.floor(F.col("start") / stretch) == F.col("part")
    starts = marked.where(own & ((F.col("start") == 0) | ~F.col("v").eqNullSafe(F.col("before")))).select(key, F.col("start").cast("long"))
    ends = rows.groupBy(key).agg(F.count(F.lit(1)).alias("start"))
    numbered = running(starts.unionByName(ends), [key, "start"], run=F.lit(1))
    first = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("run").alias("_first"))
    return numbered.join(first, F.col(key).eqNullSafe(F.col("_key"))).select(key, (F.col("run") - F.col("_first")).alias("run"), "start")
