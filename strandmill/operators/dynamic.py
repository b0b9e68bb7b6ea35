"""An index that grows by batches.

Added sequences are staged and can be found after ``merge``, which writes their postings as spans to a folder of their own,
partitioned by the low bits of spans' least m-mers (the shard), and then the batch's names. Within a merge spans are dealt by
ranges of shard, m-mer and place, so a hot shard, or an m-mer that fills one, is many tasks' work and many files. ``compact``
writes all merges so far as one, with one run of files a shard. Large merges are written in shares, one after another, so that
what is shuffled at once is a part of what is stored.

The folder of a batch's names is called after the merge and the first merge that counts with it, and is written last: a
merge or compaction that fails changes nothing and can be called again, and an index can be opened again by its path. A
name keeps its id; sequences added again under a name start at position 0 again, or with ``append_offsets`` where the
name's bases so far end. Searches look at both strands, whatever ``fr``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MapConfig
from ..functions import sequence as S
from ..functions import spans as R
from ..storage import LEAN, drop_folder, drop_written, finished, new_path, settings, written
from .index import running
from .index import span_positions as positions
from .search import map_queries

NAMES = "ref_id long, name string, bases long, fresh boolean"
SPANS = "kmer_min int, bases long, n tinyint, off tinyint, ref_id long, pos long, merge int, shard int"
#: Merges of more bases are written in shares, and in at most so many, since each share reads all sequences.
SHARE_BASES, SHARES = 1 << 26, 8


class DynamicIndex:
    def __init__(self, spark: SparkSession, cfg: MapConfig | None = None, path: str | None = None, append_offsets: bool = False):
        self.spark, self.cfg, self.append_offsets = spark, cfg or MapConfig(), append_offsets
        self.path = path or new_path(spark, "dynamic")
        #: the last merge, and the first that counts with it
        self.merges, self.first = max((tuple(map(int, name.split("-"))) for name in finished(spark, f"{self.path}/names")), default=(0, 1))
        self.known = self.names.count()
        self.staged: list[DataFrame] = []
        self.order = 0

    def _deltas(self) -> DataFrame:
        """``ref_id, name, bases, fresh``: what each batch added to each of its names."""
        live = [f"{self.path}/names/{name}" for name in finished(self.spark, f"{self.path}/names") if self.first <= int(name.split("-")[0]) <= self.merges]
        return self.spark.read.schema(NAMES).parquet(*live) if live else self.spark.createDataFrame([], NAMES)

    @property
    def names(self) -> DataFrame:
        """``ref_id, name``."""
        return self._deltas().where("fresh").select("ref_id", "name")

    def add(self, name: str, seq: str) -> None:
        self.add_batch(self.spark.createDataFrame([(0, name, seq)], "ord long, name string, seq string"))

    def add_batch(self, batch: DataFrame) -> None:
        """``ord, name, seq``: sequences in the order of ``ord``."""
        self.staged.append(batch.select(F.lit(self.order).alias("batch"), "ord", "name", "seq"))
        self.order += 1

    def merge(self) -> None:
        """Appends the staged sequences' postings. Names get their ids in order of first arrival."""
        if not self.staged:
            return
        new = self.staged[0]
        for more in self.staged[1:]:
            new = new.unionByName(more)
        new = written(new, "staged")
        first = new.groupBy("name").agg(F.min(F.struct("batch", "ord")).alias("first"), F.sum(F.octet_length("seq")).alias("bases"))
        if self.known:
            first = first.join(self.names.withColumnRenamed("ref_id", "old_id"), "name", "left")
        else:
            first = first.withColumn("old_id", F.lit(None).cast("long"))
        first = written(first, "names")
        numbered = running(first.where("old_id is null"), ["first", "name"], place=F.lit(1))
        fresh = numbered.select((F.col("place") + F.lit(self.known)).cast("long").alias("ref_id"), "name", "bases", F.lit(True).alias("fresh"))
        again = first.where("old_id is not null").select(F.col("old_id").alias("ref_id"), "name", "bases", F.lit(False).alias("fresh"))
        added = written(fresh.unionByName(again), "names")
        placed = new.join(added.select("name", "ref_id"), "name").withColumn("base", F.lit(0).cast("long"))
        if self.append_offsets:
            upto = self._deltas().groupBy("name").agg(F.sum("bases").alias("upto"))
            before = Window.partitionBy("name").orderBy("batch", "ord").rowsBetween(Window.unboundedPreceding, -1)
            earlier = F.coalesce(F.sum(F.octet_length("seq")).over(before), F.lit(0))
            placed = placed.join(upto, "name", "left").withColumn("base", F.coalesce("upto", F.lit(0)) + earlier)
        placed = written(placed.select(F.struct("ref_id", "base").alias("ref_id"), "seq"), "placed")
        drop_written(new)

        def rows(*share):
            found = positions(placed, self.cfg.k, *share)
            return found.select(*R.SPAN, F.col("ref_id.ref_id").alias("ref_id"), (F.col("pos") + F.col("ref_id.base")).alias("pos"))

        self._write(rows, added.agg(F.sum("bases")).first()[0] or 0, added, self.first)
        drop_written(placed)
        self.known += added.where("fresh").count()
        self.staged = []

    def compact(self, drop: bool = False) -> None:
        """Writes all merges' postings as one, and with ``drop`` deletes the folders that this replaces, which no search
        that was planned before may read any more."""
        if self.merges == self.first:
            return
        was, deltas = range(self.first, self.merges + 1), self._deltas()
        names = deltas.groupBy("ref_id", "name").agg(F.sum("bases").alias("bases")).withColumn("fresh", F.lit(True))
        found = self._spans().drop("shard")
        share = lambda r=None: found.where(F.pmod(F.xxhash64("kmer_min"), F.lit(r[1])) == r[0]) if r else found
        self._write(share, names.agg(F.sum("bases")).first()[0] or 0, names, self.merges + 1)
        if drop:
            for name in finished(self.spark, f"{self.path}/names"):
                if int(name.split("-")[0]) in was:
                    drop_folder(self.spark, f"{self.path}/names/{name}")
            for merge in was:
                drop_folder(self.spark, f"{self.path}/postings/merge={merge}")

    def _write(self, spans: Callable[..., DataFrame], bases: int, names: DataFrame, first: int) -> None:
        """``spans`` of a merge, all or those of a share, then its names."""
        at, shares = self.merges + 1, min(SHARES, max(1, ceil(bases / SHARE_BASES)))
        bits, all_bits = self.cfg.num_shard_bits, (4 ** R.least_length(self.cfg.k) - 1).bit_length()
        rest = max(0, all_bits - bits)
        for r in range(shares):
            rows = spans((r, shares)) if shares > 1 else spans()
            # by m-mer within a shard, so that row groups without one of a query are left out; one number holds both and the first
            # bases, since Spark sorts by one number in time linear in the rows, but by several columns with comparisons
            turned = F.shiftleft(S.shard(F.col("kmer_min"), bits), rest).bitwiseOR(S.shard_key(F.col("kmer_min"), bits))
            keyed = rows.select(S.make64(turned, R.first_bases(self.cfg.k)).alias("key"), "bases", "n", "off", "ref_id", "pos")
            dealt = keyed.repartitionByRange("key", "ref_id", "pos").sortWithinPartitions("key")
            turned = S.high32(F.col("key")).cast("int")
            shard = F.shiftright(turned, rest)
            kmer_min = F.shiftleft(turned.bitwiseAND(F.lit((1 << rest) - 1)), bits).bitwiseOR(shard)
            sharded = dealt.select(kmer_min.alias("kmer_min"), "bases", "n", "off", "ref_id", "pos", shard.alias("shard"))
            with settings(self.spark, **LEAN):
                sharded.write.mode("append" if r else "overwrite").partitionBy("shard").parquet(f"{self.path}/postings/merge={at}")
        names.write.mode("overwrite").parquet(f"{self.path}/names/{at}-{first}")
        self.merges, self.first = at, first

    def _spans(self) -> DataFrame:
        if not self.merges:
            return self.spark.createDataFrame([], SPANS).drop("merge")
        return self.spark.read.schema(SPANS).parquet(f"{self.path}/postings").where(F.col("merge").between(self.first, self.merges)).drop("merge")

    def postings(self) -> DataFrame:
        """``kmer, ref_id, pos, shard``."""
        return R.expanded(self._spans(), self.cfg.k).drop("kmer_min", "at")

    def query_batch(self, queries: DataFrame) -> DataFrame:
        """See ``search.map_queries``; shards that no k-mer of some few queries has are not read."""
        cfg = self.cfg.with_(jaccard=False, compressed=False)
        return map_queries(queries, self._spans(), self.names, cfg, both=True, on=["shard", "kmer_min"])

    def query(self, seq: str, name: str = "query") -> tuple[str, bool, int, float]:
        row = self.query_batch(self.spark.createDataFrame([(0, name, seq)], "q_id long, name string, seq string")).first()
        return row.ref, row.fwd, row.pos, row.support
