"""Indexes on disk: Parquet tables beside the settings they were built with.

Postings are stored as spans and bucketed by least m-mer: a search whose queries are too many to broadcast shuffles them to the
buckets, and the spans stay where they are. Least m-mers of over ``HEAVY`` postings, which would make a bucket of one task's
work too large, lie in a table of their own in order of m-mer and place, over as many files as they need.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MapConfig
from ..functions import sequence as S
from ..functions import spans as R
from ..operators.index import occupancy
from ..storage import LEAN, read_buckets, settings, write_buckets

#: Spans of a bucket on average, and postings of a least m-mer in it at most.
BUCKET_ROWS, HEAVY = 2_000_000, 4_000_000
#: Larger indexes than so many spans are made in shares, one after another, so that what is shuffled at once is a part of
#: what is stored; at most so many, since each share reads all sequences.
SHARE_ROWS, SHARES = 1 << 24, 8


def save_index(path: str, spans: Callable[..., DataFrame], refs: DataFrame, cfg: MapConfig, buckets: int | None = None) -> None:
    """Writes an index of these ``spans``, all or those of a share. ``buckets`` is chosen by their rows if not given. A span is
    shuffled once, to its bucket, and the statistics are those of the buckets, which hold whole k-mers."""
    spark, codec = refs.sparkSession, "zstd" if cfg.compressed else "snappy"
    counted = spans().groupBy("kmer_min").agg(F.sum(F.col("n").cast("long")).alias("n"), F.count(F.lit(1)).alias("rows"))
    with settings(spark, **LEAN):
        found = counted.agg(F.sum("rows").alias("rows"), F.collect_list(F.when(F.col("n") > HEAVY, F.col("kmer_min"))).alias("heavy")).first()
    rows, heavy = found.rows or 0, found.heavy  # every heavy one has more than HEAVY postings, so they are few
    buckets = buckets or max(1, ceil(rows / BUCKET_ROWS))
    shares = min(SHARES, max(1, ceil(rows / SHARE_ROWS)))
    parts = [spans((r, shares)) for r in range(shares)] if shares > 1 else [spans()]
    order = S.make64(F.col("kmer_min"), R.first_bases(cfg.k, cfg.sigma))
    with settings(spark, **{"spark.sql.parquet.compression.codec": codec}):  # of tables, which take no option for it when bucketed
        if heavy:
            many = F.broadcast(spark.createDataFrame([(x,) for x in heavy], "kmer_min int"))
            most = spans().join(many, "kmer_min", "left_semi").repartitionByRange("kmer_min", "ref_id", "pos").sortWithinPartitions(order)
            with settings(spark, **LEAN):
                most.write.mode("overwrite").parquet(f"{path}/heavy")
            parts = [part.join(many, "kmer_min", "left_anti") for part in parts]
        write_buckets(parts, f"{path}/postings", "kmer_min", buckets, order)
    refs.drop("seq").write.mode("overwrite").parquet(f"{path}/refs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts[0].schema)
    layout = {"buckets": buckets, "schema": schema, "heavy": bool(heavy)}
    occupancy(_tables(spark, path, layout), cfg).write.mode("overwrite").parquet(f"{path}/stats")
    spark.createDataFrame([(cfg.to_json(), json.dumps(layout))], "config string, layout string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_index(spark: SparkSession, path: str) -> tuple[list[DataFrame], DataFrame, DataFrame, MapConfig]:
    """Tables of spans, references and statistics, with the settings that were stored."""
    row = spark.read.schema("config string, layout string").json(f"{path}/config").first()
    cfg, layout = MapConfig.from_json(row.config), json.loads(row.layout)
    return _tables(spark, path, layout), spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/stats"), cfg


def _tables(spark: SparkSession, path: str, layout: dict) -> list[DataFrame]:
    """The spans in buckets, and those of heavy m-mers if there are any."""
    postings = [read_buckets(spark, f"{path}/postings", layout["schema"], "kmer_min", layout["buckets"])]
    if layout["heavy"]:
        postings.append(spark.read.schema(layout["schema"]).parquet(f"{path}/heavy"))
    return postings


def describe(cfg: MapConfig) -> str:
    return json.dumps(json.loads(cfg.to_json()))
