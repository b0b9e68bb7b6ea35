"""Pore models: the expected signal level of each k-mer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S


def read_pore_model(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``code INT, level DOUBLE`` in z-scores and k, from a table with header, k-mer and mean level first."""
    raw = spark.read.csv(path, sep="\t", header=True)
    kmer, mean = raw.columns[:2]
    return normalised(raw.select(F.col(kmer).alias("kmer"), F.col(mean).cast("double").alias("level_mean")))


def normalised(model: DataFrame) -> tuple[DataFrame, int]:
    """The model by k-mer code; all 4^k k-mers must be there once."""
    k = model.agg(F.max(F.length("kmer"))).first()[0]
    if not k or not 1 <= k <= 12:
        raise ValueError("a pore model has k-mers of 1 to 12 bases")
    coded = model.select(S.encode_kmer(S.codes(F.col("kmer")), 0, k).alias("code"), "level_mean")
    found = coded.agg(F.count(F.lit(1)), F.count_distinct("code"), F.min("code"), F.max("code"), F.avg("level_mean"), F.stddev_pop("level_mean")).first()
    if found[:4] != (4**k, 4**k, 0, 4**k - 1):
        raise ValueError(f"a pore model of {k}-mers needs each of the {4**k} once")
    return coded.select("code", ((F.col("level_mean") - F.lit(found[4])) / F.lit(found[5])).alias("level")), k
