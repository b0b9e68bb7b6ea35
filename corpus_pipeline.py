"""A training corpus from ``documents``: rejected documents go, one of each group of near copies stays, personal data
is replaced, sources are mixed to target weights and the result is packed into sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; ``run`` writes each stage's rows as
Parquet and gives the next stage what it reads back. All but the last return the columns of ``documents``; extra
columns of ``docs`` are carried along.

Defined results: null and empty texts are kept or rejected by their score like others, count as copies of each other
and take no part in the mix (they have no words); documents with a null ``doc_id`` and different texts under one are
rows like others; repeated rows are copies; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import mixing, near_copies, packing, pii, quality
from strandmill.llm.common import written
from strandmill.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is at least one half."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return quality.keep(docs, model)


def carried(docs: DataFrame) -> DataFrame:
    """``doc, row``: each row whole as a struct, so that no column of it meets a name used beside it, and 16 bytes that only
    equal rows share, two independent hashes of all columns."""
    others = [F.col(f"doc.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    parts = [F.col("doc.doc_id"), F.col("doc.doc_id").isNull(), F.col("doc.text"), F.to_json(F.struct(F.lit(0), *others))]
    key = F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts[::-1]))])
    return docs.select(F.struct("*").alias("doc")).select("doc", F.unhex(key).alias("row"))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id, null last; among equal ids that with the
    smallest hash of its text. Near copies share eight of ten different five-word shingles or more."""
    rows = carried(docs)
    ranked = rows.select(F.col("doc.text").alias("text"), "row", F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("hash"))
    first = near_copies.classes(ranked, "row", ["none", "id", "hash"])
    return rows.join(first, F.col("row") == F.col("first"), "left_semi").dropDuplicates(["row"]).select("doc.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and ``n_chars`` that fits."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice. Equal rows are taken together."""
    rows = carried(docs)
    times = mixing.mix(rows.select(F.col("row").alias("doc_id"), "doc.source", "doc.text")).where("taken > 0")
    times = times.groupBy(F.col("doc_id").alias("of")).agg(F.sum(F.expr("taken div size")).cast("int").alias("times"))
    taken = rows.dropDuplicates(["row"]).join(times, F.col("row") == F.col("of"))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens, one row per piece."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), seq_len=2048, end_id=1)


STAGES = [("quality", keep_quality), ("near_copies", keep_one_of_copies), ("personal_data", redact), ("mix", mix), ("pack", pack)]

#: SQL cannot express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
