"""FASTA and FASTQ sequences as tables, and mappings as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import running
from ..storage import written
from .ranges import FastaRanges

READ_FILES = (".fq", ".fastq", ".fq.gz", ".fastq.gz")
SEQUENCE_FILES = (".fa", ".fasta", ".fna", ".fsa", ".fa.gz", ".fasta.gz")


def read_fasta(spark: SparkSession, path: str, id_name: str = "ref_id") -> DataFrame:
    """``<id_name>, name, seq`` of one or more FASTA files. A record is one row: the reader splits text where a line
    begins with ``>``. The name is the header's first word; sequence lines are joined. Ids follow the order of names
    in the files (file, then place). Rows keep their place in their split; what is ordered is one row per split."""
    raw = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    clean = F.regexp_replace("value", "^>", "")
    head = F.substring_index(clean, "\n", 1)
    body = F.substring(clean, F.length(head) + 2, F.length(clean))
    name = F.element_at(F.split(F.trim(head), r"\s+"), 1)
    # a file of four-line records would else be one sequence
    fastq = F.col("value").startswith("@") & F.col("value").rlike("\n\\+")
    name = F.when(fastq, F.raise_error(F.concat(F.lit("FASTQ records in a file read as FASTA: "), "file"))).otherwise(name)
    rows = raw.where(F.length(F.trim(clean)) > 0).select("file", F.shiftright("at", 33).alias("split"), "at", name.alias("name"), F.regexp_replace(body, r"\s+", "").alias("seq"))
    return _numbered(rows, id_name).select(id_name, "name", "seq")


def read_pieces(spark: SparkSession, path: str, range_bytes: int = 1 << 26, piece_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """``ref_id, name, bases`` and ``ref_id, at, piece`` of one or more plain FASTA files, which are read by ranges of bytes: a
    record of any length, of one line or many, is read by as many tasks as it has ranges and never is one row. Ids
    follow the order of names in the files (file, then place); what is in order before the first name is left out."""
    spark.dataSource.register(FastaRanges)
    raw = written(spark.read.format("fasta_ranges").options(path=path, range_bytes=range_bytes, piece_bytes=piece_bytes).load(), "pieces")
    by = ["file", "start", "segment"]
    parts = raw.groupBy(*by).agg(F.max("name").alias("name"), F.sum(F.octet_length("piece")).alias("n"))
    new = F.col("name").isNotNull().cast("int")
    placed = written(running(parts, by, names=new, upto="n").withColumn("ref_id", (F.col("names") + new - 1).cast("long")).where("ref_id >= 0"), "segments")
    first = placed.groupBy("ref_id").agg(F.max("name").alias("name"), F.min("upto").alias("begin"), F.sum("n").alias("bases"))
    offsets = placed.join(first.select("ref_id", "begin"), "ref_id").select(*by, "ref_id", (F.col("upto") - F.col("begin")).alias("offset"))
    pieces = raw.where("octet_length(piece) > 0").join(offsets, by).select("ref_id", (F.col("offset") + F.col("at")).alias("at"), "piece")
    return first.select("ref_id", "name", "bases"), pieces


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (``file, split, at``) with their number over all files and splits in order."""
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    earlier = Window.orderBy("file", "first").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(earlier), F.lit(0))
    shifts = splits.select("file", "split", (before - F.col("first")).alias("shift"))
    return rows.join(shifts, ["file", "split"]).withColumn(name, (F.col("at") + F.col("shift")).cast("long"))


def read_fastq(spark: SparkSession, path: str, id_name: str = "ref_id") -> DataFrame:
    """``<id_name>, name, seq`` of one or more FASTQ files of four-line records; other files are an error. Lines are
    numbered as rows of FASTA are, since a quality line may begin with any sign, and four make a record."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = _numbered(raw.withColumn("split", F.shiftright("at", 33)), "line").select("value", F.floor(F.col("line") / 4).alias(id_name), (F.col("line") % 4).alias("of"))
    line = lambda k: F.max(F.when(F.col("of") == k, F.regexp_replace("value", "\r$", "")))
    rows = lines.groupBy(id_name).agg(line(0).alias("head"), line(1).alias("seq"), line(2).alias("plus"), line(3).alias("quality"))
    whole = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("quality"))
    name = F.element_at(F.split(F.substring("head", 2, 1 << 20), r"\s+"), 1)
    checked = F.when(F.coalesce(whole, F.lit(False)), name).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record of four lines: "), F.coalesce("head", F.lit("")))))
    return rows.select(id_name, checked.alias("name"), "seq")


def read_reads(spark: SparkSession, path: str, id_name: str = "q_id") -> DataFrame:
    """Reads of a FASTQ file by its ending, of a FASTA file otherwise."""
    return (read_fastq if path.lower().endswith(READ_FILES) else read_fasta)(spark, path, id_name)


def write_tsv(mapped: DataFrame, path: str) -> None:
    """Mappings as text lines ``name, length, reference, strand, position, support`` in query order."""
    tsv_lines(mapped).orderBy("q_id").select("line").write.mode("overwrite").text(path)


def tsv_lines(mapped: DataFrame) -> DataFrame:
    """``q_id, line``; support has six decimals."""
    line = F.concat_ws("\t", "name", F.col("qlen").cast("string"), "ref", F.when(F.col("fwd"), "+").otherwise("-"), F.col("pos").cast("string"), F.format_string("%.6f", F.col("support").cast("double")))
    return mapped.select("q_id", line.alias("line"))
