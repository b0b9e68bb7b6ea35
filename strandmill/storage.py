"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(root, exist_ok=True)
    base = tempfile.mkdtemp(prefix="strandmill-", dir=root)
    atexit.register(shutil.rmtree, base, True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: the lineage ends there, and losing an
    executor loses nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and that nothing reads any more."""
    drop_folder(df.sparkSession, df._written_path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def qualified(spark: SparkSession, folder: str) -> str:
    """The whole name of a folder, with its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_buckets(parts: list[DataFrame], path: str, key: str, buckets: int, order: Column) -> None:
    """``parts`` one after another as Parquet, in each one file for each bucket of ``key``, in the order of the number ``order``:
    Spark sorts by one number in time linear in the rows, but by several columns with comparisons. What a part shuffled goes
    with it. A catalog table is made for the writing alone."""
    spark, name, mode = parts[0].sparkSession, f"strandmill_{uuid.uuid4().hex}", "overwrite"
    for df in parts:
        writer = df.repartition(buckets, key).sortWithinPartitions(order).write.format("parquet").mode(mode).bucketBy(buckets, key)
        with settings(spark, **LEAN):
            writer.option("path", qualified(spark, path)).saveAsTable(name)
        mode = "append"
    spark.sql(f"DROP TABLE {name}")  # the files stay


#: Numbers are stored as differences, and the shuffle files of an action are deleted when it has ended, not when the driver happens to collect garbage.
LEAN = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that hold inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_buckets(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """What ``write_buckets`` wrote. Joins and aggregates by ``key`` find its rows dealt out already."""
    name, place = f"strandmill_{uuid.uuid4().hex}", qualified(spark, path).replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # what was read knows the files and how they are dealt
    return found


def finished(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables under ``folder`` that were written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    return [s.getPath().getName() for s in system.listStatus(path) if system.exists(child(s.getPath(), "_SUCCESS"))]
