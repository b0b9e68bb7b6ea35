"""Mapping of read streams: each micro-batch is searched as one table and goes to a sink.

The winner of a vote is a minimum over all of a query's votes, which an unbounded stream cannot know; within a
micro-batch a query is complete, so batches are mapped by the same plan as tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..mapper import Index, map_reads


def query_stream(reads: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Maps a stream of ``channel, read_id, seq``; ``sink`` gets each mapped batch and its number, which together with
    the checkpoint lets it write each batch once."""
    trigger = trigger or {"availableNow": True}
    return reads.writeStream.foreachBatch(lambda batch, n: sink(map_reads(batch, index), n)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with one folder per batch, so that a repeated batch replaces itself."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """What ``to_parquet`` has written, with the number of each read's ``batch``."""
    return spark.read.parquet(path)


def responses(mapped: DataFrame, ordered: str | None = None, by: list[str] | None = None) -> Iterator[Row]:
    """Mapped reads one by one, a partition at a time; with ``ordered="request"`` in the order of the columns ``by``, which
    number the requests, with ``"reverse"`` in the reverse of it, as a stack of responses gives them."""
    if ordered not in (None, "request", "reverse"):
        raise ValueError("ordered must be request or reverse")
    if ordered:
        if not by:
            raise ValueError("an order needs the columns that number the requests")
        mapped = mapped.orderBy(*[F.col(c).asc() if ordered == "request" else F.col(c).desc() for c in by])
    return mapped.toLocalIterator(prefetchPartitions=True)
