"""State that is carried along long sequences without any of them being in one task.

A sequence is cut into stretches of bounded size, and a step takes a state and a stretch and gives the state behind it.
Where a state soon forgets what it began with, as those of peak detectors do, a stretch that begins with a wrong one
mostly ends with the right one. So all stretches are run side by side, each from the start state; then those that began
otherwise than the one before them ended are run again from there, and so on for some rounds. What is left then, of
sequences that are flat for many stretches, is run in order, stretch by stretch, a task holding one stretch at a time.
The result is that of a walk from begin to end, whichever way it was found.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

Step = Callable[[bytes, tuple], tuple[bytes, tuple]]


def carried(stretches: DataFrame, step: Step, start: bytes, out: list[tuple[str, str, pa.DataType]], rounds: int = 3) -> DataFrame:
    """``key, part`` and the columns ``out`` (name, Spark's type, Arrow's type) of every stretch. ``stretches`` is a written
    table of ``key``, a struct, ``part``, numbers from 0 without gaps, and what ``step`` takes beside the state."""
    inputs = [c for c in stretches.columns if c not in ("key", "part")]
    key_type = stretches.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, part long, entry binary, exit binary, " + ", ".join(f"{n} {t}" for n, t, _ in out)
    by = ["key", "part"]

    def rows(b, states):
        """Arrow columns of a batch from its rows' entry and exit states and results."""
        entry, exit_, found = zip(*states)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(entry, pa.binary()), pa.array(exit_, pa.binary()), *(pa.array(c, t) for c, (_, _, t) in zip(zip(*found), out))], names=["key", "part", "entry", "exit", *(n for n, _, _ in out)])

    def slices(batches):
        for b in batches:
            for at in range(0, b.num_rows, 16):
                yield b.slice(at, 16)

    def each(batches):
        for b in slices(batches):
            yield rows(b, [(entry, *step(entry, given)) for entry, *given in zip(*(c.to_pylist() for c in b.columns[2:]))])

    def in_order(batches):
        state, of = start, None
        for b in slices(batches):
            states = []
            for key, entry, *given in zip(b.column(0).to_pylist(), *(c.to_pylist() for c in b.columns[2:])):
                before = state if key == of else entry
                state, found = step(before, given)
                states.append((before, state, found))
                of = key
            yield rows(b, states)

    def run(given: DataFrame, how) -> DataFrame:
        return given.select(*by, "entry", *inputs).mapInArrow(how, schema)

    def begun_wrong(states: DataFrame) -> DataFrame:
        before = states.select("key", (F.col("part") + 1).alias("part"), F.col("exit").alias("right"))
        return written(states.select(*by, "entry").join(before, by).where("entry <> right").select(*by, F.col("right").alias("entry")), "wrong")

    stretches = stretches.withColumn("part", F.col("part").cast("long"))
    states = written(run(stretches.withColumn("entry", F.lit(bytearray(start))), each), "states")
    for turn in range(rounds):
        wrong = begun_wrong(states)
        if wrong.isEmpty():
            return states.select(*by, *(n for n, _, _ in out))
        if turn < rounds - 1:
            again = run(stretches.join(wrong, by), each)
            states = written(states.join(wrong.select(*by), by, "left_anti").unionByName(again), "states")
    begin = wrong.groupBy("key").agg(F.min(F.struct("part", "entry")).alias("begin"))
    rest = stretches.join(begin, "key").where("part >= begin.part").withColumn("entry", F.col("begin.entry"))
    ordered = rest.select(*by, "entry", *inputs).repartition("key").sortWithinPartitions(*by)
    kept = states.join(begin, "key", "left").where("begin is null or part < begin.part")
    names = [n for n, _, _ in out]
    return kept.select(*by, *names).unionByName(run(ordered, in_order).select(*by, *names))
