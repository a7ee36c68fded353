"""Inspections over streams: of each micro-batch, and of event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pipelens.checks import Check
from pipelens.inspections import Inspection
from pipelens.inspector import InspectorResult, evaluate
from pipelens.operators.frame import InspectedFrame
from pipelens.plans.recorder import Recorder, recording

BATCH_BITS = 40


def inspect_batches(
    stream: DataFrame,
    program: Callable[[InspectedFrame], Any],
    handle: Callable[[int, InspectorResult], None],
    inspections: Sequence[Inspection] = (),
    checks: Sequence[Check] = (),
) -> DataStreamWriter:
    """A writer that records ``program`` on every micro-batch and hands its results over.

    Row ids hold the batch's number in the high bits, so that lineage names rows of the whole stream.
    """
    wanted = list(dict.fromkeys([*inspections, *[i for c in checks for i in c.required_inspections()]]))

    def one(batch: DataFrame, number: int) -> None:
        recorder = Recorder(wanted, track_code=False)
        rows = batch.persist()
        try:
            with recording(recorder):
                row_id = F.lit(number << BATCH_BITS) + F.monotonically_increasing_id()
                program(InspectedFrame.from_source(rows, row_id, description=f"batch {number}", recorder=recorder))
            handle(number, evaluate(recorder, wanted, checks))
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(one)


def windowed_histogram(stream: DataFrame, column: str, time: str, width: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Counts of a column's values by window of event time; rows later than the watermark are left out by the engine."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = stream.withWatermark(time, watermark).groupBy(window.alias("w"), F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "count")


def windowed_completeness(stream: DataFrame, columns: Sequence[str], time: str, width: str, watermark: str) -> DataFrame:
    """Share of values that are not null, by window of event time."""
    found = stream.withWatermark(time, watermark).groupBy(F.window(time, width).alias("w")).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *columns)
