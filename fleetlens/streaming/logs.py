"""Log lines as they are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from fleetlens.operators.log_events import parse_log_lines
from fleetlens.sources.logs import number_lines, placed_lines
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec


def read_line_stream(
    spark: SparkSession, directory: str, columns: str = "host_id string", spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Lines of files arriving below ``directory``, not numbered yet; ``columns`` are its partitions."""
    lines = spark.readStream.schema(f"value string, {columns}").format("text").load(directory)
    return placed_lines(lines, spec)


def parse_batch(placed: DataFrame, path: Column | None = None, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Typed events of one batch, with the same functions the batch job uses.

    A file arrives whole in one batch, so its lines are numbered there. ``path`` is what the
    host calls the file, where that is not where it arrived.
    """
    lines = number_lines(placed)
    return parse_log_lines(lines if path is None else lines.withColumn("path", path), spec)


def start_line_sink(placed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run ``sink(events, batch_id)`` on the typed events of every batch."""
    return (
        placed.writeStream.foreachBatch(lambda df, i: sink(parse_batch(df), i))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_event_sink(events: DataFrame, target: str, checkpoint: str, **trigger):
    return (
        events.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
