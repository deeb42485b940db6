"""Log files that grow while they are read.

Spark's file streams take a file once. Here a streaming data source keeps, as its offset,
how many bytes of each file were read, and reads on from there. A line belongs to the
batch that holds its end, so a line still being written waits; the reader of a range finds
the line's beginning by looking back. A file that became shorter was replaced and is read
anew.

A range counts its own lines; what stands before it comes from a table of lines per file,
one small version per batch, of which each batch reads the one before. So a batch reads
only what was appended, and a repeated batch writes its own version again.

The files are opened in the tasks through Arrow's file systems. A file's growth in a batch
is read in ranges of at most ``task_bytes``, by as many tasks; small ones share a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fleetlens.operators.log_events import parse_log_lines
from fleetlens.sources.files import drop_path, file_system
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec

SCHEMA = "path string, start bigint, pos bigint, line string"
#: Bytes that one task reads, and bytes read at once.
TASK_BYTES, BLOCK = 64 << 20, 1 << 20
_ROWS, _CHARS = 10_000, 8 << 20


@dataclass
class Ranges(InputPartition):
    """(path, from, to) of the growth that one task reads."""

    ranges: tuple[tuple[str, int, int], ...]

    def __init__(self, ranges):
        super().__init__(None)
        self.ranges = tuple(ranges)


def line_begin(file, at: int) -> int:
    """Where the line that holds byte ``at`` begins."""
    while at > 0:
        low = max(at - BLOCK, 0)
        file.seek(low)
        cut = file.read(at - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        at = low
    return 0


def ended_lines(file, start: int, end: int) -> Iterator[bytes]:
    """Lines, without their ends, whose end lies in [start, end)."""
    at = line_begin(file, start)
    file.seek(at)
    parts: list[bytes] = []
    while at < end and (block := file.read(min(BLOCK, end - at))):
        at += len(block)
        *ended, rest = block.split(b"\n")
        for line in ended:
            parts.append(line)
            yield b"".join(parts)
            parts = []
        parts.append(rest)


class GrowingLinesReader(DataSourceStreamReader):
    """Offsets are {path: bytes read}."""

    def __init__(self, options: dict):
        self._root = options["path"]
        self._task = int(options.get("taskbytes", TASK_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, base = file_system(self._root)
        return {f.path: f.size for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.is_file}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out, held = [], 0
        for path, to in sorted(end.items()):
            begin = start.get(path, 0)
            # A file that became shorter is another one.
            for at in range(0 if to < begin else begin, to, self._task):
                size = min(self._task, to - at)
                if not out or held + size > self._task:
                    out.append([])
                    held = 0
                out[-1].append((path, at, at + size))
                held += size
        return [Ranges(x) for x in out]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self._root)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        for path, start, end in partition.ranges:
            # The first row says that the range was read, whatever lines it has.
            rows, held, pos = [(path, start, 0, None)], 0, 0
            with fs.open_input_file(path) as file:
                for raw in ended_lines(file, start, end):
                    line = raw.rstrip(b"\r")
                    if not line:
                        continue
                    pos += 1
                    rows.append((path, start, pos, line.decode("utf-8", "replace")))
                    held += len(line)
                    if len(rows) >= _ROWS or held > _CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader({k.lower(): v for k, v in self.options.items()})


def read_growing(spark: SparkSession, directory: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Lines as they are appended to the files below ``directory``."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("taskBytes", task_bytes).load(directory)


def number_growth(lines: DataFrame, batch_id: int, root: str) -> DataFrame:
    """``line_no`` of a batch's lines; stores the lines per file up to this batch."""
    spark = lines.sparkSession
    ranges = lines.groupBy("path", "start").agg(F.max("pos").alias("n"))
    own = ranges.groupBy("path").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    known = "path string, lines bigint"
    before = spark.read.schema(known).parquet(f"{root}/lines/{batch_id - 1}") if batch_id else spark.createDataFrame([], known)
    # A file read from its beginning has no lines before.
    files = before.join(own, "path", "full_outer").withColumn(
        "base", F.when(F.col("start") == 0, 0).otherwise(F.coalesce("lines", F.lit(0)))
    )
    counted = files.select("path", F.when(F.col("n").isNull(), F.col("lines")).otherwise(F.col("base") + F.col("n")).alias("lines"))
    counted.write.mode("overwrite").parquet(f"{root}/lines/{batch_id}")
    if batch_id > 1:
        drop_path(spark, f"{root}/lines/{batch_id - 2}")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(files.select("path", "base"), "path")
    return (
        lines.filter(F.col("line").isNotNull())
        .join(placed.select("path", "start", (F.col("base") + F.col("inside")).alias("base")), ["path", "start"])
        .select("path", (F.col("base") + F.col("pos")).alias("line_no"), "line")
    )


def start_growing(
    lines: DataFrame,
    sink: Callable[[DataFrame, int], None],
    root: str,
    host_id: Column,
    path: Column | None = None,
    spec: IndicatorSpec = DEFAULT_SPEC,
    **trigger,
):
    """Run ``sink(events, batch_id)`` on the typed events of what each batch found appended.

    ``host_id`` and ``path`` (what the host calls the file) may use ``path``, the file's own.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        numbered = number_growth(batch, batch_id, root)
        named = numbered.withColumns({"host_id": host_id, "path": F.col("path") if path is None else path})
        sink(parse_log_lines(named, spec), batch_id)

    return (
        lines.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
