"""Log files to numbered lines.

A line number counts non-empty lines of a file from 1.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.paths import dirname, join_path, plain_path
from fleetlens.session import materialize
from fleetlens.sources.files import open_stream
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec

# Splits (of 128 MB as a rule) up to which their counts are broadcast, about 100 MB; beyond, Spark joins.
_FEW_SPLITS = 1 << 18
# binaryFile holds a file in one row; larger ones are streamed, with the same result.
_ONE_ROW_LIMIT = 1 << 30
# A line this long still fits into a row if every byte has to be replaced.
_LONGEST_LINE = 1 << 29
_BATCH_CHARS = 8 << 20
_GZ_SCHEMA = "path string, line_no bigint, line string, kind string, message string"
_ARROW_GZ = pa.schema(
    [("path", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("kind", pa.string()), ("message", pa.string())]
)


def is_log_name(name: Column, spec: IndicatorSpec = DEFAULT_SPEC) -> Column:
    n = F.lower(name)
    return n.startswith(spec.log_prefix) & n.contains(spec.log_infix)


def discover_logs(
    inventory: DataFrame, homes: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Log files directly in a home or in its ``logs`` directory."""
    places = homes.select("host_id", F.col("home").alias("dir")).unionByName(
        homes.select("host_id", join_path(F.col("home"), "logs").alias("dir"))
    )
    found = inventory.filter(~F.col("is_dir") & is_log_name(F.col("name"), spec)).select(
        "host_id", "path", dirname(F.col("path")).alias("dir")
    )
    return (
        found.join(places.distinct(), ["host_id", "dir"], "left_semi")
        .select("host_id", "path")
        .distinct()
    )


def _trim_line(line: Column) -> Column:
    return F.rtrim(line, F.lit("\r\n"))


def split_log_content(files: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Numbered lines of files held as one string each; a map, no shuffle."""
    lines = F.filter(
        F.transform(F.split(F.col("content"), "\n"), _trim_line),
        lambda s: s != "",
    )
    others = [c for c in files.columns if c != "content"]
    return files.select(*others, F.posexplode(lines).alias("pos", "line")).select(
        *others, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def placed_lines(lines: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Non-empty lines of a text source with the file and the split they are from, not numbered yet.

    Keeps the columns beside ``value``.
    """
    others = [c for c in lines.columns if c != "value"]
    return lines.select(
        *others,
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        _trim_line(F.col("value")).alias("line"),
    ).filter(F.length("line") > 0)


def number_lines(placed: DataFrame) -> DataFrame:
    """``line_no`` for ``placed_lines`` of whole files.

    Within a split the row order is the file order. A number is therefore the
    rank within the split plus the lines of the splits before it; only the
    per-split counts are ordered, never the lines. The text is read once: the lines are
    written as they are read, with ids that count them, and the splits are counted there.
    """
    rows = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "placed_lines")
    blocks = materialize(
        rows.groupBy("path", "block").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n")), "splits"
    )
    few = blocks.count() <= _FEW_SPLITS
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "path", "block", "first_row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    others = [c for c in placed.columns if c not in ("path", "block", "line")]
    return rows.join(F.broadcast(offsets) if few else offsets, ["path", "block"]).select(
        *others,
        "path",
        (F.col("row") - F.col("first_row") + F.col("offset") + 1).alias("line_no"),
        "line",
    )


def read_log_lines(
    spark: SparkSession,
    paths: str | list[str],
    spec: IndicatorSpec = DEFAULT_SPEC,
    larger_than: int = -1,
    host_id: Column | None = None,
) -> DataFrame:
    """Numbered lines of plain text files, which Spark splits freely.

    ``host_id`` may use ``path``, the plain path of the file.
    """
    lines = placed_lines(spark.read.text(paths).filter(F.col("_metadata.file_size") > larger_than), spec)
    return _of_host(number_lines(lines), host_id)


def _of_host(lines: DataFrame, host_id: Column | None) -> DataFrame:
    return lines if host_id is None else lines.select(host_id.alias("host_id"), "*")


#: Compressed bytes fed to the inflater at once, and inflated bytes taken.
_FED, _TAKEN = 1 << 18, 1 << 20


def _inflate(file: BinaryIO) -> Iterator[tuple[bytes, str | None]]:
    """Readable pieces of a gzip file; the last one may carry an error."""
    opened = False
    try:
        fed = file.read(_FED)
        while fed:
            stream = zlib.decompressobj(wbits=31)
            while not stream.eof and (fed := fed or file.read(_FED)):
                piece, fed = stream.decompress(fed, _TAKEN), stream.unconsumed_tail
                opened = True
                yield piece, None
            if not stream.eof:
                yield stream.flush(), "cut off"
                return
            # What the finished member left is where the next one begins.
            fed = stream.unused_data or file.read(_FED)
    except zlib.error as err:
        yield b"", "cut off" if opened else f"gzip open failed: {err}"
        return
    except OSError as err:
        yield b"", f"read failed: {err}"
        return
    if not opened:
        yield b"", "gzip open failed: empty file"


def _whole_lines(pieces: Iterator[bytes], longest: int) -> Iterator[bytes | None]:
    """Lines without their ends; None for one that no row can hold."""
    parts, held = [], 0
    for piece in pieces:
        for i, part in enumerate(piece.split(b"\n")):
            if i:
                yield b"".join(parts).rstrip(b"\r") if held <= longest else None
                parts, held = [], 0
            held += len(part)
            if held <= longest:
                parts.append(part)
            else:
                parts = []
    yield b"".join(parts).rstrip(b"\r") if held <= longest else None


def _gz_rows(path: str, file: BinaryIO, longest: int = _LONGEST_LINE) -> Iterator[tuple]:
    number, error = 0, None

    def pieces() -> Iterator[bytes]:
        nonlocal error
        for piece, error in _inflate(file):
            yield piece

    for line in _whole_lines(pieces(), longest):
        if line is None:
            number += 1
            yield path, None, None, "io", f"line {number} has more than {longest} bytes and was not read"
        elif line:
            number += 1
            yield path, number, line.decode("utf-8", "replace"), None, None
    if error == "cut off":
        error = f"truncated after line {number} (the readable part was kept)"
    if error:
        yield path, None, None, "io", error


def _gz_batches(files: Iterable[tuple[str, BinaryIO]]) -> Iterator[pa.RecordBatch]:
    """Rows of the files, one file after another; small files share a batch."""
    batch, held = [], 0
    for path, file in files:
        for row in _gz_rows(path, file):
            batch.append(row)
            held += len(row[2] or "")
            if len(batch) == 10_000 or held > _BATCH_CHARS:
                yield _gz_batch(batch)
                batch, held = [], 0
    if batch:
        yield _gz_batch(batch)


def _gz_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_GZ, strict=True)], schema=_ARROW_GZ)


def inflate_files(files: DataFrame) -> DataFrame:
    """Lines and errors, tagged, of gzip files given as (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gz_batches(
            (path.as_py(), io.BytesIO(data.as_py()))
            for batch in batches
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True)
        )

    return files.select("path", "content").mapInArrow(read, _GZ_SCHEMA)


def inflate_streams(files: DataFrame) -> DataFrame:
    """The same of gzip files given as (path, source); each task opens and streams its own."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, BinaryIO]]:
        for batch in batches:
            for path, source in zip(*(batch.column(c).to_pylist() for c in ("path", "source")), strict=True):
                try:
                    file = open_stream(source)
                except OSError as err:
                    yield path, _Unopened(err)
                    continue
                with file:
                    yield path, file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gz_batches(opened(batches))

    return files.select("path", "source").mapInArrow(read, _GZ_SCHEMA)


class _Unopened(io.RawIOBase):
    """Stands for a file that could not be opened: reading it fails the same way."""

    def __init__(self, err: OSError):
        self._err = err

    def read(self, size: int = -1) -> bytes:
        raise self._err


def read_gz_tolerant(
    spark: SparkSession, paths: str, spec: IndicatorSpec = DEFAULT_SPEC, host_id: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Lines of gzip logs, and the errors of those that are damaged.

    Files too large for one row are opened and streamed in the tasks. Both ways inflate
    and split alike, so damage costs what lies behind it, whatever the size.
    """
    listing = (
        spark.read.format("binaryFile").load(paths)
        .withColumn("source", F.col("path"))
        .withColumn("path", plain_path(F.col("path")))
    )
    small = inflate_files(listing.filter(F.col("length") <= _ONE_ROW_LIMIT))
    large = inflate_streams(listing.filter(F.col("length") > _ONE_ROW_LIMIT))
    rows = small.unionByName(large)
    lines = rows.filter(F.col("line").isNotNull()).select("path", "line_no", "line")
    errors = rows.filter(F.col("message").isNotNull()).select(
        F.lit("logs").alias("detector"), "kind", "path", "message", F.lit(True).alias("material")
    )
    return _of_host(lines, host_id), _of_host(errors, host_id)


def log_parse_errors(parsed: DataFrame) -> DataFrame:
    """One material error per file with undecodable lines, from ``parse_log_lines`` rows."""
    counts = parsed.groupBy("host_id", "path").agg(
        F.count_if(~F.col("parsed")).alias("bad"), F.count(F.lit(1)).alias("lines")
    )
    return counts.filter(F.col("bad") > 0).select(
        "host_id",
        F.lit("logs").alias("detector"),
        F.lit("parse").alias("kind"),
        "path",
        F.format_string("%d of %d lines were not valid JSON objects", "bad", "lines").alias("message"),
        F.lit(True).alias("material"),
    )
