"""File evidence: inventories, capped contents, exported git tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.paths import basename, plain_path
from fleetlens.session import materialize
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec

_ENTRY = pa.schema(
    [
        ("path", pa.string()), ("name", pa.string()), ("is_dir", pa.bool_()), ("is_regular", pa.bool_()),
        ("size", pa.int64()), ("head4", pa.binary()), ("error", pa.string()),
    ]
)
#: Entries a walking task hands over at once.
_ROWS = 4096
_CHUNK = pa.schema([("host_id", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("content", pa.binary())])


def _children(place: str) -> Iterator[dict]:
    """What a directory holds, unsorted. A symbolic link is neither a directory nor a regular file."""
    if place.startswith(("/", "file:")):
        with os.scandir(re.sub(r"^file:/+", "/", place)) as found:
            for e in found:
                yield {
                    "name": e.name, "is_dir": e.is_dir(follow_symlinks=False),
                    "is_regular": e.is_file(follow_symlinks=False), "size": e.stat(follow_symlinks=False).st_size,
                }
        return
    fs, inside = file_system(place)
    for info in fs.get_file_info(pafs.FileSelector(inside)):
        yield {
            "name": info.base_name, "is_dir": info.type == pafs.FileType.Directory,
            "is_regular": info.is_file, "size": info.size or 0,
        }


def _walk(start: str, deep: bool) -> Iterator[dict]:
    """Everything below a directory, or only what it holds itself."""
    open_dirs = [start]
    while open_dirs:
        place = open_dirs.pop()
        try:
            for entry in _children(place):
                path = f"{place.rstrip('/')}/{entry['name']}"
                row = entry | {"path": path, "head4": None, "error": None}
                if row["is_dir"]:
                    row["size"] = 0
                    if deep:
                        open_dirs.append(path)
                elif row["is_regular"]:
                    try:
                        with open_stream(path) as file:
                            row["head4"] = file.read(4)
                    except OSError as err:
                        row["error"] = str(err)
                yield row
        except OSError as err:
            name = place.rstrip("/").rpartition("/")[2]
            yield {
                "path": place, "name": name, "is_dir": True, "is_regular": False, "size": 0, "head4": None,
                "error": str(err),
            }


def _valid(text: str | None) -> str | None:
    """A file name that is no UTF-8 is shown with replacement characters."""
    return None if text is None else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _walker(deep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                rows = _walk(place, deep)
                while some := list(islice(rows, _ROWS)):
                    for row in some:
                        row.update({k: _valid(row[k]) for k in ("path", "name", "error")})
                    yield pa.RecordBatch.from_pylist(some, schema=_ENTRY)

    return run


def read_file_inventory(spark: SparkSession, root: str, host_id: Column, rounds: int = 2) -> DataFrame:
    """Files and directories below a directory of collected host trees, walked once: host_id, path, name,
    is_dir, is_regular, size, head4 (the first four bytes of a regular file), error.

    Hidden names and empty directories, which Spark's own listing leaves out, are there. ``host_id`` is an
    expression over ``path``. The first ``rounds`` levels are listed level by level, and each directory below
    them is walked by a task, so a large host is spread over many. A row with an ``error`` (a directory that
    could not be listed, a file that could not be opened) belongs to the collector's errors, too.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "path string, name string, is_dir boolean, is_regular boolean, size bigint, head4 binary, error string"
    places = spark.createDataFrame([(root,)], "path string")
    levels = []
    for level in range(rounds + 1):
        found = places.repartition(parts, "path").mapInArrow(_walker(deep=level == rounds), schema)
        levels.append(materialize(found, "walked"))
        places = levels[-1].filter("is_dir AND error IS NULL").select("path")
    listed = reduce(DataFrame.unionByName, levels).withColumn("path", plain_path(F.col("path")))
    return listed.select(host_id.alias("host_id"), "path", "name", "is_dir", "is_regular", "size", "head4", "error")


def read_capped_content(spark: SparkSession, paths: str | list[str], cap: int) -> DataFrame:
    """At most ``cap`` bytes of each file."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    ).select("path", F.col("length").alias("size"), F.substring("content", 1, cap).alias("content"))


def read_small_content(spark: SparkSession, paths: str | list[str], cap: int) -> DataFrame:
    """Files of at most ``cap`` bytes; the length test runs before a file is opened."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        .filter(F.col("length") <= cap)
        .select("path", F.col("length").alias("size"), "content")
    )


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a place, as Spark names it, and the place inside it."""
    if uri.startswith(("/", "file:")):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(quote(re.sub(r"^s3[an]:", "s3:", uri), safe="/:@"))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that a newer one replaces."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def open_stream(path: str) -> BinaryIO:
    """A file, as Spark's listing names it, opened inside a task for reading from its beginning on."""
    if path.startswith(("/", "file:")):
        return open(re.sub(r"^file:/+", "/", path), "rb")
    fs, inside = pafs.FileSystem.from_uri(quote(re.sub(r"^s3[an]:", "s3:", path), safe="/:@"))
    return fs.open_input_file(inside)


def read_content_chunks(
    spark: SparkSession,
    paths: str | list[str],
    host_id: Column,
    larger_than: int = DEFAULT_SPEC.max_candidate_bytes,
    piece: int = 64 << 20,
    spec: IndicatorSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Files too large for one row, as overlapping pieces (host_id, path, start, content).

    Only the listing is Spark's: each task opens its pieces itself and holds one at a time.
    """
    overlap = max(map(len, spec.markers)) - 1
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        .filter(F.col("length") > larger_than)
        .select(F.col("path").alias("source"), plain_path(F.col("path")).alias("path"), "length")
        .select(host_id.alias("host_id"), "path", "source", "length")
    )
    starts = listing.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(piece).cast("bigint"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_stream(row["source"]) as file:
                    file.seek(row["start"])
                    content = file.read(piece + overlap)
                yield pa.RecordBatch.from_pylist(
                    [{"host_id": row["host_id"], "path": row["path"], "start": row["start"], "content": content}], _CHUNK
                )

    return starts.repartition("path", "start").mapInArrow(read, "host_id string, path string, start bigint, content binary")


def read_git_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Objects, HEAD trees and blobs as exported per host."""
    return {
        name: spark.read.parquet(f"{root}/{name}") for name in ("git_objects", "head_tree", "blobs")
    }


def manifest_scan(manifests: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Staged manifests whose raw text names the bucket."""
    named = F.lower(basename(F.col("path"))) == spec.manifest_name
    return manifests.filter(named & F.contains("text", F.lit(spec.bucket))).select("host_id", "path")
