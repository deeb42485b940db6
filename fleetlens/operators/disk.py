"""What lies on disk: homes, queues, archives, marked binaries, repositories."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import filekind as K
from fleetlens.functions.binding import bind
from fleetlens.functions.events import any_of
from fleetlens.functions.paths import (
    ancestors,
    basename,
    clean_path,
    dirname,
    extension,
    join_path,
    prefixes_ending_in,
    under_dir,
)
from fleetlens.session import materialize
from fleetlens.spec import DEFAULT_SPEC, UNATTRIBUTED, IndicatorSpec

_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:[ \t\r\n]*:)?'


def _class(spec: IndicatorSpec) -> Column:
    return K.structural_class(F.col("name"), F.col("is_dir"), spec)


def discovered_homes(
    inventory: DataFrame, hosts: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Homes found on disk and the configured one of each host."""
    found = inventory.filter(_class(spec) == "home").select("host_id", F.col("path").alias("home"))
    return found.unionByName(hosts.select("host_id", "home")).distinct()


def upload_queues(
    inventory: DataFrame, homes: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Queue directories: any directory so named (case-folded). Those directly in a
    home are walked for their contents."""
    found = inventory.filter(_class(spec) == "queue").select("host_id", F.col("path").alias("queue"))
    in_home = homes.select("host_id", join_path(F.col("home"), spec.queue_dir).alias("queue"))
    walked = found.join(in_home.distinct(), ["host_id", "queue"], "left_semi").withColumn(
        "walked", F.lit(True)
    )
    return (
        found.distinct()
        .join(walked.distinct(), ["host_id", "queue"], "left")
        .withColumn("walked", F.coalesce("walked", F.lit(False)))
    )


def files_in_queues(
    inventory: DataFrame, queues: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Files of walked queues, by equality with the queue directories on their path."""
    files = inventory.filter(
        ~F.col("is_dir") & under_dir(F.col("path"), spec.queue_dir)
    ).select("host_id", "path", "name", "size")
    placed = files.withColumn(
        "queue", F.explode(prefixes_ending_in(F.col("path"), spec.queue_dir))
    )
    walked = queues.filter("walked").select("host_id", "queue")
    return placed.join(walked, ["host_id", "queue"]).distinct()


def queue_inventory(
    queues: DataFrame, files: DataFrame, interrupted: DataFrame | None = None
) -> DataFrame:
    """Files and bytes per queue; an empty queue stays, an interrupted walk is marked."""
    counts = files.groupBy("host_id", "queue").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )
    out = queues.join(counts, ["host_id", "queue"], "left").fillna(0, ["files", "bytes"])
    if interrupted is None:
        return out.withColumn("truncated", F.lit(False))
    cut = interrupted.select("host_id", "queue", F.lit(True).alias("truncated")).distinct()
    return out.join(cut, ["host_id", "queue"], "left").withColumn(
        "truncated", F.coalesce("truncated", F.lit(False))
    )


def staged_archives(
    inventory: DataFrame, queue_files: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Archives by name anywhere, and any tarball in a walked queue; once per path."""
    anywhere = inventory.filter(_class(spec) == "archive").select("host_id", "path", "size")
    tarball = any_of([F.lower("name").endswith(s) for s in spec.queue_archive_suffixes])
    queued = queue_files.filter(tarball).select("host_id", "path", "size")
    return (
        anywhere.unionByName(queued)
        .groupBy("host_id", "path")
        .agg(F.max("size").alias("size"))
    )


def hash_archives(
    archives: DataFrame, contents: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> tuple[DataFrame, DataFrame]:
    """SHA-256 of every archive whose content was delivered; the rest keep path and size.

    Contents are digested where they are read; only digests move. Returns the archives
    and, per host, how many stayed without a digest.
    """
    suffixes = (spec.archive_suffix, *spec.queue_archive_suffixes)
    named = any_of([F.lower("path").endswith(s) for s in suffixes])
    digests = (
        contents.filter(named)
        .select("host_id", "path", K.sha256_hex(F.col("content")).alias("sha256"))
        .distinct()
    )
    out = archives.join(digests, ["host_id", "path"], "left")
    unhashed = (
        out.groupBy("host_id")
        .agg(
            F.count_if(F.col("sha256").isNull()).alias("unhashed"),
            F.count(F.lit(1)).alias("archives"),
        )
        .filter(F.col("unhashed") > 0)
    )
    return out, unhashed


def scan_candidates(inventory: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Files of any size whose content is worth reading, decided without reading any."""
    path = F.col("path")
    # Bound once: the conditions below would each write these out again.
    parts = bind(
        inventory,
        {
            "ext": F.lower(extension(path)),
            "parent": F.lower(basename(dirname(path))),
            "command": K.is_product_binary(path, spec),
            "queued": under_dir(path, spec.queue_dir),
            "structure": K.structural_class(F.col("name"), F.col("is_dir"), spec),
        },
    )
    kinds = bind(parts, {"kind": K.kind_of(F.hex("head4"), F.col("ext"), F.col("parent"))})
    return kinds.filter(K.candidate_gate()).select("host_id", "path", "size", "kind").distinct()


def _with_hits(contents: DataFrame, spec: IndicatorSpec) -> DataFrame:
    """Rows with at least one marker, and ``hits`` as (marker, offset) pairs.

    The content is decoded byte for byte once, and searched once per marker.
    """
    decoded = bind(contents, {"bytes": K.as_bytes_text(F.col("content"))})
    found = F.array(
        *[
            F.struct(
                F.lit(m).alias("marker"),
                (F.locate(m, F.col("bytes")) - 1).cast("bigint").alias("offset"),
            )
            for m in spec.markers
        ]
    )
    return (
        bind(decoded, {"hits": F.filter(found, lambda h: h["offset"] >= 0)})
        .filter(F.size("hits") > 0)
        .drop("bytes")
    )


def _per_marker(marked: DataFrame) -> DataFrame:
    keep = [c for c in marked.columns if c not in ("content", "hits")]
    return marked.select(*keep, F.inline("hits"))


def marker_scan(contents: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """First byte offset of each marker in each file that carries one."""
    return _per_marker(_with_hits(contents, spec))


def marker_scan_chunks(chunks: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Markers in files delivered as overlapping pieces (host, path, start, content).

    Pieces overlap by the longest marker less one byte, so none is cut in two.
    """
    hits = marker_scan(chunks, spec)
    return hits.groupBy("host_id", "path", "marker").agg(
        F.min(F.col("start") + F.col("offset")).alias("offset")
    )


def chunk_cover(chunks: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Up to which byte the pieces of each file were delivered so that no marker can be missed."""
    overlap = max(map(len, spec.markers)) - 1
    file = Window.partitionBy("host_id", "path")
    ends = chunks.select("host_id", "path", "start", (F.col("start") + F.octet_length("content")).alias("end"))
    before = F.coalesce(F.max("end").over(file.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ends.withColumns({"before": before, "last": F.max("end").over(file)})
    apart = (F.col("start") > 0) & (F.col("before") < F.col("last")) & (F.col("start") + overlap > F.col("before"))
    gap = F.min(F.when(apart, F.col("before")))
    return placed.groupBy("host_id", "path").agg(F.coalesce(gap, F.max("end")).alias("covered"))


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """SHA-256 of files given as pieces, which are hashed one after another; none where bytes miss."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, done, state = None, 0, hashlib.sha256()
        for frame in frames:
            out = []
            for host, path, start, content in frame.itertuples(index=False):
                if (host, path) != file:
                    if file and state:
                        out.append((*file, done, state.hexdigest()))
                    file, done, state = (host, path), 0, hashlib.sha256()
                if state and start > done:
                    state = None
                elif state and start + len(content) > done:
                    state.update(memoryview(content)[done - start :])
                    done = start + len(content)
            yield pd.DataFrame(out, columns=["host_id", "path", "read", "sha256"])
        if file and state:
            yield pd.DataFrame([(*file, done, state.hexdigest())], columns=["host_id", "path", "read", "sha256"])

    return (
        chunks.select("host_id", "path", F.col("start").cast("bigint"), "content")
        .repartition("host_id", "path")
        .sortWithinPartitions("host_id", "path", "start")
        .mapInPandas(digest, "host_id string, path string, read bigint, sha256 string")
    )


def marked_files(
    candidates: DataFrame,
    contents: DataFrame,
    spec: IndicatorSpec = DEFAULT_SPEC,
    chunks: DataFrame | None = None,
) -> DataFrame:
    """Marker hits with kind, size and digest; only files that matched are digested.

    Contents are searched and digested where they are read; only hits move. Files too
    large for a row come as ``chunks``; only the pieces of those that matched move.
    """
    marked = _with_hits(contents.select("host_id", "path", "content"), spec)
    digested = marked.select("host_id", "path", "hits", K.sha256_hex(F.col("content")).alias("sha256"))
    found = _per_marker(digested.join(candidates, ["host_id", "path"]))
    if chunks is not None:
        hits = marker_scan_chunks(chunks, spec).join(candidates, ["host_id", "path"])
        pieces = chunks.join(hits.select("host_id", "path").distinct(), ["host_id", "path"], "left_semi")
        whole = digest_chunks(pieces).withColumnRenamed("read", "size")
        found = found.unionByName(hits.join(whole, ["host_id", "path", "size"], "left"))
        # A file delivered in both ways is one file.
        found = found.groupBy("host_id", "path", "kind", "size", "marker").agg(
            F.min("offset").alias("offset"), F.max("sha256").alias("sha256")
        )
    return found.withColumn("install", K.is_install(F.col("kind"), F.col("size"), spec))


def unscanned_candidates(
    candidates: DataFrame,
    contents: DataFrame,
    spec: IndicatorSpec = DEFAULT_SPEC,
    chunks: DataFrame | None = None,
) -> DataFrame:
    """Candidates over ``max_candidate_bytes`` that were not delivered to their end, with what was."""
    file = ["host_id", "path"]
    large = candidates.filter(F.col("size") > spec.max_candidate_bytes)
    cover = contents.select(*file, F.octet_length("content").cast("bigint").alias("covered"))
    if chunks is not None:
        cover = cover.unionByName(chunk_cover(chunks, spec))
    cover = cover.groupBy(*file).agg(F.max("covered").alias("covered"))
    return (
        large.join(cover, file, "left")
        .withColumn("covered", F.coalesce("covered", F.lit(0)))
        .filter(F.col("covered") < F.col("size"))
        .select(*file, "size", "covered")
    )


def stray_homes(homes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Homes other than the configured one."""
    return homes.select("host_id", "home").join(
        hosts.select("host_id", "home"), ["host_id", "home"], "left_anti"
    )


def active_install(installs: DataFrame, path_lookup: DataFrame) -> DataFrame:
    """The install a host's search path leads to: its first entry, by target or by name."""
    first = path_lookup.groupBy("host_id").agg(
        F.min(F.struct("ord", "entry", "resolved")).alias("first")
    )
    wanted = first.select(
        "host_id",
        F.col("first.entry").alias("entry"),
        F.explode(
            F.array_distinct(
                F.array(clean_path(F.col("first.resolved")), clean_path(F.col("first.entry")))
            )
        ).alias("clean"),
    )
    return (
        installs.select("host_id", "path").distinct()
        .withColumn("clean", clean_path(F.col("path")))
        .join(wanted, ["host_id", "clean"])
        .groupBy("host_id")
        .agg(F.min("path").alias("path"), F.min("entry").alias("path_entry"))
    )


def binaries_rollup(marked: DataFrame, active: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per marked install, the bucket as sample marker if it has it; the
    install on the search path sorts first."""
    prefer_bucket = F.struct(
        F.when(F.col("marker") == spec.bucket, 0).otherwise(1), F.col("offset"), F.col("marker")
    )
    one = (
        marked.filter("install")
        .groupBy("host_id", "path")
        .agg(
            F.min_by("marker", prefer_bucket).alias("sample_marker"),
            F.countDistinct("marker").alias("markers"),
            F.max("size").alias("size"),
        )
        .join(active, ["host_id", "path"], "left")
        .withColumn("path_entry", F.coalesce("path_entry", F.lit("")))
    )
    return one.orderBy("host_id", F.col("path_entry") == "", "path")


def git_repositories(inventory: DataFrame) -> DataFrame:
    """Directories that hold a ``.git`` (a directory, or a file for worktrees)."""
    return (
        inventory.filter((F.col("name") == ".git") & (F.col("is_dir") | F.col("is_regular")))
        .select("host_id", dirname(F.col("path")).alias("repo_path"))
        .distinct()
    )


def repo_root_of(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """The nearest repository at or above each path; relative paths have none.

    Only the distinct directories climb, since most paths share theirs. The paths are read
    twice, so they are written once.
    """
    placed = materialize(
        paths.filter(F.col("path").startswith("/")).select("host_id", "path").distinct()
        .withColumn("clean", clean_path(F.col("path")))
        .withColumn("dir", dirname(F.col("clean"))),
        "placed_paths",
    )
    climbed = placed.select("host_id", "dir").distinct().select(
        "host_id", "dir", F.explode(ancestors(F.col("dir"))).alias("repo_path")
    )
    above = (
        climbed.join(repos, ["host_id", "repo_path"])
        .groupBy("host_id", "dir")
        .agg(F.max_by("repo_path", F.length("repo_path")).alias("above"))
    )
    itself = repos.select("host_id", F.col("repo_path").alias("clean"), F.lit(True).alias("is_root"))
    return (
        placed.join(above, ["host_id", "dir"], "left")
        .join(itself, ["host_id", "clean"], "left")
        .select("host_id", "path", F.when(F.col("is_root"), F.col("clean")).otherwise(F.col("above")).alias("repo_path"))
        .filter(F.col("repo_path").isNotNull())
    )


def manifest_paths(manifests: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Every string value at any depth of the staged manifests that are valid JSON."""
    text = F.col("text")
    quoted = F.filter(
        F.regexp_extract_all(text, F.lit(_JSON_STRING), F.lit(0)), lambda s: ~s.endswith(":")
    )
    values = F.from_json(
        F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>"
    )
    named = F.lower("name") == spec.manifest_name
    return (
        manifests.filter(named & F.try_parse_json(text).isNotNull())
        .select("host_id", F.explode(values).alias("path"))
        .distinct()
    )


def manifest_errors(manifests: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Long manifests that give no repository hints, as a material error each.

    They were cut where they were collected, or are more than the parser takes.
    """
    named = F.lower("name") == spec.manifest_name
    return long_unparsed(manifests.filter(named), "queue", spec.max_manifest_bytes)


def long_unparsed(files: DataFrame, detector: str, least_bytes: int) -> DataFrame:
    """An error row for each JSON file of so many bytes or more that cannot be parsed."""
    long = F.octet_length("text") >= least_bytes
    return files.filter(long & F.try_parse_json("text").isNull()).select(
        "host_id",
        F.lit(detector).alias("detector"),
        F.lit("parse").alias("kind"),
        "path",
        F.format_string("%d bytes could not be parsed as JSON", F.octet_length("text")).alias("message"),
        F.lit(True).alias("material"),
    )


def repos_on_disk(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """``on_disk`` and ``is_git_repo`` for each ledger row."""
    dirs = inventory.filter("is_dir").select(
        "host_id", F.col("path").alias("repo_path"), F.lit(True).alias("on_disk")
    ).distinct()
    repos = git_repositories(inventory).withColumn("has_git", F.lit(True))
    real = (F.col("repo_path") != UNATTRIBUTED) & (F.col("repo_path") != "")
    return (
        ledger.join(dirs, ["host_id", "repo_path"], "left")
        .join(repos, ["host_id", "repo_path"], "left")
        .withColumn("on_disk", real & F.coalesce("on_disk", F.lit(False)))
        .withColumn("is_git_repo", F.col("on_disk") & F.coalesce("has_git", F.lit(False)))
        .drop("has_git")
    )


def package_manifest_near(binaries: DataFrame, inventory: DataFrame) -> DataFrame:
    """``package.json`` beside a binary or one directory up."""
    places = binaries.select(
        "host_id",
        F.col("path").alias("binary"),
        F.explode(
            F.array(dirname(F.col("path")), dirname(dirname(F.col("path"))))
        ).alias("dir"),
    ).distinct()
    packages = inventory.filter((F.col("name") == "package.json") & ~F.col("is_dir")).select(
        "host_id", "path", dirname(F.col("path")).alias("dir")
    ).distinct()
    return places.join(packages, ["host_id", "dir"]).select("host_id", "binary", "path")
