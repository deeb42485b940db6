"""Version evidence from manifests, install paths and binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import versions as X
from fleetlens.functions.binding import bind
from fleetlens.functions.paths import basename
from fleetlens.operators.disk import long_unparsed
from fleetlens.operators.ordering import placed
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec

#: Bytes of each end of a piece that are searched together with its neighbour.
BORDER = 1 << 16
COLUMNS = ["host_id", "version", "source", "confidence", "class", "path"]


def _evidence(df: DataFrame, source, confidence: str, spec: IndicatorSpec) -> DataFrame:
    return df.select(
        "host_id",
        "version",
        source.alias("source"),
        F.lit(confidence).alias("confidence"),
        X.classify_version(F.col("version"), spec).alias("class"),
        "path",
    )


def versions_from_manifests(files: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """files(host_id, path, text) that a home or an install directory holds."""
    found = bind(
        files.select("host_id", "path", "text"),
        {"version": X.version_from_manifest(F.col("path"), F.col("text"), spec)},
    ).filter(F.col("version").isNotNull())
    source = F.concat(F.lit("manifest:"), basename(F.col("path")))
    return _evidence(found, source, "high", spec)


def version_file_errors(files: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Long JSON version files that cannot be parsed, as a material error each."""
    named = F.col("path").endswith(".json")
    return long_unparsed(files.filter(named), "versions", spec.max_version_file_bytes)


def versions_from_install_paths(binaries: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    found = bind(
        binaries.select("host_id", "path"),
        {"version": X.version_from_install_path(F.col("path"), spec)},
    ).filter(F.col("version").isNotNull())
    return _evidence(found, F.lit("homebrew-path"), "high", spec)


def versions_from_binaries(contents: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Versions named inside a binary; a hint, so of low confidence."""
    found = contents.select(
        "host_id", "path", F.explode(X.version_strings(F.col("content"), spec)).alias("version")
    ).filter(X.plausible_version(F.col("version")))
    return _evidence(found, F.lit("binary-strings"), "low", spec)


def versions_from_chunks(chunks: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """The same of files delivered in pieces (host, path, start, content), in any number and overlap.

    Pieces are searched where they lie. A version may also be cut by a piece's end, so the
    ends of neighbouring pieces are joined and searched once more; only these ends move. A version
    spelled over more than ``BORDER`` bytes is beyond that.
    """
    size = F.octet_length("content").cast("bigint")
    ends = chunks.select(
        "host_id", "path", "start", (F.col("start") + size).alias("end"),
        F.substring("content", 1, BORDER).alias("head"),
        F.expr(f"substring(content, greatest(octet_length(content) - {BORDER}, 0) + 1)").alias("tail"),
    )
    file = Window.partitionBy("host_id", "path").orderBy("start", "end")
    pairs = ends.select(
        "host_id", "path", "end", "tail",
        F.lead("start").over(file).alias("next"), F.lead("head").over(file).alias("head"),
        # The second piece is the file's last one and was joined whole.
        (F.lead("start", 2).over(file).isNull() & (F.lead("end").over(file) - F.lead("start").over(file) <= BORDER)).alias("final"),
    ).filter(F.col("next") <= F.col("end"))
    # What the pieces share stands in the tail already.
    joined = pairs.select(
        "host_id", "path", "final", F.expr("concat(tail, substring(head, cast(end - next as int) + 1))").alias("content")
    )
    both = chunks.select("host_id", "path", "content").unionByName(joined.filter("NOT final").drop("final"))
    found = both.select(
        "host_id", "path", F.explode(X.version_strings(F.col("content"), spec, cut=True)).alias("version")
    )
    # The last piece is not cut: its end is the file's.
    last = ends.groupBy("host_id", "path").agg(F.max_by("tail", F.struct("end", "start")).alias("content"))
    rest = last.unionByName(joined.filter("final").drop("final")).select("host_id", "path", F.explode(X.version_strings(F.col("content"), spec)).alias("version"))
    named = found.unionByName(rest).filter(X.plausible_version(F.col("version"))).distinct()
    return _evidence(named, F.lit("binary-strings"), "low", spec)


def dedupe_versions(evidence: DataFrame) -> DataFrame:
    return evidence.dropDuplicates(["host_id", "version", "source", "path"])


def version_order(evidence: DataFrame) -> DataFrame:
    """With the ``place`` in the host, the surest first."""
    rank = (
        F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    )
    return placed(evidence, rank.desc(), *[F.col(c).asc() for c in ("version", "source", "path")])


def version_summary(evidence: DataFrame) -> DataFrame:
    """Distinct versions per host and affected class, weak evidence left out."""
    return (
        evidence.filter((F.col("confidence") != "low") & F.col("class").isin(X.CONFIRMED, X.REPORTED))
        .select("host_id", "class", "version")
        .distinct()
    )
