"""Log lines to typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import events as E
from fleetlens.functions import fields as J
from fleetlens.functions.binding import bind
from fleetlens.functions.versions import classify_version
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec


def parse_log_lines(lines: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per line (host_id, path, line_no, line), the line itself dropped.

    The raw marker test runs on the text, so it also sees lines that do not parse.
    """
    a = spec.aliases
    line = F.col("line")
    texts = bind(
        J.with_record(lines, a),
        {"parsed": F.col("record").isNotNull()}
        | {f"text_{name}": J.pick(aliases) for name, aliases in a.items()},
    )
    typed = bind(
        texts,
        {
            name: J.pick_str(F.col(f"text_{name}"), line, a[name])
            for name in ("event", "consumer", "sid", "repo", "gcs_path", "version")
        }
        | {
            "status": F.coalesce(J.pick_int(F.col("text_status")), F.lit(0).cast("bigint")),
            "turn": J.pick_int(F.col("text_turn")),
            "ts": J.pick_time(F.col("text_time")),
            "raw_hit": E.raw_marker_hit(line, spec),
        },
    )
    others = [c for c in lines.columns if c not in ("line", "line_no", "path", "host_id")]
    return typed.select(
        "host_id",
        "path",
        "line_no",
        *others,
        "parsed",
        "raw_hit",
        E.classify_event(F.col("event"), F.col("consumer"), F.col("status"), spec).alias("kind"),
        F.col("event").alias("raw"),
        "sid",
        "turn",
        "repo",
        "gcs_path",
        "consumer",
        "status",
        "version",
        "ts",
    )


def relevant_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("parsed") & (F.col("kind") != E.OTHER)).drop("parsed", "raw_hit")


def raw_hits(parsed: DataFrame) -> DataFrame:
    return parsed.filter("raw_hit").select("host_id", "path", "line_no")


def versions_from_logs(parsed: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Each version a host's logs name, with the first file that names it."""
    named = parsed.filter(F.col("parsed") & (F.col("version") != ""))
    return named.groupBy("host_id", "version").agg(F.min("path").alias("path")).select(
        "host_id",
        "version",
        F.lit("logs").alias("source"),
        F.lit("high").alias("confidence"),
        classify_version(F.col("version"), spec).alias("class"),
        "path",
    )


def unknown_event_names(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("kind") == E.UNKNOWN_UPLOAD).select("host_id", "raw").distinct()
    )
