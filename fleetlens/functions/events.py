"""What a log record means: start, enqueue, delivery, refusal, or drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.spec import IndicatorSpec

START = "start"
ENQUEUED = "enqueued"
SUCCESS = "upload_success"
UNKNOWN_UPLOAD = "unknown_upload"
AUTH_FAIL = "upload_auth_fail"
OTHER = "other"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_upload_leg(consumer: Column, spec: IndicatorSpec) -> Column:
    return any_of([F.lower(consumer).contains(w) for w in spec.upload_leg_words])


def is_success_event(name: Column, spec: IndicatorSpec) -> Column:
    return name.isin(*spec.success_events)


def classify_event(name: Column, consumer: Column, status: Column, spec: IndicatorSpec) -> Column:
    """The order decides: a success name is tested before the unknown-upload net."""
    leg = (consumer != "") & is_upload_leg(consumer, spec)
    return (
        F.when(name == spec.event_start, START)
        .when(name == spec.event_enqueued, ENQUEUED)
        .when(is_success_event(name, spec), SUCCESS)
        .when(leg & status.between(200, 299), SUCCESS)
        .when(name.contains(spec.event_prefix), UNKNOWN_UPLOAD)
        .when(leg & name.contains(spec.auth_code), AUTH_FAIL)
        .otherwise(OTHER)
    )


def archive_phase(object_path: Column, spec: IndicatorSpec) -> Column:
    bare = F.rtrim(F.regexp_replace(object_path, r"(?s)[?#].*", ""), F.lit("/"))
    base = F.regexp_extract(bare, r"([^/\\]*)$", 1)
    return (
        F.when(base.startswith(spec.before_prefix), "before")
        .when(base.startswith(spec.after_prefix), "after")
        .otherwise("unknown")
    )


def raw_marker_hit(line: Column, spec: IndicatorSpec) -> Column:
    """Bucket or archive name anywhere in the raw text, parseable or not."""
    return line.contains(spec.bucket) | line.contains(spec.archive_suffix)


def status_rank(status: Column) -> Column:
    return (
        F.when(status == "delivered", 4)
        .when(status == "queued", 3)
        .when(status == "collected_only", 2)
        .otherwise(1)
    )


def repo_status(deliveries: Column, archives: Column, attempts: Column) -> Column:
    return (
        F.when(deliveries > 0, "delivered")
        .when(archives > 0, "queued")
        .when(attempts > 0, "collected_only")
        .otherwise("unknown")
    )
