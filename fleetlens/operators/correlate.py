"""Attribution of uploads to repositories, and the per-repository ledger.

Correlation is global over all files of a host. Ingest order is (path, line_no).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import events as E
from fleetlens.functions.paths import normalize_repo
from fleetlens.operators.ordering import placed
from fleetlens.operators.timeline import AFTER, AT, BEFORE, totals_at
from fleetlens.spec import DEFAULT_SPEC, UNATTRIBUTED, IndicatorSpec

UPLOADS = (E.ENQUEUED, E.UNKNOWN_UPLOAD, E.SUCCESS)


def ingest_order() -> Column:
    return F.struct("path", "line_no")


def _turn_key() -> Column:
    """A missing turn is its own bucket and never meets a numbered one."""
    return F.coalesce(F.col("turn").cast("string"), F.lit("-")).alias("turn_key")


def first_start_per_turn(events: DataFrame) -> DataFrame:
    """The repository of the first start, in ingest order, that names one."""
    return (
        events.filter((F.col("kind") == E.START) & (F.col("repo") != ""))
        .groupBy("host_id", "sid", _turn_key())
        .agg(F.min_by("repo", ingest_order()).alias("start_repo"))
    )


def last_repo_per_session(events: DataFrame) -> DataFrame:
    return (
        events.filter((F.col("kind") == E.START) & (F.col("repo") != "") & (F.col("sid") != ""))
        .groupBy("host_id", "sid")
        .agg(F.max_by("repo", ingest_order()).alias("session_repo"))
    )


def attribute_uploads(events: DataFrame) -> DataFrame:
    """Upload rows with ``repo`` resolved and ``low_confidence`` set; none is dropped.

    The repository is looked up once per distinct (host, session, turn), which
    is far smaller than the events and holds a hot session in a few rows.
    """
    uploads = events.filter(F.col("kind").isin(*UPLOADS)).withColumn("turn_key", _turn_key())
    known = (
        uploads.select("host_id", "sid", "turn_key")
        .distinct()
        .join(first_start_per_turn(events), ["host_id", "sid", "turn_key"], "left")
        .join(last_repo_per_session(events), ["host_id", "sid"], "left")
        .filter(F.col("start_repo").isNotNull() | F.col("session_repo").isNotNull())
    )
    own = F.when(F.col("repo") != "", F.col("repo"))
    return (
        uploads.join(known, ["host_id", "sid", "turn_key"], "left")
        .withColumn(
            "low_confidence",
            F.col("start_repo").isNull() & (F.col("session_repo").isNotNull() | own.isNull()),
        )
        .withColumn(
            "repo", F.coalesce("start_repo", "session_repo", own, F.lit(UNATTRIBUTED))
        )
        .drop("turn_key", "start_repo", "session_repo")
    )


def attributed_rows(events: DataFrame) -> DataFrame:
    """Starts and uploads, each with its repository and the normalized key of it."""
    starts = events.filter(F.col("kind") == E.START).select(
        *[c for c in events.columns if c != "repo"],
        F.when(F.col("repo") == "", UNATTRIBUTED).otherwise(F.col("repo")).alias("repo"),
        F.lit(False).alias("low_confidence"),
    )
    insensitive = (
        F.coalesce(F.col("case_insensitive"), F.lit(False))
        if "case_insensitive" in events.columns
        else F.lit(False)
    )
    return starts.unionByName(attribute_uploads(events)).withColumn(
        "repo_key", normalize_repo(F.col("repo"), insensitive)
    )


def repo_archives(rows: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per queued archive, marked delivered if a success of the same
    repository names the same object."""
    delivered = (
        rows.filter((F.col("kind") == E.SUCCESS) & (F.col("gcs_path") != ""))
        .select("host_id", "repo_key", "gcs_path", F.lit(True).alias("was_delivered"))
        .distinct()
    )
    queued = rows.filter(F.col("kind").isin(E.ENQUEUED, E.UNKNOWN_UPLOAD))
    return queued.join(delivered, ["host_id", "repo_key", "gcs_path"], "left").select(
        "host_id",
        "repo_key",
        E.archive_phase(F.col("gcs_path"), spec).alias("phase"),
        "gcs_path",
        "sid",
        "turn",
        "ts",
        F.col("path").alias("log_file"),
        F.col("line_no").alias("log_line"),
        F.coalesce("was_delivered", F.lit(False)).alias("delivered"),
    )


def repo_sessions(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("sid") != "").select("host_id", "repo_key", "sid").distinct()


def build_ledger(rows: DataFrame) -> DataFrame:
    """One row per host and repository; every column combines before the shuffle."""
    kind = F.col("kind")
    queued = kind.isin(E.ENQUEUED, E.UNKNOWN_UPLOAD)
    start_place = F.when(kind == E.START, ingest_order())
    grouped = rows.groupBy("host_id", "repo_key").agg(
        F.min_by("repo", ingest_order()).alias("repo_path"),
        F.count_if(kind == E.START).alias("collect_attempts"),
        F.count_if(queued).alias("archives"),
        F.count_if(kind == E.SUCCESS).alias("deliveries_confirmed"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.bool_or("low_confidence").alias("low_confidence"),
        F.min(start_place).alias("cited"),
    )
    return grouped.select(
        "host_id",
        "repo_key",
        "repo_path",
        E.repo_status(
            F.col("deliveries_confirmed"), F.col("archives"), F.col("collect_attempts")
        ).alias("status"),
        "collect_attempts",
        "archives",
        "deliveries_confirmed",
        "first_seen",
        "last_seen",
        "low_confidence",
        F.col("cited.path").alias("log_file"),
        F.col("cited.line_no").alias("log_line"),
    )


def archives_sorted(archives: DataFrame) -> DataFrame:
    """With the ``place`` in the host: by repository, time (unknown first), object, and where it was logged."""
    return placed(
        archives, *[F.col(c).asc_nulls_first() for c in ("repo_key", "ts", "gcs_path", "log_file", "log_line")]
    )


def archive_counts(archives: DataFrame) -> DataFrame:
    """Total, unique and delivered archives; each unnamed one is its own."""
    per_object = archives.groupBy("host_id", "repo_key", "gcs_path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("delivered").alias("d")
    )
    return per_object.groupBy("host_id", "repo_key").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("gcs_path") == "", F.col("n")).otherwise(1)).alias("unique"),
        F.sum("d").alias("delivered"),
    )


def _windows(ledger: DataFrame, spec: IndicatorSpec) -> DataFrame:
    return ledger.filter(F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()).select(
        "host_id",
        "repo_key",
        F.col("first_seen").alias("opens"),
        (F.col("last_seen") + F.expr(spec.upload_grace)).alias("closes"),
    )


def auth_failures_in_window(
    ledger: DataFrame, events: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """The ledger with the refusals inside each repository's window (both ends included).

    A refusal counts for every repository whose window holds it. The count is
    the difference of two running totals, so no (refusal, repository) pair is built.
    """
    windows = _windows(ledger, spec)
    failures = events.filter((F.col("kind") == E.AUTH_FAIL) & F.col("ts").isNotNull())
    changes = failures.select("host_id", "ts", F.lit(AT).alias("ord"), F.lit(1).alias("delta"))
    ends = windows.select("host_id", F.col("opens").alias("ts"), F.lit(BEFORE).alias("ord")).unionByName(
        windows.select("host_id", F.col("closes").alias("ts"), F.lit(AFTER).alias("ord"))
    )
    totals = totals_at(changes, ends)
    at_open = totals.filter(F.col("ord") == BEFORE).select(
        "host_id", F.col("ts").alias("opens"), F.col("total").alias("before")
    )
    at_close = totals.filter(F.col("ord") == AFTER).select(
        "host_id", F.col("ts").alias("closes"), F.col("total").alias("until")
    )
    counts = (
        windows.join(at_open, ["host_id", "opens"])
        .join(at_close, ["host_id", "closes"])
        .select(
            "host_id", "repo_key", (F.col("until") - F.col("before")).alias("upload_auth_failures")
        )
    )
    return ledger.join(counts, ["host_id", "repo_key"], "left").fillna(
        0, subset=["upload_auth_failures"]
    )


def auth_any_window(
    events: DataFrame, ledger: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Each refusal moment with its count and whether any window of the host holds it."""
    windows = _windows(ledger, spec)
    changes = windows.select(
        "host_id", F.col("opens").alias("ts"), F.lit(BEFORE).alias("ord"), F.lit(1).alias("delta")
    ).unionByName(
        windows.select(
            "host_id", F.col("closes").alias("ts"), F.lit(AFTER).alias("ord"), F.lit(-1).alias("delta")
        )
    )
    failures = (
        events.filter(F.col("kind") == E.AUTH_FAIL)
        .groupBy("host_id", "ts")
        .agg(F.count(F.lit(1)).alias("failures"))
    )
    dated = failures.filter(F.col("ts").isNotNull())
    open_at = totals_at(changes, dated.select("host_id", "ts", F.lit(AT).alias("ord"))).filter(
        F.col("ord") == AT
    )
    inside = dated.join(open_at.drop("ord"), ["host_id", "ts"]).select(
        "host_id", "ts", "failures", (F.col("total") > 0).alias("in_window")
    )
    undated = failures.filter(F.col("ts").isNull()).withColumn("in_window", F.lit(False))
    return inside.unionByName(undated)


def auth_summary(
    events: DataFrame, ledger: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Per host: refusals in total, inside and outside the windows, and the span of them."""
    flagged = auth_any_window(events, ledger, spec)
    n = F.col("failures")
    per_host = flagged.groupBy("host_id").agg(
        F.sum(n).alias("total"),
        F.sum(F.when(F.col("in_window"), n).otherwise(0)).alias("in_window"),
        F.sum(F.when(~F.col("in_window"), n).otherwise(0)).alias("out_of_window"),
        F.min("ts").alias("first_failure"),
        F.max("ts").alias("last_failure"),
    )
    windows = _windows(ledger, spec).groupBy("host_id").agg(F.count(F.lit(1)).alias("windows"))
    return per_host.join(windows, "host_id", "left").fillna(0, subset=["windows"])


def ledger_order(ledger: DataFrame) -> DataFrame:
    """The ledger with each repository's ``place`` in its host, the worst first."""
    return placed(ledger, E.status_rank(F.col("status")).desc(), F.col("repo_path").asc(), F.col("repo_key").asc())


def top_repos(ledger: DataFrame, k: int = 10) -> DataFrame:
    """The k worst repositories of each host, with how many were left out."""
    worst_first = Window.partitionBy("host_id").orderBy(
        E.status_rank(F.col("status")).desc(), F.col("archives").desc(), "repo_path"
    )
    totals = ledger.groupBy("host_id").agg(F.count(F.lit(1)).alias("repos"))
    return (
        ledger.withColumn("place", F.row_number().over(worst_first))
        .filter(F.col("place") <= k)
        .join(totals, "host_id")
        .withColumn("omitted", F.greatest(F.col("repos") - k, F.lit(0)))
        .drop("repos")
    )
