"""Findings and their evidence, as two flat tables.

A finding is one row per host, id and instance; its evidence rows carry the
same three keys. Evidence says where something was seen, never what it said.
No evidence list is ever gathered into one row, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordering import placed
from fleetlens.functions import text as T
from fleetlens.functions import versions as X
from fleetlens.operators import config_audit as A
from fleetlens.spec import DEFAULT_SPEC, SEVERITIES, SEVERITY_RANK, IndicatorSpec

KEYS = ["host_id", "finding_id", "instance"]

# Finding ids with their severity and tags.
FINDINGS: dict[str, tuple[str, tuple[str, ...]]] = {
    "logs.upload_confirmed": ("critical", ("exfil", "upload")),
    "logs.archive_enqueued": ("high", ("exfil",)),
    "logs.collected_only": ("high", ("exfil",)),
    "logs.raw_bucket_reference": ("critical", ("exfil", "schema-drift", "upload")),
    "logs.upload_auth_failure": ("info", ()),
    "logs.unknown_upload_event": ("high", ("exfil", "schema-drift", "upload")),
    "queue.present": ("medium", ("staging", "exfil")),
    "queue.metadata_bucket": ("high", ("exfil", "staging")),
    "queue.codebase_archive": ("high", ("staging", "exfil")),
    "deepscan.binary_marker": ("high", ("install",)),
    "deepscan.file_reference": ("info", ("install",)),
    "deepscan.stray_grok_home": ("medium", ("install",)),
    "config.absent": ("medium", ("config",)),
    "config.unparseable": ("medium", ("config",)),
    "config.explicitly_disabled": ("high", ("config",)),
    "config.not_mitigated": ("medium", ("config",)),
    "config.mitigated": ("info", ("config",)),
    "config.other_keys": ("info", ("config",)),
    "config.auth_present": ("info", ("config",)),
    "version.confirmed_affected": ("high", ("install",)),
    "version.reported_affected": ("medium", ("install",)),
    "secrets.deleted_from_checkout": ("critical", ("secret",)),
    "secrets.in_head": ("high", ("secret",)),
}

_ADVICE = {
    "logs": "Rotate every credential reachable from the affected repositories' history.",
    "queue": "Keep the staged files as evidence before removing them.",
    "deepscan": "Remove the program and set the upload mitigations until then.",
    "config": "Set both upload mitigations in the configuration file.",
    "version": "Remove the affected version.",
    "secrets": "Rotate these credentials, those missing from the checkout first.",
}


@dataclass(frozen=True)
class Found:
    """What one generator emits."""

    findings: DataFrame
    evidence: DataFrame


def _text(value) -> Column:
    if value is None:
        return F.lit("")
    return F.coalesce(value if isinstance(value, Column) else F.lit(value), F.lit(""))


def evidence_rows(
    df: DataFrame, finding_id: str, *, instance=None, path=None, locator=None, note=None,
    sha256=None, size=None, source=None, source_line=None, path_entry=None,
) -> DataFrame:
    def number(value) -> Column:
        return F.coalesce(F.lit(0) if value is None else value, F.lit(0)).cast("bigint")

    return df.select(
        "host_id",
        F.lit(finding_id).alias("finding_id"),
        _text(instance).alias("instance"),
        _text(path).alias("path"),
        _text(locator).alias("locator"),
        _text(note).alias("note"),
        _text(sha256).alias("sha256"),
        number(size).alias("size_bytes"),
        _text(source).alias("source"),
        number(source_line).alias("source_line"),
        _text(path_entry).alias("path_entry"),
    )


def finding_rows(
    df: DataFrame, finding_id: str, title: Column, *, instance=None, severity: Column | None = None
) -> DataFrame:
    """One finding per row of ``df``."""
    level, tags = FINDINGS[finding_id]
    detector = finding_id.split(".")[0]
    return df.select(
        "host_id",
        F.lit(finding_id).alias("finding_id"),
        _text(instance).alias("instance"),
        F.lit(detector).alias("detector"),
        (F.lit(level) if severity is None else severity).alias("severity"),
        F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
        title.alias("title"),
        F.lit(_ADVICE[detector]).alias("remediation"),
    )


def severity_rank(severity: Column) -> Column:
    return reduce(
        lambda c, s: c.when(severity == s, SEVERITY_RANK[s]),
        SEVERITIES[1:],
        F.when(severity == SEVERITIES[0], 0),
    )


def _count(df: DataFrame, *extra: Column) -> DataFrame:
    return df.groupBy("host_id").agg(F.count(F.lit(1)).alias("n"), *extra)


def _archive_evidence(archives: DataFrame, repos: DataFrame, finding_id: str, prefix: str) -> DataFrame:
    rows = archives.join(repos.select("host_id", "repo_key", "repo_path"), ["host_id", "repo_key"])
    note = T.archive_note(F.col("phase"), F.col("sid"), F.col("turn"), F.col("ts"))
    return evidence_rows(
        rows, finding_id, path=F.col("repo_path"), locator=F.col("gcs_path"),
        note=F.concat(F.lit(prefix), note), source=F.col("log_file"), source_line=F.col("log_line"),
    )


def upload_confirmed(ledger: DataFrame, archives: DataFrame) -> Found:
    repos = ledger.filter(F.col("status") == "delivered")
    per_host = _count(repos, F.sum("deliveries_confirmed").alias("confirmed"))
    title = F.concat(
        T.plural(F.col("confirmed"), "archive"), F.lit(" confirmed delivered ("),
        T.plural(F.col("n"), "repository"), F.lit(")"),
    )
    fid = "logs.upload_confirmed"
    return Found(
        finding_rows(per_host, fid, title),
        _archive_evidence(archives.filter("delivered"), repos, fid, "delivery confirmed: "),
    )


def archive_enqueued(ledger: DataFrame, archives: DataFrame) -> Found:
    """A delivered repository was also queued and stays in this finding."""
    repos = ledger.filter(F.col("status").isin("queued", "delivered"))
    per_host = _count(repos, F.sum("archives").alias("queued"))
    title = F.format_string("%d repositories had %d archives queued for upload", "n", "queued")
    fid = "logs.archive_enqueued"
    return Found(
        finding_rows(per_host, fid, title), _archive_evidence(archives, repos, fid, "")
    )


def collected_only(ledger: DataFrame) -> Found:
    repos = ledger.filter(F.col("status") == "collected_only")
    fid = "logs.collected_only"
    note = F.format_string("%d collection attempts, no enqueue event found", "collect_attempts")
    return Found(
        finding_rows(
            _count(repos), fid, F.format_string("%d repositories were collected, upload unconfirmed", "n")
        ),
        evidence_rows(
            repos, fid, path=F.col("repo_path"), note=note, source=F.col("log_file"),
            source_line=F.col("log_line"),
        ),
    )


def raw_bucket_reference(raw_hits: DataFrame, ledger: DataFrame) -> Found:
    """Marker lines of hosts without any queued or delivered repository."""
    explained = ledger.filter(F.col("status").isin("queued", "delivered")).select("host_id").distinct()
    rows = raw_hits.join(explained, "host_id", "left_anti")
    fid = "logs.raw_bucket_reference"
    title = F.format_string("%d log lines name the bucket, but no upload event could be parsed", "n")
    return Found(
        finding_rows(_count(rows), fid, title),
        evidence_rows(
            rows, fid, path=F.col("path"), locator=F.concat(F.lit("line:"), F.col("line_no").cast("string")),
            note="line names the bucket or an archive",
        ),
    )


def upload_auth_failure(summary: DataFrame) -> Found:
    """Context only: a refusal never moves the verdict."""
    total, inside, outside = F.col("total"), F.col("in_window"), F.col("out_of_window")
    title = (
        F.when(
            F.col("windows") == 0,
            F.format_string("%d refusals on the upload leg, no collected repository to relate them to", total),
        )
        .when(inside == 0, F.format_string("No refusals while archives were queued (%d outside that time)", outside))
        .when(outside == 0, F.format_string("%d refusals on the upload leg, all during collection", inside))
        .otherwise(
            F.format_string("%d refusals on the upload leg (%d during collection, %d outside)", total, inside, outside)
        )
    )
    fid = "logs.upload_auth_failure"
    span = F.format_string(
        "%d between %s and %s", total,
        F.coalesce(T.day(F.col("first_failure")), F.lit("unknown")),
        F.coalesce(T.day(F.col("last_failure")), F.lit("unknown")),
    )
    return Found(
        finding_rows(summary, fid, title),
        evidence_rows(summary, fid, locator=span, note="refused upload client"),
    )


def unknown_upload_event(names: DataFrame) -> Found:
    fid = "logs.unknown_upload_event"
    return Found(
        finding_rows(_count(names), fid, F.lit("Unrecognized upload events in the logs")),
        evidence_rows(names, fid, locator=F.col("raw"), note="unrecognized upload event"),
    )


def queue_present(queues: DataFrame) -> Found:
    files, size = F.col("files"), T.human_bytes(F.col("bytes"))
    fid = "queue.present"
    title = (
        F.when(F.col("truncated") & (files == 0), "Upload queue present, not enumerated")
        .when(F.col("truncated"), F.format_string("Upload queue holds at least %d files (%s)", files, size))
        .when(files > 0, F.format_string("Upload queue holds %d files (%s)", files, size))
        .otherwise("Upload queue present but empty")
    )
    severity = F.when((files > 0) | F.col("truncated"), "high").otherwise("medium")
    note = F.concat(F.when(F.col("truncated"), "at least ").otherwise(""), files.cast("string"), F.lit(" files"))
    return Found(
        finding_rows(queues, fid, title, instance=F.col("queue"), severity=severity),
        evidence_rows(
            queues, fid, instance=F.col("queue"), path=F.col("queue"), note=note, size=F.col("bytes")
        ),
    )


def metadata_bucket(manifests: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> Found:
    fid = "queue.metadata_bucket"
    title = F.format_string(f"%d staged manifests point at {spec.bucket_url}", "n")
    return Found(
        finding_rows(_count(manifests), fid, title),
        evidence_rows(
            manifests, fid, path=F.col("path"), locator=spec.bucket_url, note="manifest names the bucket"
        ),
    )


def codebase_archive(archives: DataFrame) -> Found:
    fid = "queue.codebase_archive"
    per_host = _count(archives, F.sum("size").alias("bytes"))
    title = F.format_string("%d archives staged on disk (%s)", F.col("n"), T.human_bytes(F.col("bytes")))
    digest = F.col("sha256") if "sha256" in archives.columns else None
    return Found(
        finding_rows(per_host, fid, title),
        evidence_rows(
            archives, fid, path=F.col("path"), size=F.col("size"), sha256=digest,
            note="archive, recorded but not opened",
        ),
    )


def binary_marker(marked: DataFrame, active: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> Found:
    installs = marked.filter("install")
    fid = "deepscan.binary_marker"
    per_host = installs.groupBy("host_id").agg(F.countDistinct("path").alias("n"))
    rows = installs.join(active.select("host_id", "path", "path_entry"), ["host_id", "path"], "left")
    return Found(
        finding_rows(per_host, fid, F.format_string("%d executables carry upload indicators", "n")),
        evidence_rows(
            rows, fid, path=F.col("path"),
            locator=F.concat(F.lit("offset:0x"), F.lower(F.hex("offset"))),
            note=F.concat(F.lit("contains marker "), F.col("marker")),
            sha256=F.col("sha256"), size=F.col("size"), path_entry=F.col("path_entry"),
        ),
    )


def file_reference(marked: DataFrame) -> Found:
    mentions = marked.filter(~F.col("install")).groupBy("host_id", "path", "kind", "size", "sha256").agg(
        F.count(F.lit(1)).alias("markers")
    )
    fid = "deepscan.file_reference"
    return Found(
        finding_rows(_count(mentions), fid, F.format_string("%d small files mention indicators", "n")),
        evidence_rows(
            mentions, fid, path=F.col("path"), size=F.col("size"), sha256=F.col("sha256"),
            note=F.format_string("%s file mentioning %d indicators", "kind", "markers"),
        ),
    )


def stray_home(homes: DataFrame) -> Found:
    fid = "deepscan.stray_grok_home"
    return Found(
        finding_rows(homes, fid, F.lit("A second home outside the configured one"), instance=F.col("home")),
        evidence_rows(homes, fid, instance=F.col("home"), path=F.col("home"), note="home outside the configured one"),
    )


def config_findings(
    states: DataFrame, present: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> Found:
    """State findings, only for hosts on which the product is present."""
    mine = states.join(present.select("host_id").distinct(), "host_id", "left_semi")
    parts = []

    def per_path(rows: DataFrame, fid: str, title: Column, note: str) -> None:
        parts.append(
            Found(
                finding_rows(rows, fid, title, instance=F.col("path")),
                evidence_rows(rows, fid, instance=F.col("path"), path=F.col("path"), note=note),
            )
        )

    state = A.overall_state(spec)
    per_path(mine.filter(state == "missing"), "config.absent",
             F.lit("No configuration file, so no mitigation is set"), "file does not exist")
    per_path(mine.filter(state == "uncertain"), "config.unparseable",
             F.lit("The configuration could not be confirmed"), "could not confirm the mitigations")
    per_path(mine.filter(state == "mitigated"), "config.mitigated",
             F.lit("Both upload mitigations are set"), "both mitigations present")

    each = A.mitigation_status(mine, spec)
    for outcome, fid, words in (
        ("wrong value", "config.explicitly_disabled", " is set to the wrong value"),
        ("absent", "config.not_mitigated", " is not set"),
    ):
        rows = each.filter(F.col("mitigation") == outcome)
        instance = F.concat("path", F.lit("#"), "locator")
        parts.append(
            Found(
                finding_rows(rows, fid, F.concat("locator", F.lit(words)), instance=instance),
                evidence_rows(
                    rows, fid, instance=instance, path=F.col("path"), locator=F.col("locator"), note=outcome
                ),
            )
        )
    others = A.other_config_keys(mine, spec)
    per_path(others, "config.other_keys",
             F.concat(F.lit("Other upload-related options are set: "), F.array_join("others", ", ")), "")
    return union(parts)


def auth_present(inventory: DataFrame, homes: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> Found:
    """The credential file exists; it is never read."""
    expected = homes.select(
        "host_id", F.concat("home", F.lit("/" + spec.auth_name)).alias("path")
    ).distinct()
    # Few files are so named; only they move.
    named = inventory.filter(F.col("path").endswith("/" + spec.auth_name))
    rows = named.join(expected, ["host_id", "path"], "left_semi").groupBy("host_id", "path").agg(
        F.max("size").alias("size")
    )
    fid = "config.auth_present"
    return Found(
        finding_rows(rows, fid, F.lit("A cached credential is present"), instance=F.col("path")),
        evidence_rows(
            rows, fid, instance=F.col("path"), path=F.col("path"), size=F.col("size"), note="not read"
        ),
    )


def affected_versions(evidence: DataFrame) -> Found:
    """From the version detector's own evidence; versions named in logs do not fire these."""
    strong = evidence.filter(F.col("confidence") != "low")
    parts = []
    for cls, fid, words in (
        (X.CONFIRMED, "version.confirmed_affected", "Version %s is installed, confirmed affected"),
        (X.REPORTED, "version.reported_affected", "Version %s is in the reported range"),
    ):
        rows = strong.filter(F.col("class") == cls)
        per_host = rows.groupBy("host_id").agg(F.min("version").alias("version"))
        parts.append(
            Found(
                finding_rows(per_host, fid, F.format_string(words, "version")),
                evidence_rows(
                    rows, fid, path=F.when(F.col("path") == "", F.col("source")).otherwise(F.col("path")),
                    locator=F.col("version"), note=F.concat(F.lit("source: "), "source"),
                ),
            )
        )
    return union(parts)


def secret_findings(hits: DataFrame) -> Found:
    """Tagged secret only: a credential is what would leak, not proof that it did."""
    path = F.concat("repo_path", F.lit("/"), "path")
    locator = F.when(F.coalesce("blob", F.lit("")) != "", F.concat(F.lit("blob:"), "blob"))
    parts = []
    for gone, fid, words, note in (
        (True, "secrets.deleted_from_checkout", "%d credential files left the checkout but not the history",
         ", deleted from the checkout but still in history"),
        (False, "secrets.in_head", "%d credential files are in the checkout", ", tracked at HEAD"),
    ):
        rows = hits.filter(F.col("deleted_from_checkout") == gone)
        note = F.when(locator.isNull(), ", in the working tree").otherwise(note)
        parts.append(
            Found(
                finding_rows(_count(rows), fid, F.format_string(words, "n")),
                evidence_rows(
                    rows, fid, path=path, locator=locator, note=F.concat("class", note)
                ),
            )
        )
    return union(parts)


def union(parts: list[Found]) -> Found:
    return Found(
        reduce(DataFrame.unionByName, [p.findings for p in parts]),
        reduce(DataFrame.unionByName, [p.evidence for p in parts]),
    )


def findings_order(findings: DataFrame) -> DataFrame:
    """With the ``place`` in the host, the severest first."""
    return placed(findings, severity_rank(F.col("severity")).desc(), *[F.col(c).asc() for c in ("finding_id", "instance", "title")])
