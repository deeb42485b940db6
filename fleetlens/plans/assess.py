"""The whole assessment: host evidence in, report tables out.

Tables that several findings read are written once to the shared folder, so
no log line is parsed and no content scanned twice, and a lost executor costs
one stage rather than the whole lineage.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.paths import clean_path, dirname, display_path
from fleetlens.operators import config_audit as A
from fleetlens.operators import correlate as C
from fleetlens.operators import disk as D
from fleetlens.operators import findings as N
from fleetlens.operators import log_events as L
from fleetlens.operators import triage as G
from fleetlens.operators import verdicts as R
from fleetlens.operators import version_evidence as W
from fleetlens.session import configure, materialize
from fleetlens.sources.files import manifest_scan
from fleetlens.sources.logs import log_parse_errors
from fleetlens.sources.rules import RuleSet, default_rules
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec


@dataclass(frozen=True)
class EvidenceTables:
    """What the collectors of all hosts delivered; every table is keyed by ``host_id``."""

    hosts: DataFrame  # host_id, home, user_home
    log_lines: DataFrame  # host_id, path, line_no, line: read_log_lines or read_gz_tolerant with a host
    file_inventory: DataFrame  # host_id, path, name, is_dir, is_regular, size, head4
    file_content: DataFrame  # host_id, path, content
    path_lookup: DataFrame  # host_id, ord, entry, resolved
    config_files: DataFrame  # host_id, path, status, text
    manifests: DataFrame  # host_id, path, name, text
    version_files: DataFrame  # host_id, path, text
    git_objects: DataFrame  # host_id, repo_path, seq, sha, path, obj_type, from_head
    head_tree: DataFrame  # host_id, repo_path, path, sha
    blobs: DataFrame  # host_id, repo_path, sha, obj_type, size, content
    collector_errors: DataFrame  # host_id, seq, detector, kind, path, message, material
    interrupted_queues: DataFrame | None = None  # host_id, queue, message: walks that did not end
    file_chunks: DataFrame | None = None  # host_id, path, start, content: read_content_chunks


@dataclass(frozen=True)
class ReportTables:
    host_report: DataFrame
    findings: DataFrame
    evidence: DataFrame
    repos: DataFrame
    archives: DataFrame
    sessions: DataFrame
    secrets: DataFrame
    versions: DataFrame
    errors: DataFrame
    limitations: DataFrame
    exfil_facts: DataFrame
    secret_examples: DataFrame
    error_examples: DataFrame
    shown_evidence: DataFrame
    binaries: DataFrame
    configs: DataFrame
    version_summary: DataFrame
    top_repos: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


Detector = Callable[[EvidenceTables, IndicatorSpec], N.Found]
_DETECTORS: dict[str, tuple[Detector, float]] = {}


def register_detector(name: str, fn: Detector, seconds: float = 1800) -> None:
    """Add a detector whose findings join the built-in ones before the verdict.

    It returns a ``Found`` made with ``finding_rows`` and ``evidence_rows``, or
    with the same columns. Its jobs are cancelled after ``seconds``.
    """
    _DETECTORS[name] = fn, seconds


def unregister_detector(name: str) -> None:
    _DETECTORS.pop(name, None)


def _run_detectors(ev: EvidenceTables, spec: IndicatorSpec) -> tuple[list[N.Found], DataFrame | None]:
    """Findings of the registered detectors; one that fails marks every host degraded.

    Each detector's tables are written in jobs of its own, so that a task that fails, or takes
    too long, costs that detector only.
    """
    found, failed = [], []
    for name, (fn, seconds) in _DETECTORS.items():
        late = []
        try:
            with _limited(ev.hosts.sparkSession, name, seconds, late):
                out = fn(ev, spec)
                found.append(N.Found(materialize(out.findings, "detected"), materialize(out.evidence, "detected_evidence")))
        except Exception as err:  # a detector's fault must not hide the others' findings
            reason = f"not done after {seconds:g} seconds" if late else str(err).strip().split("\n")[0]
            failed.append((name, f"{type(err).__name__}: {reason}"))
    if not failed:
        return found, None
    errors = [
        ev.hosts.select(
            "host_id",
            F.lit(name).alias("detector"),
            F.lit("panic").alias("kind"),
            F.lit("").alias("path"),
            F.lit(message).alias("message"),
            F.lit(True).alias("material"),
        ).distinct()
        for name, message in failed
    ]
    return found, reduce(DataFrame.unionByName, errors)


@contextmanager
def _limited(spark: SparkSession, name: str, seconds: float, late: list) -> Iterator[None]:
    """Jobs begun inside form a group that is cancelled when the time is over; ``late`` then has an entry."""
    context, group = spark.sparkContext, f"detector-{uuid.uuid4().hex}"

    def stop() -> None:
        late.append(name)
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    keys = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = {k: context.getLocalProperty(k) for k in keys}
    context.setJobGroup(group, name, interruptOnCancel=True)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        for key, value in before.items():
            context.setLocalProperty(key, value)


def log_findings(parsed: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC):
    """The ledger of parsed log lines and what it leads to: (found, ledger, archives, sessions)."""
    events = L.relevant_events(parsed)
    rows = materialize(C.attributed_rows(events), "attributed")
    base = materialize(C.build_ledger(rows), "ledger")
    archives = materialize(C.repo_archives(rows, spec), "archives")
    ledger = C.auth_failures_in_window(base, events, spec)
    found = N.union(
        [
            N.upload_confirmed(base, archives),
            N.archive_enqueued(base, archives),
            N.collected_only(base),
            N.raw_bucket_reference(L.raw_hits(parsed), base),
            N.upload_auth_failure(C.auth_summary(events, base, spec)),
            N.unknown_upload_event(L.unknown_event_names(events)),
        ]
    )
    return found, ledger, archives, C.repo_sessions(rows)


def assess(
    spark: SparkSession,
    ev: EvidenceTables,
    spec: IndicatorSpec = DEFAULT_SPEC,
    rules: RuleSet | None = None,
    scan_contents: bool = True,
    history: str = "all",
) -> ReportTables:
    configure(spark)
    rules = rules or default_rules()
    inventory, hosts = ev.file_inventory, ev.hosts

    # Disk first: it names homes, queues and installs for everyone else.
    homes = D.discovered_homes(inventory, hosts, spec)
    queues = D.upload_queues(inventory, homes, spec)
    queue_files = D.files_in_queues(inventory, queues, spec)
    queue_table = materialize(D.queue_inventory(queues, queue_files, ev.interrupted_queues), "queues")
    archives, unhashed = D.hash_archives(
        D.staged_archives(inventory, queue_files, spec), ev.file_content, spec
    )
    candidates = materialize(D.scan_candidates(inventory, spec), "candidates")
    marked = materialize(D.marked_files(candidates, ev.file_content, spec, ev.file_chunks), "marked")
    unscanned = D.unscanned_candidates(candidates, ev.file_content, spec, ev.file_chunks)
    installs = marked.filter("install")
    active = D.active_install(installs, ev.path_lookup)
    manifests = materialize(manifest_scan(ev.manifests, spec), "manifest_hits")
    hints = materialize(
        D.repo_root_of(D.manifest_paths(ev.manifests, spec), D.git_repositories(inventory))
        .select("host_id", "repo_path")
        .distinct(),
        "hints",
    )

    # Logs.
    parsed = materialize(L.parse_log_lines(ev.log_lines, spec), "parsed")
    of_logs, ledger, archived, sessions = log_findings(parsed, spec)
    # Collectors name repositories by their clean path, logs as they please.
    ledger = ledger.withColumn("repo_path", clean_path(F.col("repo_path")))
    ledger = materialize(D.repos_on_disk(ledger, inventory), "repos")

    # Versions: from files in a home, or beside or above an install.
    beside = D.package_manifest_near(installs.select("host_id", "path").distinct(), inventory)
    at_home = ev.version_files.withColumn("home", dirname(F.col("path"))).join(
        homes.select("host_id", "home").distinct(), ["host_id", "home"], "left_semi"
    )
    no_versions = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in W.COLUMNS))
    of_pieces = no_versions if ev.file_chunks is None else W.versions_from_chunks(
        ev.file_chunks.join(marked.select("host_id", "path").distinct(), ["host_id", "path"], "left_semi"), spec
    )
    placed = beside.select("host_id", "path").unionByName(at_home.select("host_id", "path")).distinct()
    own = materialize(W.dedupe_versions(
        W.versions_from_manifests(ev.version_files.join(placed, ["host_id", "path"], "left_semi"), spec)
        .unionByName(W.versions_from_install_paths(marked.select("host_id", "path").distinct(), spec))
        .unionByName(
            W.versions_from_binaries(
                ev.file_content.join(marked.select("host_id", "path").distinct(), ["host_id", "path"], "left_semi"),
                spec,
            )
        )
        .unionByName(of_pieces)
    ), "own_versions")
    versions = materialize(
        own.unionByName(L.versions_from_logs(parsed, spec)), "versions"
    )

    # Configuration.
    states, config_errors = A.homes_configs(homes, ev.config_files, spec)
    states = materialize(states, "states")
    present = A.product_present(installs, queues, D.discovered_homes(inventory, hosts.limit(0), spec))

    # Secrets in the repositories that were implicated.
    seeds = materialize(G.seed_repos(ledger, hints), "seeds")
    objects = ev.git_objects.join(seeds, G.REPO, "left_semi")
    tree = ev.head_tree.join(seeds, G.REPO, "left_semi")
    objects = G.history_scope(objects, tree, history)
    first = None
    if scan_contents:
        blobs = ev.blobs.join(seeds, G.REPO, "left_semi")
        first = G.content_hits_first(G.content_hits(objects, blobs, rules, spec))
    _, oversized = G.blob_filter(ev.blobs.join(seeds, G.REPO, "left_semi"), spec)
    untriaged = materialize(G.untriaged_repos(ledger, objects), "untriaged")
    files = materialize(checkout_files(inventory, seeds, untriaged), "checkouts")
    secrets = materialize(
        G.secret_hits(objects, tree, first).unionByName(
            G.worktree_secrets(files, ev.file_content if scan_contents else None, rules)
        ),
        "secrets",
    )

    of_detectors, failures = _run_detectors(ev, spec)
    found = N.union(
        [
            of_logs,
            N.queue_present(queue_table),
            N.metadata_bucket(manifests, spec),
            N.codebase_archive(archives),
            N.binary_marker(marked, active, spec),
            N.file_reference(marked),
            N.stray_home(D.stray_homes(homes, hosts)),
            N.config_findings(states, present, spec),
            N.auth_present(inventory, homes, spec),
            N.affected_versions(own),
            N.secret_findings(secrets),
            *of_detectors,
        ]
    )
    findings = materialize(found.findings, "findings")
    others = (
        log_parse_errors(parsed)
        .unionByName(config_errors)
        .unionByName(D.manifest_errors(ev.manifests, spec))
        .unionByName(W.version_file_errors(ev.version_files.join(placed, ["host_id", "path"], "left_semi"), spec))
    )
    if ev.interrupted_queues is not None:
        others = others.unionByName(interrupted_errors(ev.interrupted_queues))
    if failures is not None:
        others = others.unionByName(failures)
    # Collectors number their errors; an error found here stands behind them, once.
    columns = ["host_id", "detector", "kind", "path", "message", "material"]
    listed = materialize(
        ev.collector_errors.select(*columns, F.col("seq").cast("bigint").alias("seq")).unionByName(
            others.select(*columns).distinct().withColumn("seq", F.lit(None).cast("bigint"))
        ),
        "errors",
    )
    errors = listed.drop("seq")

    triage = (
        G.history_objects(objects)
        .join(G.secret_totals(secrets, *G.REPO), G.REPO, "full_outer")
        .join(G.secrets_notes(untriaged, files), G.REPO, "full_outer")
        .withColumnsRenamed({"total": "secret_files", "deleted": "secret_files_deleted"})
        .withColumn("secrets_scanned", F.col("history_objects").isNotNull())
    )
    repos = G.merge_triage(ledger, triage)
    no_logs = hosts.select("host_id").join(parsed.select("host_id").distinct(), "host_id", "left_anti")
    caveats = R.limitations(
        hosts.select("host_id").distinct(), no_logs, oversized, unhashed, untriaged,
        versions.select("host_id").distinct(), unscanned,
    )
    report = host_report(hosts, findings, errors, ledger, secrets, versions, installs, queues, archives, hints)
    return ReportTables(
        report, N.findings_order(findings), found.evidence, C.ledger_order(repos), C.archives_sorted(archived), sessions, secrets,
        W.version_order(versions), errors, caveats,
        exfil_facts=R.exfil_facts(ledger),
        secret_examples=G.secret_examples(secrets),
        error_examples=R.error_examples(listed).drop("seq"),
        shown_evidence=R.shown_evidence(found.evidence),
        binaries=D.binaries_rollup(marked, active, spec),
        configs=A.config_rollup(findings, found.evidence).join(
            A.active_config(states, active, hosts, spec).select("host_id", "path", F.lit(True).alias("active")),
            ["host_id", "path"], "left",
        ).fillna(False, ["active"]),
        version_summary=W.version_summary(versions),
        top_repos=shown_repos(ledger, hosts),
    )


def shown_repos(ledger: DataFrame, hosts: DataFrame, k: int = 10) -> DataFrame:
    """The worst repositories of each host for people: home-relative, with the number left out.

    A host with several homes has one row per user at most; paths are shown against the longest
    user home that holds them.
    """
    homes = hosts.select("host_id", F.coalesce("user_home", F.lit("")).alias("home")).distinct()
    top = C.top_repos(ledger, k).join(homes, "host_id", "left").withColumn(
        "shown", display_path(F.col("repo_path"), F.coalesce("home", F.lit("")))
    )
    keys = ["host_id", "place", "repo_path", "status", "archives", "omitted"]
    return top.groupBy(*keys).agg(F.min_by("shown", F.length("shown")).alias("shown"))


def checkout_files(inventory: DataFrame, seeds: DataFrame, untriaged: DataFrame) -> DataFrame:
    """The files of working trees whose history was not delivered, each of its nearest repository."""
    hosts = untriaged.select("host_id").distinct()
    files = inventory.filter("is_regular").join(hosts, "host_id", "left_semi").select("host_id", "path")
    roots = D.git_repositories(inventory).unionByName(seeds.select(*G.REPO)).distinct()
    return G.worktree_files(D.repo_root_of(files, roots), untriaged)


def interrupted_errors(interrupted: DataFrame) -> DataFrame:
    """A queue that was not walked to its end may hide files, which is material."""
    return interrupted.select(
        "host_id",
        F.lit("queue").alias("detector"),
        F.lit("timeout").alias("kind"),
        F.col("queue").alias("path"),
        "message",
        F.lit(True).alias("material"),
    ).distinct()


def host_report(hosts, findings, errors, ledger, secrets, versions, *artifacts) -> DataFrame:
    """One row per host: verdict, presence, counts by severity, tallies, needed actions."""
    return (
        R.verdicts(hosts, findings, errors)
        .join(R.presence(hosts, ledger, versions, findings, *artifacts), "host_id")
        .join(R.severity_counts(findings), "host_id", "left")
        .join(R.found_tally(hosts, ledger, G.secret_totals(secrets)), "host_id")
        .join(R.needed_actions(hosts, ledger, secrets, findings), "host_id")
        .fillna(0, ["info", "low", "medium", "high", "critical"])
    )
