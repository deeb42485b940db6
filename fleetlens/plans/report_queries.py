"""Queries over configurations, findings and verdicts."""

from __future__ import annotations

import uuid
from dataclasses import MISSING, fields
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import config_audit as A
from fleetlens.operators import correlate as C
from fleetlens.operators import disk as D
from fleetlens.operators import findings as N
from fleetlens.operators import log_events as L
from fleetlens.operators import triage as G
from fleetlens.operators import verdicts as R
from fleetlens.plans import assess as P
from fleetlens.plans import disk_queries as K
from fleetlens.plans import evidence as V
from fleetlens.plans import log_queries as Q
from fleetlens.plans import secret_queries as Z
from fleetlens.plans.catalog import long, query
from fleetlens.session import materialize, shared_dir, together
from fleetlens.sources.files import manifest_scan
from fleetlens.sources.sinks import write_report_json
from fleetlens.spec import DEFAULT_SPEC as SPEC

# The state each text of the projection should be read as.
CONFIG_SQL = f"""configs AS ({V.as_sql(V.CONFIG_FILES)}),
states AS (SELECT *, home || '/config.toml' AS path,
  CASE WHEN t_k = 9 THEN 'missing' WHEN t_k IN (4, 6, 8, 10) THEN 'uncertain'
    WHEN t_k = 0 THEN 'mitigated' ELSE 'partial' END AS state,
  CASE WHEN t_k IN (0, 2) THEN 'satisfied' WHEN t_k = 1 THEN 'wrong value' ELSE 'absent' END AS flag,
  CASE WHEN t_k IN (0, 5, 7) THEN 'satisfied' WHEN t_k = 2 THEN 'wrong value' ELSE 'absent' END AS trace
  FROM configs),
each_mitigation AS (
  SELECT host_id, path, 'harness.disable_codebase_upload' AS locator, flag AS mitigation FROM states
    WHERE state IN ('mitigated', 'partial')
  UNION ALL SELECT host_id, path, 'telemetry.trace_upload', trace FROM states
    WHERE state IN ('mitigated', 'partial')),
others AS (SELECT host_id, path, CASE t_k WHEN 1 THEN 'harness.k' || cast(nation AS varchar)
    WHEN 7 THEN 'telemetry.agent, telemetry.level' END AS others
  FROM (SELECT s.*, c.c_nationkey AS nation FROM states s
    JOIN customer c ON s.host_id = 'host-' || cast(c.c_custkey AS varchar)) AS n WHERE t_k IN (1, 7))"""


def _finding_sql(fid: str, source: str, instance: str = "''", severity: str | None = None) -> str:
    level, tags = N.FINDINGS[fid]
    return (
        f"SELECT host_id, '{fid}' AS finding_id, {instance} AS instance, "
        f"{severity or repr(level)} AS severity, '{','.join(tags)}' AS tags, "
        f"cast(count(*) AS bigint) AS evidence FROM ({source}) AS s GROUP BY ALL"
    )


_QUEUED = "SELECT host_id, repo_key FROM ledger_status WHERE status IN ('queued', 'delivered')"
_DELIVERED = "SELECT host_id, repo_key FROM ledger_status WHERE status = 'delivered'"
LOG_FINDINGS_SQL = "log_findings AS (" + " UNION ALL ".join(
    [
        # A delivered repository counts even when no archive of it was confirmed by name.
        "SELECT d.host_id, 'logs.upload_confirmed' AS finding_id, '' AS instance, "
        "'critical' AS severity, 'exfil,upload' AS tags, "
        f"(SELECT count(*) FROM archives a SEMI JOIN ({_DELIVERED}) r ON a.host_id = r.host_id "
        f"AND a.repo_key = r.repo_key WHERE a.delivered AND a.host_id = d.host_id) AS evidence "
        f"FROM (SELECT DISTINCT host_id FROM ({_DELIVERED}) AS x) AS d",
        f"SELECT d.host_id, 'logs.archive_enqueued', '', 'high', 'exfil', "
        f"(SELECT count(*) FROM archives a SEMI JOIN ({_QUEUED}) r ON a.host_id = r.host_id "
        f"AND a.repo_key = r.repo_key WHERE a.host_id = d.host_id) "
        f"FROM (SELECT DISTINCT host_id FROM ({_QUEUED}) AS x) AS d",
        _finding_sql("logs.collected_only", "SELECT * FROM ledger_status WHERE status = 'collected_only'"),
        _finding_sql(
            "logs.raw_bucket_reference",
            "SELECT l.host_id FROM lines l WHERE (contains(line, 'grok-code-session-traces') "
            "OR contains(line, 'codebase.tar.gz')) AND l.host_id NOT IN (SELECT host_id FROM "
            f"({_QUEUED}) AS x)",
        ),
        _finding_sql("logs.upload_auth_failure", "SELECT DISTINCT host_id FROM fails"),
        _finding_sql(
            "logs.unknown_upload_event", "SELECT DISTINCT host_id, raw FROM ev WHERE kind = 'unknown_upload'"
        ),
    ]
) + ")"

DISK_FINDINGS_SQL = f"""manifest_rows AS ({V.as_sql(V.MANIFESTS)}),
disk_findings AS (""" + " UNION ALL ".join(
    [
        "SELECT q.host_id, 'queue.present' AS finding_id, q.queue AS instance, CASE WHEN count(f.path) > 0 "
        "THEN 'high' ELSE 'medium' END AS severity, 'staging,exfil' AS tags, cast(1 AS bigint) AS evidence "
        "FROM queues q LEFT JOIN queue_files f ON f.host_id = q.host_id AND f.queue = q.queue "
        "GROUP BY q.host_id, q.queue",
        _finding_sql(
            "queue.metadata_bucket",
            "SELECT host_id FROM manifest_rows WHERE name IN ('metadata.json', 'Metadata.json') "
            "AND contains(text, 'grok-code-session-traces')",
        ),
        _finding_sql("queue.codebase_archive", "SELECT host_id FROM staged"),
        _finding_sql("deepscan.stray_grok_home", "SELECT * FROM homes WHERE home <> '/home/u/.grok'", "home"),
    ]
) + ")"

MARKED_FINDINGS_SQL = f"""marked AS ({K._MARKERS_SQL}),
marked_findings AS (""" + " UNION ALL ".join(
    [
        _finding_sql("deepscan.binary_marker", "SELECT host_id FROM marked WHERE t_kind = 'elf'"),
        _finding_sql(
            "deepscan.file_reference", "SELECT DISTINCT host_id, path FROM marked WHERE t_kind <> 'elf'"
        ),
    ]
) + ")"

CONFIG_FINDINGS_SQL = "config_findings AS (" + " UNION ALL ".join(
    [
        _finding_sql("config.absent", "SELECT * FROM states WHERE state = 'missing'", "path"),
        _finding_sql("config.unparseable", "SELECT * FROM states WHERE state = 'uncertain'", "path"),
        _finding_sql("config.mitigated", "SELECT * FROM states WHERE state = 'mitigated'", "path"),
        _finding_sql(
            "config.explicitly_disabled", "SELECT * FROM each_mitigation WHERE mitigation = 'wrong value'",
            "path || '#' || locator",
        ),
        _finding_sql(
            "config.not_mitigated", "SELECT * FROM each_mitigation WHERE mitigation = 'absent'",
            "path || '#' || locator",
        ),
        _finding_sql("config.other_keys", "SELECT * FROM others", "path"),
    ]
) + ")"

VERSION_FINDINGS_SQL = "version_findings AS (" + " UNION ALL ".join(
    [
        _finding_sql("version.confirmed_affected", "SELECT * FROM versions WHERE class = 'CONFIRMED_AFFECTED'"),
        _finding_sql("version.reported_affected", "SELECT * FROM versions WHERE class = 'REPORTED_AFFECTED'"),
    ]
) + ")"

SECRET_FINDINGS_SQL = "secret_findings AS (" + " UNION ALL ".join(
    [
        _finding_sql("secrets.deleted_from_checkout", "SELECT * FROM secrets WHERE deleted_from_checkout"),
        _finding_sql("secrets.in_head", "SELECT * FROM secrets WHERE NOT deleted_from_checkout"),
    ]
) + ")"

ERRORS_SQL = f"errors AS ({V.as_sql(V.COLLECTOR_ERRORS)})"

# Every finding of every domain, and the hosts anything is known about.
ALL_SQL = f"""{Q.ATTRIBUTED_SQL}, {LOG_FINDINGS_SQL}, {K.INVENTORY_SQL}, {DISK_FINDINGS_SQL},
{K.CONTENT_SQL}, {MARKED_FINDINGS_SQL}, {CONFIG_SQL}, {CONFIG_FINDINGS_SQL},
{K.VERSIONS_SQL}, {VERSION_FINDINGS_SQL}, {Z.SECRETS_SQL}, {SECRET_FINDINGS_SQL}, {ERRORS_SQL},
findings AS (SELECT * FROM log_findings UNION ALL SELECT * FROM disk_findings
  UNION ALL SELECT * FROM marked_findings UNION ALL SELECT * FROM config_findings
  UNION ALL SELECT * FROM version_findings UNION ALL SELECT * FROM secret_findings),
all_hosts AS (SELECT DISTINCT host_id FROM errors UNION SELECT DISTINCT host_id FROM findings)"""

_VERDICT_SQL = """coalesce(CASE WHEN bool_or(f.severity IN ('high', 'critical') AND f.tags LIKE '%upload%')
    THEN 'COMPROMISED' WHEN bool_or(f.severity IN ('medium', 'high', 'critical')) THEN 'EXPOSED' END,
  CASE WHEN any_value(d.degraded) THEN 'INDETERMINATE' ELSE 'CLEAN' END)"""


def config_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.project(spark, sf_dir, V.CONFIG_FILES).withColumn(
        "path", F.concat("home", F.lit("/config.toml"))
    )
    homes = files.select("host_id", "home")
    return A.homes_configs(homes, files.filter("status <> 'missing'"))[0]


def collector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.project(spark, sf_dir, V.COLLECTOR_ERRORS)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = K.contents(spark, sf_dir)
    candidates = files.select("host_id", "path", "kind", F.lit(100).cast("bigint").alias("size"))
    return D.marked_files(candidates, files.drop("kind"))


def log_found(spark, sf_dir) -> N.Found:
    return P.log_findings(materialize(Q.parsed_lines(spark, sf_dir), "parsed"))[0]


def disk_found(spark, sf_dir) -> N.Found:
    inv = K.stored_inventory(spark, sf_dir)
    hosts, queues = K.hosts(inv), K.queues(inv)
    files = materialize(D.files_in_queues(inv, queues), "queue_files")
    return N.union(
        [
            N.queue_present(D.queue_inventory(queues, files)),
            N.metadata_bucket(manifest_scan(K.manifests(spark, sf_dir))),
            N.codebase_archive(D.staged_archives(inv, files)),
            N.stray_home(D.stray_homes(D.discovered_homes(inv, hosts), hosts)),
        ]
    )


def marked_found(spark, sf_dir) -> N.Found:
    hits = materialize(marked(spark, sf_dir), "marked")
    nobody = hits.select("host_id", "path", F.lit("").alias("path_entry")).limit(0)
    return N.union([N.binary_marker(hits, nobody), N.file_reference(hits)])


def config_found(spark, sf_dir) -> N.Found:
    states = materialize(config_states(spark, sf_dir), "states")
    return N.config_findings(states, states.select("host_id"))


def version_found(spark, sf_dir) -> N.Found:
    return N.affected_versions(materialize(K.manifest_versions(spark, sf_dir), "versions"))


def secret_found(spark, sf_dir) -> N.Found:
    return N.secret_findings(materialize(Z.secrets(spark, sf_dir), "secrets"))


def all_found(spark, sf_dir) -> N.Found:
    makers = (log_found, disk_found, marked_found, config_found, version_found, secret_found)
    return N.union(together(spark, [partial(make, spark, sf_dir) for make in makers]))


def summary(found: N.Found) -> DataFrame:
    """Findings with the number of their evidence rows."""
    counts = found.evidence.groupBy(*N.KEYS).agg(F.count(F.lit(1)).alias("evidence"))
    return (
        found.findings.join(counts, N.KEYS, "left")
        .fillna(0, ["evidence"])
        .select(*N.KEYS, "severity", F.array_join("tags", ",").alias("tags"), "evidence")
    )


def hosts_of(errors: DataFrame, findings: DataFrame) -> DataFrame:
    return errors.select("host_id").unionByName(findings.select("host_id")).distinct()


@query(
    "U4 P37 J17",
    f"""WITH {CONFIG_SQL}
    SELECT host_id, path, state = 'missing' AS missing, state = 'uncertain' AS uncertain,
      CASE t_k WHEN 0 THEN 'harness.disable_codebase_upload=true,telemetry.trace_upload=false'
        WHEN 1 THEN 'harness.disable_codebase_upload=false'
        WHEN 2 THEN 'harness.disable_codebase_upload=true,telemetry.trace_upload=true'
        WHEN 5 THEN 'telemetry.trace_upload=false' WHEN 7 THEN 'telemetry.trace_upload=false'
        ELSE '' END AS settings, state AS overall FROM states""",
)
def config_state_of_homes(spark, sf_dir):
    entries = F.transform(
        F.array_sort(F.map_entries(F.coalesce("values", F.expr("cast(map() as map<string,string>)")))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return config_states(spark, sf_dir).select(
        "host_id", "path", "missing", "uncertain", F.array_join(entries, ",").alias("settings"),
        A.overall_state().alias("overall"),
    )


@query("P38", f"WITH {CONFIG_SQL} SELECT * FROM each_mitigation")
def mitigation_status(spark, sf_dir):
    return A.mitigation_status(config_states(spark, sf_dir))


@query("P39", f"WITH {CONFIG_SQL} SELECT * FROM others")
def other_config_keys(spark, sf_dir):
    return A.other_config_keys(config_states(spark, sf_dir)).withColumn(
        "others", F.array_join("others", ", ")
    )


@query(
    "J16",
    f"""WITH {K.INVENTORY_SQL}, lookup AS ({V.as_sql(V.PATH_LOOKUP)}),
    chosen AS (SELECT DISTINCT host_id, CASE WHEN host_id IN (SELECT host_id FROM lookup)
        THEN '/mnt/c' || cast(length(host_id) % 9 AS varchar) || '/.grok' ELSE '' END AS install_home FROM inventory)
    SELECT h.host_id, min(CASE WHEN h.home = c.install_home THEN '0' WHEN h.home = '/home/u/.grok' THEN '1'
        ELSE '3' END || h.home || '/config.toml') AS ranked
    FROM homes h JOIN chosen c ON c.host_id = h.host_id GROUP BY h.host_id""",
)
def active_config(spark, sf_dir):
    inv = K.stored_inventory(spark, sf_dir)
    hosts = K.hosts(inv)
    states = D.discovered_homes(inv, hosts).select(
        "host_id", F.concat("home", F.lit("/config.toml")).alias("path")
    )
    active = K.path_lookup(spark, sf_dir).select("host_id").distinct().select(
        "host_id",
        F.concat(
            F.lit("/mnt/c"), (F.length("host_id") % 9).cast("string"), F.lit("/.grok/bin/grok")
        ).alias("path"),
    )
    chosen = A.active_config(states, active, hosts.withColumn("user_home", F.lit("/home/u")))
    return chosen.select("host_id", F.concat(F.col("rank").cast("string"), "path").alias("ranked"))


@query(
    "J18 F19",
    f"""WITH {K.INVENTORY_SQL}
    SELECT host_id, path, cast(max(size) AS bigint) AS size_bytes FROM (
      SELECT host_id, '/home/u/.grok/auth.json' AS path, size FROM inventory WHERE t_k = 9) AS a
    GROUP BY ALL""",
)
def auth_files(spark, sf_dir):
    """Package files of the inventory seen as credential files of the home."""
    raw = V.project(spark, sf_dir, V.FILE_INVENTORY)
    placed = raw.filter("t_k = 9").select(
        "host_id", F.lit("/home/u/.grok/auth.json").alias("path"), "size"
    )
    inv = K.stored_inventory(spark, sf_dir)
    everything = inv.select("host_id", "path", "size").unionByName(placed)
    homes = D.discovered_homes(inv, K.hosts(inv))
    return N.auth_present(everything, homes).evidence.select("host_id", "path", "size_bytes")


@query("F1 F2 F3 F4 F5 F6", f"WITH {Q.ATTRIBUTED_SQL}, {LOG_FINDINGS_SQL} SELECT * FROM log_findings")
def log_findings(spark, sf_dir):
    return summary(log_found(spark, sf_dir))


@query(
    "F5",
    f"""WITH {Q.ATTRIBUTED_SQL}, flagged AS (SELECT f.host_id, EXISTS (SELECT 1 FROM wins w
        WHERE w.host_id = f.host_id AND f.ts_us BETWEEN w.first_us AND w.end_us) AS inside FROM fails f),
    counts AS (SELECT host_id, count(*) AS total, count(*) FILTER (inside) AS i, count(*) FILTER (NOT inside) AS o
      FROM flagged GROUP BY host_id)
    SELECT host_id, CASE WHEN host_id NOT IN (SELECT host_id FROM wins)
        THEN cast(total AS varchar) || ' refusals on the upload leg, no collected repository to relate them to'
      WHEN i = 0 THEN 'No refusals while archives were queued (' || cast(o AS varchar) || ' outside that time)'
      WHEN o = 0 THEN cast(i AS varchar) || ' refusals on the upload leg, all during collection'
      ELSE cast(total AS varchar) || ' refusals on the upload leg (' || cast(i AS varchar)
        || ' during collection, ' || cast(o AS varchar) || ' outside)' END AS title FROM counts""",
)
def auth_failure_titles(spark, sf_dir):
    events = Q.log_events(spark, sf_dir)
    base = materialize(C.build_ledger(C.attributed_rows(events)), "ledger")
    return N.upload_auth_failure(C.auth_summary(events, base)).findings.select("host_id", "title")


@query("F7 F8 F9 F12", f"WITH {K.INVENTORY_SQL}, {DISK_FINDINGS_SQL} SELECT * FROM disk_findings")
def disk_findings(spark, sf_dir):
    return summary(disk_found(spark, sf_dir))


@query("F10 F11", f"WITH {K.CONTENT_SQL}, {MARKED_FINDINGS_SQL} SELECT * FROM marked_findings")
def marked_findings(spark, sf_dir):
    return summary(marked_found(spark, sf_dir))


@query(
    "F13 F14 F15 F16 F17 F18", f"WITH {CONFIG_SQL}, {CONFIG_FINDINGS_SQL} SELECT * FROM config_findings"
)
def config_findings(spark, sf_dir):
    return summary(config_found(spark, sf_dir))


@query("F20 F21 A17", f"WITH {K.VERSIONS_SQL}, {VERSION_FINDINGS_SQL} SELECT * FROM version_findings")
def version_findings(spark, sf_dir):
    return summary(version_found(spark, sf_dir))


@query("F22 F23", f"WITH {Z.SECRETS_SQL}, {SECRET_FINDINGS_SQL} SELECT * FROM secret_findings")
def secret_findings(spark, sf_dir):
    return summary(secret_found(spark, sf_dir))


@query(
    "A21",
    f"""WITH {CONFIG_SQL}, listed AS (SELECT s.host_id, s.path, s.state,
      (SELECT coalesce(string_agg(locator, ', ' ORDER BY locator), '') FROM each_mitigation e
        WHERE e.host_id = s.host_id AND e.mitigation = 'absent') AS not_set,
      (SELECT coalesce(string_agg(locator, ', ' ORDER BY locator), '') FROM each_mitigation e
        WHERE e.host_id = s.host_id AND e.mitigation = 'wrong value') AS wrong_value FROM states s)
    SELECT host_id, path, state = 'missing' AS absent, state = 'uncertain' AS unparseable,
      state = 'mitigated' AS mitigated, not_set, wrong_value FROM listed""",
)
def config_rollup(spark, sf_dir):
    found = config_found(spark, sf_dir)
    return A.config_rollup(found.findings, found.evidence)


@query(
    "A8 T3",
    f"""WITH {CONFIG_SQL}, {CONFIG_FINDINGS_SQL}
    SELECT host_id, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'low') AS low,
      count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high,
      count(*) FILTER (severity = 'critical') AS critical FROM config_findings GROUP BY host_id""",
)
def severity_counts(spark, sf_dir):
    return R.severity_counts(config_found(spark, sf_dir).findings)


@query(
    "A10",
    f"WITH {ERRORS_SQL} SELECT host_id, bool_or(material) AS degraded FROM errors GROUP BY host_id",
)
def degraded_hosts(spark, sf_dir):
    return R.degraded(collector_errors(spark, sf_dir))


@query(
    "T3",
    f"""WITH {CONFIG_SQL}, {CONFIG_FINDINGS_SQL}
    SELECT host_id, finding_id, instance, row_number() OVER (PARTITION BY host_id ORDER BY
      CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC,
      finding_id, instance) AS place FROM config_findings""",
)
def finding_places(spark, sf_dir):
    return N.findings_order(config_found(spark, sf_dir).findings).select("host_id", "finding_id", "instance", "place")


@query("O1 T3", f"WITH {ALL_SQL} SELECT * FROM findings")
def all_findings(spark, sf_dir):
    return summary(all_found(spark, sf_dir))


@query(
    "A9 A10",
    f"""WITH {ALL_SQL}
    SELECT h.host_id, {_VERDICT_SQL} AS verdict, coalesce(any_value(d.degraded), false) AS degraded
    FROM all_hosts h LEFT JOIN findings f ON f.host_id = h.host_id
    LEFT JOIN (SELECT host_id, bool_or(material) AS degraded FROM errors GROUP BY host_id) d
      ON d.host_id = h.host_id GROUP BY h.host_id""",
)
def host_verdicts(spark, sf_dir):
    findings = materialize(all_found(spark, sf_dir).findings, "findings")
    errors = collector_errors(spark, sf_dir)
    return R.verdicts(hosts_of(errors, findings), findings, errors)


@query(
    "A9 (logs and errors)",
    f"""WITH {Q.ATTRIBUTED_SQL}, {LOG_FINDINGS_SQL}, {ERRORS_SQL},
    all_hosts AS (SELECT DISTINCT host_id FROM errors UNION SELECT host_id FROM log_findings)
    SELECT h.host_id, {_VERDICT_SQL} AS verdict
    FROM all_hosts h LEFT JOIN log_findings f ON f.host_id = h.host_id
    LEFT JOIN (SELECT host_id, bool_or(material) AS degraded FROM errors GROUP BY host_id) d
      ON d.host_id = h.host_id GROUP BY h.host_id""",
)
def log_verdicts(spark, sf_dir):
    findings = log_found(spark, sf_dir).findings
    errors = collector_errors(spark, sf_dir)
    return R.verdicts(hosts_of(errors, findings), findings, errors).drop("degraded")


@query(
    "A20",
    f"""WITH {Q.ATTRIBUTED_SQL}
    SELECT host_id, count(*) FILTER (status = 'delivered') AS delivered,
      cast(coalesce(sum(deliveries_confirmed) FILTER (status = 'delivered'), 0) AS bigint) AS confirmed,
      count(*) FILTER (status IN ('delivered', 'queued')) AS queued,
      count(*) FILTER (status = 'collected_only') AS collected,
      cast(coalesce(sum(archives) FILTER (status IN ('delivered', 'queued')), 0) AS bigint) AS archives,
      count(*) FILTER (status <> 'unknown') AS repos_touched
    FROM ledger_status GROUP BY host_id""",
)
def exfil_facts(spark, sf_dir):
    return R.exfil_facts(Q.ledger(spark, sf_dir))


@query(
    "A26 A27",
    f"""WITH {Q.ATTRIBUTED_SQL}, {Z.SECRETS_SQL}, {CONFIG_SQL}, {CONFIG_FINDINGS_SQL},
    h AS (SELECT DISTINCT host_id FROM configs)
    SELECT h.host_id,
      (SELECT count(*) FROM ledger_status l WHERE l.host_id = h.host_id AND status <> 'unknown') AS repos_touched,
      (SELECT cast(coalesce(sum(archives), 0) AS bigint) FROM ledger_status l WHERE l.host_id = h.host_id) AS archives,
      (SELECT count(*) FROM secrets s WHERE s.host_id = h.host_id) AS credential_paths,
      h.host_id IN (SELECT host_id FROM ledger_status WHERE status <> 'unknown' UNION SELECT host_id FROM secrets)
        AS needs_rotate,
      h.host_id IN (SELECT host_id FROM config_findings WHERE finding_id IN
        ('config.not_mitigated', 'config.absent', 'config.explicitly_disabled', 'config.unparseable'))
        AS needs_mitigate
    FROM h""",
)
def tally_and_actions(spark, sf_dir):
    hosts = V.project(spark, sf_dir, V.CONFIG_FILES).select("host_id").distinct()
    ledger = materialize(Q.ledger(spark, sf_dir), "ledger")
    secrets = materialize(Z.secrets(spark, sf_dir), "secrets")
    findings = config_found(spark, sf_dir).findings
    return R.found_tally(hosts, ledger, G.secret_totals(secrets)).join(
        R.needed_actions(hosts, ledger, secrets, findings), "host_id"
    )


# Hosts on which an install, a queue or a home was found.
PRESENT_SQL = f"""marked AS ({K._MARKERS_SQL}),
present AS (SELECT host_id FROM marked WHERE t_kind = 'elf' UNION SELECT host_id FROM queues
  UNION SELECT host_id FROM inventory WHERE t_k IN (0, 16))"""


def present_hosts(installs: DataFrame, inv: DataFrame) -> DataFrame:
    return A.product_present(installs, K.queues(inv), D.discovered_homes(inv, K.hosts(inv).limit(0)))


@query(
    "J18 F13 F14 F15 F16 F17 F18",
    f"""WITH {K.INVENTORY_SQL}, {K.CONTENT_SQL}, {PRESENT_SQL}, {CONFIG_SQL}, {CONFIG_FINDINGS_SQL}
    SELECT * FROM config_findings WHERE host_id IN (SELECT host_id FROM present)""",
)
def config_findings_where_present(spark, sf_dir):
    """A configuration says something of hosts only that have the product."""
    inv = K.stored_inventory(spark, sf_dir)
    installs = marked(spark, sf_dir).filter("install")
    return summary(N.config_findings(config_states(spark, sf_dir), present_hosts(installs, inv)))


@query(
    "F10 J12",
    f"""WITH {K.CONTENT_SQL}, marked AS ({K._MARKERS_SQL}),
    first AS (SELECT host_id, arg_min(path, t_id) AS entry FROM file_content GROUP BY host_id)
    SELECT m.host_id, m.path, 'contains marker ' || marker AS note,
      CASE WHEN f.entry = m.path THEN m.path ELSE '' END AS path_entry
    FROM marked m JOIN first f ON f.host_id = m.host_id WHERE t_kind = 'elf'""",
)
def marked_evidence(spark, sf_dir):
    """What speaks for each executable, and whether it is the one that the search path finds."""
    hits = materialize(marked(spark, sf_dir), "marked")
    lookup = V.project(spark, sf_dir, V.FILE_CONTENT).select(
        "host_id", F.col("t_id").alias("ord"), F.col("path").alias("entry"), F.col("path").alias("resolved")
    )
    found = N.binary_marker(hits, D.active_install(hits.filter("install"), lookup))
    return found.evidence.select("host_id", "path", "note", F.coalesce("path_entry", F.lit("")).alias("path_entry"))


@query(
    "A11",
    f"""WITH {Q.ATTRIBUTED_SQL}, {K.VERSIONS_SQL}, {K.INVENTORY_SQL}, {K.CONTENT_SQL}, {PRESENT_SQL}, {ERRORS_SQL},
    m AS ({V.as_sql(V.MANIFESTS)}), seen AS (SELECT host_id FROM ledger UNION SELECT host_id FROM versions
      UNION SELECT host_id FROM present UNION SELECT host_id FROM staged
      UNION SELECT m.host_id FROM m JOIN inventory i ON i.host_id = m.host_id AND i.t_k = 7
        AND i.path IN ('/home/u/src/repo' || cast(m.t_id % 300 AS varchar) || '/.git',
          '/home/u/src/repo' || cast((m.t_id * 3) % 300 AS varchar) || '/.git')
        WHERE m.name IN ('metadata.json', 'Metadata.json') AND m.t_id % 10 <> 9)
    SELECT DISTINCT e.host_id, e.host_id IN (SELECT host_id FROM seen) AS product_present FROM errors e""",
)
def product_presence(spark, sf_dir):
    hosts = collector_errors(spark, sf_dir).select("host_id").distinct()
    inv, hits, ledger = together(
        spark,
        [
            lambda: K.stored_inventory(spark, sf_dir),
            lambda: materialize(marked(spark, sf_dir), "marked"),
            lambda: Q.ledger(spark, sf_dir),
        ],
    )
    queues, installs = K.queues(inv), hits.filter("install")
    found = N.union(
        [
            N.config_findings(config_states(spark, sf_dir), present_hosts(installs, inv)),
            N.binary_marker(hits, D.active_install(installs, K.path_lookup(spark, sf_dir))),
        ]
    )
    return R.presence(
        hosts, ledger, K.manifest_versions(spark, sf_dir), found.findings, installs,
        queues, D.staged_archives(inv, D.files_in_queues(inv, queues)), K.repo_roots(spark, sf_dir, inv),
    )


@query(
    "A25 O2",
    f"""WITH {Q.ATTRIBUTED_SQL}, {K.INVENTORY_SQL}, {K.CANDIDATES_SQL}, {K.VERSIONS_SQL}, {ERRORS_SQL},
    h AS (SELECT DISTINCT host_id FROM errors), {Z.OBJECTS_SQL},
    untriaged AS (SELECT DISTINCT host_id, repo_path FROM ledger WHERE repo_path <> '<unattributed>'
      EXCEPT SELECT host_id, repo_path FROM objects)
    SELECT host_id, 'Only what is still on the host can be seen.' AS limitation FROM h
    UNION SELECT host_id, 'No log files were found; rotated logs leave no trace.' FROM h
      WHERE host_id NOT IN (SELECT host_id FROM lines)
    UNION SELECT host_id, cast(count(*) FILTER (size % 3 = 0) AS varchar) || ' of ' || cast(count(*) AS varchar)
      || ' staged archives were not hashed.' FROM staged GROUP BY host_id HAVING count(*) FILTER (size % 3 = 0) > 0
    UNION SELECT host_id, cast(count(*) AS varchar) || ' affected repositories could not be triaged.'
      FROM untriaged GROUP BY host_id
    UNION SELECT host_id, path || ': only 0 of ' || cast(size AS varchar) || ' bytes were searched for markers.'
      FROM candidates WHERE size > {SPEC.max_candidate_bytes}
    UNION SELECT host_id, 'A version above the reported range is unknown, not clean.' FROM versions
    UNION SELECT host_id, repo_path || ': ' || cast(count(*) AS varchar) || ' blobs were too large to scan by content.'
      FROM objects WHERE obj_type = 'blob' AND size > 3000 GROUP BY host_id, repo_path""",
)
def limitations(spark, sf_dir):
    hosts = collector_errors(spark, sf_dir).select("host_id").distinct()
    git, inv, ledger = together(
        spark, [partial(make, spark, sf_dir) for make in (Z.stored_evidence, K.stored_inventory, Q.ledger)]
    )
    _, oversized = G.blob_filter(Z.blobs(git), Z.SMALL_BLOBS)
    staged = D.staged_archives(inv, D.files_in_queues(inv, K.queues(inv)))
    bodies = staged.filter("size % 3 > 0").select("host_id", "path", F.encode("path", "UTF-8").alias("content"))
    with_logs = Q.log_lines(spark, sf_dir).select("host_id").distinct()
    return R.limitations(
        hosts, hosts.join(with_logs, "host_id", "left_anti"), oversized, D.hash_archives(staged, bodies)[1],
        G.untriaged_repos(ledger, Z.objects(git)),
        K.manifest_versions(spark, sf_dir).select("host_id"),
        D.unscanned_candidates(D.scan_candidates(inv), K.contents(spark, sf_dir)),
    )


@query(
    "W6",
    f"""WITH {ERRORS_SQL}, nth AS (SELECT *, kind = 'permission' AS denial,
        row_number() OVER (PARTITION BY host_id, kind = 'permission' ORDER BY seq) AS n FROM errors),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY
        CASE WHEN NOT denial AND n = 1 THEN 0 WHEN denial THEN 1 ELSE 2 END, seq) AS place,
        count(*) OVER (PARTITION BY host_id) AS total FROM nth)
    SELECT host_id, seq, kind, place, greatest(total - 3, 0) AS omitted FROM ranked WHERE place <= 3""",
)
def error_examples(spark, sf_dir):
    return R.error_examples(collector_errors(spark, sf_dir)).select(
        "host_id", "seq", "kind", long(F.col("place"), "place"), "omitted"
    )


@query(
    "T5 T4",
    f"""WITH {K.INVENTORY_SQL}, ranked AS (SELECT host_id, path,
        row_number() OVER (PARTITION BY host_id ORDER BY path) AS place,
        count(*) OVER (PARTITION BY host_id) AS n FROM staged)
    SELECT host_id, path, place, greatest(n - 10, 0) AS omitted FROM ranked WHERE place <= 10""",
)
def shown_evidence(spark, sf_dir):
    inv = K.stored_inventory(spark, sf_dir)
    found = N.codebase_archive(D.staged_archives(inv, D.files_in_queues(inv, K.queues(inv))))
    return R.shown_evidence(found.evidence).select(
        "host_id", "path", long(F.col("place"), "place"), "omitted"
    )


@query(
    "J10",
    f"""WITH {Q.ATTRIBUTED_SQL}, {Z.OBJECTS_SQL},
    triage AS (SELECT host_id, repo_path, count(*) AS history_objects FROM objects GROUP BY ALL),
    moved AS (SELECT host_id, '/home/u/src/src' || cast(row_number() OVER (PARTITION BY host_id ORDER BY repo_path)
      AS varchar) AS repo_path, status FROM ledger_status)
    SELECT coalesce(m.host_id, t.host_id) AS host_id, coalesce(m.repo_path, t.repo_path) AS repo_path,
      coalesce(m.status, 'unknown') AS status, coalesce(t.history_objects, 0) AS history_objects
    FROM moved m FULL JOIN triage t ON t.host_id = m.host_id AND t.repo_path = m.repo_path""",
)
def merge_triage(spark, sf_dir):
    """Ledger rows renamed so that some meet a triaged repository."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("host_id").orderBy("repo_path"))
    moved = Q.ledger(spark, sf_dir).select(
        "host_id", F.concat(F.lit("/home/u/src/src"), order.cast("string")).alias("repo_path"), "status"
    )
    return G.merge_triage(moved, G.history_objects(Z.objects(Z.git_evidence(spark, sf_dir)))).fillna(
        0, ["history_objects"]
    )


@query(
    "J15",
    f"""WITH {Q.ATTRIBUTED_SQL}, {Z.OBJECTS_SQL}
    SELECT host_id, repo_path FROM ledger WHERE repo_path <> '<unattributed>'
    UNION SELECT host_id, repo_path FROM objects""",
)
def seed_repos(spark, sf_dir):
    return G.seed_repos(Q.ledger(spark, sf_dir), Z.objects(Z.git_evidence(spark, sf_dir)).select(*G.REPO))


def evidence_tables(spark: SparkSession, sf_dir: str) -> P.EvidenceTables:
    """Delivered tables are written ones; each is projected once, however often it is read."""

    def contents() -> tuple[DataFrame, DataFrame]:
        files = materialize(K.contents(spark, sf_dir).select("host_id", "path", "content"), "contents")
        listed = files.select(
            "host_id", "path", F.substring_index("path", "/", -1).alias("name"),
            F.lit(False).alias("is_dir"), F.lit(True).alias("is_regular"),
            F.octet_length("content").cast("bigint").alias("size"), F.unhex(F.lit("7F454C46")).alias("head4"),
        )
        return files, materialize(K.inventory(spark, sf_dir).unionByName(listed), "inventory")

    (files, inventory), git, errors, config, manifests = together(
        spark,
        [
            contents,
            lambda: Z.stored_evidence(spark, sf_dir),
            lambda: materialize(collector_errors(spark, sf_dir), "collector_errors"),
            lambda: materialize(V.project(spark, sf_dir, V.CONFIG_FILES).withColumn(
                "path", F.concat("home", F.lit("/config.toml"))
            ), "configs"),
            lambda: materialize(K.manifests(spark, sf_dir), "manifests"),
        ],
    )
    hosts = (
        errors.select("host_id").unionByName(inventory.select("host_id")).distinct()
        .withColumns({"home": F.lit("/home/u/.grok"), "user_home": F.lit("/home/u")})
    )
    return P.EvidenceTables(
        hosts=hosts,
        log_lines=Q.log_lines(spark, sf_dir),
        file_inventory=inventory,
        file_content=files,
        path_lookup=K.path_lookup(spark, sf_dir),
        config_files=config.filter("status <> 'missing'"),
        manifests=manifests,
        version_files=V.project(spark, sf_dir, V.VERSION_TEXTS).select("host_id", "path", "text"),
        git_objects=Z.objects(git),
        head_tree=Z.head_tree(git),
        blobs=Z.blobs(git),
        collector_errors=errors,
    )


def _extra_detector(ev, spec):
    """One finding per host that has a configuration file."""
    rows = ev.config_files.select("host_id").distinct()
    return N.Found(
        N.finding_rows(rows, "deepscan.file_reference", F.lit("has a configuration"), severity=F.lit("low")),
        N.evidence_rows(rows, "deepscan.file_reference", note=F.lit("from a registered detector")),
    )


def _late_detector(ev, spec):
    """Fails only when its rows are computed."""
    fail = F.raise_error(F.lit("a task failed")).cast("string")
    rows = ev.hosts.withColumn("host_id", F.when(F.col("home") == "", F.col("host_id")).otherwise(fail))
    return N.Found(N.finding_rows(rows, "deepscan.file_reference", F.lit("never")), N.evidence_rows(rows, "deepscan.file_reference"))


@query(
    "U5",
    f"""WITH {CONFIG_SQL}, {ERRORS_SQL}
    SELECT DISTINCT host_id, 'finding' AS kind FROM states WHERE t_k <> 9
    UNION ALL SELECT DISTINCT host_id, 'panic' FROM (SELECT host_id FROM states UNION SELECT host_id FROM errors) AS h""",
)
def registered_detectors(spark, sf_dir):
    """A detector of one's own and one whose task fails: the one is heard, the other is an error of every host."""
    errors = collector_errors(spark, sf_dir)
    config = V.project(spark, sf_dir, V.CONFIG_FILES)
    hosts = config.select("host_id").unionByName(errors.select("host_id")).distinct().withColumn("home", F.lit("/home/u"))
    none = spark.createDataFrame([], "host_id string")
    empty = {f.name: none for f in fields(P.EvidenceTables) if f.default is MISSING}
    ev = P.EvidenceTables(**{**empty, "hosts": hosts, "config_files": config.filter("status <> 'missing'")})
    P.register_detector("extra", _extra_detector)
    P.register_detector("late", _late_detector)
    try:
        found, failures = P._run_detectors(ev, SPEC)
    finally:
        P.unregister_detector("extra")
        P.unregister_detector("late")
    (one,) = found
    return one.findings.select("host_id", F.lit("finding").alias("kind")).unionByName(failures.select("host_id", "kind"))


@query("E1 U5 S10")
def assess_hosts(spark, sf_dir):
    """The whole assessment, written as JSON and read back."""
    report = P.assess(spark, evidence_tables(spark, sf_dir))
    out = f"{shared_dir(spark)}/fleetlens/report-{uuid.uuid4().hex}"
    write_report_json({"host_report": report.host_report}, out)
    return spark.read.json(f"{out}/host_report")
