"""Queries over log evidence: parsing, attribution, ledger, refusals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import events as E
from fleetlens.functions import fields as J
from fleetlens.functions import text as T
from fleetlens.functions.paths import clean_path, normalize_repo
from fleetlens.operators import correlate as C
from fleetlens.operators import log_events as L
from fleetlens.plans import evidence as V
from fleetlens.plans.catalog import known, long, query, us
from fleetlens.session import materialize, shared_dir
from fleetlens.sources import logs as S
from fleetlens.spec import DEFAULT_SPEC as SPEC

# What the lines were made from, as the events they should parse to.
EVENTS_SQL = f"""
lines AS ({V.as_sql(V.LOG_LINES)}),
truth AS (
  SELECT host_id, path, line_no, line, t_form, t_name AS raw, t_sid AS sid,
    CASE WHEN t_form = 2 THEN NULL ELSE t_turn END AS turn,
    t_repo AS repo, t_gcs_path AS gcs_path, t_consumer AS consumer, t_status AS status,
    t_version AS version,
    CASE t_form WHEN 0 THEN epoch_us(ts) WHEN 4 THEN epoch_us(ts) WHEN 5 THEN NULL
      ELSE t_epoch * 1000000 END AS ts_us,
    CASE WHEN t_name = 'repo_state.upload.start' THEN 'start'
      WHEN t_name = 'repo_state.upload.enqueued' THEN 'enqueued'
      WHEN t_name = 'repo_state.upload.completed' THEN 'upload_success'
      WHEN t_consumer LIKE 'Storage%' AND t_status = 204 THEN 'upload_success'
      WHEN t_name LIKE '%repo_state.upload%' THEN 'unknown_upload'
      WHEN t_consumer LIKE 'Storage%' AND t_name LIKE '%401%' THEN 'upload_auth_fail'
      ELSE 'other' END AS kind
  FROM lines WHERE t_form < 6),
ev AS (SELECT * FROM truth WHERE kind <> 'other')
"""

ATTRIBUTED_SQL = (
    EVENTS_SQL
    + """,
starts AS (SELECT * FROM ev WHERE kind = 'start'),
ups AS (SELECT * FROM ev WHERE kind IN ('enqueued', 'unknown_upload', 'upload_success')),
by_turn AS (
  SELECT host_id, sid, turn, repo FROM (
    SELECT *, row_number() OVER (PARTITION BY host_id, sid, turn ORDER BY path, line_no) AS rn
    FROM starts WHERE repo <> '') AS s WHERE rn = 1),
by_sid AS (
  SELECT host_id, sid, repo FROM (
    SELECT *, row_number() OVER (PARTITION BY host_id, sid ORDER BY path DESC, line_no DESC) AS rn
    FROM starts WHERE repo <> '' AND sid <> '') AS s WHERE rn = 1),
attributed AS (
  SELECT u.* EXCLUDE (repo),
    coalesce(t.repo, s.repo, CASE WHEN u.repo <> '' THEN u.repo END, '<unattributed>') AS repo,
    CASE WHEN t.repo IS NOT NULL THEN false WHEN s.repo IS NOT NULL THEN true
         WHEN u.repo <> '' THEN false ELSE true END AS low_confidence
  FROM ups u
  LEFT JOIN by_turn t ON u.host_id = t.host_id AND u.sid = t.sid AND u.turn IS NOT DISTINCT FROM t.turn
  LEFT JOIN by_sid s ON u.host_id = s.host_id AND u.sid = s.sid),
rws AS (
  SELECT *, regexp_replace(repo, '^(/work/team[0-9]+)/.*$', '\\1/app') AS repo_key FROM (
    SELECT host_id, path, line_no, kind, sid, turn, gcs_path, ts_us,
      CASE WHEN repo = '' THEN '<unattributed>' ELSE repo END AS repo, false AS low_confidence
    FROM starts
    UNION ALL
    SELECT host_id, path, line_no, kind, sid, turn, gcs_path, ts_us, repo, low_confidence
    FROM attributed) AS a),
archives AS (
  SELECT r.host_id, r.repo_key, r.gcs_path, r.sid, r.turn, r.ts_us, r.path, r.line_no,
    EXISTS (SELECT 1 FROM rws s WHERE s.kind = 'upload_success' AND s.host_id = r.host_id
            AND s.repo_key = r.repo_key AND s.gcs_path = r.gcs_path AND s.gcs_path <> '') AS delivered
  FROM rws r WHERE kind IN ('enqueued', 'unknown_upload')),
ledger AS (
  SELECT host_id, repo_key,
    arg_min(repo, path || chr(1) || lpad(cast(line_no AS varchar), 12, '0')) AS repo_path,
    count(*) FILTER (kind = 'start') AS collect_attempts,
    count(*) FILTER (kind IN ('enqueued', 'unknown_upload')) AS archives,
    count(*) FILTER (kind = 'upload_success') AS deliveries_confirmed,
    min(ts_us) AS first_us, max(ts_us) AS last_us, bool_or(low_confidence) AS low_confidence,
    min(path || chr(1) || lpad(cast(line_no AS varchar), 12, '0')) FILTER (kind = 'start') AS cited
  FROM rws GROUP BY host_id, repo_key),
ledger_status AS (
  SELECT *, CASE WHEN deliveries_confirmed > 0 THEN 'delivered' WHEN archives > 0 THEN 'queued'
    WHEN collect_attempts > 0 THEN 'collected_only' ELSE 'unknown' END AS status FROM ledger),
fails AS (SELECT host_id, ts_us FROM ev WHERE kind = 'upload_auth_fail'),
wins AS (SELECT host_id, repo_key, first_us, last_us + 3600000000 AS end_us
         FROM ledger WHERE first_us IS NOT NULL)
"""
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.project(spark, sf_dir, V.LOG_LINES).select("host_id", "path", "line_no", "line")


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_log_lines(log_lines(spark, sf_dir))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once and written; what follows reads the typed events several times."""
    return materialize(L.relevant_events(parsed_lines(spark, sf_dir)), "events")


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.attributed_rows(log_events(spark, sf_dir))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.build_ledger(attributed(spark, sf_dir))


@query(
    "S2 P1 P2 P3 P4 P5 P7 P8",
    f"""WITH {EVENTS_SQL}
    SELECT host_id, path, line_no, kind, raw, sid, coalesce(turn, -1) AS turn, repo, gcs_path,
      consumer, cast(status AS bigint) AS status, version, coalesce(ts_us, -1) AS ts_us
    FROM truth""",
)
def parse_log_records(spark, sf_dir):
    return parsed_lines(spark, sf_dir).filter("parsed").select(
        "host_id", "path", "line_no", "kind", "raw", "sid", known("turn", "turn"), "repo",
        "gcs_path", "consumer", "status", "version", us("ts", "ts_us"),
    )


@query(
    "S4",
    f"""WITH {EVENTS_SQL}
    SELECT host_id, path, 'parse' AS kind,
      cast(count(*) FILTER (t_form >= 6) AS varchar) || ' of ' || cast(count(*) AS varchar)
        || ' lines were not valid JSON objects' AS message, true AS material
    FROM lines GROUP BY host_id, path HAVING count(*) FILTER (t_form >= 6) > 0""",
)
def log_parse_errors(spark, sf_dir):
    return S.log_parse_errors(parsed_lines(spark, sf_dir)).drop("detector")


@query(
    "P12",
    f"""WITH {EVENTS_SQL}
    SELECT host_id, path, line_no FROM lines
    WHERE contains(line, 'grok-code-session-traces') OR contains(line, 'codebase.tar.gz')""",
)
def raw_marker_lines(spark, sf_dir):
    return L.raw_hits(parsed_lines(spark, sf_dir))


@query(
    "S2 W1",
    """SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS bigint) AS line_no,
      md5(line) AS line_md5
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) AS s
    WHERE line <> ''""",
)
def log_line_numbers(spark, sf_dir):
    files = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return S.split_log_content(files).select("doc_id", "line_no", F.md5("line").alias("line_md5"))


@query(
    "S2 W1 (files)",
    f"""WITH {EVENTS_SQL}
    SELECT count(*) AS lines, cast(0 AS bigint) AS files_with_gaps,
      cast(sum(length(line)) AS bigint) AS chars FROM lines""",
)
def read_numbered_files(spark, sf_dir):
    """The lines written as text files and read back; every file counts 1..n without gaps."""
    out = f"{shared_dir(spark)}/fleetlens/lines-{uuid.uuid4().hex}"
    log_lines(spark, sf_dir).select("line").write.text(out)
    per_file = S.read_log_lines(spark, out).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"),
        F.sum("line_no").alias("total"), F.sum(F.length("line")).alias("chars"),
    )
    gap = (F.col("last") != F.col("n")) | (F.col("total") * 2 != F.col("n") * (F.col("n") + 1))
    return per_file.agg(
        F.sum("n").alias("lines"), F.count_if(gap).alias("files_with_gaps"),
        F.sum("chars").alias("chars"),
    )


@query(
    "S3 U2",
    """SELECT source, count(*) AS lines, cast(max(n) AS bigint) AS longest_file FROM (
      SELECT source, count(*) OVER (PARTITION BY doc_id) AS n FROM (
        SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS s
      WHERE line <> '') AS t GROUP BY source""",
)
def inflate_logs(spark, sf_dir):
    """Documents gzipped into one file each, then inflated again."""
    @F.pandas_udf("binary")
    def squeeze(texts):
        import gzip

        return texts.map(lambda s: gzip.compress(s.encode(), 1))

    docs = V.table(spark, sf_dir, "documents")
    files = docs.select(
        F.concat("source", F.lit("#"), F.col("doc_id").cast("string")).alias("path"),
        squeeze("text").alias("content"),
    )
    per_file = S.inflate_files(files).filter("line IS NOT NULL").groupBy("path").agg(
        F.max("line_no").alias("n")
    )
    return per_file.groupBy(F.substring_index("path", "#", 1).alias("source")).agg(
        F.sum("n").alias("lines"), F.max("n").alias("longest_file")
    )


@query(
    "P6",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN -1
        WHEN 1 THEN (1704067200 + event_id) * 1000000 WHEN 2 THEN (1704067200000 + event_id) * 1000
        WHEN 3 THEN 1704067200000000 + event_id ELSE (1704067200 + event_id) * 1000000 + 500000 END AS ts_us
    FROM events""",
)
def epoch_magnitudes(spark, sf_dir):
    n = F.col("event_id")
    x = (
        F.when(n % 5 == 0, -n)
        .when(n % 5 == 1, n + 1704067200)
        .when(n % 5 == 2, n + 1704067200000)
        .when(n % 5 == 3, n + 1704067200000000)
        .otherwise(n + 1704067200.5)
        .cast("double")
    )
    return V.table(spark, sf_dir, "events").select("event_id", us(J.epoch_auto(x), "ts_us"))


@query(
    "P9 P10",
    f"""WITH {EVENTS_SQL}
    SELECT raw, consumer, raw = 'repo_state.upload.completed' AS success_name,
      consumer LIKE 'Storage%' AS upload_leg, count(*) AS n FROM truth GROUP BY raw, consumer""",
)
def event_signals(spark, sf_dir):
    return (
        parsed_lines(spark, sf_dir)
        .filter("parsed")
        .groupBy("raw", "consumer")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "raw", "consumer", E.is_success_event(F.col("raw"), SPEC).alias("success_name"),
            E.is_upload_leg(F.col("consumer"), SPEC).alias("upload_leg"), "n",
        )
    )


@query(
    "P11",
    f"""WITH {EVENTS_SQL}
    SELECT gcs_path, CASE WHEN gcs_path LIKE '%before_codebase%' THEN 'before'
      WHEN gcs_path LIKE '%after_codebase%' THEN 'after' ELSE 'unknown' END AS phase,
      count(*) AS n FROM truth GROUP BY gcs_path""",
)
def archive_phases(spark, sf_dir):
    return (
        parsed_lines(spark, sf_dir).filter("parsed").groupBy("gcs_path")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("gcs_path", E.archive_phase(F.col("gcs_path"), SPEC).alias("phase"), "n")
    )


@query(
    "P13",
    """SELECT l_orderkey, l_linenumber,
      CASE l_linenumber % 7 WHEN 6 THEN '<unattributed>' WHEN 5 THEN '/b' WHEN 4 THEN '../rel'
        ELSE CASE WHEN l_orderkey % 2 = 0 THEN '/users/x/repo' ELSE '/Users/X/Repo' END
          || cast(l_partkey % 50 AS varchar) END AS repo_key, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def normalized_repos(spark, sf_dir):
    items = V.table(spark, sf_dir, "lineitem")
    raw = F.expr(
        """CASE l_linenumber % 7 WHEN 0 THEN concat('/Users//X/Repo', l_partkey % 50)
          WHEN 1 THEN concat('/Users/X/./Repo', l_partkey % 50, '/')
          WHEN 2 THEN concat('/Users/X/y/../Repo', l_partkey % 50)
          WHEN 3 THEN concat('/Users/X/Repo', l_partkey % 50, '/z/..')
          WHEN 4 THEN './a/../../rel' WHEN 5 THEN '/../a/../b/' ELSE '<unattributed>' END"""
    )
    return (
        items.select(
            "l_orderkey", "l_linenumber",
            normalize_repo(raw, F.col("l_orderkey") % 2 == 0).alias("repo_key"),
        )
        .groupBy("l_orderkey", "l_linenumber", "repo_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "J1 J2 J3 W2 W3",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT host_id, path, line_no, kind, repo, low_confidence FROM attributed""",
)
def attribute_uploads(spark, sf_dir):
    return C.attribute_uploads(log_events(spark, sf_dir)).select(
        "host_id", "path", "line_no", "kind", "repo", "low_confidence"
    )


@query(
    "A1 A2 A5 W7 P44",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT host_id, repo_key, repo_path, status, collect_attempts, archives, deliveries_confirmed,
      coalesce(first_us, -1) AS first_us, coalesce(last_us, -1) AS last_us, low_confidence,
      coalesce(split_part(cited, chr(1), 1), '') AS log_file,
      coalesce(cast(split_part(cited, chr(1), 2) AS bigint), -1) AS log_line
    FROM ledger_status""",
)
def repo_ledger(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        "host_id", "repo_key", "repo_path", "status", "collect_attempts", "archives",
        "deliveries_confirmed", us("first_seen", "first_us"), us("last_seen", "last_us"),
        "low_confidence", known("log_file", "log_file", ""), known("log_line", "log_line"),
    )


@query(
    "J6 A4 T4",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT host_id, repo_key, gcs_path, sid, coalesce(turn, -1) AS turn, coalesce(ts_us, -1) AS ts_us,
      path AS log_file, line_no AS log_line, delivered
    FROM archives""",
)
def repo_archives(spark, sf_dir):
    return C.repo_archives(attributed(spark, sf_dir)).select(
        "host_id", "repo_key", "gcs_path", "sid", known("turn", "turn"), us("ts", "ts_us"),
        "log_file", "log_line", "delivered",
    )


@query(
    "A4",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT host_id, repo_key, path AS log_file, line_no AS log_line, row_number() OVER (PARTITION BY host_id
      ORDER BY repo_key, ts_us NULLS FIRST, gcs_path, path, line_no) AS place FROM archives""",
)
def archive_places(spark, sf_dir):
    return C.archives_sorted(C.repo_archives(attributed(spark, sf_dir))).select(
        "host_id", "repo_key", "log_file", "log_line", "place"
    )


@query(
    "T1 P44",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT host_id, repo_key, status, row_number() OVER (PARTITION BY host_id ORDER BY
      CASE status WHEN 'delivered' THEN 4 WHEN 'queued' THEN 3 WHEN 'collected_only' THEN 2 ELSE 1 END DESC,
      repo_path, repo_key) AS place FROM ledger_status""",
)
def repo_places(spark, sf_dir):
    return C.ledger_order(ledger(spark, sf_dir)).select("host_id", "repo_key", "status", "place")


@query(
    "A3",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT DISTINCT host_id, repo_key, sid FROM rws WHERE sid <> ''""",
)
def repo_sessions(spark, sf_dir):
    return C.repo_sessions(attributed(spark, sf_dir))


@query(
    "A7",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT host_id, repo_key, count(*) AS total,
      count(DISTINCT CASE WHEN gcs_path <> '' THEN gcs_path END) + count(*) FILTER (gcs_path = '') AS "unique",
      count(*) FILTER (delivered) AS delivered
    FROM archives GROUP BY host_id, repo_key""",
)
def archive_counts(spark, sf_dir):
    return C.archive_counts(C.repo_archives(attributed(spark, sf_dir)))


@query(
    "J4",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT l.host_id, l.repo_key, count(f.ts_us) AS upload_auth_failures
    FROM ledger l LEFT JOIN wins w ON w.host_id = l.host_id AND w.repo_key = l.repo_key
    LEFT JOIN fails f ON f.host_id = w.host_id AND f.ts_us BETWEEN w.first_us AND w.end_us
    GROUP BY l.host_id, l.repo_key""",
)
def auth_failures_in_window(spark, sf_dir):
    events = log_events(spark, sf_dir)
    base = materialize(C.build_ledger(C.attributed_rows(events)), "ledger")
    return C.auth_failures_in_window(base, events).select(
        "host_id", "repo_key", "upload_auth_failures"
    )


@query(
    "J5 A6",
    f"""WITH {ATTRIBUTED_SQL},
    flagged AS (SELECT f.host_id, f.ts_us, EXISTS (SELECT 1 FROM wins w WHERE w.host_id = f.host_id
        AND f.ts_us BETWEEN w.first_us AND w.end_us) AS inside FROM fails f)
    SELECT f.host_id, count(*) AS total, count(*) FILTER (inside) AS in_window,
      count(*) FILTER (NOT inside) AS out_of_window,
      coalesce(min(ts_us), -1) AS first_us, coalesce(max(ts_us), -1) AS last_us,
      (SELECT count(*) FROM wins w WHERE w.host_id = f.host_id) AS windows
    FROM flagged f GROUP BY f.host_id""",
)
def auth_summary(spark, sf_dir):
    events = log_events(spark, sf_dir)
    base = materialize(C.build_ledger(C.attributed_rows(events)), "ledger")
    return C.auth_summary(events, base).select(
        "host_id", "total", "in_window", "out_of_window", us("first_failure", "first_us"),
        us("last_failure", "last_us"), "windows",
    )


@query(
    "A15",
    f"""WITH {EVENTS_SQL} SELECT DISTINCT host_id, raw FROM ev WHERE kind = 'unknown_upload'""",
)
def unknown_event_names(spark, sf_dir):
    return L.unknown_event_names(log_events(spark, sf_dir))


@query(
    "A16",
    f"""WITH {EVENTS_SQL}
    SELECT host_id, version, min(path) AS path, 'high' AS confidence, 'logs' AS source,
      CASE WHEN version = '0.2.93' THEN 'CONFIRMED_AFFECTED'
        WHEN cast(split_part(version, '.', 3) AS int) <= 99 THEN 'REPORTED_AFFECTED'
        ELSE 'UNKNOWN' END AS class
    FROM truth WHERE version <> '' GROUP BY host_id, version""",
)
def versions_from_logs(spark, sf_dir):
    return L.versions_from_logs(parsed_lines(spark, sf_dir))


@query(
    "T1 T2 P44",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT host_id, repo_path, status, archives, place, greatest(n - 10, 0) AS omitted FROM (
      SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY
          CASE status WHEN 'delivered' THEN 4 WHEN 'queued' THEN 3 WHEN 'collected_only' THEN 2 ELSE 1 END DESC,
          archives DESC, repo_path) AS place, count(*) OVER (PARTITION BY host_id) AS n
      FROM ledger_status) AS r WHERE place <= 10""",
)
def top_repos(spark, sf_dir):
    return C.top_repos(ledger(spark, sf_dir)).select(
        "host_id", "repo_path", "status", "archives", long(F.col("place"), "place"), "omitted"
    )


@query(
    "P42 P43",
    f"""WITH {ATTRIBUTED_SQL}
    SELECT host_id, path, line_no,
      concat_ws(', ', CASE WHEN gcs_path LIKE '%before_codebase%' THEN 'before'
          WHEN gcs_path LIKE '%after_codebase%' THEN 'after' ELSE 'unknown' END
          || '-turn archive queued for upload',
        CASE WHEN sid <> '' THEN 'session ' || sid END, 'turn ' || cast(turn AS varchar),
        strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ')) AS note,
      concat_ws('   ', CASE WHEN sid <> '' THEN 'session ' || sid END, 'turn ' || cast(turn AS varchar),
        strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ'),
        path || ':' || cast(line_no AS varchar)) AS provenance
    FROM archives""",
)
def archive_notes(spark, sf_dir):
    a = C.repo_archives(attributed(spark, sf_dir))
    return a.select(
        "host_id", F.col("log_file").alias("path"), F.col("log_line").alias("line_no"),
        T.archive_note(F.col("phase"), F.col("sid"), F.col("turn"), F.col("ts")).alias("note"),
        T.archive_provenance(
            F.col("sid"), F.col("turn"), F.col("ts"), F.col("log_file"), F.col("log_line")
        ).alias("provenance"),
    )


@query(
    "P42",
    f"""WITH {ATTRIBUTED_SQL},
    days AS (SELECT *, strftime(make_timestamp(first_us), '%Y-%m-%d') AS d1,
      strftime(make_timestamp(last_us), '%Y-%m-%d') AS d2 FROM ledger)
    SELECT host_id, repo_key, CASE WHEN d1 IS NULL THEN '-' WHEN d1 = d2 THEN d1
      ELSE d1 || ' -> ' || d2 END AS collected FROM days""",
)
def collected_windows(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        "host_id", "repo_key",
        T.collected_window(F.col("first_seen"), F.col("last_seen")).alias("collected"),
    )
