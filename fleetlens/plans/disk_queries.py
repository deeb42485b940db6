"""Queries over file evidence: inventory, queues, binaries, versions."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import filekind as K
from fleetlens.functions import text as T
from fleetlens.functions import versions as X
from fleetlens.functions.binding import bind
from fleetlens.functions.paths import display_path, under_dir
from fleetlens.operators import disk as D
from fleetlens.operators import version_evidence as W
from fleetlens.plans import evidence as V
from fleetlens.plans.catalog import known, long, query
from fleetlens.session import materialize, shared_dir
from fleetlens.sources import files as S
from fleetlens.sources.logs import discover_logs as find_logs
from fleetlens.spec import DEFAULT_SPEC as SPEC

INVENTORY_SQL = f"""inventory AS ({V.as_sql(V.FILE_INVENTORY)}),
homes AS (SELECT DISTINCT host_id, path AS home FROM inventory WHERE t_k IN (0, 16)
  UNION SELECT DISTINCT host_id, '/home/u/.grok' FROM inventory),
queues AS (SELECT DISTINCT host_id, path AS queue, t_k = 1 AS walked FROM inventory WHERE t_k IN (1, 18)),
queue_files AS (SELECT DISTINCT i.host_id, q.queue, i.path, i.name, i.size, i.t_k FROM inventory i
  JOIN queues q ON i.host_id = q.host_id AND q.walked AND i.t_k IN (2, 3)),
staged AS (SELECT host_id, path, max(size) AS size FROM inventory WHERE t_k IN (3, 4)
  GROUP BY host_id, path)"""

_EXECUTABLE = "t_head IN ('7F454C46', 'CFFAEDFE', '4D5A9000', '4D5A')"
CANDIDATES_SQL = f"""candidates AS (SELECT DISTINCT host_id, path, size, CASE
    WHEN t_head = '7F454C46' THEN 'elf' WHEN t_head = 'CFFAEDFE' THEN 'mach-o'
    WHEN t_head LIKE '4D5A%' THEN 'pe' WHEN t_head = '23212F62' THEN 'script'
    WHEN t_k IN (6, 10, 11) THEN 'script' ELSE 'none' END AS kind
  FROM inventory WHERE is_regular AND size > 0
    AND (t_k IN (5, 6, 10, 11) OR (t_k = 15 AND t_head <> '00000000')))"""

CONTENT_SQL = f"file_content AS ({V.as_sql(V.FILE_CONTENT)})"
_MARKERS_SQL = " UNION ALL ".join(
    f"SELECT host_id, path, t_kind, t_text, '{m}' AS marker, "
    f"cast(strlen(substr(t_text, 1, position('{m}' IN t_text) - 1)) AS bigint) AS \"offset\" "
    f"FROM file_content WHERE contains(t_text, '{m}')"
    for m in SPEC.markers
)

CLASS_OF = """CASE WHEN NOT regexp_matches(version, '^v?[0-9]+[.][0-9]+[.][0-9]+([-+].+)?$') THEN 'UNKNOWN'
  WHEN regexp_matches(version, '^v?0[.]2[.]93([-+].+)?$') THEN 'CONFIRMED_AFFECTED'
  WHEN regexp_matches(version, '^v?0[.]2[.][0-9]{1,2}([-+].+)?$') THEN 'REPORTED_AFFECTED'
  WHEN regexp_matches(version, '^v?0[.][01][.]') THEN 'REPORTED_AFFECTED' ELSE 'UNKNOWN' END"""

VERSIONS_SQL = f"""version_files AS ({V.as_sql(V.VERSION_TEXTS)}),
manifest_versions AS (SELECT DISTINCT host_id, t_version AS version, 'high' AS confidence,
    'manifest:' || regexp_extract(path, '[^/]+$') AS source, path
  FROM version_files WHERE t_k IN (0, 2, 3, 6, 7)),
versions AS (SELECT *, {CLASS_OF} AS class FROM manifest_versions)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What filters ask for is made once a row, and not before the rows are dealt out."""
    files = V.project(spark, sf_dir, V.FILE_INVENTORY)
    return bind(files, {c: F.col(c) for c in ("path", "name", "is_dir", "is_regular")}).select(
        "host_id", "path", "name", "is_dir", "is_regular", "size", "head4"
    )


def stored_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as a written table, for queries that read it several times."""
    return materialize(inventory(spark, sf_dir), "inventory")


def hosts(inv: DataFrame) -> DataFrame:
    return inv.select("host_id", F.lit("/home/u/.grok").alias("home")).distinct()


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.project(spark, sf_dir, V.FILE_CONTENT).select(
        "host_id", "path", F.col("t_kind").alias("kind"),
        F.encode("t_text", "UTF-8").alias("content"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is put together once, whatever asks for it."""
    return bind(
        V.project(spark, sf_dir, V.MANIFESTS).select("host_id", "path", "name", "text"), {"text": F.col("text")}
    )


def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.project(spark, sf_dir, V.PATH_LOOKUP)


def manifest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.project(spark, sf_dir, V.VERSION_TEXTS).select("host_id", "path", "text")
    return W.dedupe_versions(W.versions_from_manifests(files))


@query(
    "S1",
    f"""WITH {INVENTORY_SQL}
    SELECT DISTINCT host_id, path FROM inventory WHERE t_k IN (12, 13) AND NOT is_dir""",
)
def discover_logs(spark, sf_dir):
    inv = stored_inventory(spark, sf_dir)
    return find_logs(inv, D.discovered_homes(inv, hosts(inv)))


@query(
    "S5 S6",
    """SELECT cast(doc_id % 16 AS bigint) AS bucket, cast(sum(strlen(text) + 1) AS bigint) AS bytes,
      true AS capped FROM documents GROUP BY 1""",
)
def read_file_inventory(spark, sf_dir):
    """Documents written as text files, then listed and read back with a cap."""
    out = f"{shared_dir(spark)}/fleetlens/files-{uuid.uuid4().hex}"
    docs = V.table(spark, sf_dir, "documents")
    docs.select("text", (F.col("doc_id") % 16).alias("bucket")).write.partitionBy("bucket").text(out)
    bucket = F.regexp_extract("path", r"/bucket=(\d+)/[^/]*$", 1).cast("bigint").alias("bucket")
    walked = S.read_file_inventory(spark, out, F.lit("host")).filter(r"is_regular AND name NOT RLIKE '^[._]'")
    listed = walked.groupBy(bucket).agg(
        F.sum("size").alias("bytes")
    )
    capped = S.read_capped_content(spark, out, 500).groupBy(bucket).agg(
        F.bool_and(F.octet_length("content") == F.least("size", F.lit(500))).alias("capped")
    )
    return listed.join(capped, "bucket")


@query(
    "S5 P30",
    """SELECT cast(floor(doc_id / 100) AS bigint) AS bucket, CASE cast(floor(doc_id / 100) AS bigint) % 4 WHEN 0 THEN 'elf' WHEN 1 THEN 'pe'
        WHEN 2 THEN 'script' ELSE 'none' END AS kind, cast(1 AS bigint) AS dirs, cast(sum(strlen(text) + 5) AS bigint) AS bytes
    FROM documents GROUP BY ALL""",
)
def walked_heads(spark, sf_dir):
    """Documents written a hundred to a folder, below a hidden one and under four kinds of first bytes, then
    walked and told apart."""
    out = f"{shared_dir(spark)}/fleetlens/tree-{uuid.uuid4().hex}"
    bucket = F.floor(F.col("doc_id") / 100)
    head = F.element_at(F.array(*map(F.lit, ("\x7fELF", "MZ..", "#!sh", "text"))), (bucket % 4 + 1).cast("int"))
    docs = V.table(spark, sf_dir, "documents").select(F.concat(head, "text").alias("text"), bucket.alias("bucket"))
    docs.repartition("bucket").write.partitionBy("bucket").text(f"{out}/.home")
    walked = S.read_file_inventory(spark, out, F.lit("host"), rounds=1)
    files = walked.filter("is_regular AND name LIKE 'part-%'").withColumn("dir", F.regexp_extract("path", "^(.*)/", 1))
    dirs = walked.filter("is_dir").select("host_id", F.col("path").alias("dir"))
    return (
        files.join(dirs, ["host_id", "dir"])
        .groupBy(F.regexp_extract("dir", r"=(\d+)$", 1).cast("bigint").alias("bucket"))
        .agg(
            F.max(K.file_kind(F.col("head4"), F.regexp_replace("path", r"\.txt$", ""))).alias("kind"),
            F.count_distinct("dir").alias("dirs"),
            F.sum("size").alias("bytes"),
        )
    )


@query(
    "S11",
    f"""WITH m AS ({V.as_sql(V.MANIFESTS)})
    SELECT host_id, path FROM m WHERE name IN ('metadata.json', 'Metadata.json')
      AND contains(text, 'grok-code-session-traces')""",
)
def manifest_scan(spark, sf_dir):
    return S.manifest_scan(manifests(spark, sf_dir))


@query(
    "P36 P45",
    f"""WITH {INVENTORY_SQL}
    SELECT coalesce(CASE WHEN t_k IN (1, 18) THEN 'queue' WHEN t_k IN (0, 16) THEN 'home'
        WHEN t_k IN (3, 4) THEN 'archive' WHEN t_k = 2 THEN 'manifest' END, '') AS class,
      t_k IN (1, 2, 3, 17, 18) AS under_queue, count(*) AS n FROM inventory GROUP BY ALL""",
)
def structural_classes(spark, sf_dir):
    return (
        inventory(spark, sf_dir)
        .groupBy(
            known(K.structural_class(F.col("name"), F.col("is_dir"), SPEC), "class", ""),
            under_dir(F.col("path"), SPEC.queue_dir).alias("under_queue"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "P30 P31 P32 P34",
    f"""WITH {INVENTORY_SQL}, {CANDIDATES_SQL}
    SELECT *, kind IN ('elf', 'mach-o', 'pe') OR size >= 524288 AS install FROM candidates""",
)
def scan_candidates(spark, sf_dir):
    return D.scan_candidates(inventory(spark, sf_dir)).withColumn(
        "install", K.is_install(F.col("kind"), F.col("size"), SPEC)
    )


@query("P33 T7", f"WITH {CONTENT_SQL} SELECT host_id, path, marker, \"offset\" FROM ({_MARKERS_SQL}) AS m")
def marker_scan(spark, sf_dir):
    return D.marker_scan(contents(spark, sf_dir).drop("kind"))


@query(
    "P33 (chunks)",
    f"WITH {CONTENT_SQL} SELECT host_id, path, marker, \"offset\" FROM ({_MARKERS_SQL}) AS m",
)
def marker_scan_chunks(spark, sf_dir):
    """The same contents cut into overlapping pieces of 512 bytes."""
    overlap = max(map(len, SPEC.markers)) - 1
    whole = contents(spark, sf_dir).drop("kind")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("content") - 1, F.lit(0)), F.lit(512))
    pieces = whole.withColumn("start", F.explode(starts)).withColumn(
        "content", F.substring(F.col("content"), F.col("start") + 1, F.lit(512 + overlap))
    )
    return D.marker_scan_chunks(pieces)


@query(
    "P33 P34 P35 J14",
    f"""WITH {CONTENT_SQL}
    SELECT host_id, path, marker, "offset", sha256(t_text) AS sha256,
      t_kind IN ('elf') OR strlen(t_text) >= 524288 AS install FROM ({_MARKERS_SQL}) AS m""",
)
def marked_files(spark, sf_dir):
    found = contents(spark, sf_dir)
    candidates = found.select(
        "host_id", "path", "kind", F.octet_length("content").cast("bigint").alias("size")
    )
    return D.marked_files(candidates, found.drop("kind")).drop("kind", "size")


@query(
    "A22 J12",
    f"""WITH {CONTENT_SQL}, marked AS ({_MARKERS_SQL}),
    installs AS (SELECT * FROM marked WHERE t_kind = 'elf'),
    picked AS (SELECT host_id, arg_min(path, t_id) AS entry FROM file_content GROUP BY host_id)
    SELECT i.host_id, i.path, count(DISTINCT marker) AS markers,
      CASE WHEN bool_or(marker = 'grok-code-session-traces') THEN 'grok-code-session-traces'
        ELSE arg_min(marker, "offset") END AS sample_marker,
      CASE WHEN any_value(p.entry) = i.path THEN i.path ELSE '' END AS path_entry
    FROM installs i JOIN picked p ON p.host_id = i.host_id GROUP BY i.host_id, i.path""",
)
def binaries_rollup(spark, sf_dir):
    found = V.project(spark, sf_dir, V.FILE_CONTENT)
    files = contents(spark, sf_dir)
    candidates = files.select("host_id", "path", "kind", F.lit(100).cast("bigint").alias("size"))
    marked = D.marked_files(candidates, files.drop("kind"))
    lookup = found.select(
        "host_id", F.col("t_id").alias("ord"), F.col("path").alias("entry"),
        F.concat(F.lit("/elsewhere"), F.col("path")).alias("resolved"),
    )
    active = D.active_install(marked.filter("install"), lookup)
    return D.binaries_rollup(marked, active).drop("size")


@query(
    "J12",
    f"""WITH {INVENTORY_SQL}, lookup AS ({V.as_sql(V.PATH_LOOKUP)}),
    first AS (SELECT host_id, arg_min(entry, ord) AS entry, arg_min(resolved, ord) AS resolved
      FROM lookup GROUP BY host_id),
    installs AS (SELECT DISTINCT host_id, path FROM inventory WHERE t_k = 5)
    SELECT i.host_id, min(i.path) AS path, min(f.entry) AS path_entry FROM installs i JOIN first f
      ON f.host_id = i.host_id AND (i.path = f.entry
        OR i.path = replace(replace(f.resolved, '//', '/'), '/./', '/'))
    GROUP BY i.host_id""",
)
def active_install(spark, sf_dir):
    installs = inventory(spark, sf_dir).filter(K.is_product_binary(F.col("path"), SPEC))
    return D.active_install(installs, path_lookup(spark, sf_dir))


@query(
    "J11",
    f"WITH {INVENTORY_SQL} SELECT host_id, home FROM homes WHERE home <> '/home/u/.grok'",
)
def stray_homes(spark, sf_dir):
    inv = stored_inventory(spark, sf_dir)
    configured = hosts(inv)
    return D.stray_homes(D.discovered_homes(inv, configured), configured)


def queues(inv: DataFrame) -> DataFrame:
    """Queues of the configured homes are walked here; the strays are only named."""
    return D.upload_queues(inv, hosts(inv))


@query(
    "A14 P41",
    f"""WITH {INVENTORY_SQL}, counted AS (
      SELECT q.host_id, q.queue, q.walked, count(f.path) AS files,
        cast(coalesce(sum(f.size), 0) AS bigint) AS bytes
      FROM queues q LEFT JOIN queue_files f ON f.host_id = q.host_id AND f.queue = q.queue GROUP BY ALL)
    SELECT *, false AS truncated, CASE WHEN bytes < 1024 THEN cast(bytes AS varchar) || ' B'
      WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0)
      WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576.0)
      ELSE printf('%.1f GB', bytes / 1073741824.0) END AS shown FROM counted""",
)
def queue_inventory(spark, sf_dir):
    inv = stored_inventory(spark, sf_dir)
    q = queues(inv)
    files = D.files_in_queues(inv, q)
    return D.queue_inventory(q, files).withColumn("shown", T.human_bytes(F.col("bytes")))


@query("O4 W8", f"WITH {INVENTORY_SQL} SELECT * FROM staged")
def staged_archives(spark, sf_dir):
    inv = stored_inventory(spark, sf_dir)
    return D.staged_archives(inv, D.files_in_queues(inv, queues(inv)))


@query(
    "W4 P35",
    f"""WITH {INVENTORY_SQL}
    SELECT host_id, path, size, CASE WHEN size % 3 > 0 THEN sha256(path || '!') ELSE '' END AS sha256
    FROM staged""",
)
def hash_archives(spark, sf_dir):
    inv = stored_inventory(spark, sf_dir)
    archives = D.staged_archives(inv, D.files_in_queues(inv, queues(inv)))
    bodies = archives.filter("size % 3 > 0").select(
        "host_id", "path", F.encode(F.concat("path", F.lit("!")), "UTF-8").alias("content")
    )
    hashed, _ = D.hash_archives(archives, bodies)
    return hashed.fillna("", ["sha256"])


@query(
    "P47",
    f"""WITH m AS ({V.as_sql(V.MANIFESTS)}), valid AS (SELECT * FROM m
      WHERE name IN ('metadata.json', 'Metadata.json') AND t_id % 10 <> 9)
    SELECT DISTINCT host_id, path FROM (
      SELECT host_id, '/home/u/src/repo' || cast(t_id % 300 AS varchar) || '/src/a.py' AS path FROM valid
      UNION ALL SELECT host_id, '/home/u/src/repo' || cast((t_id * 3) % 300 AS varchar) || '/b.txt' FROM valid
      UNION ALL SELECT host_id, 'rel/c' FROM valid UNION ALL SELECT host_id, 'a"b' FROM valid
      UNION ALL SELECT host_id, CASE WHEN contains(text, 'grok-code') THEN 'gs://grok-code-session-traces/x'
        ELSE 'gs://elsewhere/x' END FROM valid) AS p""",
)
def manifest_paths(spark, sf_dir):
    return D.manifest_paths(manifests(spark, sf_dir))


@query(
    "J8 J15",
    f"""WITH {INVENTORY_SQL}, m AS ({V.as_sql(V.MANIFESTS)}),
    repos AS (SELECT DISTINCT host_id, replace(path, '/.git', '') AS repo_path FROM inventory WHERE t_k = 7),
    named AS (SELECT DISTINCT host_id, p || s AS path, p AS repo_path FROM (
      SELECT host_id, '/home/u/src/repo' || cast(t_id % 300 AS varchar) AS p, '/src/a.py' AS s FROM m
        WHERE name IN ('metadata.json', 'Metadata.json') AND t_id % 10 <> 9
      UNION ALL SELECT host_id, '/home/u/src/repo' || cast((t_id * 3) % 300 AS varchar), '/b.txt' FROM m
        WHERE name IN ('metadata.json', 'Metadata.json') AND t_id % 10 <> 9) AS u)
    SELECT n.host_id, n.path, n.repo_path FROM named n JOIN repos r
      ON r.host_id = n.host_id AND r.repo_path = n.repo_path""",
)
def repo_root_of(spark, sf_dir):
    return repo_roots(spark, sf_dir, inventory(spark, sf_dir))


def repo_roots(spark: SparkSession, sf_dir: str, inv: DataFrame) -> DataFrame:
    """The repositories that staged manifests name, of an inventory."""
    repos = materialize(D.git_repositories(inv), "git_repositories")
    return D.repo_root_of(D.manifest_paths(manifests(spark, sf_dir)), repos)


@query(
    "J9",
    f"""WITH {INVENTORY_SQL}, asked AS (SELECT DISTINCT host_id,
        '/home/u/src/repo' || cast(t_id % 300 AS varchar) AS repo_path FROM inventory)
    SELECT a.host_id, a.repo_path, coalesce(bool_or(i.t_k = 19), false) AS on_disk,
      coalesce(bool_or(i.t_k = 19) AND bool_or(i.t_k = 7), false) AS is_git_repo
    FROM asked a LEFT JOIN inventory i ON i.host_id = a.host_id AND i.t_k IN (7, 19)
      AND replace(i.path, '/.git', '') = a.repo_path GROUP BY ALL""",
)
def repos_on_disk(spark, sf_dir):
    asked = V.project(spark, sf_dir, V.FILE_INVENTORY).select(
        "host_id",
        F.concat(F.lit("/home/u/src/repo"), (F.col("t_id") % 300).cast("string")).alias("repo_path"),
    )
    return D.repos_on_disk(asked.distinct(), stored_inventory(spark, sf_dir))


@query(
    "J13",
    f"""WITH {INVENTORY_SQL}
    SELECT DISTINCT b.host_id, b.path AS binary, p.path FROM inventory b JOIN inventory p
      ON p.host_id = b.host_id AND b.t_k = 6 AND p.t_k = 9 AND NOT p.is_dir
      AND p.path = '/opt/tool' || cast(b.t_id % 400 AS varchar) || '/package.json'""",
)
def package_manifest_near(spark, sf_dir):
    inv = stored_inventory(spark, sf_dir)
    return D.package_manifest_near(inv.filter(F.col("name") == "app"), inv)


@query(
    "P40",
    f"""WITH {INVENTORY_SQL}
    SELECT path, CASE WHEN path LIKE '/home/u/%' THEN '~' || substr(path, 8) ELSE path END AS shown,
      count(*) AS n FROM inventory GROUP BY path""",
)
def display_paths(spark, sf_dir):
    return (
        inventory(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        .select("path", display_path(F.col("path"), F.lit("/home/u")).alias("shown"), "n")
    )


@query(
    "P14 P15",
    f"""WITH version_files AS ({V.as_sql(V.VERSION_TEXTS)})
    SELECT t_id, version, {CLASS_OF} AS class,
      regexp_matches(version, '^v?[0-9]+[.][0-9]+[.][0-9]+([-+].+)?$') AS plausible
    FROM (SELECT t_id, t_version || CASE WHEN t_id % 13 = 0 THEN '.x' ELSE '' END AS version
      FROM version_files) AS v""",
)
def classify_versions(spark, sf_dir):
    v = F.concat("t_version", F.when(F.col("t_id") % 13 == 0, ".x").otherwise(""))
    return (
        V.project(spark, sf_dir, V.VERSION_TEXTS).select("t_id", v.alias("version"))
        .select(
            "t_id", "version", X.classify_version(F.col("version"), SPEC).alias("class"),
            X.plausible_version(F.col("version")).alias("plausible"),
        )
    )


@query("P16 W8", f"WITH {VERSIONS_SQL} SELECT * FROM versions")
def versions_from_manifests(spark, sf_dir):
    return manifest_versions(spark, sf_dir)


@query(
    "P17",
    f"""WITH {CONTENT_SQL}
    SELECT host_id, path, '0.2.' || cast(t_id % 130 AS varchar) || '_1' AS version, 'UNKNOWN' AS class
    FROM file_content WHERE t_id % 4 = 2""",
)
def versions_from_install_paths(spark, sf_dir):
    return W.versions_from_install_paths(contents(spark, sf_dir)).select(
        "host_id", "path", "version", "class"
    )


@query(
    "P18 U3",
    f"""WITH {CONTENT_SQL}, named AS (
      SELECT host_id, path, '0.2.' || cast(t_id % 110 AS varchar) AS version FROM file_content WHERE t_id % 6 = 1
      UNION ALL SELECT host_id, path, '1.4.2' FROM file_content WHERE t_id % 6 = 1
      UNION ALL SELECT host_id, path, '0.2.93' FROM file_content WHERE t_id % 6 = 2
      UNION ALL SELECT host_id, path, '0.1.7' FROM file_content WHERE t_id % 6 = 2)
    SELECT *, 'low' AS confidence, {CLASS_OF} AS class FROM named""",
)
def versions_from_binaries(spark, sf_dir):
    return W.versions_from_binaries(contents(spark, sf_dir)).select(
        "host_id", "path", "version", "confidence", "class"
    )


@query(
    "P18 U3 (pieces)",
    f"""WITH {CONTENT_SQL}, named AS (
      SELECT host_id, path, '0.2.' || cast(t_id % 110 AS varchar) AS version FROM file_content WHERE t_id % 6 = 1
      UNION ALL SELECT host_id, path, '1.4.2' FROM file_content WHERE t_id % 6 = 1
      UNION ALL SELECT host_id, path, '0.2.93' FROM file_content WHERE t_id % 6 = 2
      UNION ALL SELECT host_id, path, '0.1.7' FROM file_content WHERE t_id % 6 = 2)
    SELECT DISTINCT *, 'low' AS confidence, {CLASS_OF} AS class FROM named""",
)
def versions_from_pieces(spark, sf_dir):
    """The same contents in pieces of 512 bytes with two in common, so that runs and versions cross borders."""
    whole = contents(spark, sf_dir).select("host_id", "path", "content")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("content") - 1, F.lit(0)), F.lit(512))
    pieces = whole.withColumn("start", F.explode(starts)).withColumn(
        "content", F.substring(F.col("content"), F.col("start") + 1, F.lit(514))
    )
    return W.versions_from_chunks(pieces).select("host_id", "path", "version", "confidence", "class")


@query(
    "T6",
    f"""WITH {VERSIONS_SQL}
    SELECT host_id, version, path, row_number() OVER (PARTITION BY host_id ORDER BY version, source, path) AS place
    FROM versions""",
)
def version_places(spark, sf_dir):
    """All of one confidence here, so by version."""
    return W.version_order(W.dedupe_versions(manifest_versions(spark, sf_dir))).select("host_id", "version", "path", "place")


@query(
    "A28 T6",
    f"""WITH {VERSIONS_SQL} SELECT DISTINCT host_id, class, version FROM versions
    WHERE class <> 'UNKNOWN'""",
)
def version_summary(spark, sf_dir):
    return W.version_summary(manifest_versions(spark, sf_dir))
