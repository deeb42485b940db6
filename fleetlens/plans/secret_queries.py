"""Queries over repository evidence: file names, contents, triage."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import secret_paths as P
from fleetlens.functions import text as T
from fleetlens.functions.filekind import looks_binary, sha256_hex
from fleetlens.functions.paths import basename, extension
from fleetlens.operators import disk as D
from fleetlens.operators import triage as G
from fleetlens.operators.secret_scan import scan_contents
from fleetlens.plans import evidence as V
from fleetlens.plans.catalog import query
from fleetlens.session import materialize, shared_dir
from fleetlens.sources.files import read_git_tables as read_exported
from fleetlens.sources.rules import default_rules, rules_table
from fleetlens.spec import DEFAULT_SPEC as SPEC

RULES = default_rules()
SMALL_BLOBS = replace(SPEC, max_blob_bytes=3000)

OBJECTS_SQL = f"objects AS ({V.as_sql(V.GIT_OBJECTS)})"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _union(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _entropy_sql(s: str) -> str:
    n = f"(length({s}) - length(replace({s}, c, '')))"
    return (
        f"coalesce(-list_sum(list_transform(list_distinct(string_split({s}, '')), "
        f"lambda c: ({n} / strlen({s})) * log2({n} / strlen({s})))), 0)"
    )


def _groups(pattern: str) -> int:
    """Capturing groups: opening brackets that are neither escaped, in a class, nor marked ``(?``."""
    bare = re.sub(r"\\.", "", pattern)
    bare = re.sub(r"\[\]?[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)", bare))


def _allowed_sql(allow) -> str:
    """Whether an allowlist hits a match, its path test left out: those are applied on the paths."""
    # No content of the projection holds what the line allowlists look for.
    target = {"match": "match", "line": "''"}.get(allow.target, "secret")
    tests = []
    if allow.regexes:
        tests.append(f"regexp_matches({target}, {_quote(_union(allow.regexes))})")
    if allow.stopwords:
        words = "|".join(re.escape(w) for w in allow.stopwords)
        tests.append(f"regexp_matches(lower(secret), {_quote(words)})")
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def _rule_sql(i: int) -> str:
    """Blobs a rule hits, its path conditions left out."""
    rule = RULES.rules[i]
    numbers = [rule.secret_group] if rule.secret_group else range(1, _groups(rule.regex) + 1)
    regex = _quote(rule.regex)
    columns = [f"unnest(regexp_extract_all(t_content, {regex}, 0)) AS match"]
    columns += [f"unnest(regexp_extract_all(t_content, {regex}, {g})) AS g{g}" for g in numbers]
    secret = "coalesce(" + "".join(f"nullif(g{g}, ''), " for g in numbers) + "match)"
    if rule.secret_group:
        secret = f"g{rule.secret_group}"
    gate = " OR ".join(f"contains(lower(t_content), {_quote(w)})" for w in rule.gate_words) or "true"
    tests = [f"NOT {_allowed_sql(a)}" for a in (RULES.allow, *rule.allow) if not (a.all_of and a.paths)]
    if rule.entropy:
        tests.append(f"{_entropy_sql('secret')} > {rule.entropy}")
    return (
        f"SELECT DISTINCT sha, {i} AS rule_ord, {_quote(rule.id)} AS rule_id FROM ("
        f"SELECT sha, match, {secret} AS secret FROM (SELECT sha, {', '.join(columns)} "
        f"FROM contents WHERE {gate}) AS m) AS n WHERE {' AND '.join(tests)}"
    )


_PATH_RULES = {i: r.path for i, r in enumerate(RULES.rules) if r.path}
_PATH_GUARDS = {
    i: a.paths for i, r in enumerate(RULES.rules) for a in r.allow if a.paths and not a.all_of
}
_PATH_ONLY = [i for i, r in enumerate(RULES.rules) if r.path and not r.regex]

_RAW_HITS_SQL = "\nUNION ALL ".join(_rule_sql(i) for i, r in enumerate(RULES.rules) if r.regex) + "".join(
    f"\nUNION ALL SELECT sha, {i}, {_quote(RULES.rules[i].id)} FROM contents" for i in _PATH_ONLY
)
_PATH_TESTS_SQL = " AND ".join(
    [f"(rule_ord <> {i} OR regexp_matches(path, {_quote(p)}))" for i, p in _PATH_RULES.items()]
    + [
        f"(rule_ord <> {i} OR NOT regexp_matches(path, {_quote(_union(p))}))"
        for i, p in _PATH_GUARDS.items()
    ]
)

HITS_SQL = f"""{OBJECTS_SQL},
contents AS (SELECT DISTINCT sha, t_content FROM objects WHERE obj_type = 'blob'),
firsts AS (SELECT host_id, repo_path, sha, min(seq) AS seq, arg_min(path, seq) AS path FROM objects
  WHERE NOT regexp_matches(path, {_quote(_union(RULES.allow.paths))}) GROUP BY ALL),
scannable AS (SELECT f.* FROM firsts f SEMI JOIN (SELECT * FROM objects WHERE obj_type = 'blob') b
  ON f.host_id = b.host_id AND f.repo_path = b.repo_path AND f.sha = b.sha),
raw_hits AS ({_RAW_HITS_SQL}),
hits AS (SELECT s.host_id, s.repo_path, s.seq, s.path, s.sha AS blob, h.rule_ord, h.rule_id
  FROM scannable s JOIN raw_hits h ON s.sha = h.sha WHERE {_PATH_TESTS_SQL}),
first_hits AS (SELECT host_id, repo_path, path, rule_id, blob FROM (
  SELECT *, row_number() OVER (PARTITION BY host_id, repo_path, path ORDER BY seq, rule_ord) AS rn
  FROM hits) AS r WHERE rn = 1)"""

# The class by file name, told by the projection's own list of names.
CLASS_SQL = """CASE
  WHEN path IN ('.env', 'deploy/.env.latest') THEN 'dotenv'
  WHEN path IN ('keys/ID_RSA', 'tls/server.pem') THEN 'private-key'
  WHEN path IN ('store/app.jks', 'cert/a.p12') THEN 'keystore'
  WHEN path IN ('cfg/credentials.json', 'cfg/service-account-prod.json', '.aws/credentials')
    THEN 'cloud-credential'
  WHEN path = '.npmrc' THEN 'package-registry'
  WHEN path IN ('iac/prod.tfstate', 'iac/terraform.tfvars') THEN 'iac-secret'
  WHEN path = '.kube/config' THEN 'kubeconfig'
  WHEN path IN ('web/.htpasswd', 'conf/app-secrets.yaml') THEN 'generic-secret' ELSE '' END"""

SECRETS_SQL = f"""{HITS_SQL},
history AS (SELECT host_id, repo_path, path, arg_max(sha, seq) AS blob, bool_or(t_in_head) AS in_head,
    {CLASS_SQL} AS class FROM objects WHERE obj_type = 'blob' GROUP BY host_id, repo_path, path),
secrets AS (SELECT h.host_id, h.repo_path, h.path, coalesce(f.rule_id, h.class) AS class,
    coalesce(f.blob, h.blob) AS blob, h.in_head, NOT h.in_head AS deleted_from_checkout
  FROM history h LEFT JOIN first_hits f
    ON h.host_id = f.host_id AND h.repo_path = f.repo_path AND h.path = f.path
  WHERE h.class <> '' OR f.rule_id IS NOT NULL)"""


def git_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.project(spark, sf_dir, V.GIT_OBJECTS)


def stored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table, for queries that read it several times."""
    return materialize(git_evidence(spark, sf_dir), "git")


def objects(raw: DataFrame) -> DataFrame:
    return raw.select(
        "host_id", "repo_path", "seq", "sha", "path", "obj_type", (F.col("seq") % 7 != 0).alias("from_head")
    )


def head_tree(raw: DataFrame) -> DataFrame:
    return raw.filter("t_in_head").select("host_id", "repo_path", "path", "sha")


def blobs(raw: DataFrame) -> DataFrame:
    return raw.select(
        "host_id", "repo_path", "sha", "obj_type", "size",
        F.col("t_content").cast("binary").alias("content"),
    )


def hits(raw: DataFrame) -> DataFrame:
    return G.content_hits(objects(raw), blobs(raw), RULES)


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stored_evidence(spark, sf_dir)
    first = G.content_hits_first(hits(raw))
    return G.secret_hits(objects(raw), head_tree(raw), first)


@query(
    "P19 P20 P21",
    f"""WITH {OBJECTS_SQL}
    SELECT path, {CLASS_SQL} AS class, path = '.env.example' AS template,
      regexp_matches(path, '[.](go|js|md|txt)$') AS code, count(*) AS n
    FROM objects GROUP BY path""",
)
def secret_path_classes(spark, sf_dir):
    p = F.col("path")
    return (
        objects(git_evidence(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "path", P.classify_secret_path(p).alias("class"),
            P.is_template_name(F.lower(basename(p))).alias("template"),
            P.is_code_extension(extension(p)).alias("code"), "n",
        )
    )


@query(
    "P22",
    f"""WITH {OBJECTS_SQL}
    SELECT path, regexp_matches(path, {_quote(_union(RULES.allow.paths))}) AS allowlisted,
      count(*) AS n FROM objects GROUP BY path""",
)
def allowlisted_paths(spark, sf_dir):
    return (
        objects(git_evidence(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        .select("path", P.matches_any(F.col("path"), RULES.allow.paths).alias("allowlisted"), "n")
    )


@query(
    "P23 P35",
    """SELECT page_id, page_id % 3 = 0 AS binary, sha256(html || CASE WHEN page_id % 3 = 0 THEN 'x' ELSE 'y' END) AS sha256
    FROM pages""",
)
def binary_contents(spark, sf_dir):
    page = V.table(spark, sf_dir, "pages")
    nul = F.when(F.col("page_id") % 3 == 0, F.lit("\x00")).otherwise(F.lit(" "))
    head = F.encode(F.concat(F.substring("html", 1, 20), nul, F.col("html")), "UTF-8")
    body = F.encode(
        F.concat("html", F.when(F.col("page_id") % 3 == 0, "x").otherwise("y")), "UTF-8"
    )
    return page.select("page_id", looks_binary(head).alias("binary"), sha256_hex(body).alias("sha256"))


@query(
    "P24",
    "SELECT doc_id, unnest(rules) AS rule_id FROM (SELECT doc_id, list_distinct(flatten(["
    + ", ".join(
        f"CASE WHEN contains(lower(text), {_quote(w)}) THEN ["
        + ", ".join(_quote(r.id) for r in RULES.rules if w in r.gate_words)
        + "] ELSE [] END"
        for w in sorted({w for r in RULES.rules for w in r.gate_words})
    )
    + "])) AS rules FROM documents) AS d",
)
def keyword_rules(spark, sf_dir):
    return G.keyword_rules(V.table(spark, sf_dir, "documents"), RULES, "doc_id")


@query(
    "P26",
    f"""SELECT page_id, cast(round({_entropy_sql('url')}, 6) AS double) AS entropy FROM pages""",
)
def url_entropy(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(
        "page_id", F.round(T.shannon_entropy(F.col("url")), 6).alias("entropy")
    )


@query(
    "S8",
    f"""WITH {OBJECTS_SQL}
    SELECT host_id, repo_path, count(*) FILTER (size <= 3000) AS kept,
      count(*) FILTER (size > 3000) AS oversized
    FROM objects WHERE obj_type = 'blob' GROUP BY host_id, repo_path""",
)
def blob_filter(spark, sf_dir):
    kept, oversized = G.blob_filter(blobs(stored_evidence(spark, sf_dir)), SMALL_BLOBS)
    counts = kept.groupBy(*G.REPO).agg(F.count(F.lit(1)).alias("kept"))
    return counts.join(oversized, G.REPO, "full_outer").fillna(0, ["kept", "oversized"])


@query(
    "A19",
    f"""WITH {HITS_SQL} SELECT host_id, repo_path, sha, seq, path FROM firsts""",
)
def first_path_of_blob(spark, sf_dir):
    return G.first_path_of_blob(objects(git_evidence(spark, sf_dir)), RULES)


@query(
    "U1 P24 P25 P27 P28 P29 J14",
    f"WITH {HITS_SQL} SELECT * FROM hits",
)
def scan_secrets(spark, sf_dir):
    return hits(stored_evidence(spark, sf_dir))


@query(
    "P25 P28 (documents)",
    f"""WITH contents AS (SELECT md5(text) AS sha, text AS t_content FROM documents)
    SELECT sha, rule_id FROM ("""
    + "\nUNION ALL ".join(_rule_sql(i) for i, r in enumerate(RULES.rules) if r.regex)
    + ") AS h",
)
def secrets_in_documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        F.md5("text").alias("sha"), F.col("text").cast("binary").alias("content"),
        F.lit(False).alias("path_only"),
    )
    return G._rule_ids(scan_contents(docs, RULES), RULES).select("sha", "rule_id").distinct()


@query("A18", f"WITH {HITS_SQL} SELECT * FROM first_hits")
def content_hits_first(spark, sf_dir):
    return G.content_hits_first(hits(stored_evidence(spark, sf_dir)))


@query(
    "J7 O3",
    f"""WITH {OBJECTS_SQL}
    SELECT host_id, repo_path, path, bool_or(t_in_head) AS in_head FROM objects
    WHERE obj_type = 'blob' GROUP BY ALL""",
)
def deleted_from_checkout(spark, sf_dir):
    raw = stored_evidence(spark, sf_dir)
    return G.deleted_from_checkout(objects(raw), head_tree(raw))


@query(
    "A24",
    f"""WITH {OBJECTS_SQL}
    SELECT host_id, repo_path, path, arg_max(sha, seq) AS blob FROM objects
    WHERE obj_type = 'blob' GROUP BY ALL""",
)
def latest_blob_of_path(spark, sf_dir):
    return G.latest_blob_of_path(objects(git_evidence(spark, sf_dir)))


@query(
    "A23 O5",
    f"""WITH {OBJECTS_SQL}
    SELECT host_id, repo_path, count(*) AS history_objects, count(*) FILTER (t_in_head) AS head_objects,
      count(*) FILTER (seq % 7 <> 0) AS from_head_objects
    FROM objects GROUP BY ALL""",
)
def history_objects(spark, sf_dir):
    raw = stored_evidence(spark, sf_dir)
    everything = G.history_objects(G.history_scope(objects(raw), head_tree(raw), "all"))
    head = G.history_objects(G.history_scope(objects(raw), head_tree(raw), "none"))
    head = head.withColumnRenamed("history_objects", "head_objects")
    from_head = G.history_objects(G.history_scope(objects(raw), head_tree(raw), "head"))
    from_head = from_head.withColumnRenamed("history_objects", "from_head_objects")
    return (
        everything.join(head, G.REPO, "left")
        .join(from_head, G.REPO, "left")
        .fillna(0, ["head_objects", "from_head_objects"])
    )


@query(
    "S7",
    f"""WITH {OBJECTS_SQL}
    SELECT host_id, repo_path, count(*) AS objects, count(*) FILTER (t_in_head) AS head,
      cast(sum(strlen(t_content)) AS bigint) AS bytes FROM objects GROUP BY ALL""",
)
def read_git_tables(spark, sf_dir):
    """The three tables as a collector exports them, read back."""
    raw = stored_evidence(spark, sf_dir)
    root = f"{shared_dir(spark)}/fleetlens/export-{uuid.uuid4().hex}"
    exported = {"git_objects": objects(raw), "head_tree": head_tree(raw), "blobs": blobs(raw)}
    for name, df in exported.items():
        df.write.parquet(f"{root}/{name}")
    back = read_exported(spark, root)
    counts = [
        back["git_objects"].groupBy(*G.REPO).agg(F.count(F.lit(1)).alias("objects")),
        back["head_tree"].groupBy(*G.REPO).agg(F.count(F.lit(1)).alias("head")),
        back["blobs"].groupBy(*G.REPO).agg(F.sum(F.octet_length("content")).alias("bytes")),
    ]
    return (
        counts[0].join(counts[1], G.REPO, "left").join(counts[2], G.REPO).fillna(0, ["head"])
    )


@query("P19 J7 A24 A18", f"WITH {SECRETS_SQL} SELECT * FROM secrets")
def secret_hits(spark, sf_dir):
    return secrets(spark, sf_dir).drop("in_history")


@query(
    "P46",
    f"""WITH {SECRETS_SQL} SELECT host_id, repo_path, path, substr(blob, 1, 12) AS short_blob FROM secrets""",
)
def short_blob_ids(spark, sf_dir):
    return secrets(spark, sf_dir).select(
        "host_id", "repo_path", "path", T.short_id(F.col("blob")).alias("short_blob")
    )


@query(
    "A12",
    f"""WITH {SECRETS_SQL} SELECT host_id, repo_path, count(*) AS total,
      count(*) FILTER (deleted_from_checkout) AS deleted FROM secrets GROUP BY host_id, repo_path""",
)
def secret_totals(spark, sf_dir):
    return G.secret_totals(secrets(spark, sf_dir), "host_id", "repo_path")


@query(
    "A13",
    f"""WITH {SECRETS_SQL}, counts AS (SELECT host_id, class, count(*) AS n FROM secrets GROUP BY ALL)
    SELECT host_id, string_agg(cast(n AS varchar) || ' x ' || class, ', ' ORDER BY class) AS summary
    FROM counts GROUP BY host_id""",
)
def secret_class_summary(spark, sf_dir):
    return G.secret_class_summary(secrets(spark, sf_dir))


@query(
    "W5",
    f"""WITH {SECRETS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY host_id, class
        ORDER BY deleted_from_checkout DESC, path, repo_path) AS in_class FROM secrets),
    placed AS (SELECT *, row_number() OVER (PARTITION BY host_id
        ORDER BY CASE WHEN in_class = 1 THEN 0 ELSE 1 END, deleted_from_checkout DESC, class, path, repo_path) AS place,
        count(*) OVER (PARTITION BY host_id) AS n FROM ranked)
    SELECT host_id, repo_path, path, class, place, greatest(n - 3, 0) AS omitted FROM placed WHERE place <= 3""",
)
def secret_examples(spark, sf_dir):
    return G.secret_examples(secrets(spark, sf_dir)).select(
        "host_id", "repo_path", "path", "class", F.col("place").cast("bigint").alias("place"),
        "omitted",
    )


@query(
    "S9",
    "SELECT doc_id % 10 AS bucket, count(DISTINCT r.rule_id) AS rules_due FROM documents JOIN (VALUES "
    + ", ".join(f"({_quote(r.id)}, {_quote(w)})" for r in RULES.rules for w in r.gate_words)
    + ") AS r(rule_id, word) ON contains(lower(text), word) GROUP BY 1",
)
def rule_table_coverage(spark, sf_dir):
    """The rule table as rows, joined to the documents' due rules."""
    due = G.keyword_rules(V.table(spark, sf_dir, "documents"), RULES, "doc_id")
    rules = rules_table(spark, RULES).select("rule_id")
    return (
        due.join(F.broadcast(rules), "rule_id")
        .groupBy((F.col("doc_id") % 10).alias("bucket"))
        .agg(F.countDistinct("rule_id").alias("rules_due"))
    )


# Files of the first repository of three came with a history, and so did those of inner ones.
WORKTREE_SQL = f"""checkout AS ({V.as_sql(V.CHECKOUT_FILES)}),
files AS (SELECT DISTINCT host_id, top AS repo_path, rel AS path, t_content FROM checkout
  WHERE NOT t_nested AND t_number % 3 <> 0 AND rel NOT LIKE '.git/%'),
firsts AS (SELECT *, md5(t_content) AS sha FROM files
  WHERE NOT regexp_matches(path, {_quote(_union(RULES.allow.paths))})),
contents AS (SELECT DISTINCT sha, t_content FROM firsts),
raw_hits AS ({_RAW_HITS_SQL}),
found AS (SELECT f.host_id, f.repo_path, f.path, arg_min(h.rule_id, h.rule_ord) AS rule_id
  FROM firsts f JOIN raw_hits h ON f.sha = h.sha WHERE {_PATH_TESTS_SQL} GROUP BY ALL),
named AS (SELECT DISTINCT host_id, repo_path, path, {CLASS_SQL} AS class FROM files)"""


def checkout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed files, their contents, repositories without a history)."""
    raw = materialize(V.project(spark, sf_dir, V.CHECKOUT_FILES), "checkout")
    inner = raw.filter("t_nested").select("host_id", F.concat("top", F.lit("/inner")).alias("repo_path"))
    roots = raw.select("host_id", F.col("top").alias("repo_path")).unionByName(inner).distinct()
    untriaged = raw.filter("t_number % 3 <> 0").select("host_id", F.col("top").alias("repo_path"))
    gone = raw.select("host_id", F.lit("/home/u/gone").alias("repo_path"))
    contents = raw.select("host_id", "path", F.col("t_content").cast("binary").alias("content"))
    return D.repo_root_of(raw.select("host_id", "path"), roots), contents, untriaged.unionByName(gone).distinct()


@query(
    "J10 U1 (working tree)",
    f"""WITH {WORKTREE_SQL}
    SELECT n.host_id, n.repo_path, n.path, coalesce(f.rule_id, n.class) AS class, '' AS blob,
      false AS in_head, false AS deleted_from_checkout
    FROM named n LEFT JOIN found f ON f.host_id = n.host_id AND f.repo_path = n.repo_path AND f.path = n.path
    WHERE f.rule_id IS NOT NULL OR n.class <> ''""",
)
def worktree_secrets(spark, sf_dir):
    placed, contents, untriaged = checkout(spark, sf_dir)
    return G.worktree_secrets(G.worktree_files(placed, untriaged), contents, RULES).drop("in_history")


@query(
    "J10 (notes)",
    f"""WITH {WORKTREE_SQL}
    SELECT host_id, repo_path, 'No history was delivered; ' || cast(count(*) AS varchar)
      || ' files of the working tree were examined.' AS secrets_note FROM named GROUP BY ALL
    UNION ALL SELECT DISTINCT host_id, '/home/u/gone', 'No history was delivered and no file of the checkout was listed.'
      FROM checkout
    UNION ALL SELECT DISTINCT host_id, top, 'No history was delivered and no file of the checkout was listed.'
      FROM checkout c WHERE t_number % 3 <> 0
        AND NOT EXISTS (SELECT 1 FROM named n WHERE n.host_id = c.host_id AND n.repo_path = c.top)""",
)
def secrets_notes(spark, sf_dir):
    placed, _, untriaged = checkout(spark, sf_dir)
    return G.secrets_notes(untriaged, G.worktree_files(placed, untriaged))
