"""Evidence tables projected from the warehouse tables at hand.

Each projection is plain SQL over one table and gives rows the shape of host
evidence. Columns named ``t_…`` state what the evidence was made from; the
operators never read them, only the checks do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# One JSON log line per event. t_form 0..7 selects a spelling; 6 and 7 do not parse.
_LOG_FIELDS = """
    SELECT event_id, ts, event_type, user_id,
      'host-' || cast(user_id % 37 AS string) AS host_id,
      '/home/u/.grok/logs/unified.jsonl'
        || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE '.2' END AS path,
      cast(event_id AS bigint) AS line_no,
      event_id % 8 AS t_form,
      CASE event_type
        WHEN 'signup' THEN 'repo_state.upload.start'
        WHEN 'purchase' THEN 'repo_state.upload.enqueued'
        WHEN 'click' THEN CASE event_id % 5
          WHEN 0 THEN 'repo_state.upload.completed'
          WHEN 1 THEN 'repo_state.upload.paused'
          ELSE 'storage put' END
        WHEN 'error' THEN 'auth 401 attribution'
        ELSE 'heartbeat' END AS t_name,
      CASE WHEN event_type = 'click' AND event_id % 5 > 1 THEN 'StorageClient.put_object'
           WHEN event_type = 'error' AND event_id % 4 < 3 THEN 'StorageClient.upload_file'
           WHEN event_type = 'error' THEN 'FeedbackClient.update'
           ELSE '' END AS t_consumer,
      CASE WHEN event_type = 'click' AND event_id % 5 > 1
           THEN CASE WHEN event_id % 2 = 0 THEN 204 ELSE 503 END ELSE 0 END AS t_status,
      CASE WHEN event_id % 23 = 0 THEN '' ELSE 's' || cast(user_id AS string) END AS t_sid,
      CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(event_id % 6 AS bigint) END AS t_turn,
      CASE WHEN event_type = 'signup' AND event_id % 13 <> 0
             THEN '/work/team' || cast(user_id % 4 AS string) || '/'
               || CASE event_id % 4 WHEN 0 THEN '/app' WHEN 1 THEN './app/' WHEN 2 THEN 'x/../app'
                  ELSE 'app' END
           WHEN event_type <> 'signup' AND event_id % 3 = 0
             THEN '/own/r' || cast(user_id % 9 AS string)
           ELSE '' END AS t_repo,
      CASE WHEN event_type IN ('purchase', 'click') AND event_id % 7 <> 0
           THEN 'gs://grok-code-session-traces/u' || cast(user_id AS string) || '/'
             || cast(event_id % 40 AS string) || '/'
             || CASE event_id % 3 WHEN 0 THEN 'before_codebase.tar.gz'
                  WHEN 1 THEN 'after_codebase.tar.gz?sig=a/b' ELSE 'other.bin/' END
           ELSE '' END AS t_gcs_path,
      CASE WHEN event_type = 'view' AND event_id % 10 = 0
           THEN '0.2.' || cast(event_id % 120 AS string) ELSE '' END AS t_version,
      1704067200 + event_id * 260 AS t_epoch
    FROM {events}
"""

_LOG_TEXT = """
    '{{"' || CASE t_form WHEN 1 THEN 'event_name' WHEN 2 THEN 'name' ELSE 'event' END
      || '":"' || t_name || '"'
    || CASE WHEN t_sid = '' THEN ''
            WHEN t_form = 1 THEN ',"session_id":"' || t_sid || '"'
            WHEN t_form = 4 THEN ',"sid":"replaced","sid":"' || t_sid || '"'
            ELSE ',"sid":"' || t_sid || '"' END
    || ',"ctx":{{"k":1'
    || CASE WHEN t_turn IS NULL THEN ''
            WHEN t_form = 1 THEN ',"turn":" ' || cast(t_turn AS string) || '"'
            WHEN t_form = 2 THEN ',"turn_number":' || cast(t_turn AS string) || '.0'
            ELSE ',"turn_number":' || cast(t_turn AS string) END
    || CASE WHEN t_repo = '' THEN '' WHEN t_form = 5 THEN ',"cwd":"' || t_repo || '"'
            ELSE ',"repo_path":"' || t_repo || '"' END
    || CASE WHEN t_consumer = '' THEN '' ELSE ',"consumer":"' || t_consumer || '"' END || '}}'
    || CASE WHEN t_gcs_path = '' THEN '' WHEN t_form = 1 THEN ',"gcsPath":"' || t_gcs_path || '"'
            ELSE ',"gcs_path":null,"dest":"' || t_gcs_path || '"' END
    || CASE WHEN t_status = 0 THEN '' WHEN t_form = 3 THEN ',"code":"' || cast(t_status AS string) || '"'
            ELSE ',"status":' || cast(t_status AS string) END
    || CASE WHEN t_version = '' THEN '' ELSE ',"ver":"' || t_version || '"' END
    || CASE t_form WHEN 0 THEN ',"ts":"' || replace(cast(ts AS string), ' ', 'T') || 'Z"'
         WHEN 1 THEN ',"timestamp":' || cast(t_epoch AS string) || '000'
         WHEN 2 THEN ',"time":"' || cast(t_epoch AS string) || '"'
         WHEN 3 THEN ',"ts":' || cast(t_epoch AS string) || '000000'
         WHEN 4 THEN ',"ts":"' || cast(ts AS string) || ' +0000 UTC"'
         ELSE ',"ts":"not a time"' END
    || CASE t_form WHEN 6 THEN '' ELSE '}}' END
    || CASE t_form WHEN 3 THEN ' trailing' ELSE '' END
"""

LOG_LINES = f"""
  SELECT *, CASE WHEN t_form = 7 THEN '[' || t_text || ']' ELSE t_text END AS line
  FROM (SELECT *, {_LOG_TEXT} AS t_text FROM ({_LOG_FIELDS}) AS fields) AS texts
"""

# Files of a host, from lineitem. t_k selects the kind of place.
FILE_INVENTORY = """
  SELECT host_id, t_k, path, t_id,
    t_k IN (0, 1, 7, 16, 18, 19) AS is_dir,
    t_k NOT IN (0, 1, 7, 16, 18, 19) AND t_id % 29 <> 0 AS is_regular,
    t_size AS size,
    unhex(CASE WHEN t_k IN (5, 6, 10, 15) THEN CASE t_id % 6 WHEN 0 THEN '7F454C46'
            WHEN 1 THEN 'CFFAEDFE' WHEN 2 THEN '4D5A9000' WHEN 3 THEN '23212F62'
            WHEN 4 THEN '4D5A' ELSE '00000000' END ELSE '89504E47' END) AS head4,
    CASE WHEN t_k IN (5, 6, 10, 15) THEN CASE t_id % 6 WHEN 0 THEN '7F454C46'
            WHEN 1 THEN 'CFFAEDFE' WHEN 2 THEN '4D5A9000' WHEN 3 THEN '23212F62'
            WHEN 4 THEN '4D5A' ELSE '00000000' END ELSE '89504E47' END AS t_head,
    reverse(substr(reverse(path), 1, strpos_rev - 1)) AS name
  FROM (
    SELECT *, strpos_slash AS strpos_rev FROM (
    SELECT *, length(path) - length(replace(path, '/', '')) AS t_slashes,
      instr(reverse(path), '/') AS strpos_slash
    FROM (
      SELECT 'host-' || cast(l_suppkey % 60 AS string) AS host_id,
        t_k, t_id, cast(floor(l_extendedprice * 10) AS bigint) * (CASE WHEN t_id % 41 = 0 THEN 0 ELSE 1 END) AS t_size,
        CASE t_k
          WHEN 0 THEN '/home/u/.grok'
          WHEN 1 THEN '/home/u/.grok/upload_queue'
          WHEN 2 THEN '/home/u/.grok/upload_queue/' || cast(t_id AS string) || '/metadata.json'
          WHEN 3 THEN '/home/u/.grok/upload_queue/' || cast(t_id AS string) || '/before_codebase.tar.gz'
          WHEN 4 THEN '/home/u/Downloads/' || cast(t_id AS string) || '_Codebase.tar.gz'
          WHEN 5 THEN '/opt/v' || cast(t_id % 50 AS string) || '/Grok'
          WHEN 6 THEN '/opt/tool' || cast(t_id % 400 AS string) || '/bin/app'
          WHEN 7 THEN '/home/u/src/repo' || cast(t_id % 300 AS string) || '/.git'
          WHEN 8 THEN '/home/u/pics/a' || cast(t_id AS string) || '.PNG'
          WHEN 9 THEN '/opt/tool' || cast(t_id % 400 AS string) || '/package.json'
          WHEN 10 THEN '/usr/lib/l' || cast(t_id AS string) || '.so'
          WHEN 11 THEN '/home/u/src/repo' || cast(t_id % 300 AS string) || '/run' || cast(t_id AS string) || '.sh'
          WHEN 12 THEN '/home/u/.grok/unified.jsonl.' || cast(t_id % 700 AS string)
          WHEN 13 THEN '/home/u/.grok/logs/Unified-' || cast(t_id % 500 AS string) || '.jsonl.gz'
          WHEN 14 THEN '/home/u/src/repo' || cast(t_id % 300 AS string) || '/unified.jsonl'
          WHEN 15 THEN '/srv/data' || cast(t_id AS string) || '.dat'
          WHEN 16 THEN '/mnt/c' || cast(t_id % 9 AS string) || '/.grok'
          WHEN 17 THEN '/home/u/.grok/UPLOAD_QUEUE/' || cast(t_id AS string) || '.TGZ'
          WHEN 18 THEN '/mnt/c' || cast(t_id % 9 AS string) || '/.grok/Upload_Queue'
          ELSE '/home/u/src/repo' || cast(t_id % 300 AS string) END AS path,
        l_extendedprice
      FROM (SELECT *, l_orderkey * 8 + l_linenumber AS t_id,
              (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 20 AS t_k FROM {lineitem}) AS keyed
    ) AS placed
    ) AS measured
  ) AS named
"""

# Versions of files in repositories, from documents: objects, HEAD and contents.
GIT_OBJECTS = """
  SELECT *, md5(t_content) AS sha FROM (
    SELECT 'host-' || cast(doc_id % 12 AS string) AS host_id,
      CASE WHEN doc_id % 3 = 0 THEN '/work/team' || cast(doc_id % 4 AS string) || '/app'
        ELSE '/home/u/src/' || source END AS repo_path,
      doc_id AS seq, n_chars AS size, doc_id AS t_id,
      CASE WHEN doc_id % 17 = 0 THEN 'tree' ELSE 'blob' END AS obj_type,
      doc_id % 5 <> 0 AS t_in_head,
      CASE doc_id % 26
        WHEN 0 THEN '.env' WHEN 1 THEN 'deploy/.env.latest' WHEN 2 THEN '.env.example'
        WHEN 3 THEN 'keys/ID_RSA' WHEN 4 THEN 'tls/server.pem' WHEN 5 THEN 'tls/server.pub'
        WHEN 6 THEN 'store/app.jks' WHEN 7 THEN 'cfg/credentials.json'
        WHEN 8 THEN 'cfg/service-account-prod.json' WHEN 9 THEN '.aws/credentials'
        WHEN 10 THEN '.npmrc' WHEN 11 THEN 'iac/prod.tfstate' WHEN 12 THEN 'iac/terraform.tfvars'
        WHEN 13 THEN '.kube/config' WHEN 14 THEN 'web/.htpasswd' WHEN 15 THEN 'conf/app-secrets.yaml'
        WHEN 16 THEN 'src/secrets.go' WHEN 17 THEN 'node_modules/x/index.js'
        WHEN 18 THEN 'img/logo.png' WHEN 19 THEN 'iac/main.tf' WHEN 20 THEN 'cert/a.p12'
        WHEN 21 THEN 'pkg/@octokit/auth-token/README.md'
        ELSE 'src/f' || cast(doc_id % 400 AS string) || '.txt' END AS path,
      text || CASE doc_id % 9
        WHEN 0 THEN chr(10) || 'pat ghp_' || md5(text) || 'AbC9'
        WHEN 1 THEN chr(10) || 'id = AKIAQ' || 'WERTYUIOPASDFGH'
        WHEN 2 THEN chr(10) || 'id = AKIAQ' || 'WERTYUIOEXAMPLE'
        WHEN 3 THEN chr(10) || 'password = "' || substr(md5(text), 1, 14) || '"'
        WHEN 4 THEN chr(10) || 'datadog_key: ' || md5(text) || 'beefcafe'
        ELSE '' END AS t_content
    FROM {documents}
  ) AS objects
"""

# Configuration files, from customer. t_k selects the text.
CONFIG_FILES = """
  SELECT 'host-' || cast(c_custkey AS string) AS host_id, '/home/u/.grok' AS home,
    c_custkey % 11 AS t_k,
    CASE c_custkey % 11 WHEN 9 THEN 'missing' WHEN 10 THEN 'unreadable' ELSE 'ok' END AS status,
    CASE c_custkey % 11
      WHEN 0 THEN '[harness]' || chr(10) || 'disable_codebase_upload = true' || chr(10)
        || '[telemetry]' || chr(10) || 'trace_upload = false # off'
      WHEN 1 THEN '[harness]' || chr(10) || 'disable_codebase_upload = false' || chr(10)
        || 'k' || cast(c_nationkey AS string) || ' = 1'
      WHEN 2 THEN 'harness.disable_codebase_upload = true' || chr(10) || 'telemetry.trace_upload = true'
      WHEN 3 THEN '# [harness]' || chr(10) || '# disable_codebase_upload = true'
      WHEN 4 THEN '[[harness]]' || chr(10) || 'disable_codebase_upload = true'
      WHEN 5 THEN '[harness]' || chr(10) || 'note = ' || chr(34) || chr(34) || chr(34) || chr(10)
        || 'disable_codebase_upload = true' || chr(10) || chr(34) || chr(34) || chr(34) || chr(10)
        || '[telemetry]' || chr(10) || 'trace_upload = FALSE,'
      WHEN 6 THEN '[harness]' || chr(10) || 'disable_codebase_upload = ' || chr(34) || 'true' || chr(34)
      WHEN 7 THEN '[telemetry]' || chr(10) || 'trace_upload = false' || chr(10) || 'level = 3' || chr(10)
        || 'level = 4' || chr(10) || 'agent = ' || chr(34) || '#x' || chr(34)
      WHEN 8 THEN '[harness]' || chr(10) || 'note = ' || chr(34) || chr(34) || chr(34) || 'open'
      ELSE '' END AS text
  FROM {customer}
"""

# Staged manifests, from orders: JSON naming local paths and sometimes the bucket.
MANIFESTS = """
  SELECT 'host-' || cast(o_custkey % 60 AS string) AS host_id,
    '/home/u/.grok/upload_queue/' || cast(o_orderkey AS string) || '/'
      || CASE o_orderkey % 6 WHEN 5 THEN 'notes.json' WHEN 4 THEN 'Metadata.json'
           ELSE 'metadata.json' END AS path,
    CASE o_orderkey % 6 WHEN 5 THEN 'notes.json' WHEN 4 THEN 'Metadata.json'
         ELSE 'metadata.json' END AS name,
    o_orderkey AS t_id,
    '{{"files":[{{"src":"/home/u/src/repo' || cast(o_orderkey % 300 AS string) || '/src/a.py","n":1}},"/home/u/src/repo'
      || cast((o_orderkey * 3) % 300 AS string) || '/b.txt","rel/c"],"dst":"gs://'
      || CASE WHEN o_orderstatus = 'F' THEN 'grok-code-session-traces' ELSE 'elsewhere' END
      || '/x","q' || chr(92) || '"uote":"a' || chr(92) || '"b"' || CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE '}}' END AS text
  FROM {orders}
"""

# Where each host's search path finds the command, from supplier and customer keys.
PATH_LOOKUP = """
  SELECT 'host-' || cast(c_custkey % 60 AS string) AS host_id, c_custkey AS ord,
    CASE c_custkey % 3 WHEN 0 THEN '/opt/v' || cast(c_custkey % 50 AS string) || '/Grok'
      ELSE '/usr/local/bin/grok' || cast(c_custkey % 2 AS string) END AS entry,
    CASE c_custkey % 3 WHEN 2 THEN '/opt//v' || cast(c_nationkey AS string) || '/./Grok'
      ELSE '/elsewhere/grok' END AS resolved
  FROM {customer}
"""

# Text files that state a version, from part.
VERSION_FILES = """
  SELECT 'host-' || cast(p_partkey % 60 AS string) AS host_id, p_partkey AS t_id,
    p_partkey % 9 AS t_k,
    CASE p_partkey % 2 WHEN 0 THEN 'v' ELSE '' END || cast(CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS string)
      || '.' || cast(p_size % 4 AS string) || '.' || cast(p_partkey % 120 AS string)
      || CASE WHEN p_partkey % 7 = 0 THEN '-rc.1' ELSE '' END AS t_version,
    '/home/u/.grok/' || CASE p_partkey % 9 WHEN 0 THEN 'version' WHEN 1 THEN 'VERSION'
      WHEN 2 THEN 'install.json' WHEN 3 THEN 'package.json' WHEN 4 THEN 'package.json'
      WHEN 5 THEN 'manifest.json' WHEN 6 THEN '.version' WHEN 7 THEN 'package.json'
      ELSE 'install.json' END AS path
  FROM {part}
"""

VERSION_TEXTS = f"""
  SELECT *, CASE t_k
      WHEN 0 THEN chr(10) || t_version || ' ' || chr(10)
      WHEN 1 THEN 'release ' || t_version
      WHEN 3 THEN '{{{{"name":"@x/Grok","version":"' || t_version || '"}}}}'
      WHEN 4 THEN '{{{{"name":"left-pad","version":"' || t_version || '"}}}}'
      WHEN 5 THEN '{{{{"version":12}}}}'
      WHEN 6 THEN t_version
      WHEN 7 THEN '{{{{"name":"the-grok-cli-kit","version":"' || t_version || '"}}}}'
      WHEN 8 THEN '{{{{"version":"' || t_version || '"'
      ELSE '{{{{"version":"' || t_version || '","x":[1,2]}}}}' END AS text
  FROM ({VERSION_FILES}) AS files
"""

# Files with byte content, from pages: markers and version strings between text.
FILE_CONTENT = """
  SELECT 'host-' || cast(page_id % 60 AS string) AS host_id, page_id AS t_id,
    '/opt/tool' || cast(page_id AS string) || CASE page_id % 4 WHEN 0 THEN '/bin/app'
      WHEN 1 THEN '/run.sh' WHEN 2 THEN '/Cellar/my-grok-x/0.2.' || cast(page_id % 130 AS string) || '_1/bin/grok'
      ELSE '/lib.so' END AS path,
    CASE page_id % 3 WHEN 0 THEN 'elf' WHEN 1 THEN 'script' ELSE 'none' END AS t_kind,
    html || CASE page_id % 6 WHEN 0 THEN 'é repo_state.upload é grok-code-session-traces'
      WHEN 1 THEN chr(1) || 'Grok-cli/0.2.' || cast(page_id % 110 AS string) || chr(2) || '"version" : "1.4.2"'
      WHEN 2 THEN 'x' || chr(1) || 'v0.1' || chr(1) || 'grok 0.2.93 grok build 0.1.7 cli-chat-proxy.grok.com'
      ELSE '' END AS t_text
  FROM {pages}
"""

# Checked-out files, from pages: some lie in a repository inside another one.
CHECKOUT_FILES = """
  SELECT host_id, top, t_number, t_nested, rel, t_content,
    top || CASE WHEN t_nested THEN '/inner/' ELSE '/' END || rel AS path
  FROM (
    SELECT 'host-' || cast(page_id % 60 AS string) AS host_id, page_id % 12 AS t_number,
      '/home/u/src/r' || cast(page_id % 12 AS string) AS top, page_id % 7 = 0 AS t_nested,
      CASE page_id % 13 WHEN 0 THEN '.env' WHEN 1 THEN 'keys/ID_RSA' WHEN 2 THEN '.git/config'
        WHEN 3 THEN 'node_modules/x/index.js' ELSE 'src/p' || cast(page_id AS string) || '.txt' END AS rel,
      coalesce(html, '') || CASE page_id % 5
        WHEN 0 THEN chr(10) || 'pat ghp_' || md5(cast(page_id AS string)) || 'AbC9'
        WHEN 1 THEN chr(10) || 'id = AKIAQ' || 'WERTYUIOPASDFGH'
        WHEN 2 THEN chr(10) || 'pat ghp_' || md5('same') || 'AbC9'
        ELSE '' END AS t_content
    FROM {pages}
  ) AS files
"""

# What collectors failed to see, from orders.
COLLECTOR_ERRORS = """
  SELECT 'host-' || cast(o_custkey AS string) AS host_id, o_orderkey AS seq,
    CASE o_orderstatus WHEN 'F' THEN 'deepscan' WHEN 'O' THEN 'logs' ELSE 'config' END AS detector,
    CASE WHEN o_orderkey % 3 = 0 THEN 'io' WHEN o_orderkey % 3 = 1 THEN 'permission' ELSE 'timeout' END AS kind,
    '/home/u/' || cast(o_orderkey % 1000 AS string) AS path,
    'code ' || cast(o_orderkey % 50 AS string) AS message,
    o_orderpriority = '1-URGENT' AND o_custkey % 4 = 0 AS material
  FROM {orders}
"""


#: Fewer rows than this are not worth a task of their own.
_LEAST_ROWS = 1000


def dealt(rows: DataFrame) -> DataFrame:
    """The rows, dealt out by their first column if row groups leave half of the cores idle.

    A row group is read by one task, however many splits its file has, and what is projected
    from it costs far more than reading it. The rows of each split are counted in the footers.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    counts = rows.groupBy(F.spark_partition_id()).count()
    largest, total = counts.agg(F.max("count"), F.sum("count")).first()
    tasks = min((total or 0) // _LEAST_ROWS, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if tasks < 2 or largest * cores <= 2 * total:
        return rows
    return rows.repartition(tasks, rows.columns[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def project(spark: SparkSession, sf_dir: str, projection: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in projection}
    return spark.sql(projection, **used)


def as_sql(projection: str) -> str:
    """The projection for an engine that already knows the tables by name."""
    return projection.format(**{t: t for t in TABLES})
