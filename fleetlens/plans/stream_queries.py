"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions import events as E
from fleetlens.operators.log_events import relevant_events
from fleetlens.plans import log_queries as Q
from fleetlens.plans.catalog import query, us
from fleetlens.session import materialize, shared_dir
from fleetlens.operators import correlate as C
from fleetlens.sources.files import file_system
from fleetlens.sources.logs import placed_lines
from fleetlens.streaming import auth, growing, ledger, logs, windows


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/fleetlens/{name}-{uuid.uuid4().hex}"


def arriving_files(spark, sf_dir, root: str) -> None:
    """The log lines as text files, one per host and log file, in file order."""
    name = F.substring_index("path", "/", -1)
    lines = Q.log_lines(spark, sf_dir).select("host_id", name.alias("name"), "line_no", "line")
    (
        lines.repartition("host_id", "name")
        .sortWithinPartitions("host_id", "name", "line_no")
        .select("host_id", "name", "line")
        .write.partitionBy("host_id", "name")
        .text(root)
    )


_PARTITIONS = "host_id string, name string"
_LOG_DIR = "/home/u/.grok/logs/"


@query(
    "R1",
    f"""WITH {Q.EVENTS_SQL},
    numbered AS (SELECT host_id, path, line_no AS id,
        row_number() OVER (PARTITION BY host_id, path ORDER BY line_no) AS line_no FROM lines WHERE line <> '')
    SELECT t.host_id, t.kind, count(*) AS n, cast(sum(CASE WHEN ts_us IS NULL THEN 0 ELSE 1 END) AS bigint) AS dated,
      cast(sum(n.line_no) AS bigint) AS line_numbers
    FROM truth t JOIN numbered n ON n.host_id = t.host_id AND n.path = t.path AND n.id = t.line_no
    GROUP BY t.host_id, t.kind""",
)
def stream_log_events(spark, sf_dir):
    """Files arrive, their lines are numbered and parsed."""
    root = _place(spark, "line-stream")
    arriving_files(spark, sf_dir, f"{root}/in")
    arriving = logs.read_line_stream(spark, f"{root}/in", _PARTITIONS)

    def keep(events, batch):
        events.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    logs.start_line_sink(arriving, keep, f"{root}/checkpoint").awaitTermination()
    return (
        spark.read.parquet(f"{root}/out").filter("parsed").groupBy("host_id", "kind")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count("ts").alias("dated"),
            F.sum("line_no").alias("line_numbers"),
        )
    )


@query(
    "R2",
    f"""WITH {Q.ATTRIBUTED_SQL}
    SELECT host_id, repo_key, status, collect_attempts, archives, deliveries_confirmed,
      coalesce(first_us, -1) AS first_us, low_confidence FROM ledger_status""",
)
def stream_ledger(spark, sf_dir):
    """Text files arrive in three batches; the ledger ends equal to the batch one."""
    root = _place(spark, "ledger-stream")
    arriving_files(spark, sf_dir, f"{root}/in")
    files = len(spark.read.text(f"{root}/in").inputFiles())
    lines = (
        spark.readStream.schema(f"value string, {_PARTITIONS}").format("text")
        .option("maxFilesPerTrigger", max(1, -(-files // 3)))
        .load(f"{root}/in")
    )

    def merge(placed, batch):
        # The collector's folders say where the file lay on its host.
        events = logs.parse_batch(placed, F.concat(F.lit(_LOG_DIR), F.col("name")))
        ledger.merge_batch(relevant_events(events).drop("name"), batch, f"{root}/state")

    (
        placed_lines(lines).writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return ledger.current_ledger(spark, f"{root}/state").select(
        "host_id", "repo_key", "status", "collect_attempts", "archives", "deliveries_confirmed",
        us("first_seen", "first_us"), "low_confidence",
    )


@query(
    "R3",
    f"""WITH {Q.EVENTS_SQL}
    SELECT DISTINCT f.host_id, f.path, f.line_no, f.ts_us FROM ev f JOIN ev u ON u.host_id = f.host_id
      AND u.kind <> 'upload_auth_fail' AND u.ts_us BETWEEN f.ts_us - 3600000000 AND f.ts_us
    WHERE f.kind = 'upload_auth_fail'""",
)
def stream_auth_window(spark, sf_dir):
    root = _place(spark, "auth-stream")
    events = Q.log_events(spark, sf_dir)
    events.write.parquet(f"{root}/in")

    def arriving():
        return spark.readStream.schema(events.schema).parquet(f"{root}/in")

    # The replay is not in time order, so nothing may count as late.
    found = auth.stream_auth_window(arriving(), arriving(), late="36500 days")
    logs.start_event_sink(
        found.select("host_id", "path", "line_no", "ts"), f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("host_id", "path", "line_no", us("ts", "ts_us"))


def written_files(spark, sf_dir, root: str, part: float) -> None:
    """The beginning of every log as one file per host and name; a later, larger part makes it longer.

    A task writes its files whole, so one that runs again changes nothing.
    """
    lines = Q.log_lines(spark, sf_dir).withColumn("name", F.substring_index("path", "/", -1))
    of_file = Window.partitionBy("host_id", "name")
    shown = lines.withColumn("share", F.percent_rank().over(of_file.orderBy("line_no"))).filter(F.col("share") <= part)

    def write(frames):
        fs, base = file_system(root)
        place, out = None, None
        for frame in frames:
            for host, name, line in zip(frame["host_id"], frame["name"], frame["line"], strict=True):
                if (host, name) != place:
                    if out:
                        out.close()
                    place = host, name
                    fs.create_dir(f"{base}/{host}")
                    out = fs.open_output_stream(f"{base}/{host}/{name}")
                out.write(line.encode() + b"\n")
        if out:
            out.close()
        yield from ()

    ordered = shown.repartition("host_id", "name").sortWithinPartitions("host_id", "name", "line_no")
    ordered.select("host_id", "name", "line").mapInPandas(write, "done boolean").collect()


@query(
    "R1 W1",
    f"""WITH {Q.EVENTS_SQL},
    numbered AS (SELECT host_id, path, line_no AS id,
        row_number() OVER (PARTITION BY host_id, path ORDER BY line_no) AS line_no FROM lines WHERE line <> '')
    SELECT t.host_id, t.path, n.line_no, t.kind, coalesce(t.ts_us, -1) AS ts_us
    FROM truth t JOIN numbered n ON n.host_id = t.host_id AND n.path = t.path AND n.id = t.line_no""",
)
def stream_growing_logs(spark, sf_dir):
    """Files grow between triggers; lines and their numbers end equal to the batch ones."""
    root = _place(spark, "growing-stream")
    parts = F.split("path", "/")

    def keep(events, batch):
        events.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    for part in (0.4, 0.7, 1.0):
        written_files(spark, sf_dir, f"{root}/in", part)
        growing.start_growing(
            growing.read_growing(spark, f"{root}/in"), keep, f"{root}/state",
            F.element_at(parts, -2), F.concat(F.lit(_LOG_DIR), F.element_at(parts, -1)),
        ).awaitTermination()
    return spark.read.parquet(f"{root}/out").filter("parsed").select("host_id", "path", "line_no", "kind", us("ts", "ts_us"))


@query(
    "R3 J5",
    f"""WITH {Q.ATTRIBUTED_SQL}
    SELECT f.host_id, f.ts_us, count(*) AS failures FROM fails f
    WHERE EXISTS (SELECT 1 FROM wins w WHERE w.host_id = f.host_id AND f.ts_us BETWEEN w.first_us AND w.end_us)
    GROUP BY f.host_id, f.ts_us""",
)
def stream_refusal_windows(spark, sf_dir):
    """Events replayed in time order, in four parts; the watermark is two hours behind."""
    root = _place(spark, "window-stream")
    events = Q.log_events(spark, sf_dir)
    refused = events.filter(F.col("kind") == E.AUTH_FAIL).select("host_id", F.lit("").alias("repo_key"), "kind", "ts")
    rows = materialize(
        C.attributed_rows(events).select("host_id", "repo_key", "kind", "ts").unionByName(refused).filter("ts IS NOT NULL"), "replayed"
    )
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return rows.select("host_id", F.lit(0).cast("bigint").alias("ts_us"), F.lit(0).cast("bigint").alias("failures"))
    cuts = [first + (last - first) * i / 4 for i in range(1, 4)]
    # Nothing may be forgotten, however long the replay.
    keep = f"{max(36500, (last - first).days + 1)} days"
    # A later event of no host lets the watermark pass all others.
    late = rows.limit(1).select(F.lit("").alias("host_id"), "repo_key", F.lit(E.START).alias("kind"), (F.lit(last) + F.expr("INTERVAL 1 DAY")).alias("ts"))
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if a is None else rows.filter(F.col("ts") >= F.lit(a))
        (part.unionByName(late) if b is None else part.filter(F.col("ts") < F.lit(b))).write.mode("append").parquet(f"{root}/in")
        # A part's files lie side by side in time, so a batch takes them all; the next run goes on from its state.
        found = windows.stream_windows(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), late="2 hours", keep=keep)
        logs.start_event_sink(found, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").filter("in_window").select("host_id", "ts_us", "failures")
