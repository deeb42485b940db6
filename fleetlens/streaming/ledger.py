"""The ledger kept up to date as events arrive.

Correlation is global per host, so a late start event can still name the repository of
uploads seen before. What is kept is therefore not the ledger's rows but partial sums from
which any attribution follows: per host, session, turn, kind and the event's own repository
the number of events, their first and last time and their first and last place. Partial sums
of two batches merge by adding up; their number is that of distinct turns, not of events.

Hosts are dealt over buckets. A batch reads the current version of the buckets it touches,
merges, and writes new versions of those; a manifest then names the current version of
every bucket. A batch that runs again starts from the manifest before it and overwrites
its own files, so a retry changes nothing. Versions that no kept manifest names are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import events as E
from fleetlens.functions.paths import normalize_repo
from fleetlens.operators.correlate import UPLOADS
from fleetlens.sources.files import drop_path, path_exists
from fleetlens.spec import UNATTRIBUTED

BUCKETS = 64
_KEYS = ("host_id", "sid", "turn_key", "repo", "kind", "case_insensitive")


def _bucket():
    return F.pmod(F.xxhash64("host_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def partial_sums(events: DataFrame) -> DataFrame:
    """Starts and uploads of some events, summed up."""
    insensitive = F.coalesce(F.col("case_insensitive"), F.lit(False)) if "case_insensitive" in events.columns else F.lit(False)
    place = F.struct("path", "line_no")
    return (
        events.filter(F.col("kind").isin(E.START, *UPLOADS))
        .withColumns({"turn_key": F.coalesce(F.col("turn").cast("string"), F.lit("-")), "case_insensitive": insensitive})
        .groupBy(*_KEYS)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
            F.min(place).alias("from_place"), F.max(place).alias("to_place"),
        )
    )


def merged_sums(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*_KEYS).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("from_place").alias("from_place"), F.max("to_place").alias("to_place"),
    )


def ledger_of_sums(sums: DataFrame) -> DataFrame:
    """What ``build_ledger(attributed_rows(events))`` gives for the events that were summed up."""
    start = F.col("kind") == E.START
    named = sums.filter(start & (F.col("repo") != ""))
    by_turn = named.groupBy("host_id", "sid", "turn_key").agg(F.min_by("repo", "from_place").alias("start_repo"))
    by_session = named.filter("sid <> ''").groupBy("host_id", "sid").agg(F.max_by("repo", "to_place").alias("session_repo"))
    own = F.when(F.col("repo") != "", F.col("repo"))
    rows = sums.join(by_turn, ["host_id", "sid", "turn_key"], "left").join(by_session, ["host_id", "sid"], "left").withColumns(
        {
            "low": ~start & F.col("start_repo").isNull() & (F.col("session_repo").isNotNull() | own.isNull()),
            "repo": F.when(start, F.coalesce(own, F.lit(UNATTRIBUTED))).otherwise(
                F.coalesce("start_repo", "session_repo", own, F.lit(UNATTRIBUTED))
            ),
        }
    )
    keyed = rows.withColumn("repo_key", normalize_repo(F.col("repo"), F.col("case_insensitive")))

    def events(*kinds: str):
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))

    grouped = keyed.groupBy("host_id", "repo_key").agg(
        F.min_by("repo", "from_place").alias("repo_path"),
        events(E.START).alias("collect_attempts"),
        events(E.ENQUEUED, E.UNKNOWN_UPLOAD).alias("archives"),
        events(E.SUCCESS).alias("deliveries_confirmed"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.bool_or("low").alias("low_confidence"),
        F.min(F.when(start, F.col("from_place"))).alias("cited"),
    )
    status = E.repo_status(F.col("deliveries_confirmed"), F.col("archives"), F.col("collect_attempts"))
    return grouped.select(
        "host_id", "repo_key", "repo_path", status.alias("status"), "collect_attempts", "archives",
        "deliveries_confirmed", "first_seen", "last_seen", "low_confidence",
        F.col("cited.path").alias("log_file"), F.col("cited.line_no").alias("log_line"),
    )


def _manifest(spark: SparkSession, root: str, batch_id: int) -> dict[str, int]:
    """Bucket → the batch that wrote its current version, as of the end of that batch."""
    if batch_id < 0:
        return {}
    (row,) = spark.read.text(f"{root}/manifests/{batch_id}").collect()
    return json.loads(row[0])


def _version(root: str, bucket: str, batch_id: int) -> str:
    return f"{root}/versions/batch={batch_id}/bucket={bucket}"


def merge_batch(batch: DataFrame, batch_id: int, root: str) -> list[str]:
    """Merge the batch's events into the buckets of their hosts; returns what was read of earlier batches."""
    spark = batch.sparkSession
    fresh = f"{root}/fresh/{batch_id}"
    partial_sums(batch).withColumn("bucket", _bucket()).write.mode("overwrite").parquet(fresh)
    new = spark.read.parquet(fresh)
    # At most one row per bucket.
    touched = sorted(str(r["bucket"]) for r in new.select("bucket").distinct().collect())
    before = _manifest(spark, root, batch_id - 1)
    read = [_version(root, b, before[b]) for b in touched if b in before]
    sums = new.drop("bucket")
    if read:
        sums = sums.unionByName(spark.read.parquet(*read))
    merged_sums(sums).withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{root}/versions/batch={batch_id}"
    )
    now = {**before, **dict.fromkeys(touched, batch_id)}
    spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifests/{batch_id}")
    _compact(spark, root, batch_id, before)
    return read


def _compact(spark: SparkSession, root: str, batch_id: int, kept: dict[str, int]) -> None:
    """Delete what neither this batch's manifest nor the one before names."""
    drop_path(spark, f"{root}/fresh/{batch_id}")
    # A batch that runs again finds that done.
    if batch_id < 2 or not path_exists(spark, f"{root}/manifests/{batch_id - 2}"):
        return
    for bucket, version in _manifest(spark, root, batch_id - 2).items():
        if kept.get(bucket) != version:
            drop_path(spark, _version(root, bucket, version))
    drop_path(spark, f"{root}/manifests/{batch_id - 2}")


def start_ledger(events: DataFrame, root: str, checkpoint: str, **trigger):
    return (
        events.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, root))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def last_batch(spark: SparkSession, root: str) -> int:
    """The newest manifest's batch, -1 without any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return -1
    whole = [s.getPath() for s in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(p.getName()) for p in whole), default=-1)


def current_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The ledger of all events merged so far."""
    manifest = _manifest(spark, root, last_batch(spark, root))
    paths = [_version(root, b, v) for b, v in sorted(manifest.items())]
    if not paths:
        raise ValueError(f"no batch was merged below {root}")
    return ledger_of_sums(spark.read.parquet(*paths))
