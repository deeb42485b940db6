"""Per-host conclusions from findings, errors and the ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.findings import KEYS, severity_rank
from fleetlens.spec import SEVERITIES

MITIGATE_IDS = (
    "config.not_mitigated", "config.absent", "config.explicitly_disabled", "config.unparseable",
)
IMPLICATED = ("delivered", "queued", "collected_only")


def degraded(errors: DataFrame) -> DataFrame:
    return errors.groupBy("host_id").agg(F.bool_or("material").alias("degraded"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """One column per severity name."""
    return findings.groupBy("host_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def verdicts(hosts: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """Every host gets a verdict; one without findings is clean only if all was seen."""
    rank = severity_rank(F.col("severity"))
    signs = findings.groupBy("host_id").agg(
        F.bool_or((rank >= 3) & F.array_contains("tags", "upload")).alias("upload"),
        F.bool_or(rank >= 2).alias("exposure"),
    )
    return (
        hosts.select("host_id").distinct()
        .join(signs, "host_id", "left")
        .join(degraded(errors), "host_id", "left")
        .fillna(False, ["upload", "exposure", "degraded"])
        .select(
            "host_id",
            F.when(F.col("upload"), "COMPROMISED")
            .when(F.col("exposure"), "EXPOSED")
            .when(F.col("degraded"), "INDETERMINATE")
            .otherwise("CLEAN")
            .alias("verdict"),
            "degraded",
        )
    )


def presence(
    hosts: DataFrame, ledger: DataFrame, versions: DataFrame, findings: DataFrame,
    *artifacts: DataFrame,
) -> DataFrame:
    """Whether anything of the product was seen. ``artifacts`` are any tables keyed by
    host whose rows prove it: installs, queues, archives, repository hints."""
    keys = [a.select("host_id") for a in artifacts]
    keys.append(ledger.select("host_id"))
    keys.append(versions.filter(F.col("confidence") != "low").select("host_id"))
    keys.append(
        findings.filter(
            (F.col("detector") == "config") | (F.col("finding_id") == "deepscan.binary_marker")
        ).select("host_id")
    )
    seen = reduce(DataFrame.unionByName, keys).distinct().withColumn("product_present", F.lit(True))
    return hosts.select("host_id").distinct().join(seen, "host_id", "left").fillna(
        False, ["product_present"]
    )


def exfil_facts(ledger: DataFrame) -> DataFrame:
    """Delivered, confirmed, queued (delivered ones included), collected, archives, touched."""
    status = F.col("status")
    queued = status.isin("delivered", "queued")
    return ledger.groupBy("host_id").agg(
        F.count_if(status == "delivered").alias("delivered"),
        F.sum(F.when(status == "delivered", F.col("deliveries_confirmed")).otherwise(0)).alias("confirmed"),
        F.count_if(queued).alias("queued"),
        F.count_if(status == "collected_only").alias("collected"),
        F.sum(F.when(queued, F.col("archives")).otherwise(0)).alias("archives"),
        F.count_if(status.isin(*IMPLICATED)).alias("repos_touched"),
    )


def found_tally(hosts: DataFrame, ledger: DataFrame, secret_totals: DataFrame) -> DataFrame:
    of_ledger = ledger.groupBy("host_id").agg(
        F.count_if(F.col("status").isin(*IMPLICATED)).alias("repos_touched"),
        F.sum("archives").alias("archives"),
    )
    return (
        hosts.select("host_id").distinct()
        .join(of_ledger, "host_id", "left")
        .join(secret_totals.select("host_id", F.col("total").alias("credential_paths")), "host_id", "left")
        .fillna(0, ["repos_touched", "archives", "credential_paths"])
    )


def needed_actions(
    hosts: DataFrame, ledger: DataFrame, secrets: DataFrame, findings: DataFrame
) -> DataFrame:
    rotate = (
        ledger.filter(F.col("status").isin(*IMPLICATED)).select("host_id")
        .unionByName(secrets.select("host_id")).distinct().withColumn("needs_rotate", F.lit(True))
    )
    mitigate = (
        findings.filter(F.col("finding_id").isin(*MITIGATE_IDS)).select("host_id").distinct()
        .withColumn("needs_mitigate", F.lit(True))
    )
    return (
        hosts.select("host_id").distinct()
        .join(rotate, "host_id", "left").join(mitigate, "host_id", "left")
        .fillna(False, ["needs_rotate", "needs_mitigate"])
    )


def _sentence(df: DataFrame, text: Column) -> DataFrame:
    return df.select("host_id", text.alias("limitation"))


def limitations(
    hosts: DataFrame, no_logs: DataFrame, oversized: DataFrame, unhashed: DataFrame,
    untriaged: DataFrame, versions: DataFrame, unscanned: DataFrame | None = None,
) -> DataFrame:
    """What each host's answer does not cover, each sentence once."""
    files = [] if unscanned is None else [
        _sentence(
            unscanned,
            F.format_string("%s: only %d of %d bytes were searched for markers.", "path", "covered", "size"),
        )
    ]
    per_host = untriaged.groupBy("host_id").agg(F.count(F.lit(1)).alias("n"))
    return reduce(
        DataFrame.unionByName,
        [
            _sentence(hosts, F.lit("Only what is still on the host can be seen.")),
            _sentence(no_logs, F.lit("No log files were found; rotated logs leave no trace.")),
            _sentence(
                oversized,
                F.format_string("%s: %d blobs were too large to scan by content.", "repo_path", "oversized"),
            ),
            _sentence(
                unhashed, F.format_string("%d of %d staged archives were not hashed.", "unhashed", "archives")
            ),
            _sentence(per_host, F.format_string("%d affected repositories could not be triaged.", "n")),
            _sentence(versions, F.lit("A version above the reported range is unknown, not clean.")),
            *files,
        ],
    ).distinct()


def error_examples(errors: DataFrame, k: int = 3) -> DataFrame:
    """Up to k errors per host: one that is not a permission denial, then denials, then the rest.

    errors carry ``seq``, their order in the report; those without one come last, by their columns.
    """
    denial = F.col("kind") == "permission"
    order = [F.col("seq").asc_nulls_last(), "detector", "kind", "path", "message"]
    in_kind = Window.partitionBy("host_id", denial).orderBy(*order)
    few = errors.withColumn("nth", F.row_number().over(in_kind)).filter(F.col("nth") <= k)
    rank = F.when(~denial & (F.col("nth") == 1), 0).when(denial, 1).otherwise(2)
    chosen = Window.partitionBy("host_id").orderBy(rank, *order)
    totals = errors.groupBy("host_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        few.withColumn("place", F.row_number().over(chosen))
        .filter(F.col("place") <= k)
        .join(totals, "host_id")
        .withColumn("omitted", F.greatest(F.col("n") - k, F.lit(0)))
        .drop("n", "nth")
    )


def shown_evidence(evidence: DataFrame, k: int = 10) -> DataFrame:
    """The first k evidence rows of each finding and how many more there are.

    A display table; the evidence itself stays whole.
    """
    first = Window.partitionBy(*KEYS).orderBy("path", "locator", "source", "source_line")
    totals = evidence.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return (
        evidence.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k)
        .join(totals, KEYS)
        .withColumn("omitted", F.greatest(F.col("n") - k, F.lit(0)))
        .drop("n")
    )


