"""Content-addressed web archive.

Two tables make an archive. ``records`` holds one row per WARC record: its exact
header block and the digest of its payload. ``payloads`` holds each distinct payload
once, under its SHA-256. The digest is verified when a payload is stored (all rows
of one digest agree in length and SHA-1) and when it is read (it is computed anew
from the stored bytes). The original records come back by joining the two; the
payload table is bucketed by digest, so the join moves headers only.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the
largest id is a response and the others are revisits of it. Defined cases: a null
payload is empty; a null id is smaller than any other, and records that are all
without id, or repeat the largest id, are all responses; an empty table gives an
empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import shared_dir

CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Names of the two tables of an archive."""

    records: str
    payloads: str


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    revisit_bytes: int = 1000,
    buckets: int | None = None,
    date: Column | None = None,
) -> Archive:
    """Write one record per row of ``pages`` and each distinct payload once.

    ``date`` is when a page was fetched, a timestamp; without one, or where it is null, the
    records carry the time of the writing.
    """
    spark = pages.sparkSession
    name = f"warc_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/fleetlens/{name}"
    archive = Archive(f"{name}_records", f"{name}_payloads")
    body = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(*([] if date is None else [date]), F.current_timestamp()).alias("fetched"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        body.groupBy("digest")
        .agg(F.any_value("payload").alias("payload"))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("path", f"{folder}/payloads")
        .bucketBy(buckets, "digest")
        .saveAsTable(archive.payloads)
    )
    facts = body.select(
        "page_id",
        "url",
        "fetched",
        "digest",
        F.length("payload").cast("long").alias("size"),
        F.sha1("payload").alias("sha1"),
    )
    same = facts.groupBy("digest").agg(
        F.max("page_id").alias("holder"),
        F.count_if(F.lit(True)).alias("uses"),
        (F.min(F.struct("size", "sha1")) == F.max(F.struct("size", "sha1"))).alias("verified"),
    )
    shared = same.filter("uses > 1").withColumn(
        "holder",
        F.when(F.col("verified"), F.col("holder")).otherwise(
            F.raise_error(F.lit("payloads of one SHA-256 differ in length or SHA-1"))
        ),
    )
    revisit = (F.col("size") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    records = facts.join(shared.drop("uses", "verified"), "digest", "left").withColumn(
        "revisit", F.coalesce(F.col("holder").isNotNull() & revisit, F.lit(False))
    )
    digest = F.concat(F.lit("sha1:"), "sha1")
    block = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _record_id(F.col("page_id"))),
        _header("WARC-Date", F.date_format(F.to_utc_timestamp("fetched", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        # A line break inside a URL would end the header.
        _header("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]+", "")),
        _header("WARC-Payload-Digest", digest),
        F.when(
            F.col("revisit"),
            F.concat(
                _header(
                    "WARC-Profile",
                    F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ),
                _header("WARC-Refers-To", _record_id(F.col("holder"))),
            ),
        ).otherwise(F.lit("")),
        _header(
            "Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("size").cast("string"))
        ),
        F.lit(CRLF),
    )
    (
        records.select("page_id", block.alias("header"), "digest")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("path", f"{folder}/records")
        .saveAsTable(archive.records)
    )
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: ``page_id``, ``header``, ``record`` (all its bytes) and the full ``payload``."""
    stored = spark.table(archive.payloads).withColumn(
        "payload",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(
            F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary")
        ),
    )
    revisit = header_field("WARC-Type") == "revisit"
    return (
        spark.table(archive.records)
        .join(stored, "digest")
        .select(
            "page_id",
            "header",
            F.concat(
                F.col("header").cast("binary"),
                F.when(revisit, F.lit(b"")).otherwise(F.col("payload")),
                F.lit((CRLF * 2).encode()),
            ).alias("record"),
            "payload",
        )
    )


def header_field(name: str, header: str = "header") -> Column:
    """The value of a header field; null where the record has none."""
    found = F.regexp_extract(F.col(header), f"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)
