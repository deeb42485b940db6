"""Running totals along time, without pairing rows.

``totals_at`` answers "what is the sum of all changes up to this moment" for
many moments of many hosts. Changes are first merged per (key, moment). The
total of a moment is the total of the days before, of the minutes before
within the day, and of the moments before within the minute; no group is
larger than one host's days, one day's minutes or one minute's moments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Order of rows that share a timestamp: a window opens before the events at its
# first moment and closes after those at its last.
BEFORE, AT, AFTER = 0, 1, 2


def totals_at(changes: DataFrame, moments: DataFrame, key: str = "host_id") -> DataFrame:
    """changes(key, ts, ord, delta), moments(key, ts, ord) → distinct moments with ``total``."""
    marks = (
        changes.select(key, "ts", "ord", F.col("delta").cast("bigint").alias("delta"), F.lit(False).alias("asked"))
        .unionByName(
            moments.select(key, "ts", "ord", F.lit(0).cast("bigint").alias("delta"), F.lit(True).alias("asked"))
        )
        .groupBy(key, "ts", "ord")
        .agg(F.sum("delta").alias("delta"), F.bool_or("asked").alias("asked"))
        .withColumn("day", F.date_trunc("day", "ts"))
        .withColumn("minute", F.date_trunc("minute", "ts"))
    )
    minutes = marks.groupBy(key, "day", "minute").agg(F.sum("delta").alias("delta"))
    days = minutes.groupBy(key, "day").agg(F.sum("delta").alias("delta"))

    def earlier(order: str, *parts: str):
        w = Window.partitionBy(*parts).orderBy(order)
        return F.coalesce(
            F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )

    day_start = days.select(key, "day", earlier("day", key).alias("day_start"))
    minute_start = (
        minutes.select(key, "day", "minute", earlier("minute", key, "day").alias("minute_start"))
        .join(day_start, [key, "day"])
        .select(key, "minute", (F.col("day_start") + F.col("minute_start")).alias("start"))
    )
    within = Window.partitionBy(key, "minute").orderBy("ts", "ord").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        marks.withColumn("here", F.sum("delta").over(within))
        .filter("asked")
        .join(minute_start, [key, "minute"])
        .select(key, "ts", "ord", (F.col("start") + F.col("here")).alias("total"))
    )
