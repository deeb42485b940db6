"""Places in an order, without a task that holds all rows or all rows of one host.

Rows are range-partitioned by the order and written with their rank inside their partition;
the partitions' counts, summed, say where each partition's places begin. A place inside a
host is the distance to the host's first one, so a host of any size spans many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import materialize

_OWN = ("_part", "_row", "_before", "_first")


def placed(rows: DataFrame, *order: Column, within: str = "host_id", name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in ``order`` among the rows of the same ``within``.

    Rows that are equal in all of ``order`` get different places, in any order.
    """
    by = [F.col(within).asc(), *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # Written, so that ranks never change: the id counts the rows of a partition in its lower 33 bits.
    written = materialize(
        ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
        "ranked",
    )
    # One row per partition.
    counts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    ranks = written.join(F.broadcast(begins), "_part").withColumn("_row", F.col("_row") + F.col("_before"))
    firsts = ranks.groupBy(F.col(within).alias("_within")).agg(F.min("_row").alias("_first"))
    return (
        ranks.join(firsts, ranks[within].eqNullSafe(firsts["_within"]))
        .withColumn(name, F.col("_row") - F.col("_first") + 1)
        .drop(*_OWN, "_within")
    )
