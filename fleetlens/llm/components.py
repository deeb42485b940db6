"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``root`` for every vertex of ``edges`` (long columns ``a`` and ``b``).

    In each round every vertex joins the smallest of itself and its neighbours, and the edges
    are drawn anew between what was joined. Ids in no order along the graph, as written row
    numbers of a hashed table are, leave a fraction of the vertices in each round.
    """
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    mapping = edges.select(F.col("a").alias("vertex")).union(edges.select("b")).distinct()
    mapping = materialize(mapping.withColumn("root", F.col("vertex")), "roots")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        joins = both.groupBy(F.col("a").alias("_from")).agg(F.least(F.min("a"), F.min("b")).alias("_to"))
        joins = materialize(joins, "joins")

        def moved(frame: DataFrame, column: str, joins: DataFrame = joins) -> DataFrame:
            step = frame.join(joins, F.col(column) == F.col("_from"), "left")
            return step.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")

        mapping = materialize(moved(mapping, "root"), "roots")
        edges = materialize(
            moved(moved(edges, "a"), "b").filter("a <> b").distinct(), "edges"
        )
    return mapping
