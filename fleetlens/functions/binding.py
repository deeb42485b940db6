"""Computed-once columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters refer to instead of copying their expressions.

    The optimizer pushes a filter through a projection by writing the projected
    expression into the filter, once per reference. Large expressions used by
    several others then multiply. A one-row generator ends that: its output is
    computed once per row and conditions on it stay above it.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(row)).alias("_bound")).select(
        *kept, *[F.col("_bound").getField(n).alias(n) for n in columns]
    )
