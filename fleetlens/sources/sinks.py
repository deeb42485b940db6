"""Report tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_nulls(df: DataFrame) -> DataFrame:
    """Empty arrays instead of missing ones; other missing values are left out of the JSON."""
    arrays = {n: t for n, t in df.dtypes if t.startswith("array")}
    return df.withColumns(
        {n: F.coalesce(F.col(n), F.array().cast(t)) for n, t in arrays.items()}
    )


def write_report_json(tables: dict[str, DataFrame], root: str) -> None:
    """Each report table as JSON lines below ``root``; the host report by verdict.

    Lists that grow with the evidence are rows of their own table, joined by
    ``host_id``, so that no host's record has to fit into one task.
    """
    for name, df in tables.items():
        writer = without_nulls(df).write
        if name == "host_report":
            writer = writer.partitionBy("verdict")
        writer.json(f"{root}/{name}")
