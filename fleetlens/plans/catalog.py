"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import configure

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None
    covers: str


CATALOG: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register the function under its own name; ``covers`` lists survey items."""

    def register(fn: Run) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        assert fn.__name__ not in CATALOG, fn.__name__
        CATALOG[fn.__name__] = Query(run, sql, covers)
        return fn

    return register


def us(ts: str | Column, name: str) -> Column:
    """A timestamp as microseconds, -1 when unknown."""
    return F.coalesce(F.unix_micros(ts), F.lit(-1).cast("bigint")).alias(name)


def known(value: str | Column, name: str, default=-1) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column, F.lit(default)).alias(name)


def long(value: Column, name: str) -> Column:
    return value.cast("bigint").alias(name)
