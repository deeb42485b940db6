"""Run registered queries beside their SQL and compare the results as multisets."""

from __future__ import annotations

import collections
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    from fleetlens.plans.evidence import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame) -> tuple[list[str], list[str], collections.Counter]:
    columns = sorted(frame.columns)
    frame = frame[columns]
    kinds = ["n" if frame[c].dtype.kind in "iu" else frame[c].dtype.kind for c in columns]
    kinds = [k if k != "T" else "O" for k in kinds]
    # A column with missing whole numbers comes as floats from one engine, as objects from another.
    kinds = ["?" if frame[c].isna().any() else k for c, k in zip(columns, kinds, strict=True)]

    def plain(v) -> str:
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "None"
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    data = collections.Counter(
        tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)
    )
    return columns, kinds, data


def compare(spark, con, run, sql, sf_dir) -> str:
    ours = run(spark, sf_dir).toPandas()
    if sql is None:
        return f"rows-only {len(ours)}"
    theirs = con.execute(sql).df()
    a, b = rows(ours), rows(theirs)
    if a[0] != b[0]:
        return f"COLUMNS {a[0]} != {b[0]}"
    missing, extra = b[2] - a[2], a[2] - b[2]
    if missing or extra:
        return (
            f"DIFF ours={len(ours)} sql={len(theirs)} columns={a[0]}\n"
            f"   only ours {list(extra.items())[:3]}\n   only sql  {list(missing.items())[:3]}"
        )
    if a[1] != b[1]:
        return f"TYPES {list(zip(a[0], a[1], b[1]))}"
    return f"ok {len(ours)}" if len(ours) else "EMPTY"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            result = compare(spark, con, run, oracle.get(name), sf_dir)
        except Exception as err:  # noqa: BLE001
            result = f"ERROR {type(err).__name__} {str(err)[:1200]}"
        good = result.startswith(("ok", "rows-only"))
        bad += not good
        print(f"{'  ' if good else '!!'} {name:32} {time.time() - start:5.1f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
