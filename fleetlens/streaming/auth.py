"""Refusals on the upload leg that follow collection within the grace period."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import events as E
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec

COLLECTION = (E.START, E.ENQUEUED, E.UNKNOWN_UPLOAD, E.SUCCESS)

#: Rows a task holds before it sums them up.
_HELD = 1 << 18


def outermost(slot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's activity the earliest moment per host and slot, and the latest one for the slot after it.

    A refusal that has activity at most a slot's length before it has one of these there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["host_id", "slot"]).aggregate([("low", "min"), ("high", "max")]).rename_columns(names)

        names = ["host_id", "slot", "low", "high"]
        for batch in batches:
            us = pc.cast(batch.column(1), pa.int64())
            # Whole numbers divide towards zero; no log is older than 1970 by more than this.
            at = pc.subtract(pc.divide(pc.add(us, slot << 20), slot), 1 << 20)
            held.append(pa.Table.from_arrays([batch.column(0), at, us, us], names))
            rows += batch.num_rows
            if rows > _HELD:
                held = [summed()]
                if held[0].num_rows > _HELD // 2:
                    yield from _moments(held.pop())
                rows = sum(t.num_rows for t in held)
        if held:
            yield from _moments(summed())

    return run


def _moments(table: pa.Table) -> Iterator[pa.RecordBatch]:
    host, slot, low, high = (table.column(i) for i in range(4))
    stamp = pa.timestamp("us", tz="UTC")
    for at, seen in ((slot, low), (pc.add(slot, 1), high)):
        yield from pa.Table.from_arrays([host, at, seen.cast(stamp)], ["seen_host", "seen_slot", "seen_at"]).to_batches()


def stream_auth_window(
    uploads: DataFrame, refusals: DataFrame, late: str = "1 hour", spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Each refusal that has collection activity of its host in the hour before it.

    An early sign, not the batch answer: the batch job's window runs from the first to the
    last activity of a repository, and so holds refusals between two distant activities too.
    Both sides are watermarked and the time bound limits the state. The join is
    a semi join on hosts and slots as long as the grace period: a refusal comes out once, and
    it meets the outermost activity of its slot and the one before, however much there is.
    Rows later than the watermark are left to the batch job. As an earliest moment stands for its
    whole slot, activity may be later than refusals by a slot.
    """
    grace = refusals.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + {spec.upload_grace}) AS g").first()["g"]
    activity = (
        uploads.filter(F.col("kind").isin(*COLLECTION) & F.col("ts").isNotNull())
        .select("host_id", "ts")
        .mapInArrow(outermost(grace), "seen_host string, seen_slot bigint, seen_at timestamp")
        .withWatermark("seen_at", f"{late} {grace} microseconds")
    )
    failures = (
        refusals.filter((F.col("kind") == E.AUTH_FAIL) & F.col("ts").isNotNull())
        .withWatermark("ts", late)
        .withColumn("slot", F.expr(f"(unix_micros(ts) - pmod(unix_micros(ts), {grace}L)) div {grace}L"))
    )
    return failures.join(
        activity,
        F.expr(f"host_id = seen_host AND slot = seen_slot AND seen_at <= ts AND seen_at >= ts - {spec.upload_grace}"),
        "left_semi",
    ).drop("slot")
