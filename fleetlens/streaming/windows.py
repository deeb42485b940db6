"""Refusals inside the windows of a host's repositories, as the batch job defines them, on a stream.

A repository's window runs from its first activity to the grace period after its last
one, so a refusal long after an activity is inside as soon as the repository is active
again. Per host the state holds each repository's first and last activity, the refusals
that no window holds yet, and the events younger than the watermark, which are dealt with
in time order once the watermark has passed them.

What bounds the state: events wait for the watermark's delay at most; refusals that no
window came to hold within ``keep`` are given up as outside; a repository that was silent
for ``keep`` is forgotten, and a later activity opens a new window. With ``keep`` at least
the span of the data the answers are those of the batch job.
"""

from __future__ import annotations

import heapq
import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions import events as E
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec
from fleetlens.streaming.auth import COLLECTION

_OUT = "host_id string, ts_us bigint, failures bigint, in_window boolean"
#: The state store that keeps state by column families, which this needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Events of a chunk. Chunks that overlap in time are open side by side, so they are small.
_CHUNK = 500
#: Decisions given out at once.
_HELD = 10_000


class Windows(StatefulProcessor):
    """Per host: ``waiting`` events, ``repos`` and ``pending`` refusals by moment.

    A call of the state store costs far more than an event, so waiting events are kept in chunks:
    in time order, under the moment of the first, as JSON lists (moment, is a refusal, repository, how many).
    """

    def __init__(self, grace_us: int, keep_us: int):
        self._grace, self._keep = grace_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "ts bigint, id string", "events string")
        self._repos = handle.getMapState("repos", "repo string", "first bigint, last bigint")
        self._pending = handle.getMapState("pending", "ts bigint", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        latest = 0
        for frame in rows:
            # Equal moments of a repository are one entry; refusals have no repository.
            sizes = frame[frame["ts_us"] >= mark].groupby(["ts_us", "repo_key"], sort=False).size()
            # An activity opens its window before the refusals of its moment.
            events = sorted((int(ts), repo == "", repo, int(n)) for (ts, repo), n in sizes.items())
            if events:
                self._wait(events)
                latest = max(latest, events[-1][0])
        if latest:
            self._handle.registerTimer(latest // 1000 + 1)
        yield _rows([])

    def _wait(self, events: list[tuple]) -> None:
        for i in range(0, len(events), _CHUNK):
            chunk = events[i : i + _CHUNK]
            self._waiting.updateValue((chunk[0][0], uuid.uuid4().hex), (json.dumps(chunk, ensure_ascii=False),))

    def _chunk(self, place: tuple[int, str], mark: int) -> Iterator[tuple]:
        """The chunk's events before ``mark``; it leaves the state, and its later events go back."""
        # Comes before the chunk's events, which are read when time has come to them.
        yield place[0], False, "", 0
        events = [tuple(e) for e in json.loads(self._waiting.getValue(place)[0])]
        self._waiting.removeKey(place)
        due = bisect_left(events, (mark,))
        self._wait(events[due:])
        yield from events[:due]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        places = [tuple(p) for p in self._waiting.keys() if p[0] < mark]
        if not places:
            yield _rows([])
            return
        due = in_order([self._chunk(p, mark) for p in places])
        repos = {k[0]: v for k, v in self._repos.iterator()}
        pending = dict(sorted((k[0], v[0]) for k, v in self._pending.iterator()))
        was, had = dict(repos), dict(pending)
        out = decide(due, repos, pending, self._grace, self._keep)
        while rows := list(islice(out, _HELD)):
            yield _rows([(key[0], *r) for r in rows])
        for repo in was.keys() - repos.keys():
            self._repos.removeKey((repo,))
        for repo, span in repos.items():
            if was.get(repo) != span:
                self._repos.updateValue((repo,), span)
        for ts in had.keys() - pending.keys():
            self._pending.removeKey((ts,))
        for ts in pending.keys() - had.keys():
            self._pending.updateValue((ts,), (pending[ts],))


def in_order(chunks: list[Iterator[tuple]]) -> Iterator[tuple[int, bool, str, int]]:
    """The events of all chunks in time order, equal moments of a repository as one."""
    for (ts, refused, repo), same in groupby(heapq.merge(*chunks), itemgetter(0, 1, 2)):
        # Without either it is where a chunk begins.
        if refused or repo:
            yield ts, refused, repo, sum(e[3] for e in same)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["host_id", "ts_us", "failures", "in_window"])


def decide(due, repos: dict, pending: dict, grace: int, keep: int) -> Iterator[tuple[int, int, bool]]:
    """Go through events (moment, is a refusal, repository, how many) in time order; change the state, yield what is decided."""
    # Every window opened before the moment at hand, so the latest activity tells whether one is open.
    latest = max((last for _, last in repos.values()), default=None)
    for now, refused, repo, n in due:
        if refused:
            if latest is not None and now <= latest + grace:
                yield now, n, True
            elif repos:
                pending[now] = n
            else:
                # Windows that open later do not reach back.
                yield now, n, False
            continue
        latest = now
        if repo not in repos:
            repos[repo] = (now, now)
        else:
            first, last = repos[repo]
            repos[repo] = (first, now)
            # The pending refusals are in time order, too.
            while now > last + grace and pending and next(reversed(pending)) >= first:
                yield *pending.popitem(), True
    for at in [at for at in pending if at < now - keep]:
        yield at, pending.pop(at), False
    for repo in [r for r, (_, last) in repos.items() if last < now - keep]:
        del repos[repo]


def stream_windows(
    rows: DataFrame, late: str = "2 hours", keep: str = "90 days", spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """Refusal moments (``host_id``, ``ts_us``, ``failures``, ``in_window``) as soon as they are decided.

    ``rows`` are attributed events with ``host_id``, ``repo_key``, ``kind`` and ``ts``. A refusal that
    is still pending may yet come to lie inside a window and is not given out.
    """
    spark = rows.sparkSession
    spark.conf.set(*STORE)
    seconds = spark.sql(f"SELECT {spec.upload_grace} AS g, INTERVAL {keep} AS k").select(
        *[(F.expr(f"unix_micros(timestamp_seconds(0) + {c})")).alias(c) for c in ("g", "k")]
    ).first()
    wanted = (
        rows.filter(F.col("ts").isNotNull() & F.col("kind").isin(*COLLECTION, E.AUTH_FAIL))
        .withColumn("repo_key", F.when(F.col("kind") == E.AUTH_FAIL, "").otherwise(F.col("repo_key")))
        .withWatermark("ts", late)
        # Without ``ts``: pandas would count it in nanoseconds, which end in 2262.
        .select("host_id", "repo_key", F.unix_micros("ts").alias("ts_us"))
    )
    return wanted.groupBy("host_id").transformWithStateInPandas(
        Windows(seconds["g"], seconds["k"]), _OUT, "Append", "EventTime"
    )
