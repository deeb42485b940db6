import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import growing as G
from fleetlens.streaming.windows import decide

HOUR = 3_600_000_000


def numbered(rows):
    """What a batch reader would number: ended lines that are not empty."""
    lines = [x.rstrip(b"\r").decode() for x in rows.split(b"\n")[:-1]]
    return list(enumerate((x for x in lines if x), 1))


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_ranges_share_no_line(size, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 3)
    data = b"one\n\ntwo two\r\nthree\nopen"
    cuts = [*range(0, len(data), size), len(data)]
    got = [x for a, b in zip(cuts[:-1], cuts[1:]) for x in G.ended_lines(io.BytesIO(data), a, b)]
    assert got == data.split(b"\n")[:-1]


def test_growing_files(spark, tmp_path):
    root, state, out = tmp_path / "in", tmp_path / "state", {}
    (root / "h").mkdir(parents=True)

    def step():
        def keep(batch, batch_id):
            out[batch_id] = [(r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in G.number_growth(batch, batch_id, str(state)).collect()]
            # A repeated batch finds the same.
            again = [(r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in G.number_growth(batch, batch_id, str(state)).collect()]
            assert sorted(again) == sorted(out[batch_id])

        lines = G.read_growing(spark, str(root), task_bytes=50)
        lines.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/c").trigger(availableNow=True).start().awaitTermination()
        return [x for i in sorted(out) for x in out[i]]

    a = b"".join(b"line %d %s\r\n\n" % (i, b"x" * (i % 40)) for i in range(30))
    b = b"half a li"
    (root / "h/a").write_bytes(a)
    (root / "h/b").write_bytes(b)
    assert sorted(step()) == sorted(("a", *x) for x in numbered(a))
    more, rest = b"\nnext\nlast", b"ne\nsecond\n"
    (root / "h/a").write_bytes(a + more)
    (root / "h/b").write_bytes(b + rest)
    (root / "h/c").write_bytes(b"new\n")
    want = [("a", *x) for x in numbered(a + more)] + [("b", *x) for x in numbered(b + rest)] + [("c", 1, "new")]
    assert sorted(step()) == sorted(want)
    # Nothing new, then a file that was replaced by a shorter one.
    assert sorted(step()) == sorted(want)
    (root / "h/b").write_bytes(b"anew\n")
    assert sorted(step()) == sorted([*want, ("b", 1, "anew")])
    # Only the last versions of the counts are kept.
    assert len(list((state / "lines").iterdir())) <= 2


def in_windows(events):
    """Moments of refusals inside the window of any repository, from the definition."""
    spans = {}
    for ts, refused, repo, _ in events:
        if not refused:
            first, last = spans.get(repo, (ts, ts))
            spans[repo] = min(first, ts), max(last, ts)
    return {ts for ts, refused, _, _ in events if refused and any(a <= ts <= b + HOUR for a, b in spans.values())}


@pytest.mark.parametrize("seed", range(12))
def test_decisions_equal_the_definition(seed):
    rng = random.Random(seed)
    moments = sorted({rng.randrange(60) * HOUR // 4 for _ in range(rng.randrange(1, 50))})
    events = sorted((t, rng.random() < 0.5, "", 1) if rng.random() < 0.5 else (t, False, rng.choice("abc"), 1) for t in moments)
    events = [(t, r, "" if r else repo or "d", n) for t, r, repo, n in events]
    repos, pending, found = {}, {}, []
    at = 0
    while at < len(events):
        step = rng.randrange(1, 9)
        found += decide(events[at : at + step], repos, pending, HOUR, 10**18)
        at += step
    assert {t for t, _, inside in found if inside} == in_windows(events)
    outside = {t for t, _, inside in found if not inside} | set(pending)
    assert outside == {t for t, r, _, _ in events if r} - in_windows(events)


def test_what_is_old_leaves_the_state():
    repos, pending = {}, {}
    keep = 10 * HOUR
    found = list(decide([(0, False, "a", 1), (2 * HOUR, True, "", 3)], repos, pending, HOUR, keep))
    assert found == [] and pending == {2 * HOUR: 3}
    found = list(decide([(20 * HOUR, False, "b", 1)], repos, pending, HOUR, keep))
    assert found == [(2 * HOUR, 3, False)] and set(repos) == {"b"} and not pending


def test_the_state_is_small_and_reported(spark, tmp_path):
    from fleetlens.functions import events as E
    from fleetlens.streaming.windows import stream_windows

    rows = [(f"h{i % 3}", "r", E.START if i % 2 else E.AUTH_FAIL, i * 600) for i in range(400)]
    df = spark.createDataFrame(rows, "host_id string, repo_key string, kind string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    cuts = [0, 60_000, 120_000, 180_000, 10**7]
    late = df.limit(1).select(F.lit("").alias("host_id"), "repo_key", F.lit(E.START).alias("kind"), F.timestamp_seconds(F.lit(10**6)).alias("ts"))
    for a, b in zip(cuts[:-1], cuts[1:]):
        df.filter((F.unix_seconds("ts") >= a) & (F.unix_seconds("ts") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = (
        stream_windows(arriving, late="2 hours", keep="1 day").writeStream.format("parquet").outputMode("append")
        .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in stream.recentProgress if p.stateOperators]
    # Two hours of events wait, besides a window and a timer per host.
    assert max(held) <= 250 and held[-1] <= 12, held
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.filter("in_window").count() > 150


def random_events(rng, n):
    from fleetlens.functions import events as E

    kinds = [E.START, E.ENQUEUED, E.UNKNOWN_UPLOAD, E.SUCCESS, E.AUTH_FAIL]
    return [
        (
            f"h{rng.randrange(9)}", f"/l/{rng.randrange(3)}", i, rng.choice(kinds), rng.choice(["", "s1", "s2"]),
            rng.choice([None, 1, 2]), rng.choice(["", "/r/A", "/r/a", "/r/b//"]), rng.choice(["", "gs://x"]),
            rng.choice([None, 1_700_000_000 + rng.randrange(10**6)]), rng.random() < 0.5,
        )
        for i in range(n)
    ]


_EVENT = "host_id string, path string, line_no bigint, kind string, sid string, turn bigint, repo string, gcs_path string, s bigint, case_insensitive boolean"


def test_the_ledger_of_sums_is_the_batch_ledger(spark, tmp_path):
    from fleetlens.operators.correlate import attributed_rows, build_ledger
    from fleetlens.streaming import ledger as L

    rows = random_events(random.Random(4), 600)
    rows = [(*r[:9], int(r[0][1:]) % 2 == 0) for r in rows]
    events = spark.createDataFrame(rows, _EVENT).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    root, buckets = str(tmp_path), {}
    # The last batch has one host only, and late starts for it.
    parts = [events.filter("line_no < 200"), events.filter("line_no >= 200 AND host_id <> 'h3'"), events.filter("line_no >= 200 AND host_id = 'h3'"), events.limit(0)]
    read = []
    for i, part in enumerate(parts):
        read.append(L.merge_batch(part, i, root))
        # A batch that runs again changes nothing and reads the same.
        assert L.merge_batch(part, i, root) == read[-1]
    assert read[0] == [] and len(read[2]) == 1 and read[3] == []
    # Only the touched bucket's current version is read.
    (own,) = {r.bucket for r in parts[2].select(L._bucket()).distinct().collect()}
    assert read[2][0].endswith(f"bucket={own}")
    want = build_ledger(attributed_rows(events))
    got = L.current_ledger(spark, root)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Versions that were replaced are gone.
    kept = sum(1 for _ in (tmp_path / "versions").glob("batch=*/bucket=*"))
    now = len(L._manifest(spark, root, 3))
    assert kept <= now + 1 and len(list((tmp_path / "manifests").iterdir())) == 2


def test_refusal_windows_of_parts_in_many_files(spark):
    """More files in a part than one batch used to take: none of its rows may count as late."""
    from compare import compare, connect
    from fleetlens.plans import CATALOG

    small = "/root/testdata/sf0.001"
    own = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        query = CATALOG["stream_refusal_windows"]
        assert compare(spark, connect(small), query.run, query.sql, small).startswith("ok")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def events_at(path, years_users_kinds):
    """Rows of ``events`` whose log lines are of host 3, so many years after 2024, with a repository per user."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = []
    for years, user, kind in years_users_kinds:
        # An epoch in milliseconds; every thirteenth event names no repository.
        n = round(years * 365.25 * 86400 / 260) // 24 * 24 + 1
        rows.append({"event_id": n + 24 * (n % 13 == 0), "user_id": 3 + 37 * user, "event_type": kind, "value": 0.0, "props": "{}"})
    table = pa.Table.from_pylist(rows)
    pq.write_table(table.append_column("ts", pa.array([0] * len(rows), pa.timestamp("us"))), path)


@pytest.mark.parametrize(
    "events, found",
    [
        # Moments that nanoseconds from 1970 do not reach, at both ends of windows.
        ([(0, 0, "signup"), (280, 0, "error"), (296, 0, "signup"), (296.5, 0, "error")], 1),
        # A repository silent for more than a century, while others go on.
        ([(0, 0, "signup"), (0.5, 0, "error"), (110, 1, "signup"), (110.5, 1, "signup"), (150, 0, "signup")], 1),
    ],
)
def test_refusal_windows_over_centuries(spark, tmp_path, events, found):
    import duckdb
    from compare import rows
    from fleetlens.plans import CATALOG

    events_at(tmp_path / "events.parquet", events)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    query = CATALOG["stream_refusal_windows"]
    ours, theirs = query.run(spark, str(tmp_path)).toPandas(), con.execute(query.sql).df()
    assert rows(ours) == rows(theirs) and len(ours) == found


def test_chunks_come_in_time_order_and_are_read_late():
    from fleetlens.streaming.windows import in_order

    rng, opened = random.Random(3), []
    events = sorted((rng.randrange(300), repo == "", repo, 1) for repo in rng.choices(["", "a", "b"], k=400))

    def chunk(part):
        yield part[0][0], False, "", 0
        opened.append(part[0][0])
        yield from part

    # Three that lie side by side in time, and one that overlaps with all.
    parts = [events[::4], *([e for i, e in enumerate(events) if i % 4 and a <= e[0] < a + 100] for a in (0, 100, 200))]
    got = in_order([chunk(p) for p in parts])
    seen = [next(got)]
    assert max(opened) < 100
    seen += got
    want = Counter(e[:3] for e in events)
    assert seen == [(*place, want[place]) for place in sorted(want)] and len(opened) == 4


def state_calls(spark, tmp_path, n):
    """What the state store was called for by ``n`` events of one host."""
    from fleetlens.functions import events as E
    from fleetlens.streaming.windows import stream_windows

    rows = spark.range(n).select(
        F.lit("h").alias("host_id"), F.lit("r").alias("repo_key"),
        F.when(F.col("id") % 2 == 0, E.START).otherwise(E.AUTH_FAIL).alias("kind"), F.timestamp_seconds(F.col("id") + 10**9).alias("ts"),
    )
    late = rows.limit(1).select(F.lit("").alias("host_id"), "repo_key", "kind", F.timestamp_seconds(F.lit(2 * 10**9)).alias("ts"))
    rows.unionByName(late).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    stream = (
        stream_windows(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in{n}")).writeStream.format("parquet")
        .option("path", f"{tmp_path}/out{n}").option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out{n}").filter("in_window").count() == n // 2
    return sum(p.stateOperators[0].numRowsUpdated + p.stateOperators[0].numRowsRemoved for p in stream.recentProgress if p.stateOperators)


def test_the_state_store_is_not_called_for_each_event(spark, tmp_path):
    assert state_calls(spark, tmp_path, 4000) < 400


def test_outermost_activity_decides():
    import pyarrow as pa

    from fleetlens.streaming.auth import outermost

    rng = random.Random(1)
    seen = [(rng.choice("ab"), rng.randrange(-3 * HOUR, 40 * HOUR)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([h for h, _ in seen]), pa.array([t for _, t in seen]).cast(pa.timestamp("us", tz="UTC"))], ["host_id", "ts"]
    )
    kept = [r for out in outermost(HOUR)(iter([batch.slice(0, 100), batch.slice(100)])) for r in out.to_pylist()]
    assert len(kept) <= 2 * len({(h, t // HOUR) for h, t in seen}) < 2 * len(seen)
    moments = {(r["seen_host"], r["seen_slot"], round(r["seen_at"].timestamp() * 1e6)) for r in kept}
    for t in range(-4 * HOUR, 42 * HOUR, HOUR // 7):
        for host in "abc":
            want = any(h == host and t - HOUR <= at <= t for h, at in seen)
            assert want == any(h == host and slot == t // HOUR and t - HOUR <= at <= t for h, slot, at in moments)
