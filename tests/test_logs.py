import gzip
import io
import json

from pyspark.sql import functions as F

from fleetlens.functions import events as E
from fleetlens.functions import fields as J
from fleetlens.functions.paths import clean_path
from fleetlens.operators import correlate as C
from fleetlens.operators import log_events as L
from fleetlens.session import materialize
from fleetlens.sources import logs as S
from fleetlens.spec import DEFAULT_SPEC as SPEC

LINES = "host_id string, path string, line_no bigint, line string"


def parse(spark, *lines, host="h", path="/l/unified.jsonl"):
    rows = [(host, path, i, s) for i, s in enumerate(lines, 1)]
    return L.parse_log_lines(spark.createDataFrame(rows, LINES))


def event(name, sid="s1", turn=0, repo=None, ts="2026-06-12T10:00:00Z", **more):
    ctx = {"turn_number": turn} if turn is not None else {}
    if repo:
        ctx["repo_path"] = repo
    return json.dumps({"event": f"repo_state.upload.{name}", "sid": sid, "ctx": ctx, "ts": ts, **more})


def refusal(ts, consumer="StorageClient.upload_file"):
    return json.dumps({"msg": "auth 401 attribution", "ctx": {"consumer": consumer}, "ts": ts})


def ledger(spark, *lines):
    events = materialize(L.relevant_events(parse(spark, *lines)), "events")
    rows = C.attributed_rows(events)
    return C.build_ledger(rows), rows, events


def test_damaged_lines_leave_the_others_readable(spark):
    start = '{{"event":"repo_state.upload.start","sid":"{}",{}}}'
    lines = [
        "", "   \t", '"a string"', "17", "true", "{} {", '{"event":', "event=repo_state.upload.start",
        '{"something":"else"}', '{"event":{"deep":[1]}}', "\x01", '{"n":Infinity}',
        start.format("s-text", '"ctx":{"turn_number":"12","repo_path":"/srv/alpha"}'),
        start.format("s-part", '"ctx":{"turn_number":2.5,"repo_path":"/srv/beta"}'),
        start.format("s-flat", '"repo_path":"/srv/gamma"'),
        start.format("s-long", '"ctx":{"repo_path":"/srv/delta"},"pad":"' + "z" * 300_000 + '"'),
        '{"event":"repo_state.upload.enqueued","sid":"s-flat","gcs_path":"gs://k/s-flat/before_codebase.tar.gz?x=1"}',
        '{"event":"repo_state.upload.enqueued","sid":"s-none","gcs_path":"gs://k/s-none/whatever.tar.gz"}',
    ]
    parsed = parse(spark, *lines)
    bad = {r.line_no for r in parsed.filter("not parsed").collect()}
    assert bad == {1, 2, 3, 4, 5, 7, 8, 11, 12}
    table, _, events = ledger(spark, *lines)
    found = {r.repo_path: r for r in table.collect()}
    assert {"/srv/alpha", "/srv/beta", "/srv/gamma", "/srv/delta"} <= set(found)
    assert found["/srv/gamma"].status == "queued"
    assert found["<unattributed>"].low_confidence
    turns = {r.sid: r.turn for r in events.collect()}
    assert turns["s-text"] == 12 and turns["s-part"] is None
    errors = S.log_parse_errors(parsed).collect()
    assert errors[0].message.startswith(f"{len(bad)} of ") and errors[0].material


FIELD_CASES = [
    ('{"event":true,"name":"x"}', "raw", ""),  # the first non-null alias wins, usable or not
    ('{"event":"true"}', "raw", "true"),
    ('{"event":null,"name":"x"}', "raw", "x"),
    ('{"event":1.50}', "raw", "1.50"),
    ('{"event":{"a":1}}', "raw", ""),
    ('{"event":"{braced}"}', "raw", "{braced}"),
    ('{"event":[1]}', "raw", ""),
    ('{"event":"a","event":"b"} trailing', "raw", "b"),
    ('{"ctx.turn":7}', "turn", None),
    ('{"ctx":"{\\"turn\\":7}"}', "turn", None),
    ('{"ctx":{"turn":" 7 "}}', "turn", 7),
    ('{"turn":1e3}', "turn", None),
    ('{"turn":12345678901234567890}', "turn", None),
    ('{"turn":0}', "turn", 0),
    ('{"EVENT":"x"}', "raw", ""),
    ('{"event":1e3}', "raw", "1e3"),
    ('{"sid":"0"}', "sid", "0"),
    ('{"sid":-0}', "sid", "-0"),
    ('{"sid":"1.50"}', "sid", "1.50"),
]


def test_field_access(spark):
    rows = {r.line_no: r for r in parse(spark, *[c[0] for c in FIELD_CASES]).collect()}
    for i, (line, field, want) in enumerate(FIELD_CASES, 1):
        assert rows[i][field] == want, line


def test_times(spark):
    texts = {
        "2024-01-01T00:00:07.179575123Z": 1704067207179575,
        "2024-01-01T02:00:07+02:00": 1704067207000000,
        "2024-01-01T00:00:07": 1704067207000000,
        "2024-01-01 00:00:07.5 +0000 UTC": 1704067207500000,
        "2024-01-01 02:00:07 +0200 CEST": 1704067207000000,
        "2024-01-01 00:00:07": 1704067207000000,
        "1704067207": 1704067207000000,
        "1704067207.25": 1704067207250000,
        "1704067207000": 1704067207000000,
        "1704067207000000": 1704067207000000,
        "1704067207000000000": 1704067207000000,
        "0": None, "-5": None, "soon": None, "2024": 2024000000, "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.unix_micros(J.pick_time(F.col("t"))).alias("us")).collect()
    assert {r.t: r.us for r in got} == texts


def test_event_classes(spark):
    cases = [
        ("repo_state.upload.start", "", 0, "start"),
        ("repo_state.upload.enqueued", "", 200, "enqueued"),
        ("repo_state.upload.done", "", 0, "upload_success"),
        ("put", "StorageClient.put", 204, "upload_success"),
        ("put", "FeedbackClient", 204, "other"),
        ("repo_state.upload.retry", "", 0, "unknown_upload"),
        ("xrepo_state.upload.start", "", 0, "unknown_upload"),
        ("auth 401", "MyUPLOADer", 0, "upload_auth_fail"),
        ("auth 401", "", 0, "other"),
    ]
    df = spark.createDataFrame(cases, "n string, c string, s int, want string")
    got = df.select("want", E.classify_event(F.col("n"), F.col("c"), F.col("s"), SPEC).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_archive_phase(spark):
    cases = {
        "gs://b/s/1/before_codebase.tar.gz": "before",
        "gs://b/s/1/after_codebase.tar.gz?sig=x/y": "after",
        "gs://b/s/1/before_codebase.tar.gz/": "before",
        "gs:\\\\bucket\\s\\before_codebase.tar.gz": "before",
        "gs://b/s/1/something_else.tar.gz": "unknown",
        "": "unknown",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.x for r in df.select("p", E.archive_phase(F.col("p"), SPEC).alias("x")).collect()}
    assert got == cases


def test_clean_path(spark):
    cases = {
        "/a//b/": "/a/b", "/a/./b": "/a/b", "/a/../b": "/b", "/../a": "/a", "a/../..": "..",
        "": ".", "/": "/", "./": ".", "a/b": "a/b", "/a/..": "/", "../../x": "../../x", "/a/b..c": "/a/b..c",
        "/..": "/", "/.git": "/.git",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.x for r in df.select("p", clean_path(F.col("p")).alias("x")).collect()} == cases


def test_correlation_is_global_over_rotated_files(spark):
    old = parse(spark, event("start", repo="/work/api"), path="/l/unified.jsonl.1")
    new = parse(spark, event("enqueued", gcs_path="gs://x"), path="/l/unified.jsonl")
    rows = C.attributed_rows(L.relevant_events(old.unionByName(new)))
    (row,) = C.build_ledger(rows).collect()
    assert (row.repo_path, row.status, row.low_confidence) == ("/work/api", "queued", False)


def test_fallbacks_and_statuses(spark):
    table, rows, _ = ledger(
        spark,
        event("start", sid="a", turn=1, repo="/r/one"),
        event("start", sid="a", turn=2, repo="/r/two"),
        event("enqueued", sid="a", turn=9, repo="/own"),  # session only: the last start, not sure
        event("enqueued", sid="b", turn=1, repo="/own"),  # its own repository
        event("done", sid="a", turn=1, gcs_path="gs://k"),
        event("enqueued", sid="a", turn=1, gcs_path="gs://k"),
        event("enqueued", sid="a", turn=1, gcs_path="gs://other"),
        event("paused", sid="zz", turn=1),
    )
    got = {r.repo_path: r for r in table.collect()}
    assert got["/r/one"].status == "delivered" and got["/r/one"].archives == 2
    assert got["/r/two"].status == "queued" and got["/r/two"].low_confidence
    assert got["/own"].status == "queued" and not got["/own"].low_confidence
    assert got["<unattributed>"].archives == 1
    delivered = {r.gcs_path: r.delivered for r in C.repo_archives(rows).filter("repo_key = '/r/one'").collect()}
    assert delivered == {"gs://k": True, "gs://other": False}


def test_refusals_count_to_the_hour_and_no_further(spark):
    table, _, events = ledger(
        spark,
        event("start", repo="/work/pay", ts="2026-06-12T10:00:00Z"),
        event("enqueued", ts="2026-06-12T10:00:05Z"),
        refusal("2026-06-12T09:59:59Z"), refusal("2026-06-12T10:00:00Z"),
        refusal("2026-06-12T11:00:05Z"), refusal("2026-06-12T11:00:06Z"),
        refusal("2026-06-12T10:30:00Z", consumer="FeedbackClient.update"), refusal("never"),
    )
    (row,) = C.auth_failures_in_window(table, events).collect()
    assert row.upload_auth_failures == 2 and row.status == "queued"
    (s,) = C.auth_summary(events, table).collect()
    assert (s.total, s.in_window, s.out_of_window, s.windows) == (5, 2, 3, 1)


def test_refusals_against_brute_force_with_a_hot_host(spark):
    import random

    rng = random.Random(5)
    base = 1_700_000_000_000_000
    windows = [("hot" if i % 3 else f"h{i}", f"r{i}", base + rng.randrange(10**12)) for i in range(60)]
    windows = [(h, r, a, a + rng.randrange(10**10)) for h, r, a in windows]
    marks = [m for _, _, a, b in windows for m in (a, b + 3_600_000_000)]
    fails = [
        ("hot" if i % 3 else f"h{i % 60}", rng.choice(marks) if i % 4 == 0 else base + rng.randrange(10**12))
        for i in range(500)
    ]
    table = spark.createDataFrame(windows, "host_id string, repo_key string, a bigint, b bigint").select(
        "host_id", "repo_key", F.timestamp_micros("a").alias("first_seen"), F.timestamp_micros("b").alias("last_seen")
    )
    events = spark.createDataFrame(fails, "host_id string, t bigint").select(
        "host_id", F.timestamp_micros("t").alias("ts"), F.lit(E.AUTH_FAIL).alias("kind")
    )
    got = {r.repo_key: r.upload_auth_failures for r in C.auth_failures_in_window(table, events).collect()}
    want = {
        r: sum(1 for fh, t in fails if fh == h and a <= t <= b + 3_600_000_000) for h, r, a, b in windows
    }
    assert got == want
    inside = C.auth_summary(events, table).agg(F.sum("in_window")).collect()[0][0]
    assert inside == sum(
        any(h == fh and a <= t <= b + 3_600_000_000 for h, _, a, b in windows) for fh, t in fails
    )


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i}" if i % 5 else "" for i in range(3000)]
    (tmp_path / "unified.jsonl").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "unified.jsonl.1").write_text("a\n\nb")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = S.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [s for s in lines if s]
    big = {r.line_no: r.line for r in got if r.path.endswith("jsonl")}
    assert big == dict(enumerate(want, 1))
    assert {(r.line_no, r.line) for r in got if r.path.endswith(".1")} == {(1, "a"), (2, "b")}


def test_damaged_gzip_keeps_what_is_readable(spark, tmp_path):
    text = "".join(f'{{"n":{i},"pad":"{i * 7919 % 1000003}"}}\n' for i in range(5000)).encode()
    whole = gzip.compress(text)
    (tmp_path / "ok.gz").write_bytes(whole + gzip.compress(b"second member\n"))
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "no.gz").write_bytes(b"plain text")
    lines, errors = S.read_gz_tolerant(spark, str(tmp_path))
    counts = {r.path.rsplit("/", 1)[1]: r["count"] for r in lines.groupBy("path").count().collect()}
    assert counts["ok.gz"] == 5001 and 0 < counts["cut.gz"] < 5000 and "no.gz" not in counts
    messages = {r.path.rsplit("/", 1)[1]: r for r in errors.collect()}
    assert set(messages) == {"cut.gz", "no.gz"} and all(r.material for r in messages.values())
    assert "truncated after line" in messages["cut.gz"].message
    assert "open failed" in messages["no.gz"].message


def test_discovery_looks_in_the_home_and_in_logs(spark):
    names = [
        ("/u/.grok/unified.jsonl", True), ("/u/.grok/logs/Unified-1.jsonl.2.gz", True),
        ("/u/.grok/logs/deep/unified.jsonl", False), ("/u/.grok/other.jsonl", False),
        ("/u/unified.jsonl", False),
    ]
    rows = [("h", p, p.rsplit("/", 1)[1], False) for p, _ in names]
    inventory = spark.createDataFrame(rows, "host_id string, path string, name string, is_dir boolean")
    homes = spark.createDataFrame([("h", "/u/.grok")], "host_id string, home string")
    got = {r.path for r in S.discover_logs(inventory, homes).collect()}
    assert got == {p for p, want in names if want}


def test_long_lines_are_read_whole_by_both_readers(spark, tmp_path):
    line = '{"pad":"' + "é" * (9 << 20) + '"}'
    for name, write in (("plain", bytes), ("gz", gzip.compress)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"unified.jsonl{'.gz' * (name == 'gz')}").write_bytes(write(f"a\n{line}\r\nb".encode()))
    plain = S.read_log_lines(spark, str(tmp_path / "plain")).collect()
    packed, errors = S.read_gz_tolerant(spark, str(tmp_path / "gz"))
    want = {(1, "a"), (2, line), (3, "b")}
    assert {(r.line_no, r.line) for r in plain} == want == {(r.line_no, r.line) for r in packed.collect()}
    assert errors.count() == 0
    got = list(S._gz_rows("p", io.BytesIO(gzip.compress(b"a\n" + b"x" * 9 + b"\nb\n")), 8))
    assert [r[:2] for r in got] == [("p", 1), ("p", None), ("p", 3)] and "line 2" in got[1][4]


def test_gzip_of_any_size_takes_the_tolerant_path(spark, tmp_path, monkeypatch):
    whole = gzip.compress("".join(f"line {i} {i * 7919 % 1000003}\n" for i in range(50_000)).encode())
    (tmp_path / "ok log.gz").write_bytes(whole + gzip.compress(b"second member\n"))
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "no.gz").write_bytes(b"plain text")

    def read():
        return [sorted(map(tuple, df.collect())) for df in S.read_gz_tolerant(spark, str(tmp_path))]

    in_rows = read()
    monkeypatch.setattr(S, "_ONE_ROW_LIMIT", 0)
    assert read() == in_rows and len(in_rows[0]) > 50_001 and len(in_rows[1]) == 2
    gone = spark.createDataFrame([("p", f"file:{tmp_path}/gone.gz")], "path string, source string")
    (row,) = S.inflate_streams(gone).collect()
    assert row.kind == "io" and "read failed" in row.message


def test_lines_are_read_once_and_not_exchanged(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"unified.jsonl.{i}").write_text("".join(f"{i} {k}\n\n" for k in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = S.read_log_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        # What is left to do reads the written lines, not the text, and moves only counts.
        assert "Format: Text" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        want = sorted((f".{i}", k + 1, f"{i} {k}") for i in range(3) for k in range(400))
        assert sorted((r.path[-2:], r.line_no, r.line) for r in lines.collect()) == want
        monkeypatch.setattr(S, "_FEW_SPLITS", 0)
        assert sorted((r.path[-2:], r.line_no, r.line) for r in S.read_log_lines(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_gzip_files_share_a_batch():
    files = [(f"f{i}", io.BytesIO(gzip.compress(f"a{i}\nb\n".encode()))) for i in range(300)]
    (batch,) = S._gz_batches(files)
    assert batch.num_rows == 600
    assert batch.slice(598).to_pylist() == [
        {"path": "f299", "line_no": n, "line": line, "kind": None, "message": None} for n, line in ((1, "a299"), (2, "b"))
    ]


def test_a_damaged_file_costs_its_neighbours_nothing():
    whole = gzip.compress(b"x\ny\n")
    files = [("a", io.BytesIO(whole)), ("b", io.BytesIO(whole[:-9])), ("c", io.BytesIO(b"")), ("d", io.BytesIO(whole))]
    (batch,) = S._gz_batches(files)
    rows = batch.to_pylist()
    assert [r["path"] for r in rows if r["message"]] == ["b", "c"]
    assert [(r["path"], r["line_no"]) for r in rows if r["line"] and r["path"] in "ad"] == [
        ("a", 1), ("a", 2), ("d", 1), ("d", 2)
    ]
    assert not list(S._gz_batches([]))


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    from fleetlens.plans import evidence as V
    from fleetlens.plans import log_queries as Q

    rows = spark.range(20_000).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 50 AS user_id", "'signup' AS event_type"
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    lines = Q.log_lines(spark, str(tmp_path))
    tasks = lines.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in tasks) < 20_000 / 4
    assert lines.select("line_no").distinct().count() == lines.count() == 20_000
    even = spark.range(0, 20_000, 1, 16).select("id")
    assert V.dealt(even) is even
    few = spark.range(0, 900, 1, 1).select("id")
    assert V.dealt(few) is few
    assert V.dealt(few.limit(0)).count() == 0
