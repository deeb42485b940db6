from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import filekind as K
from fleetlens.functions import text as T
from fleetlens.functions import versions as V
from fleetlens.functions.paths import ancestors, display_path
from fleetlens.operators import config_audit as A
from fleetlens.operators import disk as D
from fleetlens.operators import version_evidence as W
from fleetlens.sources import files as S
from fleetlens.sources.files import manifest_scan, read_content_chunks
from fleetlens.spec import DEFAULT_SPEC as SPEC

INVENTORY = (
    "host_id string, path string, name string, is_dir boolean, is_regular boolean, size bigint, head4 binary"
)


def inventory(spark, *rows):
    """rows (path, kind d|f|l, size, head)"""
    return spark.createDataFrame(
        [("h", p, p.rsplit("/", 1)[1], k == "d", k == "f", s, h) for p, k, s, h in rows], INVENTORY
    )


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()[0].y


def test_file_kinds(spark):
    cases = [
        (b"\x7fELF", "/a/x", "elf"), (b"\xca\xfe\xba\xbf", "/a/x", "mach-o"), (b"MZ\x90\x00", "/a/x", "pe"),
        (b"MZ", "/a/x", "pe"), (b"#!", "/a/x.txt", "script"), (b"abcd", "/a/x.MJS", "script"),
        (b"abcd", "/usr/Bin/x", "script"), (b"abcd", "/usr/lib/x", "none"), (b"", "/sbin/x", "script"),
        (b"\x7fEL", "/a/x.dat", "none"),
    ]
    df = spark.createDataFrame(cases, "h binary, p string, want string")
    got = df.select("want", K.file_kind(F.col("h"), F.col("p")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_markers_at_every_alignment(spark):
    marker = SPEC.bucket.encode()
    rows = [("h", f"/f{i}", b"\xc3\xa9" * 3 + b"." * i + marker + b"tail" + marker) for i in range(40)]
    whole = spark.createDataFrame(rows, "host_id string, path string, content binary")
    got = {r.path: r.offset for r in D.marker_scan(whole).collect()}
    assert got == {f"/f{i}": 6 + i for i in range(40)}
    overlap = max(map(len, SPEC.markers)) - 1
    pieces = [
        (h, p, s, c[s : s + 16 + overlap]) for h, p, c in rows for s in range(0, len(c), 16)
    ]
    chunks = spark.createDataFrame(pieces, "host_id string, path string, start bigint, content binary")
    assert {r.path: r.offset for r in D.marker_scan_chunks(chunks).collect()} == got


def test_queues_archives_and_candidates(spark):
    inv = inventory(
        spark,
        ("/u/.grok", "d", 0, b""), ("/u/.grok/upload_queue", "d", 0, b""),
        ("/u/.grok/upload_queue/1/metadata.json", "f", 5, b"{"), ("/u/.grok/upload_queue/1/a.TGZ", "f", 7, b""),
        ("/u/.grok/upload_queue/before_codebase.tar.gz", "f", 9, b""),
        ("/u/x/my_codebase.tar.gz", "f", 11, b""), ("/m/upload_queue", "d", 0, b""),
        ("/m/upload_queue/z.tgz", "f", 3, b""), ("/opt/Grok", "f", 100, b"zzzz"), ("/opt/y.png", "f", 5, b"\x7fELF"),
        ("/opt/link", "l", 5, b"\x7fELF"), ("/opt/empty", "f", 0, b"\x7fELF"), ("/opt/tool", "f", 600_000, b"\x7fELF"),
        ("/u/.grok/upload_queue/run", "f", 5, b"#!/b"),
    )
    hosts = spark.createDataFrame([("h", "/u/.grok")], "host_id string, home string")
    homes = D.discovered_homes(inv, hosts)
    queues = D.upload_queues(inv, homes)
    files = D.files_in_queues(inv, queues)
    got = {r.queue: (r.files, r.bytes) for r in D.queue_inventory(queues, files).collect()}
    assert got == {"/u/.grok/upload_queue": (4, 26), "/m/upload_queue": (0, 0)}
    archives = D.staged_archives(inv, files)
    assert {r.path for r in archives.collect()} == {
        "/u/.grok/upload_queue/1/a.TGZ", "/u/.grok/upload_queue/before_codebase.tar.gz", "/u/x/my_codebase.tar.gz",
    }
    assert {r.path: r.kind for r in D.scan_candidates(inv).collect()} == {"/opt/Grok": "none", "/opt/tool": "elf"}
    assert D.stray_homes(homes, hosts).count() == 0


def test_nearest_repository(spark):
    inv = inventory(
        spark, ("/w/.git", "d", 0, b""), ("/w/sub/mod/.git", "f", 9, b""), ("/other/.git", "l", 0, b""),
    )
    paths = spark.createDataFrame(
        [("h", p) for p in ("/w/a/b.py", "/w/sub/mod", "/w/sub/mod/x", "/w", "rel/x", "/none", "/w/sub/../q")],
        "host_id string, path string",
    )
    got = {r.path: r.repo_path for r in D.repo_root_of(paths, D.git_repositories(inv)).collect()}
    assert got == {
        "/w/a/b.py": "/w", "/w/sub/mod": "/w/sub/mod", "/w/sub/mod/x": "/w/sub/mod", "/w": "/w", "/w/sub/../q": "/w",
    }
    assert one(spark, ancestors, "/a/b/") == ["/a/b", "/a", "/"]
    assert one(spark, ancestors, "/") == ["/"]


def test_manifest_strings(spark):
    text = '{"a":"/x/1","b":{"k:":["/x/2",{"c":"q\\"uo\\\\te"}]},"n":1,"e":"","f":"end:" , "u":"\\u00e9"}'
    rows = [("h", "/q/metadata.json", "metadata.json", text), ("h", "/q/2/metadata.json", "metadata.json", '{"a":"/lost"')]
    df = spark.createDataFrame(rows, "host_id string, path string, name string, text string")
    assert {r.path for r in D.manifest_paths(df).collect()} == {"/x/1", "/x/2", 'q"uo\\te', "", "end:", "é"}


def test_active_install_takes_the_first_entry(spark):
    installs = spark.createDataFrame([("h", "/opt/v1/grok"), ("h", "/opt/v2/grok")], "host_id string, path string")
    entries = "host_id string, ord bigint, entry string, resolved string"
    lookup = spark.createDataFrame(
        [("h", 1, "/bin/grok", "/opt//v2/./grok"), ("h", 2, "/opt/v1/grok", "/opt/v1/grok")], entries
    )
    (row,) = D.active_install(installs, lookup).collect()
    assert (row.path, row.path_entry) == ("/opt/v2/grok", "/bin/grok")
    elsewhere = spark.createDataFrame([("h", 1, "/bin/grok", "/snap/grok"), ("h", 2, "/opt/v1/grok", "/x")], entries)
    assert D.active_install(installs, elsewhere).count() == 0


def test_versions(spark):
    cases = {
        "0.2.93": V.CONFIRMED, "v0.2.93": V.CONFIRMED, " 0.2.99\n": V.REPORTED, "0.2.100": V.UNKNOWN,
        "0.1.500": V.REPORTED, "0.3.0": V.UNKNOWN, "1.0.0": V.UNKNOWN, "0.2": V.UNKNOWN,
        "0.2.93-rc.1": V.CONFIRMED, "latest": V.UNKNOWN,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.c for r in df.select("v", V.classify_version(F.col("v"), SPEC).alias("c")).collect()} == cases
    files = spark.createDataFrame(
        [
            ("h", "/u/.grok/version", "0.2.93\n"), ("h", "/u/.grok/VERSION", "soon"),
            ("h", "/o/package.json", '{"name":"left-pad","version":"1.0.0"}'),
            ("h", "/p/package.json", '{"name":"@xai/grok","version":"0.2.50"}'),
            ("h", "/u/.grok/install.json", '{"version":5}'), ("h", "/u/.grok/manifest.json", '{"version":"0.2.1"}'),
        ],
        "host_id string, path string, text string",
    )
    got = {(r.version, r.source, r["class"]) for r in W.versions_from_manifests(files).collect()}
    assert got == {
        ("0.2.93", "manifest:version", V.CONFIRMED), ("0.2.50", "manifest:package.json", V.REPORTED),
        ("0.2.1", "manifest:manifest.json", V.REPORTED),
    }
    body = b"\x00GROK-build v0.2.93\x01xgrok 1\x00\"version\": \"3.2.1\"\x00" + b"." * 5000 + b"grok/9.9.9\x00short"
    binaries = spark.createDataFrame([("h", "/b", body)], "host_id string, path string, content binary")
    assert {r.version for r in W.versions_from_binaries(binaries).collect()} == {"0.2.93", "3.2.1", "9.9.9"}


def test_report_values(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 1048576: "1.0 MB", 5 * 1024**3: "5.0 GB",
             2**60: "1.0 EB"}
    df = spark.createDataFrame([(k,) for k in sizes], "n bigint")
    assert {r.n: r.s for r in df.select("n", T.human_bytes(F.col("n")).alias("s")).collect()} == sizes
    shown = {"/u": "~", "/u/x": "~/x", "/ux": "/ux", "": ""}
    df = spark.createDataFrame([(k,) for k in shown], "p string")
    assert {r.p: r.s for r in df.select("p", display_path(F.col("p"), F.lit("/u")).alias("s")).collect()} == shown


FLAG = "disable_codebase_upload"


# text: the upload flag is on, the trace flag is off, the file is not to be trusted
CONFIGS = {
    f"[harness]\n{FLAG} = true\n[telemetry]\ntrace_upload = false": (True, True, False),
    f"telemetry.trace_upload=false\nharness.{FLAG}=true": (True, True, False),
    f"[ 'harness' ]\n\t'{FLAG}' = True, # why\r\n": (True, False, False),
    f"[harness]\n{FLAG} = true\n{FLAG} = false": (False, False, False),
    f"[harness]\n#{FLAG} = true": (False, False, False),
    f"{FLAG} = true": (False, False, False),
    f"[other]\n{FLAG} = true\ntrace_upload = false": (False, False, False),
    f"[harness]\na = \'\'\'\n{FLAG} = true\n\'\'\' \n[telemetry]\ntrace_upload = false": (False, True, False),
    f'[harness]\na = """b""" # c\n{FLAG} = true': (True, False, False),
    f'[harness]\na = "q \\" # q"\n{FLAG} = true': (True, False, False),
    f"[harness]\na = 'q\\' # ' {FLAG}\n{FLAG} = true": (True, False, False),
    f'[harness]\na = \\" # "\n{FLAG} = true': (True, False, False),
    f"[harness]\n{FLAG} = 1": (False, False, True),
    f'[harness]\n{FLAG} = true\na = """': (True, False, True),
    f"[[harness]]\n{FLAG} = true": (False, False, True),
    "[telemetry\ntrace_upload = false": (False, False, True),
    "telemetry": (False, False, True),
    "": (False, False, False),
}


def test_config_reader_fails_closed(spark):
    rows = spark.createDataFrame([(t,) for t in CONFIGS], "t string").select(
        "t", A.config_state(F.col("t")).alias("s")
    )
    for r in rows.collect():
        on, off = r.s["values"].get(f"harness.{FLAG}"), r.s["values"].get("telemetry.trace_upload")
        assert (on == "true", off == "false", r.s["uncertain"]) == CONFIGS[r.t], r.t


def test_long_config_is_uncertain(spark):
    homes = spark.createDataFrame([("a", "/u/.grok")], "host_id string, home string")
    text = f"[harness]\n{FLAG} = true\n[telemetry]\ntrace_upload = false\n" + "# x\n" * (SPEC.max_config_bytes // 4)
    files = spark.createDataFrame(
        [("a", "/u/.grok/config.toml", "ok", text)], "host_id string, path string, status string, text string"
    )
    (state,) = A.homes_configs(homes, files)[0].select(A.overall_state().alias("s")).collect()
    assert state.s == "uncertain"


def test_config_states_and_errors(spark):
    homes = spark.createDataFrame([(h, "/u/.grok") for h in "abc"], "host_id string, home string")
    files = spark.createDataFrame(
        [("a", "/u/.grok/config.toml", "ok", f"[harness]\n{FLAG} = true\n[telemetry]\ntrace_upload = false\nz = 1"),
         ("b", "/u/.grok/config.toml", "unreadable", None)],
        "host_id string, path string, status string, text string",
    )
    states, errors = A.homes_configs(homes, files)
    got = {r.host_id: r.s for r in states.select("host_id", A.overall_state().alias("s")).collect()}
    assert got == {"a": "mitigated", "b": "uncertain", "c": "missing"}
    assert [(r.host_id, r.material) for r in errors.collect()] == [("b", True)]
    (others,) = A.other_config_keys(states).collect()
    assert others.others == ["telemetry.z"]


def test_long_manifests_and_version_files_are_read_whole(spark):
    pad = "x" * SPEC.max_manifest_bytes
    long = '{"pad":"%s","path":"/x/behind","to":"%s"}' % (pad, SPEC.bucket)
    rows = [("h", "/q/1/metadata.json", "metadata.json", long), ("h", "/q/2/metadata.json", "metadata.json", long[:-1])]
    df = spark.createDataFrame(rows, "host_id string, path string, name string, text string")
    assert {r.path for r in manifest_scan(df).collect()} == {"/q/1/metadata.json", "/q/2/metadata.json"}
    assert {r.path for r in D.manifest_paths(df).collect()} == {pad, "/x/behind", SPEC.bucket}
    (error,) = D.manifest_errors(df).collect()
    assert error.path == "/q/2/metadata.json" and error.material
    files = [("h", "/u/.grok/install.json", '{"pad":"%s","version":"0.2.93"}' % pad), ("h", "/u/.grok/manifest.json", long[:-1])]
    files = spark.createDataFrame(files, "host_id string, path string, text string")
    assert {r.version for r in W.versions_from_manifests(files).collect()} == {"0.2.93"}
    assert [r.path for r in W.version_file_errors(files).collect()] == ["/u/.grok/manifest.json"]


def test_large_candidates_are_searched_in_pieces(spark, tmp_path):
    import hashlib

    marker = SPEC.bucket.encode()
    body = b"\x7fELF" + b"." * 3000 + marker + b"." * 3000
    (tmp_path / "big tool").write_bytes(body)
    path = str(tmp_path / "big tool")
    inv = inventory(
        spark, (path, "f", len(body), b"\x7fELF"), ("/opt/huge", "f", 600 << 20, b"\x7fELF"), ("/opt/cut", "f", 900, b"\x7fELF"),
    )
    candidates = D.scan_candidates(inv)
    assert {r.path for r in candidates.collect()} == {path, "/opt/huge", "/opt/cut"}
    chunks = read_content_chunks(spark, str(tmp_path), F.lit("h"), larger_than=1000, piece=777)
    assert chunks.count() > 3
    none = spark.createDataFrame([], "host_id string, path string, content binary")
    (row,) = D.marked_files(candidates, none, SPEC, chunks).collect()
    assert (row.path, row.offset, row.size, row.kind) == (path, 3004, len(body), "elf")
    assert row.sha256 == hashlib.sha256(body).hexdigest()
    small = replace(SPEC, max_candidate_bytes=800)
    left = {r.path: r.covered for r in D.unscanned_candidates(candidates, none, small, chunks).collect()}
    assert left == {"/opt/huge": 0, "/opt/cut": 0}
    # A piece that misses is neither digested over nor counted as searched.
    holed = chunks.filter(F.col("start") != 777 * 2)
    (row,) = D.marked_files(candidates, none, SPEC, holed).collect()
    assert row.sha256 is None
    assert {r.path: r.covered for r in D.unscanned_candidates(candidates, none, small, holed).collect()}[path] < 777 * 2 + 100


@pytest.mark.parametrize("piece, overlap", [(40, 0), (41, 3), (64, 30), (10_000, 0)])
def test_versions_in_pieces(spark, piece, overlap):
    """Runs and versions that cross borders, at every place; digits cut by a border give no other version."""
    bodies = [b"\x00" * i + b"GROK-build v0.2.93" + b"." * i + b"\x01" + b'"version": "13.22.111"' + b"x" * (i % 7) for i in range(0, 80, 3)]
    bodies += [b"grok 1.2.3", b"\x00grok 1.2.3\x00", b"." * 300 + b"grok/4.5.67"]
    whole = spark.createDataFrame([("h", f"/b{i}", bytearray(b)) for i, b in enumerate(bodies)], "host_id string, path string, content binary")
    rows = [
        ("h", f"/b{i}", at, bytearray(b[at : at + piece + overlap]))
        for i, b in enumerate(bodies)
        for at in range(0, len(b), piece)
    ]
    pieces = spark.createDataFrame(rows, "host_id string, path string, start bigint, content binary")
    want = sorted(map(tuple, W.versions_from_binaries(whole).distinct().collect()))
    assert sorted(map(tuple, W.versions_from_chunks(pieces).collect())) == want
    assert len(want) == 2 * (len(bodies) - 3) + 3


def test_a_gap_between_pieces_joins_nothing(spark):
    rows = [("h", "/b", 0, bytearray(b"......grok 1.2")), ("h", "/b", 100, bytearray(b".3......"))]
    pieces = spark.createDataFrame(rows, "host_id string, path string, start bigint, content binary")
    assert W.versions_from_chunks(pieces).count() == 0


def test_repository_above_any_depth(spark):
    roots = ["/r", "/r/" + "/".join("d" * 3 for _ in range(40))]
    deep = {80: roots[1], 500: roots[1], 30: roots[0]}
    paths = [("h", "/r" + "/ddd" * n + "/file") for n in deep] + [("h", "/elsewhere" + "/d" * 90)]
    got = D.repo_root_of(
        spark.createDataFrame(paths, "host_id string, path string"),
        spark.createDataFrame([("h", r) for r in roots], "host_id string, repo_path string"),
    )
    assert sorted(r.repo_path for r in got.collect()) == sorted(deep.values())


def test_walk_sees_hidden_names_links_and_failures(spark, tmp_path):
    (tmp_path / "h1/.grok/upload_queue").mkdir(parents=True)
    (tmp_path / "h1/.grok/bin").mkdir()
    (tmp_path / "h1/.grok/bin/grok").write_bytes(b"\x7fELF\x02rest")
    (tmp_path / "h1/a b").mkdir()
    (tmp_path / "h1/a b/one").write_bytes(b"x")
    (tmp_path / "h1/loop").symlink_to(tmp_path / "h1")
    (tmp_path / "h2").mkdir()
    (tmp_path / "top").write_bytes(b"")
    host = F.regexp_extract("path", f"^{tmp_path}/([^/]+)", 1)
    for rounds in (0, 1, 2, 5):
        rows = S.read_file_inventory(spark, str(tmp_path), host, rounds).collect()
        got = {r.path.removeprefix(f"{tmp_path}/"): r for r in rows}
        assert len(got) == len(rows)
        assert {p for p, r in got.items() if r.is_dir} == {
            "h1", "h2", "h1/.grok", "h1/.grok/upload_queue", "h1/.grok/bin", "h1/a b"
        }
        assert {p: (r.size, bytes(r.head4)) for p, r in got.items() if r.is_regular} == {
            "h1/.grok/bin/grok": (9, b"\x7fELF"), "h1/a b/one": (1, b"x"), "top": (0, b"")
        }
        assert not got["h1/loop"].is_dir and not got["h1/loop"].is_regular
        assert got["h1/.grok/bin"].host_id == "h1" and {r.error for r in rows} == {None}
    (failed,) = S.read_file_inventory(spark, str(tmp_path / "none"), F.lit("h"), 1).collect()
    assert failed.is_dir and "none" in failed.error


def _large_tables(spark, folder):
    """Tables of one row group each, with 20,000 rows of files and of manifests."""
    spark.range(20_000).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "cast(id % 7 AS int) AS l_linenumber",
        "cast(id AS double) AS l_extendedprice",
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(20_000).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "'5-LOW' AS o_orderpriority"
    ).coalesce(1).write.parquet(f"{folder}/orders.parquet")


def test_paths_and_texts_are_made_after_the_rows_are_dealt_out(spark, tmp_path):
    from fleetlens.plans import disk_queries as K

    _large_tables(spark, tmp_path)
    repos = D.git_repositories(K.inventory(spark, str(tmp_path)))
    plan = repos._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "/.git" not in below and "/.git" in plan
    named = D.manifest_paths(K.manifests(spark, str(tmp_path)))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "files" not in below and plan.count('"files"') + plan.count('{"files') <= 2
    assert repos.count() == repos.distinct().count() > 0 and named.count() > 0


def test_repository_roots_read_manifests_and_inventory_once(spark, tmp_path):
    from fleetlens.plans import CATALOG

    _large_tables(spark, tmp_path)
    files = CATALOG["repo_root_of"].run(spark, str(tmp_path)).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]
