from dataclasses import fields
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import findings as N
from fleetlens.operators import verdicts as R
from fleetlens.plans import assess as P
from fleetlens.plans import report_queries as Q
from fleetlens.sources.sinks import write_report_json
from fleetlens.spec import DEFAULT_SPEC

FINDINGS = "host_id string, finding_id string, instance string, detector string, severity string, tags array<string>"
ERRORS = "host_id string, seq bigint, detector string, kind string, path string, message string, material boolean"


def verdict(spark, findings, material=None):
    rows = [("h", f"x.{i}", "", "x", s, list(t)) for i, (s, t) in enumerate(findings)]
    errors = [] if material is None else [("h", 1, "x", "io", "", "", material)]
    hosts = spark.createDataFrame([("h",)], "host_id string")
    (row,) = R.verdicts(
        hosts, spark.createDataFrame(rows, FINDINGS), spark.createDataFrame(errors, ERRORS)
    ).collect()
    return row.verdict


@pytest.mark.parametrize(
    ("findings", "material", "want"),
    [
        ([("high", ["exfil"])], None, "EXPOSED"),
        ([("critical", ["exfil", "upload"])], None, "COMPROMISED"),
        ([("medium", ["upload"])], None, "EXPOSED"),
        ([("medium", ["config"])], None, "EXPOSED"),
        ([("high", ["upload"])], True, "COMPROMISED"),
        ([("low", ["install"])], True, "INDETERMINATE"),
        ([("info", [])], False, "CLEAN"),
        ([], None, "CLEAN"),
        ([], True, "INDETERMINATE"),
    ],
)
def test_verdict(spark, findings, material, want):
    assert verdict(spark, findings, material) == want


def test_presence(spark):
    hosts = spark.createDataFrame([(h,) for h in "abcdef"], "host_id string")
    ledger = spark.createDataFrame([("a",)], "host_id string")
    versions = spark.createDataFrame([("b", "high"), ("c", "low")], "host_id string, confidence string")
    found = spark.createDataFrame(
        [("d", "config.absent", "", "config", "medium", []), ("e", "deepscan.file_reference", "", "deepscan", "info", [])],
        FINDINGS,
    )
    queues = spark.createDataFrame([("f",)], "host_id string")
    got = R.presence(hosts, ledger, versions, found, queues).filter("product_present").collect()
    assert {r.host_id for r in got} == {"a", "b", "d", "f"}


def test_error_examples(spark):
    rows = [("h", i, "x", k, "", "", False) for i, k in enumerate(
        ["permission", "permission", "io", "permission", "timeout", "io"])]
    rows += [("few", 0, "x", "io", "", "", False), ("few", 1, "x", "io", "", "", False)]
    shown = R.error_examples(spark.createDataFrame(rows, ERRORS)).collect()
    assert sorted((r.place, r.seq) for r in shown if r.host_id == "h") == [(1, 2), (2, 0), (3, 1)]
    assert {r.omitted for r in shown if r.host_id == "h"} == {3}
    assert len([r for r in shown if r.host_id == "few"]) == 2


def test_every_finding_id_is_declared_once():
    assert len(N.FINDINGS) == 23
    upload = {f for f, (_, tags) in N.FINDINGS.items() if "upload" in tags}
    assert upload == {"logs.upload_confirmed", "logs.raw_bucket_reference", "logs.unknown_upload_event"}
    assert not any("exfil" in t for f, (_, t) in N.FINDINGS.items() if f.startswith(("secrets", "config")))


SMALL = "/root/testdata/sf0.001"


def test_assessment_and_custom_detector(spark, tmp_path):
    def detector(ev, spec):
        rows = ev.hosts.limit(1)
        return N.Found(
            N.finding_rows(rows, "logs.upload_confirmed", F.lit("from outside")),
            N.evidence_rows(rows, "logs.upload_confirmed", note="mine"),
        )

    def broken(ev, spec):
        raise ValueError("boom")

    P.register_detector("outside", detector)
    P.register_detector("broken", broken)
    try:
        ev = Q.evidence_tables(spark, SMALL)
        cut = ev.file_inventory.filter((F.col("name") == DEFAULT_SPEC.queue_dir) & F.col("is_dir")).select(
            "host_id", F.col("path").alias("queue"), F.lit("stopped early").alias("message")
        )
        report = P.assess(spark, replace(ev, interrupted_queues=cut))
    finally:
        P.unregister_detector("outside")
        P.unregister_detector("broken")
    write_report_json(report.tables(), str(tmp_path / "out"))
    hosts = spark.read.json(str(tmp_path / "out/host_report"))
    assert hosts.filter("verdict = 'CLEAN'").count() == 0  # the broken detector degrades every host
    ids = {r.finding_id for r in report.findings.select("finding_id").distinct().collect()}
    assert {"logs.archive_enqueued", "queue.present", "config.not_mitigated", "secrets.in_head"} <= ids
    assert report.findings.filter("title = 'from outside'").count() == 1
    titles = report.findings.filter("finding_id = 'queue.present'").select("title").collect()
    assert any("at least" in r.title or "not enumerated" in r.title for r in titles)
    assert report.errors.filter("message = 'stopped early' AND material").count() == cut.distinct().count()
    assert report.repos.filter("secrets_scanned IS NULL").count() == 0
    assert report.errors.filter("kind = 'panic'").count() == report.host_report.count()
    # No planted secret got into any table.
    values = [r.v for r in Q.Z.git_evidence(spark, SMALL).filter("t_id % 9 = 0").select(
        F.regexp_extract("t_content", "(ghp_[0-9a-zA-Z]{36})", 1).alias("v")).collect()]
    written = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out"))
    text = "\n".join(r.value for r in written.collect())
    assert len(values) > 10 and "secrets.in_head" in text
    assert not any(v in text for v in values)


def test_a_detector_that_fails_or_hangs_costs_itself_only(spark):
    def late(ev, spec):
        @F.udf("string")
        def fail(host):
            raise ValueError("in a task")

        rows = ev.hosts.select(fail("host_id").alias("host_id"))
        return N.Found(N.finding_rows(rows, "logs.upload_confirmed", F.lit("no")), N.evidence_rows(rows, "logs.upload_confirmed"))

    def endless(ev, spec):
        @F.udf("string")
        def wait(host):
            import time

            time.sleep(300)
            return host

        rows = ev.hosts.select(wait("host_id").alias("host_id"))
        return N.Found(N.finding_rows(rows, "logs.upload_confirmed", F.lit("no")), N.evidence_rows(rows, "logs.upload_confirmed"))

    def good(ev, spec):
        return N.Found(
            N.finding_rows(ev.hosts, "logs.upload_confirmed", F.lit("mine")), N.evidence_rows(ev.hosts, "logs.upload_confirmed")
        )

    hosts = spark.createDataFrame([("a",), ("b",)], "host_id string")
    none = {f.name: hosts.limit(0) for f in fields(P.EvidenceTables)}
    P.register_detector("late", late)
    P.register_detector("endless", endless, seconds=3)
    P.register_detector("good", good)
    try:
        found, failures = P._run_detectors(P.EvidenceTables(**{**none, "hosts": hosts}), DEFAULT_SPEC)
    finally:
        for name in ("late", "endless", "good"):
            P.unregister_detector(name)
    assert [f.findings.count() for f in found] == [2]
    rows = {(r.host_id, r.detector): r.message for r in failures.collect()}
    assert set(rows) == {(h, d) for h in "ab" for d in ("late", "endless")}
    assert "not done after 3 seconds" in rows["a", "endless"]
    # What runs afterwards is in no group of a detector's.
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_places_span_partitions(spark):
    import random

    from fleetlens.operators.ordering import placed

    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "host_id string, n int, i int").repartition(7)
    got = {(r.host_id, r.n, r.i): r.place for r in placed(df, F.col("n").desc(), F.col("i").asc()).collect()}
    want = {}
    for host in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == host), key=lambda r: (-r[1], r[2]))
        want.update({r: k for k, r in enumerate(own, 1)})
    assert got == want
    assert placed(df.limit(0), F.col("n").asc()).count() == 0


def test_error_examples_do_not_depend_on_the_layout(spark):
    from fleetlens.operators import verdicts as R

    rows = [("h", None, "d", "io", f"/p{i}", "m", True) for i in range(9)] + [("h", 4, "z", "io", "/q", "m", True), ("h", 5, "z", "permission", "/r", "m", True)]
    df = spark.createDataFrame(rows, "host_id string, seq bigint, detector string, kind string, path string, message string, material boolean")
    for n in (1, 5):
        got = R.error_examples(df.repartition(n)).orderBy("place").collect()
        assert [r.path for r in got] == ["/q", "/r", "/p0"] and got[0].omitted == 8


def test_presence_projects_files_and_contents_once(spark):
    from fleetlens.plans import CATALOG

    result = CATALOG["product_presence"].run(spark, "/root/testdata/sf0.001")
    given = [f.rsplit("/", 1)[-1] for f in result.inputFiles()]
    assert "lineitem.parquet" not in given and "pages.parquet" not in given


def test_tables_read_several_times_are_written(spark):
    from fleetlens.plans import report_queries as Y

    small = "/root/testdata/sf0.001"
    ev = Y.evidence_tables(spark, small)
    read = [f for t in (ev.file_inventory, ev.file_content, ev.manifests, ev.collector_errors) for f in t.inputFiles()]
    assert read and not [f for f in read if "testdata" in f]
    for made in (Y.config_found, Y.version_found, Y.marked_found):
        found = made(spark, small)
        assert not [f for d in (found.findings, found.evidence) for f in d.inputFiles() if "testdata" in f]
