import hashlib
import re

import pytest

from fleetlens.llm.url_filter import PATTERNS, PatternRule, SiteRule, filter_urls, rule_index, rule_table, url_tokens, with_host_path
from fleetlens.llm.url_queries import SITES
from fleetlens.llm.warc import header_field, read_archive, write_archive

URLS = {
    "http://a.example.com/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
    "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
    "https://EXAMPLE.com/en/": ("example.com", "/en/", "com/en/", "block"),
    "https://example.com/EN/": ("example.com", "/EN/", None, "allow"),
    "x://notcom/en/": ("notcom", "/en/", None, "allow"),
    "x://com/en/": ("com", "/en/", "com/en/", "block"),
    "http://m.example.net/de/81#f": ("m.example.net", "/de/81", "example.net/de/8", "block"),
    "http://net?x/de/": ("net", "", None, "allow"),
    "http://www.ads-track.example.org/fr/1": ("www.ads-track.example.org", "/fr/1", None, "block"),
    "http://ads-track.shop.net/de/1": ("ads-track.shop.net", "/de/1", "net/de/", "allow"),
    "http://myads-tracker.org/": ("myads-tracker.org", "/", None, "allow"),
    "http://h/banners/1": ("h", "/banners/1", None, "block"),
    "no scheme/en/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_urls(spark):
    rows = [(u, 3, "x", "y") for u in [*URLS, *URLS]]
    pages = spark.createDataFrame(rows, "url string, page_id int, rule string, token string")
    got = [(r.url, (r.host, r.path, r.rule, r.verdict)) for r in filter_urls(pages, SITES).collect()]
    assert sorted(got, key=str) == sorted([*URLS.items(), *URLS.items()], key=str)
    assert filter_urls(pages.limit(0), SITES).count() == 0


def test_allowing_patterns_win_and_rules_need_a_token(spark):
    pages = spark.createDataFrame([("http://x.org/ads/ok/1",), ("http://x.org/ads/1",)], "url string")
    patterns = [PatternRule("b", "/ads/", ["ads"], "block"), PatternRule("a", "/ads/ok/", ["ads", "ok"], "allow")]
    got = {r.url[-4:]: r.verdict for r in filter_urls(pages, [], patterns).collect()}
    assert got == {"ok/1": "allow", "ds/1": "block"}
    with pytest.raises(ValueError):
        filter_urls(pages, [], [PatternRule("none", ".*", [], "block")])


def test_index_files_a_rule_under_its_rarest_token(spark):
    pages = spark.createDataFrame([("http://a.com/en/1",), ("http://b.com/en/2",), ("http://c.com/fr/2",)], "url string")
    urls = with_host_path(pages)
    from pyspark.sql import functions as F

    tokens = urls.select(F.explode(url_tokens(F.concat("host", "path"))).alias("token"))
    rules = rule_table(spark, [SiteRule("com", "/en/", "block"), SiteRule("b.com", "/en/", "block")], PATTERNS[:1])
    got = {r.rule: r.token for r in rule_index(tokens, rules).collect()}
    assert got["com/en/"] == "en" and got["b.com/en/"] == "b"


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([("http://x.org/ads/1",)], "url string")
    plan = filter_urls(pages.filter("url <> ''"), SITES)._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and "InPandas" not in plan


def page_rows():
    big, other = "é" * 600, "x" * 1000
    return [
        (1, "http://a/", big), (5, "http://b/\r\nWARC-Type: fake", big), (3, None, big), (None, "u", big),
        (2, "s", "small"), (9, "s", "small"), (7, "n", None), (8, "e", ""),
        (11, "o", other), (10, "o", other), (11, "o", other), (12, "long", "y\r\n\r\n" * 100_000),
        (None, "p", "z" * 2000), (None, "p", "z" * 2000),
    ]


def test_archive_gives_every_record_back(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in page_rows()], "page_id long, url string, html string, digest string")
    archive = write_archive(pages)
    rows = read_archive(spark, archive).withColumns(
        {n: header_field(f"WARC-{n}") for n in ("Type", "Payload-Digest", "Refers-To")}
    ).collect()
    want = []
    for page, _, html in page_rows():
        body = (html or "").encode()
        same = [p for p, _, h in page_rows() if (h or "").encode() == body and p is not None]
        revisit = len(body) >= 1000 and bool(same) and page != max(same)
        want.append((page, body, "revisit" if revisit else "response", f"<urn:page:{max(same)}>" if revisit else None))
    got = [(r.page_id, bytes(r.payload), r.Type, r["Refers-To"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in rows:
        body = b"" if r.Type == "revisit" else bytes(r.payload)
        assert bytes(r.record) == r.header.encode() + body + b"\r\n\r\n"
        assert f"Content-Length: {len(body)}\r\n" in r.header
        assert r["Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest()
    assert spark.table(archive.payloads).count() == len({(h or "") for _, _, h in page_rows()})


def test_archive_notices_a_changed_payload(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 10)], "page_id long, url string, html string")
    archive = write_archive(pages)
    spark.sql(f"SELECT digest, cast('other' AS binary) AS payload FROM {archive.payloads}").createOrReplaceTempView("tampered")
    archive = type(archive)(archive.records, "tampered")
    with pytest.raises(Exception, match="does not have its digest"):
        read_archive(spark, archive).collect()


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archive(spark, write_archive(pages)).count() == 0


def test_every_record_is_dated(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(
        [(1, "http://a/", "x", "2024-02-29 23:30:00"), (2, None, None, None)],
        "page_id long, url string, html string, seen string",
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = read_archive(spark, write_archive(pages, date=F.to_timestamp("seen"))).collect()
        dates = {r.page_id: re.findall("\r\nWARC-Date: ([^\r]*)\r\n", r.header) for r in rows}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert dates[1] == ["2024-03-01T04:30:00Z"]
    assert len(dates[2]) == 1 and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", dates[2][0])
