"""The query on URLs and its SQL."""

from __future__ import annotations

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.url_filter import PATTERNS, SiteRule, filter_urls

SITES = [
    SiteRule("com", "/en/", "block"),
    SiteRule("example.com", "/en/7", "allow"),
    SiteRule("net", "/de/", "allow"),
    SiteRule("example.net", "/de/8", "block"),
    SiteRule("org", "/es/", "block"),
]


def _sql() -> str:
    sites = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in SITES)
    patterns = ", ".join(f"('{r.name}', '{r.regex}', '{r.verdict}')" for r in PATTERNS)
    return f"""
    WITH sites(h, p, v) AS (VALUES {sites}),
    patterns(name, regex, v) AS (VALUES {patterns}),
    parts AS (
      SELECT page_id,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    urls AS (
      SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM parts),
    site_hits AS (
      SELECT host, path, arg_min(h || p, (-length(h || p), h || p)) AS rule,
        arg_min(v, (-length(h || p), h || p)) AS v
      FROM (SELECT DISTINCT host, path FROM urls), sites
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      GROUP BY host, path),
    pattern_hits AS (
      SELECT host, path, arg_min(name, (v, name)) AS pattern, min(v) AS v
      FROM (SELECT DISTINCT host, path FROM urls), patterns
      WHERE regexp_matches(host || path, regex)
      GROUP BY host, path)
    SELECT page_id, host, path, rule, coalesce(s.v, t.v, 'allow') AS verdict, pattern
    FROM urls LEFT JOIN site_hits s USING (host, path) LEFT JOIN pattern_hits t USING (host, path)
    """


@llm_query(_sql())
def op6_url_filter(spark, sf_dir):
    """Every page URL against the site rules and the patterns."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, SITES).select(
        "page_id", "host", "path", "rule", "verdict", "pattern"
    )
