"""URL filters [native]: pattern rules indexed by their rarest literal token.

Each rule carries a regular expression and the literal tokens that every matching
URL holds as whole tokens. A rule is filed under the one of them that the fewest
URLs hold; the tokens of a URL fetch the rules filed under them, and only those
run their expression. Rules are rows, so a large rule set is joined by hash like
any table; nothing is broadcast by hand.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule, so it is allowed. URLs that occur often are judged once. Repeated
rows give repeated results. Of the site rules that fit, the longest wins, then the
smallest text; a site rule wins over the patterns; of patterns that fit, one that
allows wins over any that blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile("[0-9a-z]+")


@dataclass(frozen=True)
class SiteRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"^(?:[^/]*\.)?\Q{self.host}\E(?=/|$)\Q{self.path}\E"

    @property
    def tokens(self) -> list[str]:
        """Whole tokens of every match; the last one of the path may go on in the URL."""
        text = self.name.lower()
        ends_open = bool(self.path) and text[-1:].isalnum()
        found = [m for m in _TOKEN.finditer(text)]
        return [m.group() for m in found if not (ends_open and m.end() == len(text))]


@dataclass(frozen=True)
class PatternRule:
    """``regex`` is searched in host + path; ``tokens`` are literals between separators in every match."""

    name: str
    regex: str
    tokens: list[str]
    verdict: str


#: Labels of advertising and spam hosts, and path segments of advertisements.
PATTERNS = [
    PatternRule(f"host:{label}", rf"^(?:[^/]*\.)?{label}\.", label.split("-"), "block")
    for label in ("ads-track", "cheap-pills", "casino-win", "adserver", "doubleclick", "popunder")
] + [
    PatternRule(f"path:/{part}/", rf"/{part}/", [part], "block")
    for part in ("adclick", "banners", "sponsored")
]


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path`` of the URL."""
    after = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    has = F.coalesce(F.contains(F.col(url), F.lit("://")), F.lit(False))
    host = F.when(has, F.translate(F.regexp_extract(after, "^[^/?#]*", 0), _UPPER, _LOWER))
    path = F.when(has, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1))
    return pages.withColumns(
        {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))}
    )


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.lower(target), "[^0-9a-z]+"))


def rule_table(spark: SparkSession, sites: list[SiteRule], patterns: list[PatternRule]) -> DataFrame:
    rows = [(r.name, r.regex, r.tokens, r.verdict, True) for r in sites]
    rows += [(r.name, r.regex, r.tokens, r.verdict, False) for r in patterns]
    for name, _, tokens, _, _ in rows:
        if not tokens:
            raise ValueError(f"rule {name} has no literal token to be indexed by")
    return spark.createDataFrame(
        rows, "rule string, regex string, tokens array<string>, verdict string, is_site boolean"
    )


def rule_index(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule, with the one of its tokens that the fewest URLs hold."""
    literals = rules.select("rule", "regex", "verdict", "is_site", F.explode("tokens").alias("token"))
    held = (
        tokens.join(literals.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("urls"))
    )
    return (
        literals.join(held, "token", "left")
        .groupBy("rule", "regex", "verdict", "is_site")
        .agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    )


def filter_urls(
    pages: DataFrame,
    sites: list[SiteRule],
    patterns: list[PatternRule] | None = None,
    url: str = "url",
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the site rule that won), ``pattern`` and ``verdict``.

    Columns of ``pages`` with these names are replaced.
    """
    spark = pages.sparkSession
    rules = rule_table(spark, sites, PATTERNS if patterns is None else patterns)
    own = ["host", "path", "rule", "pattern", "verdict"]
    pages = pages.drop(*[c for c in own if c != url])
    urls = with_host_path(pages.select(F.col(url).alias("_url")).distinct(), "_url")
    urls = urls.filter(F.col("_url").isNotNull()).withColumn("_target", F.concat("host", "path"))
    tokens = urls.select("_url", "_target", F.explode(url_tokens(F.col("_target"))).alias("token"))
    found = (
        tokens.join(rule_index(tokens.select("token"), rules), "token")
        .filter(F.expr("_target rlike regex"))
        .groupBy("_url")
        .agg(
            F.min(
                F.when(
                    F.col("is_site"),
                    F.struct((-F.length("rule")).alias("n"), "rule", F.col("verdict").alias("v")),
                )
            ).alias("site"),
            F.min(
                F.when(~F.col("is_site"), F.struct(F.col("verdict").alias("v"), "rule"))
            ).alias("pattern"),
        )
        .select(
            "_url",
            F.col("site.rule").alias("rule"),
            F.col("pattern.rule").alias("pattern"),
            F.coalesce("site.v", "pattern.v").alias("verdict"),
        )
    )
    joined = pages.join(found, pages[url] == found["_url"], "left").drop("_url")
    return with_host_path(joined, url).withColumn(
        "verdict", F.coalesce("verdict", F.lit("allow"))
    )
