"""Line dedup [native]: lines that many sites share are boilerplate.

The number of distinct sites of a line is estimated by a HyperLogLog sketch per line
hash, merged by aggregation, so a line's state stays small however many sites hold it.
Where the estimate is near the threshold, the sites are counted exactly. A line at or
over the threshold stays in the document with the smallest id and goes from all others,
so a group of copies keeps one whole text.

Defined cases: lines are compared without spaces, tabs and returns around them; a line
of fewer than ``min_words`` words is never removed; a null site is a site of its own,
shared with the empty one; a null text stays null; a document whose lines all go has an
empty text; a line held only by documents without id stays in them; repeated
rows are treated alike; columns of the input with the names of the added ones are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize


@dataclass(frozen=True)
class LineRule:
    """``margin``: relative distance from ``min_sites`` within which sites are counted exactly."""

    min_sites: int = 5
    min_words: int = 3
    margin: float = 0.25
    lg_k: int = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _line_key(line: Column) -> Column:
    return F.unhex(F.md5(_trimmed(line)))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def line_table(docs: DataFrame, rule: LineRule, doc_id: str, text: str, site: str) -> DataFrame:
    """A row per document and distinct line: hash, site, and the document's id and text digest."""
    long_enough = F.expr(f"array_size(split(line, '[ \t\r]+')) >= {rule.min_words}")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(site), F.lit("")).alias("site"),
        _text_key(F.col(text)).alias("text_key"),
        F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _trimmed))).alias("line"),
    )
    return rows.filter(long_enough).withColumn("line", F.unhex(F.md5("line")))


def boilerplate(lines: DataFrame, rule: LineRule) -> DataFrame:
    """The lines of at least ``min_sites`` sites, with ``keeper``, the smallest id that holds each."""
    low, high = rule.min_sites * (1 - rule.margin), rule.min_sites * (1 + rule.margin)
    spread = materialize(
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("site", rule.lg_k).alias("sketch"), F.min("doc_id").alias("keeper"))
        .select("line", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= low),
        "spread",
    )
    near = spread.filter(F.col("sites") <= high).select("line", "keeper")
    counted = (
        lines.join(near.select("line"), "line", "left_semi")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("exact"))
        .filter(F.col("exact") >= rule.min_sites)
    )
    return near.join(counted.select("line"), "line").unionByName(
        spread.filter(F.col("sites") > high).select("line", "keeper")
    )


def dedup_lines(
    docs: DataFrame,
    rule: LineRule = LineRule(),
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, plus ``n_lines`` and ``n_removed_lines``."""
    lines = materialize(line_table(docs, rule, doc_id, text, site), "lines")
    gone = (
        lines.join(boilerplate(lines, rule), "line")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
        .agg(F.collect_set("line").alias("_gone"))
    )
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    joined = docs.select(*columns).join(
        gone,
        F.col(doc_id).eqNullSafe(F.col("_doc")) & (_text_key(F.col(text)) == F.col("_key")),
        "left",
    )
    all_lines = _lines(F.col(text))
    left = F.when(
        F.col("_gone").isNotNull(),
        F.filter(all_lines, lambda x: ~F.array_contains("_gone", _line_key(x))),
    )
    return (
        joined.withColumns({"_left": left, "n_lines": F.coalesce(F.array_size(all_lines), F.lit(0))})
        .withColumns(
            {
                "n_lines": F.col("n_lines").cast("long"),
                "n_removed_lines": F.coalesce(F.col("n_lines") - F.array_size("_left"), F.lit(0).cast("long")),
                text: F.coalesce(F.array_join("_left", "\n"), F.col(text)),
            }
        )
        .select(*columns, "n_lines", "n_removed_lines")
    )
