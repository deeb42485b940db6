"""Small values for reports, and entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon_entropy(s: Column) -> Column:
    """Character frequencies over the *byte* length, as the thresholds expect."""
    chars = F.split(s, "")
    size = F.octet_length(s).cast("double")

    def term(total: Column, c: Column) -> Column:
        f = F.size(F.filter(chars, lambda x: x == c)) / size
        return total - f * F.log2(f)

    return F.when(s == "", 0.0).otherwise(
        F.aggregate(F.array_distinct(chars), F.lit(0.0), term)
    )


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    units = "KMGTPE"
    for i, unit in enumerate(units, start=1):
        shown = F.format_string("%.1f " + unit + "B", n / F.lit(float(1024**i)))
        out = out.when(n < 1024 ** (i + 1), shown) if i < len(units) else out.otherwise(shown)
    return out


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def collected_window(first: Column, last: Column) -> Column:
    return (
        F.when(first.isNull() & last.isNull(), "-")
        .when(first.isNull(), day(last))
        .when(last.isNull() | (day(first) == day(last)), day(first))
        .otherwise(F.concat(day(first), F.lit(" -> "), day(last)))
    )


def archive_note(phase: Column, sid: Column, turn: Column, ts: Column) -> Column:
    """Only what the event carried: an absent turn is not printed as turn 0."""
    return F.concat_ws(
        ", ",
        F.concat(phase, F.lit("-turn archive queued for upload")),
        F.when(sid != "", F.concat(F.lit("session "), sid)),
        F.concat(F.lit("turn "), turn.cast("string")),
        rfc3339(ts),
    )


def archive_provenance(
    sid: Column, turn: Column, ts: Column, log_file: Column, log_line: Column
) -> Column:
    citation = F.when(
        log_file != "",
        F.when(log_line > 0, F.concat_ws(":", log_file, log_line.cast("string"))).otherwise(
            log_file
        ),
    )
    return F.concat_ws(
        "   ",
        F.when(sid != "", F.concat(F.lit("session "), sid)),
        F.concat(F.lit("turn "), turn.cast("string")),
        rfc3339(ts),
        citation,
    )


def short_id(sha: Column) -> Column:
    return F.substring(sha, 1, 12)


def plural(n: Column, noun: str) -> Column:
    many = noun[:-1] + "ies" if noun.endswith("y") else noun + "s"
    return F.concat(n.cast("string"), F.when(n == 1, " " + noun).otherwise(" " + many))
