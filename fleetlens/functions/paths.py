"""Path arithmetic on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.spec import UNATTRIBUTED


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(path.rlike(r"^/[^/]*$"), "/").otherwise(cut)


def extension(path: Column) -> Column:
    """From the last dot of the last segment, '' without one."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def join_path(directory: Column, *names: str) -> Column:
    return F.concat(directory, *[F.lit("/" + n) for n in names])


# An empty, ``.`` or ``..`` segment, or a trailing slash.
_UNCLEAN = r"//|(^|/)\.\.?(/|$)|[^/]/$|^$"


def clean_path(path: Column) -> Column:
    """Lexical cleaning: repeated and trailing slashes, ``.`` and ``..``.

    Most paths are clean already and are returned as they are.
    """
    return F.when(~path.rlike(_UNCLEAN), path).otherwise(_cleaned(path))


def _cleaned(path: Column) -> Column:
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        can_drop = (F.size(done) > 0) & (F.when(F.size(done) > 0, last) != "..")
        return (
            F.when(part != "..", F.concat(done, F.array(part)))
            .when(can_drop, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    folded = F.when(
        path.contains(".."),
        F.aggregate(parts, F.array().cast("array<string>"), step),
    ).otherwise(parts)
    joined = F.array_join(folded, "/")
    return (
        F.when(absolute, F.concat(F.lit("/"), joined))
        .when(joined == "", ".")
        .otherwise(joined)
    )


def plain_path(uri: Column) -> Column:
    """The path of a file as its host names it, from the URI that a reader reports."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def normalize_repo(path: Column, case_insensitive: Column) -> Column:
    cleaned = clean_path(path)
    return F.when(path == UNATTRIBUTED, path).otherwise(
        F.when(case_insensitive, F.lower(cleaned)).otherwise(cleaned)
    )


def display_path(path: Column, home: Column) -> Column:
    """Home-relative form for people; locators are never passed through here."""
    return (
        F.when((home == "") | (path == ""), path)
        .when(path == home, "~")
        .when(
            path.startswith(F.concat(home, F.lit("/"))),
            F.concat(F.lit("~"), F.substr(path, F.length(home) + 1)),
        )
        .otherwise(path)
    )


def under_dir(path: Column, segment: str) -> Column:
    return F.array_contains(F.split(F.lower(path), "/"), segment.lower())


def ancestors(path: Column) -> Column:
    """The path itself and its parents up to ``/``, nearest first."""
    cleaned = clean_path(path)
    slashes = F.length(cleaned) - F.length(F.replace(cleaned, F.lit("/")))
    below_root = F.transform(
        F.sequence(F.when(cleaned == "/", 1).otherwise(slashes + 1), F.lit(2), F.lit(-1)),
        lambda n: F.call_function("substring_index", cleaned, F.lit("/"), n),
    )
    every = F.when(cleaned == "/", F.array(F.lit("/"))).otherwise(
        F.concat(below_root, F.array(F.lit("/")))
    )
    return F.when(path.startswith("/"), every).otherwise(
        F.array().cast("array<string>")
    )


def prefixes_ending_in(path: Column, segment: str) -> Column:
    """The directories on the path that are named ``segment``, case-insensitively."""
    parts = F.split(path, "/")
    at = F.filter(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.lower(F.get(parts, i - 1)) == segment.lower(),
    )
    return F.transform(at, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def home_of(path: Column, home_dir: str) -> Column:
    """The nearest directory on the path that is named like a product home."""
    escaped = home_dir.replace(".", r"\.")
    return F.regexp_extract(path, rf"^(.*/{escaped})(?:/.*)?$", 1)
