"""Version strings: where they come from and what they mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.paths import basename
from fleetlens.spec import IndicatorSpec

# Patterns a version must match.
SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:[-+][0-9A-Za-z.\-]+)?\z"
_JSON_VERSION = r'(?i)"version"[\t\n\f\r ]*:[\t\n\f\r ]*"(\d+\.\d+\.\d+)"'

CONFIRMED = "CONFIRMED_AFFECTED"
REPORTED = "REPORTED_AFFECTED"
UNKNOWN = "UNKNOWN"


def plausible_version(version: Column) -> Column:
    return version.rlike(SEMVER)


def classify_version(version: Column, spec: IndicatorSpec) -> Column:
    """There is no safe class: whatever is not known to be affected is unknown."""
    text = F.regexp_replace(version, r"^\s+|\s+$", "")
    major, minor, patch = (
        F.regexp_extract(text, SEMVER, g).try_cast("bigint") for g in (1, 2, 3)
    )
    c_major, c_minor, c_patch = spec.confirmed_version
    r_major, r_minor, r_patch = spec.reported_max
    return (
        F.when(~text.rlike(SEMVER), UNKNOWN)
        .when((major == c_major) & (minor == c_minor) & (patch == c_patch), CONFIRMED)
        .when((major == r_major) & (minor == r_minor) & (patch <= r_patch), REPORTED)
        .when((major == r_major) & (minor < r_minor), REPORTED)
        .otherwise(UNKNOWN)
    )


def is_product_package(name: Column, spec: IndicatorSpec) -> Column:
    n = F.lower(name)
    hit = (n == spec.product_word) | n.endswith("/" + spec.product_word)
    for word in spec.package_words:
        hit = hit | n.contains(word)
    return hit


def version_from_manifest(path: Column, text: Column, spec: IndicatorSpec) -> Column:
    """Trimmed text of a plain file, ``.version`` of a JSON one; NULL if implausible.

    A ``package.json`` counts only when it is the product's own package.
    """
    base = basename(path)
    record = F.try_parse_json(text)
    json_version = F.when(
        F.schema_of_variant(F.variant_get(record, "$.version", "variant")) == "STRING",
        F.try_variant_get(record, "$.version", "string"),
    )
    name = F.coalesce(
        F.when(
            F.schema_of_variant(F.variant_get(record, "$.name", "variant")) == "STRING",
            F.try_variant_get(record, "$.name", "string"),
        ),
        F.lit(""),
    )
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    found = (
        F.when((base == "package.json") & ~is_product_package(name, spec), None)
        .when(base.endswith(".json"), json_version)
        .otherwise(plain)
    )
    return F.when(plausible_version(found), found)


def version_from_install_path(path: Column, spec: IndicatorSpec) -> Column:
    pattern = rf"(?i)/Cellar/[^/]*{spec.product_word}[^/]*/(\d+\.\d+\.\d+[^/]*)/"
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found)


def version_strings(content: Column, spec: IndicatorSpec, cut: bool = False) -> Column:
    """Distinct versions named in the printable runs of a binary, however long the runs are.

    With ``cut`` the content may go on behind its end: what touches the end is left out.
    """
    # The two ways in which a binary names a version.
    named = rf"(?i){spec.product_word}[-_ ]?(?:build|cli)?[/ v]{{1,3}}(\d+\.\d+\.\d+)"
    quoted = _JSON_VERSION
    if cut:
        named = named.replace(r"\d+)", r"\d++)(?!\x{E000})")
    text = F.decode(content, "ISO-8859-1")
    run = r"[\x20-\x7e]{6,}"
    if cut:
        # A character that no byte decodes to marks the end.
        text, run = F.concat(text, F.lit("\uE000")), run + r"\x{E000}?"
    runs = F.regexp_extract_all(text, F.lit(run), F.lit(0))
    found = F.flatten(
        F.transform(
            runs,
            lambda r: F.concat(
                F.regexp_extract_all(r, F.lit(named), F.lit(1)),
                F.regexp_extract_all(r, F.lit(quoted), F.lit(1)),
            ),
        )
    )
    return F.array_distinct(found)
