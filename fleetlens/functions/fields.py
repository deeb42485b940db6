"""Drift-tolerant field access on JSON log lines.

A line is read once with ``from_json``, every alias as its text. The text of a
fraction keeps its point, so ``4`` is an integer turn and ``4.0`` is not. The
last of repeated keys wins, and what follows the first value is ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})?$"
_ZONED = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}(?:\.\d+)?) ([+-]\d{2})(\d{2}) [A-Za-z]+$"
_PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"
_HAS_ZONE = r"(Z|[+-]\d{2}:\d{2})$"

# Numbers that ``from_json`` may spell differently than the line does.
_REWRITTEN = r"^(0|-?\d+(\.\d+)?[eE][+-]?\d+|-?\d+\.\d+)$"

_CORRUPT = "_corrupt"
_STRICT = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _CORRUPT,
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def _keys(aliases: dict[str, tuple[str, ...]]) -> tuple[list[str], dict[str, list[str]]]:
    """Top-level keys, and the keys looked up inside each nested object.

    ``ctx.turn`` is a path through nested objects, never a literal key.
    """
    top: dict[str, None] = {}
    nested: dict[str, dict[str, None]] = {}
    for alias in (a for group in aliases.values() for a in group):
        outer, _, inner = alias.partition(".")
        top[outer] = None
        if inner:
            nested.setdefault(outer, {})[inner] = None
    return list(top), {k: list(v) for k, v in nested.items()}


def _text_schema(keys: list[str]) -> str:
    return ", ".join(f"`{k}` string" for k in [*keys, _CORRUPT])


def _json_path(alias: str) -> str:
    return "$" + "".join(f"['{part}']" for part in alias.split("."))


def _is_object_text(text: Column, line: Column, key: str) -> Column:
    """An object's text starts with a brace; so may a string's, which the line shows."""
    kind = F.schema_of_variant(
        F.variant_get(F.try_parse_json(line), _json_path(key), "variant")
    )
    braced = text.startswith("{")
    return braced & (~line.contains('"{') | kind.startswith("OBJECT"))


def parse_json_object(line: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The line's first JSON value as text fields, NULL unless it is an object."""
    top, _ = _keys(aliases)
    starts_object = F.ltrim(line, F.lit(" \t\r\n")).startswith("{")
    return F.when(starts_object, F.from_json(line, _text_schema(top), _STRICT))


def with_record(lines, aliases: dict[str, tuple[str, ...]], line: str = "line"):
    """Add ``record`` (NULL when the line is not an object) and the nested objects
    the aliases reach into, as ``record_<key>``."""
    _, nested = _keys(aliases)
    text = F.col(line)
    out = lines.withColumn("record", parse_json_object(text, aliases)).withColumn(
        "record", F.when(F.col(f"record.{_CORRUPT}").isNull(), F.col("record"))
    )
    for key, keys in nested.items():
        inner = F.col("record").getField(key)
        out = out.withColumn(
            f"record_{key}",
            F.when(
                _is_object_text(inner, text, key), F.from_json(inner, _text_schema(keys), _STRICT)
            ),
        )
    return out


def _field(alias: str) -> Column:
    outer, _, inner = alias.partition(".")
    if inner:
        return F.col(f"record_{outer}").getField(inner)
    return F.col("record").getField(outer)


def pick(aliases: tuple[str, ...]) -> Column:
    """Text of the first alias that resolves to a non-null value, whatever its type."""
    return F.coalesce(*[_field(a) for a in aliases])


def _literal(text: Column, line: Column, aliases: tuple[str, ...]) -> Column:
    """The number in the line that equals ``text`` under one of the keys, as written."""
    keys = "|".join(re.escape(a.split(".")[-1]) for a in aliases)
    written = F.regexp_extract_all(
        line, F.lit(rf'"(?:{keys})"\s*:\s*(-?[0-9][0-9.eE+-]*)'), F.lit(1)
    )
    same = F.filter(written, lambda n: n.try_cast("double") == text.try_cast("double"))
    return F.get(same, F.lit(0))


def pick_str(text: Column, line: Column, aliases: tuple[str, ...]) -> Column:
    """A picked string as it is, a number as its literal, anything else as ''.

    Only text that could also be a boolean, an object or an array is looked up
    again with its type, and only a fraction again for the way it is written.
    """
    record = F.try_parse_json(line)
    values = F.array(*[F.variant_get(record, _json_path(a), "variant") for a in aliases])
    first = F.get(F.filter(values, lambda v: v.isNotNull() & ~F.is_variant_null(v)), F.lit(0))
    doubtful = text.isin("true", "false") | text.rlike(r"^[\[{]")
    return (
        F.when(text.isNull(), "")
        .when(text.rlike(_REWRITTEN), F.coalesce(_literal(text, line, aliases), text))
        .when(~doubtful, text)
        .when(F.schema_of_variant(first) == "STRING", text)
        .otherwise("")
    )


def pick_int(text: Column) -> Column:
    """An integer literal or an integer string; NULL otherwise (``4.0`` is NULL)."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare.rlike(_INT), bare.try_cast("bigint"))


def epoch_auto(x: Column) -> Column:
    """Seconds, millis, micros or nanos since the epoch, told apart by magnitude."""
    whole = x.cast("bigint")
    frac_nanos = ((x - whole) * F.lit(1e9)).cast("bigint")
    return (
        F.when(~(x > 0) | F.isnan(x), None)
        .when(x > 1e17, F.timestamp_micros(F.floor(whole / 1000).cast("bigint")))
        .when(x > 1e14, F.timestamp_micros(whole))
        .when(x > 1e11, F.timestamp_millis(whole))
        .otherwise(F.timestamp_micros(whole * 1_000_000 + F.floor(frac_nanos / 1000).cast("bigint")))
    )


def pick_time(text: Column) -> Column:
    """A timestamp string in one of the known layouts, else a numeric epoch, else NULL."""
    iso = F.translate(text, ",", ".")
    iso = F.when(iso.rlike(_HAS_ZONE), iso).otherwise(F.concat(iso, F.lit("Z")))
    zoned = F.concat(
        F.regexp_extract(text, _ZONED, 1), F.lit("T"), F.regexp_extract(text, _ZONED, 2),
        F.regexp_extract(text, _ZONED, 3), F.lit(":"), F.regexp_extract(text, _ZONED, 4),
    )
    plain = F.concat(F.translate(text, " ", "T"), F.lit("Z"))
    return (
        F.when(text.rlike(_ISO), iso.try_cast("timestamp"))
        .when(text.rlike(_ZONED), zoned.try_cast("timestamp"))
        .when(text.rlike(_PLAIN), plain.try_cast("timestamp"))
        .when(text.rlike(_FLOAT), epoch_auto(text.try_cast("double")))
    )
