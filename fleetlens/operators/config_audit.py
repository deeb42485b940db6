"""Whether the upload mitigations are set in a host's configuration.

The reader fails closed: whatever it cannot be sure about makes the file
uncertain, and an uncertain file is not mitigated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.binding import bind
from fleetlens.functions.paths import home_of, join_path
from fleetlens.spec import DEFAULT_SPEC, IndicatorSpec

# The pieces of a line: text, quoted strings (a closing double quote has no backslash before
# it), backslashes with the double quote they keep from opening, and comment signs.
_PIECES = (
    r'''[^"'#\\]++|\\++"?|"[^"]*+(?:(?<=\\)"[^"]*+)*+(?:"|\z)|'[^']*+(?:'|\z)|#'''
)
_LONG_QUOTES = ('"""', "'''")
_LINE = "struct<kind: string, name: string, value: string, opens: string, ends: array<string>>"
_ENTRIES = "array<struct<place: string, name: string, value: string>>"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unquoted(text: Column) -> Column:
    return F.btrim(_bare(text), F.lit("\"'"))


def _line_facts(raw: Column) -> Column:
    """What a line is by itself, and which long strings it would end."""
    pieces = F.regexp_extract_all(raw, F.lit(_PIECES), F.lit(0))
    sign = F.array_position(pieces, "#")
    line = _bare(F.array_join(F.when(sign > 0, F.slice(pieces, 1, sign - 1)).otherwise(pieces), ""))
    held = F.filter(F.array(*map(F.lit, _LONG_QUOTES)), lambda q: F.contains(line, q))
    first = F.coalesce(F.get(held, F.lit(0)), F.lit(""))
    # The first long quote of the line, if it stands there once only.
    opens = F.when(
        (first != "") & (F.length(line) - F.length(F.replace(line, first, F.lit(""))) < 6), first
    ).otherwise("")
    bracket, equals = F.instr(line, "]"), F.instr(line, "=")
    kind = (
        F.when(line == "", "empty")
        .when(opens != "", "long")
        .when(line.startswith("[[") | (line.startswith("[") & (bracket == 0)), "unclear")
        .when(line.startswith("["), "table")
        .when(equals == 0, "unclear")
        .otherwise("entry")
    )
    name = F.when(kind == "table", F.substring(line, F.lit(2), bracket - 2)).when(
        kind == "entry", F.substring(line, F.lit(1), equals - 1)
    )
    value = F.lower(F.regexp_replace(_bare(F.substring(line, equals + 1, F.length(line))), ",$", ""))
    return F.struct(
        kind.alias("kind"),
        F.coalesce(_unquoted(name), F.lit("")).alias("name"),
        value.alias("value"),
        opens.alias("opens"),
        F.filter(F.array(*map(F.lit, _LONG_QUOTES)), lambda q: F.contains(raw, q)).alias("ends"),
    ).cast(_LINE)


def _fold(state: Column, line: Column, tables: list[str]) -> Column:
    """The state after one more line: the open long string, the table, doubt, the entries so far of ``tables``."""
    inside = state["open"] != ""
    entry = ~inside & (line["kind"] == "entry")
    dotted = (state["table"] == "") & F.contains(line["name"], F.lit("."))
    place = F.when(dotted, F.regexp_replace(line["name"], r"\.[^.]*$", "")).otherwise(state["table"])
    name = F.when(dotted, F.substring_index(line["name"], ".", -1)).otherwise(line["name"])
    return F.struct(
        F.when(inside & F.array_contains(line["ends"], state["open"]), "")
        .when(inside, state["open"])
        .otherwise(line["opens"])
        .alias("open"),
        F.when(~inside & (line["kind"] == "table"), line["name"]).otherwise(state["table"]).alias("table"),
        (state["doubt"] | (~inside & (line["kind"] == "unclear"))).alias("doubt"),
        F.when(
            entry & place.isin(*tables),
            F.concat(
                state["entries"],
                F.array(F.struct(place.alias("place"), name.alias("name"), line["value"].alias("value"))),
            ),
        )
        .otherwise(state["entries"])
        .alias("entries"),
    )


def config_state(text: Column, spec: IndicatorSpec = DEFAULT_SPEC) -> Column:
    """A struct: boolean ``values`` of the mitigations by locator, the ``keys`` of their tables, and
    whether the file is ``uncertain``. One pass over the lines, as columns."""
    start = F.struct(
        F.lit("").alias("open"),
        F.lit("").alias("table"),
        F.lit(False).alias("doubt"),
        F.array().cast(_ENTRIES).alias("entries"),
    )
    lines = F.transform(F.split(text, "\n"), _line_facts)
    tables = list(dict.fromkeys(m.table for m in spec.mitigations))

    def finish(state: Column) -> Column:
        entries = state["entries"]

        def of(m):
            return F.filter(entries, lambda e: (e["place"] == m.table) & (e["name"] == m.key))

        def truth(e: Column) -> Column:
            return e["value"].isin("true", "false")

        values = [
            (F.lit(m.locator), F.try_element_at(F.filter(of(m), truth), F.lit(-1))["value"])
            for m in spec.mitigations
        ]
        unclear = F.lit(False)
        for m in spec.mitigations:
            unclear = unclear | F.exists(of(m), lambda e: ~truth(e))

        def names(table: str) -> Column:
            own = F.filter(entries, lambda e: e["place"] == table)
            return F.sort_array(F.transform(own, lambda e: e["name"]))

        return F.struct(
            F.map_filter(F.create_map(*[c for v in values for c in v]), lambda _, v: v.isNotNull()).alias("values"),
            F.map_from_arrays(
                F.array(*map(F.lit, tables)), F.array(*[names(t) for t in tables])
            ).alias("keys"),
            (state["doubt"] | unclear | (state["open"] != "")).alias("uncertain"),
        )

    return F.aggregate(lines, start, lambda state, line: _fold(state, line, tables), finish)


def text_states(texts: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """(digest, state) of each distinct text of (digest, text): it is read once, however many homes hold it."""
    distinct = texts.groupBy("digest").agg(F.any_value("text").alias("text"))
    return bind(distinct, {"state": config_state(F.col("text"), spec)}).select("digest", "state")


def homes_configs(
    homes: DataFrame, config_files: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> tuple[DataFrame, DataFrame]:
    """One state per home, and a material error for each file that could not be read.

    config_files(host_id, path, status ok|unreadable, text); no row means no file.
    """
    expected = homes.select(
        "host_id", "home", join_path(F.col("home"), spec.config_name).alias("path")
    )
    joined = expected.join(
        config_files.select("host_id", "path", "status", "text"), ["host_id", "path"], "left"
    )
    text = F.coalesce("text", F.lit(""))
    # A file too long to be a configuration is not judged by its beginning.
    long = F.octet_length(text) > spec.max_config_bytes
    sized = joined.withColumns({"long": long, "text": F.when(long, F.lit("")).otherwise(text)})
    sized = sized.withColumn("digest", F.sha2("text", 256))
    parsed = sized.drop("text").join(text_states(sized.select("digest", "text"), spec), "digest", "left")
    readable = F.coalesce(F.col("status") == "ok", F.lit(False))
    states = parsed.select(
        "host_id",
        "home",
        "path",
        F.coalesce(F.col("status") == "missing", F.lit(True)).alias("missing"),
        (F.coalesce(F.col("status") == "unreadable", F.lit(False)) | (readable & (F.col("long") | F.col("state.uncertain")))).alias(
            "uncertain"
        ),
        F.when(readable, F.col("state.values")).alias("values"),
        F.when(readable, F.col("state.keys")).alias("keys"),
    )
    errors = joined.filter(F.col("status") == "unreadable").select(
        "host_id",
        F.lit("config").alias("detector"),
        F.lit("permission").alias("kind"),
        "path",
        F.lit("configuration could not be read").alias("message"),
        F.lit(True).alias("material"),
    )
    return states, errors


def overall_state(spec: IndicatorSpec = DEFAULT_SPEC) -> Column:
    """missing, uncertain, mitigated (all set) or partial."""
    every = F.lit(True)
    for m in spec.mitigations:
        every = every & F.coalesce(
            F.try_element_at(F.col("values"), F.lit(m.locator)) == m.want, F.lit(False)
        )
    return (
        F.when(F.col("missing"), "missing")
        .when(F.col("uncertain"), "uncertain")
        .when(every, "mitigated")
        .otherwise("partial")
    )


def mitigation_status(states: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Each readable configuration's mitigations: satisfied, wrong value or absent."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m.locator).alias("locator"),
                F.when(F.try_element_at(F.col("values"), F.lit(m.locator)) == m.want, "satisfied")
                .when(F.try_element_at(F.col("values"), F.lit(m.locator)).isNotNull(), "wrong value")
                .otherwise("absent")
                .alias("mitigation"),
            )
            for m in spec.mitigations
        ]
    )
    known = states.filter(~F.col("missing") & ~F.col("uncertain"))
    return known.select("host_id", "path", F.inline(rows))


def other_config_keys(states: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC) -> DataFrame:
    """Keys beside the mitigations in their tables, each once, in order."""
    tables = list(dict.fromkeys(m.table for m in spec.mitigations))
    none = F.array().cast("array<string>")

    def full_names(table: str) -> Column:
        names = F.coalesce(F.try_element_at(F.col("keys"), F.lit(table)), none)
        return F.transform(names, lambda k: F.concat(F.lit(table + "."), k))

    named = F.flatten(F.array(*[full_names(t) for t in tables]))
    known = F.array(*[F.lit(m.locator) for m in spec.mitigations])
    others = F.array_except(F.array_distinct(named), known)
    return states.select("host_id", "path", others.alias("others")).filter(F.size("others") > 0)


def product_present(
    installs: DataFrame, queues: DataFrame, existing_homes: DataFrame
) -> DataFrame:
    """Hosts on which a missing configuration means something."""
    return (
        installs.select("host_id")
        .unionByName(queues.select("host_id"))
        .unionByName(existing_homes.select("host_id"))
        .distinct()
    )


def active_config(
    states: DataFrame, active: DataFrame, hosts: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """The configuration that governs each host.

    In order: the one of the home that holds the install on the search path, of
    the host's configured home, of the default home, the first by path.
    """
    install_home = active.select("host_id", home_of(F.col("path"), spec.home_dir).alias("install_home"))
    ranked = (
        states.select("host_id", "path")
        .join(install_home, "host_id", "left")
        .join(hosts.select("host_id", F.col("home").alias("host_home"), "user_home"), "host_id", "left")
    )

    def inside(home: Column) -> Column:
        return (home != "") & (
            (home_of(F.col("path"), spec.home_dir) == home)
            | F.col("path").startswith(F.concat(home, F.lit("/")))
        )

    default = F.concat("user_home", F.lit(f"/{spec.home_dir}/{spec.config_name}"))
    rank = (
        F.when(inside(F.col("install_home")), 0)
        .when(inside(F.col("host_home")), 1)
        .when(F.col("path") == default, 2)
        .otherwise(3)
    )
    return ranked.groupBy("host_id").agg(
        F.min_by("path", F.struct(rank, F.col("path"))).alias("path"),
        F.min(rank).alias("rank"),
    )


def config_rollup(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per configuration path from its findings: state flags and key lists."""
    of_config = findings.filter(F.col("finding_id").startswith("config.")).select(
        "host_id", "finding_id", "instance"
    )
    cited = evidence.select("host_id", "finding_id", "instance", "path", "locator")
    fid = F.col("finding_id")
    rows = of_config.join(cited, ["host_id", "finding_id", "instance"])

    def keys(finding_id: str) -> Column:
        # At most one key per mitigation, so these lists stay as short as the spec.
        return F.array_join(
            F.array_sort(F.collect_set(F.when(fid == finding_id, F.col("locator")))), ", "
        )

    return rows.filter(
        fid.isin(
            "config.absent", "config.unparseable", "config.mitigated", "config.not_mitigated",
            "config.explicitly_disabled",
        )
    ).groupBy("host_id", "path").agg(
        F.bool_or(fid == "config.absent").alias("absent"),
        F.bool_or(fid == "config.unparseable").alias("unparseable"),
        F.bool_or(fid == "config.mitigated").alias("mitigated"),
        keys("config.not_mitigated").alias("not_set"),
        keys("config.explicitly_disabled").alias("wrong_value"),
    )


