"""Secrets in the repositories that went out: by file name and by content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.keyword_gate import KeywordGate
from fleetlens.functions.filekind import looks_binary
from fleetlens.functions.secret_paths import classify_secret_path, jvm_regex, matches_any
from fleetlens.operators.secret_scan import path_guards, scan_contents
from fleetlens.session import materialize
from fleetlens.sources.rules import RuleSet
from fleetlens.spec import DEFAULT_SPEC, UNATTRIBUTED, IndicatorSpec

REPO = ["host_id", "repo_path"]


def seed_repos(ledger: DataFrame, hints: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Repositories to triage: from the ledger, from staged manifests, and asked for."""
    seeds = ledger.filter(F.col("repo_path") != UNATTRIBUTED).select(*REPO).unionByName(
        hints.select(*REPO)
    )
    return (seeds if extra is None else seeds.unionByName(extra.select(*REPO))).distinct()


def history_scope(objects: DataFrame, head_tree: DataFrame, scope: str) -> DataFrame:
    """Which objects count as sent: from any ref, reachable from HEAD, or only HEAD's tree.

    objects(host_id, repo_path, seq, sha, path, obj_type, from_head), where ``from_head`` is
    needed for the scope "head" only.
    """
    columns = [*REPO, "seq", "sha", "path", "obj_type"]
    if scope == "none":
        return head_tree.select(
            *REPO, F.lit(0).cast("bigint").alias("seq"), "sha", "path", F.lit("blob").alias("obj_type")
        )
    if scope == "head":
        if "from_head" not in objects.columns:
            raise ValueError("the scope 'head' needs the column from_head of the git objects")
        objects = objects.filter("from_head")
    elif scope != "all":
        raise ValueError(f"unknown history scope {scope!r}")
    return objects.select(*columns)


def files_only(objects: DataFrame) -> DataFrame:
    """A history also lists directories, which hold no credential of their own."""
    return objects.filter(F.col("obj_type") == "blob")


def history_objects(objects: DataFrame) -> DataFrame:
    return objects.groupBy(*REPO).agg(F.count(F.lit(1)).alias("history_objects"))


def deleted_from_checkout(objects: DataFrame, head_tree: DataFrame) -> DataFrame:
    """Distinct history paths, each either in HEAD or gone from it."""
    history = files_only(objects).filter(F.col("path") != "").select(*REPO, "path").distinct()
    head = head_tree.select(*REPO, "path", F.lit(True).alias("in_head")).distinct()
    return history.join(head, [*REPO, "path"], "left").select(
        *REPO, "path", F.coalesce("in_head", F.lit(False)).alias("in_head")
    )


def latest_blob_of_path(objects: DataFrame) -> DataFrame:
    return files_only(objects).groupBy(*REPO, "path").agg(F.max_by("sha", "seq").alias("blob"))


def first_path_of_blob(objects: DataFrame, rule_set: RuleSet) -> DataFrame:
    """Each blob of a repository once, under the first path not allowlisted."""
    return (
        objects.filter(~matches_any(F.col("path"), rule_set.allow.paths))
        .groupBy(*REPO, "sha")
        .agg(F.min(F.struct("seq", "path")).alias("first"))
        .select(*REPO, "sha", F.col("first.seq").alias("seq"), F.col("first.path").alias("path"))
    )


def blob_filter(
    blobs: DataFrame, spec: IndicatorSpec = DEFAULT_SPEC
) -> tuple[DataFrame, DataFrame]:
    """Scannable blobs, and per repository how many were too large to scan.

    Without a limit these are the ones too large to be delivered, which have no content.
    """
    sized = blobs.filter((F.col("obj_type") == "blob") & (F.col("size") >= 0))
    if spec.max_blob_bytes is None:
        over = F.col("content").isNull() & (F.col("size") > 0)
    else:
        over = F.col("size") > spec.max_blob_bytes
    kept = sized.filter(~over)
    oversized = (
        sized.filter(over)
        .groupBy(*REPO)
        .agg(F.count(F.lit(1)).alias("oversized"))
    )
    return kept, oversized


def scan_units(scannable: DataFrame, rule_set: RuleSet) -> DataFrame:
    """Distinct contents to scan: ``sha`` and whether a rule asks for its path only.

    A blob id names its content, so clones of a repository across the fleet are
    scanned once; the paths come back in ``content_hits``.
    """
    path_only = [r.path for r in rule_set.rules if r.path and not r.regex]
    return scannable.groupBy("sha").agg(
        F.bool_or(matches_any(F.col("path"), tuple(path_only))).alias("path_only")
    )


def _rule_path_gate(rule_set: RuleSet) -> Column:
    """A rule with a path pattern needs the path to match; open guards need it not to."""
    ok = F.lit(True)
    for i, rule in enumerate(rule_set.rules):
        if rule.path:
            ok = ok & (
                (F.col("rule_ord") != i) | F.col("path").rlike(jvm_regex(rule.path))
            )
    for g, (_, allow) in enumerate(path_guards(rule_set)):
        ok = ok & ~(F.array_contains("unless", g) & matches_any(F.col("path"), allow.paths))
    return ok


def content_hits(
    objects: DataFrame, blobs: DataFrame, rule_set: RuleSet, spec: IndicatorSpec = DEFAULT_SPEC
) -> DataFrame:
    """(host, repository, path, blob, rule) for every rule that hits a scanned blob.

    Whether a content was delivered shows in the content only, so the scan list is written: its
    three readers would read all contents once each.
    """
    firsts = first_path_of_blob(objects, rule_set)
    kept, _ = blob_filter(blobs, spec)
    scannable = materialize(
        firsts.join(kept.select(*REPO, "sha").distinct(), [*REPO, "sha"], "left_semi"), "scannable"
    )
    units = scan_units(scannable, rule_set)
    hits = scan_contents(_contents(may_hold(kept, units)).join(units, "sha"), rule_set)
    ids = _rule_ids(hits, rule_set)
    return scannable.join(ids, "sha").filter(_rule_path_gate(rule_set)).select(
        *REPO, "seq", "path", F.col("sha").alias("blob"), "rule_ord", "rule_id"
    ).distinct()


#: Bits of the filter that keeps contents off the wire: 16 MB, whatever the number of blobs.
_FILTER_BITS = 1 << 27


def may_hold(kept: DataFrame, units: DataFrame) -> DataFrame:
    """Rows whose ``sha`` may be in the scan list, chosen in the scan, before any shuffle.

    One bit per id, hashed to a place, in bitmaps of 4 KB by bucket: at most 4,096 of them,
    so they are broadcast whatever the data's size. Ids that share a bit with one of the list
    pass too and fall out in the join; the fuller the filter, the less it saves, never more.
    """
    place = F.pmod(F.xxhash64("sha"), F.lit(_FILTER_BITS))
    bits = units.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return (
        kept.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place"))
        .join(F.broadcast(bits), "bucket")
        .filter(is_set)
        .select(*kept.columns)
    )


def _contents(kept: DataFrame) -> DataFrame:
    """One text per blob id; copies of a blob meet before their contents move."""
    return (
        kept.filter(~looks_binary(F.col("content")))
        .groupBy("sha")
        .agg(F.any_value("content").alias("content"))
    )


def _rule_ids(hits: DataFrame, rule_set: RuleSet) -> DataFrame:
    names = F.array(*[F.lit(r.id) for r in rule_set.rules])
    return hits.withColumn("rule_id", F.get(names, F.col("rule_ord")))


def content_hits_first(hits: DataFrame) -> DataFrame:
    """One hit per path: the first rule in table order on the first scanned blob."""
    return (
        hits.groupBy(*REPO, "path")
        .agg(F.min(F.struct("seq", "rule_ord", "rule_id", "blob")).alias("hit"))
        .select(*REPO, "path", F.col("hit.rule_id").alias("rule_id"), F.col("hit.blob").alias("blob"))
    )


def secret_hits(
    objects: DataFrame, head_tree: DataFrame, first_hits: DataFrame | None = None
) -> DataFrame:
    """One row per credential path of a repository's history.

    A content hit gives class and blob; otherwise the file name gives the class
    and the latest version the blob.
    """
    paths = deleted_from_checkout(objects, head_tree)
    named = latest_blob_of_path(objects).withColumn(
        "class", classify_secret_path(F.col("path"))
    )
    if first_hits is None:
        hits = named.filter(F.col("class") != "")
    else:
        found = first_hits.select(
            *REPO, "path", "rule_id", F.col("blob").alias("hit_blob")
        )
        hits = (
            named.join(found, [*REPO, "path"], "left")
            .filter((F.col("class") != "") | F.col("rule_id").isNotNull())
            .withColumn("class", F.coalesce("rule_id", "class"))
            .withColumn("blob", F.coalesce("hit_blob", "blob"))
            .drop("rule_id", "hit_blob")
        )
    return hits.join(paths, [*REPO, "path"]).select(
        *REPO, "path", "class", "blob", "in_head", F.lit(True).alias("in_history"),
        (~F.col("in_head")).alias("deleted_from_checkout"),
    )


def secret_totals(hits: DataFrame, *by: str) -> DataFrame:
    return hits.groupBy(*(by or ("host_id",))).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("deleted_from_checkout").alias("deleted")
    )


def secret_class_summary(hits: DataFrame) -> DataFrame:
    """"n x class" per host, by class. The list is as long as the rule table at most."""
    counts = hits.groupBy("host_id", "class").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("class", "n"))),
        lambda p: F.concat(p["n"].cast("string"), F.lit(" x "), p["class"]),
    )
    return counts.groupBy("host_id").agg(F.array_join(parts, ", ").alias("summary"))


def secret_examples(hits: DataFrame, k: int = 3) -> DataFrame:
    """Up to k examples per host: one per class not seen yet, deleted ones first, then fill."""
    order = [F.col("deleted_from_checkout").desc(), "class", "path", "repo_path"]
    best = Window.partitionBy("host_id", "class").orderBy(*order)
    # At most k rows of a class can be shown, so the rest leave before the host is ranked.
    ranked = hits.withColumn("in_class", F.row_number().over(best)).filter(F.col("in_class") <= k)
    overall = Window.partitionBy("host_id").orderBy(
        F.when(F.col("in_class") == 1, 0).otherwise(1), *order
    )
    shown = ranked.withColumn("place", F.row_number().over(overall)).filter(F.col("place") <= k)
    totals = hits.groupBy("host_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        shown.join(totals, "host_id")
        .withColumn("omitted", F.greatest(F.col("n") - k, F.lit(0)))
        .drop("n", "in_class")
    )


def keyword_rules(texts: DataFrame, rule_set: RuleSet, key: str) -> DataFrame:
    """Rules worth running on each text: one of their keywords occurs, or they have none.

    All texts of a batch are searched for all keywords together; no join is needed, since
    the rule table travels with the function.
    """
    words = sorted({w for r in rule_set.rules for w in r.gate_words})
    by_word = [[r.id for r in rule_set.rules if w in r.gate_words] for w in words]
    always = [r.id for r in rule_set.rules if r.regex and not r.gate_words]
    rows = texts.select(key, F.lower("text").alias("lower"))
    schema = T.StructType([rows.schema[key], T.StructField("rule_id", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = KeywordGate(words)
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            row, word = gate.find([x or b"" for x in text.to_pylist()])
            pairs = {(r, rule) for r, w in zip(row.tolist(), word.tolist(), strict=True) for rule in by_word[w]}
            pairs.update((r, rule) for r in range(len(text)) for rule in always)
            at, rules = zip(*sorted(pairs), strict=True) if pairs else ((), ())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rules, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "rule_id"])

    return rows.mapInArrow(find, schema)


def worktree_files(placed: DataFrame, untriaged: DataFrame) -> DataFrame:
    """Checked-out files of repositories without a delivered history.

    placed(host_id, path, repo_path) names the nearest repository of each file, so that a
    repository inside another one keeps its files to itself. ``path`` becomes relative to
    ``repo_path``; ``file`` keeps the whole one. What git stores below ``.git`` is no part.
    """
    below = F.when(F.col("repo_path") == "/", 2).otherwise(F.length("repo_path") + 2)
    inside = placed.join(untriaged.select(*REPO).distinct(), REPO, "left_semi").select(
        *REPO, F.col("path").alias("file"), F.substring("path", below, F.length("path")).alias("path")
    )
    return inside.filter((F.col("path") != "") & ~F.col("path").startswith(".git/")).distinct()


def worktree_secrets(files: DataFrame, contents: DataFrame | None, rule_set: RuleSet) -> DataFrame:
    """Credential files of working trees, with the columns of ``secret_hits`` and no blob.

    A content counts where it was delivered (host_id, path, content) and is text: the first
    rule in table order gives the class. Otherwise the file name does. Equal contents are
    scanned once in the fleet; they are named by their digest, since git names none here.
    """
    named = files.withColumn("class", classify_secret_path(F.col("path")))
    if contents is not None:
        open_to_rules = files.filter(~matches_any(F.col("path"), rule_set.allow.paths))
        delivered = contents.select("host_id", F.col("path").alias("file"), "content").join(
            open_to_rules.select("host_id", "file").distinct(), ["host_id", "file"], "left_semi"
        )
        digest = F.sha2("content", 256).alias("sha")
        firsts = open_to_rules.join(delivered.select("host_id", "file", digest), ["host_id", "file"])
        path_only = [r.path for r in rule_set.rules if r.path and not r.regex]
        units = firsts.groupBy("sha").agg(
            F.bool_or(matches_any(F.col("path"), tuple(path_only))).alias("path_only")
        )
        texts = _contents(delivered.select(digest, "content"))
        hits = _rule_ids(scan_contents(texts.join(units, "sha"), rule_set), rule_set)
        found = (
            firsts.join(hits, "sha").filter(_rule_path_gate(rule_set))
            .groupBy(*REPO, "path").agg(F.min_by("rule_id", "rule_ord").alias("rule_id"))
        )
        named = named.join(found, [*REPO, "path"], "left").withColumn("class", F.coalesce("rule_id", "class"))
    no = F.lit(False)
    return named.filter(F.col("class") != "").select(
        *REPO, "path", "class", F.lit("").alias("blob"),
        no.alias("in_head"), no.alias("in_history"), no.alias("deleted_from_checkout"),
    )


def secrets_notes(untriaged: DataFrame, files: DataFrame) -> DataFrame:
    """Why the history of a repository was not examined, and what was instead."""
    seen = files.groupBy(*REPO).agg(F.count(F.lit(1)).alias("n"))
    return untriaged.select(*REPO).distinct().join(seen, REPO, "left").select(
        *REPO,
        F.when(F.col("n").isNull(), F.lit("No history was delivered and no file of the checkout was listed."))
        .otherwise(F.format_string("No history was delivered; %d files of the working tree were examined.", "n"))
        .alias("secrets_note"),
    )


def untriaged_repos(ledger: DataFrame, objects: DataFrame) -> DataFrame:
    """Implicated repositories whose history was not available."""
    return ledger.filter(F.col("repo_path") != UNATTRIBUTED).select(*REPO).distinct().join(
        objects.select(*REPO).distinct(), REPO, "left_anti"
    )


def merge_triage(ledger: DataFrame, triage: DataFrame) -> DataFrame:
    """Ledger rows with triage columns; triage-only repositories enter with status unknown."""
    theirs = [c for c in triage.columns if c not in REPO]
    joined = ledger.drop(*[c for c in theirs if c in ledger.columns]).join(triage, REPO, "full_outer")
    merged = joined.withColumn("status", F.coalesce("status", F.lit("unknown")))
    if "secrets_scanned" in theirs:
        merged = merged.withColumn("secrets_scanned", F.coalesce("secrets_scanned", F.lit(False)))
    return merged
