"""Host-level quality rules.

Every document is measured; a rule says which measures fail. Failures are counted
per host, and each host's failure rate of a rule is shrunk towards the corpus by a
beta prior fitted to the rates of all hosts, so that a host of three documents is
not condemned by two of them. A host that fails a rule in most of its documents,
after shrinking, is rejected with all its documents.

Defined cases: a null text has no words; a null host is a host of its own; repeated
rows count as often as they occur; an empty table gives an empty result; columns of
the input that have a measure's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words as W
from fleetlens.session import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_NEWLINE = np.arange(256) == 10
_SLICE = 1 << 20


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules, and the shrunk failure rate above which a host is rejected."""

    min_words: int = 10
    repeat_percent: int = 20
    symbol_percent: int = 10
    dup_line_percent: int = 30
    host_rate: float = 0.5

    def failures(self, at: str = "") -> dict[str, Column]:
        """Rule name to condition; ``at`` is put before the names of the measures."""

        def m(name: str) -> Column:
            return F.col(at + name)

        return {
            "few_words": m("n_words") < self.min_words,
            "repeats": 100 * m("n_repeat_words") > self.repeat_percent * m("n_words"),
            "symbols": 100 * m("n_symbols") > self.symbol_percent * m("word_chars"),
            "dup_lines": 100 * m("n_dup_lines") > self.dup_line_percent * m("n_lines"),
        }

    def base_failed(self, at: str = "") -> Column:
        own = self.failures(at)
        return own["few_words"] | own["repeats"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _measure(texts: list[bytes]) -> list[np.ndarray]:
    found = W.split(texts, lower=False)
    lead = (found.data & 0xC0) != 0x80
    in_word = ~W.SPACES[found.data]
    lines = W.split(texts, _NEWLINE, lower=False)
    full = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
    keys = lines.hashes[full] ^ W.mix(lines.doc[full].astype(np.uint64))
    n_lines = np.bincount(lines.doc[full], minlength=len(texts))
    _, firsts = np.unique(keys, return_index=True)
    n_distinct = np.bincount(lines.doc[full][firsts], minlength=len(texts))
    hashes, at = W.windows(found, 5)
    owner = found.doc[at]
    _, group, times = np.unique(
        hashes ^ W.mix(owner.astype(np.uint64)), return_inverse=True, return_counts=True
    )
    twice = at[times[group] > 1]
    n = len(found.hashes)
    step = np.bincount(twice, minlength=n + 6) - np.bincount(twice + 5, minlength=n + 6)
    covered = np.cumsum(step)[:n] > 0
    return [
        np.diff(found.first),
        _per_text(lead & in_word, found.offsets),
        _per_text(_SYMBOLS[found.data], found.offsets),
        n_lines,
        n_lines - n_distinct,
        np.bincount(found.doc[covered], minlength=len(texts)),
    ]


_TYPE = "struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">"


def measures(text: Column) -> Column:
    """The measures of each text, as a struct."""

    @F.arrow_udf(_TYPE)
    def measure(column: pa.Array) -> pa.Array:
        texts = W.as_bytes(column)
        parts = [_measure(texts[a:b]) for a, b in W.slices([len(t) for t in texts], _SLICE)]
        joined = [np.concatenate([p[i] for p in parts] or [[]]) for i in range(len(MEASURES))]
        return pa.StructArray.from_arrays(
            [pa.array(x.astype(np.int64), pa.int64()) for x in joined], list(MEASURES)
        )

    return measure(text)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its measures."""
    keep = [c for c in docs.columns if c not in MEASURES and c != text]
    return docs.select(*keep, measures(F.col(text)).alias("_m")).select(*keep, "_m.*")


def host_verdicts(table: DataFrame, rules: QualityRules, host: str = "source") -> DataFrame:
    """One row per host: documents, and per rule its failures and shrunk rate; ``rejected``.

    ``table`` holds the measures. The prior of a rule has the mean of the corpus and the
    variance of the hosts' rates; hosts that all agree leave nothing but the mean.
    """
    failures = rules.failures()
    hosts = table.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("docs"),
        *[F.count_if(c).alias(f"{name}_failed") for name, c in failures.items()],
    )
    hosts = materialize(hosts, "hosts")
    # One row, whatever the size of the corpus.
    prior = hosts.agg(
        *[
            F.struct(
                (F.sum(f"{name}_failed") / F.sum("docs")).alias("mean"),
                F.var_pop(F.col(f"{name}_failed") / F.col("docs")).alias("variance"),
            ).alias(name)
            for name in failures
        ]
    ).first()
    rejected = F.lit(False)
    for name in failures:
        mean, variance = prior[name]["mean"], prior[name]["variance"]
        if not variance:
            rate = F.lit(float(mean or 0.0))
        else:
            weight = max(mean * (1 - mean) / variance - 1, 0.0)
            rate = (F.col(f"{name}_failed") + mean * weight) / (F.col("docs") + weight)
        hosts = hosts.withColumn(f"{name}_rate", rate)
        rejected = rejected | (F.col(f"{name}_rate") > rules.host_rate)
    return hosts.withColumn("rejected", rejected)


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without the text, with measures, ``base_failed``, ``host_rejected`` and ``kept``."""
    own = ("base_failed", "host_rejected", "kept")
    table = materialize(measured(docs.drop(*[c for c in own if c != host]), text), "measures")
    bad = host_verdicts(table, rules, host).filter("rejected").select(F.col("host").alias("_host"))
    return (
        table.join(bad.withColumn("host_rejected", F.lit(True)), table[host].eqNullSafe(bad["_host"]), "left")
        .drop("_host")
        .withColumns(
            {
                "host_rejected": F.coalesce("host_rejected", F.lit(False)),
                "base_failed": rules.base_failed(),
            }
        )
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    table = materialize(measured(docs.select(host, text), text), "measures")
    bad = host_verdicts(table, rules, host).filter("rejected").select(F.col("host").alias("_host"))
    return (
        docs.withColumn("_m", measures(F.col(text)))
        .filter(~rules.base_failed("_m."))
        .join(bad, F.col(host).eqNullSafe(F.col("_host")), "left_anti")
        .select(*docs.columns)
    )
