"""The secret rule table.

``load_rules(path)`` reads a rule corpus in the public TOML format (tables
``[[rules]]`` and ``[allowlist]``). ``default_rules()`` reads the corpus in
``corpus/``, an unchanged third-party file under the MIT licence beside it.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Allow:
    all_of: bool = False
    target: str = "secret"
    regexes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    regex: str = ""
    path: str = ""
    entropy: float = 0.0
    secret_group: int = 0
    keywords: tuple[str, ...] = ()
    allow: tuple[Allow, ...] = ()

    @property
    def gate_words(self) -> tuple[str, ...]:
        """Lower-cased keywords; an empty one means the rule always runs."""
        words = tuple(k.lower() for k in self.keywords)
        return () if "" in words else words


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    allow: Allow = Allow()


def _allow(raw: dict) -> Allow:
    return Allow(
        all_of=str(raw.get("condition", "")).upper() in ("AND", "&&"),
        target=raw.get("regexTarget") or "secret",
        regexes=tuple(raw.get("regexes", ())),
        paths=tuple(raw.get("paths", ())),
        stopwords=tuple(s.lower() for s in raw.get("stopwords", ())),
    )


def load_rules(path: str) -> RuleSet:
    with open(path, "rb") as f:
        corpus = tomllib.load(f)
    rules = tuple(
        Rule(
            id=r["id"],
            regex=r.get("regex", ""),
            path=r.get("path", ""),
            entropy=float(r.get("entropy", 0)),
            secret_group=int(r.get("secretGroup", 0)),
            keywords=tuple(r.get("keywords", ())),
            allow=tuple(_allow(a) for a in r.get("allowlists", ())),
        )
        for r in corpus["rules"]
    )
    return RuleSet(rules, _allow(corpus.get("allowlist", {})))


def default_rules() -> RuleSet:
    """The whole public corpus: fixed values, as its publishers ship them."""
    return load_rules(os.path.join(os.path.dirname(__file__), "corpus", "gitleaks.toml"))


def rules_table(spark: SparkSession, rule_set: RuleSet) -> DataFrame:
    """The rule table as rows, in table order; its size is the corpus, never the data."""
    rows = [
        (
            i, r.id, r.regex, r.path, float(r.entropy), r.secret_group, list(r.gate_words),
            [(a.all_of, a.target, list(a.regexes), list(a.paths), list(a.stopwords))
             for a in r.allow],
        )
        for i, r in enumerate(rule_set.rules)
    ]
    return spark.createDataFrame(
        rows,
        "rule_ord int, rule_id string, regex string, path string, entropy double, "
        "secret_group int, keywords array<string>, allow array<struct<all_of: boolean, "
        "target: string, regexes: array<string>, paths: array<string>, stopwords: array<string>>>",
    )
