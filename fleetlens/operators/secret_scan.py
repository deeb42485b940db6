"""Content rules over blob text, as one Arrow function per task.

Matching runs in Arrow's RE2, the dialect the rules are written in, over whole
batches of texts. The only thing that leaves the function is which rule hit
which blob: no match, secret or line is ever part of its output.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fleetlens.functions.keyword_gate import KeywordGate, runs
from fleetlens.sources.rules import Allow, Rule, RuleSet

#: Bytes of texts in which a rule's matches are looked for together; a run of texts ends as soon as it has them.
_SLICE = 1 << 20

HIT_SCHEMA = "sha string, rule_ord int, unless array<int>"
_ARROW_HITS = pa.schema(
    [("sha", pa.string()), ("rule_ord", pa.int32()), ("unless", pa.list_(pa.int32()))]
)


def path_guards(rule_set: RuleSet) -> list[tuple[int, Allow]]:
    """Allowlists that look at the path: decided after the scan, where paths are known."""
    return [(i, a) for i, r in enumerate(rule_set.rules) for a in r.allow if a.paths]


def entropy(s: str) -> float:
    size = len(s.encode("utf-8", "surrogatepass"))
    return -sum(n / size * math.log2(n / size) for n in Counter(s).values()) if s else 0.0


def _group_count(pattern: str) -> int:
    """How many groups, nine at most. Every try compiles the pattern, and few have more than two."""
    probe = pa.array([""])
    for n in range(1, 10):
        try:
            pc.replace_substring_regex(probe, pattern=pattern, replacement=f"\\{n}")
        except pa.ArrowInvalid:
            return n - 1
    return 9


def _marks(texts: list[str]) -> tuple[str, str, str] | None:
    """Three characters that no text contains, if there are any."""
    free = (chr(c) for c in range(0xE000, 0xF8FF) if not any(chr(c) in t for t in texts))
    found = tuple(islice(free, 3))
    return found if len(found) == 3 else None


def _spans(texts: list[str], pattern: str, groups: int) -> Iterator[tuple[int, str, list[str], str]]:
    """Every match: the text's number, the match with its groups, and the line(s) around it.

    The pattern is compiled once for all texts.
    """
    marks = _marks(texts)
    if marks is None:
        if len(texts) == 1:
            raise ValueError("a text contains all characters of private use")
        half = len(texts) // 2
        yield from _spans(texts[:half], pattern, groups)
        yield from ((half + i, *rest) for i, *rest in _spans(texts[half:], pattern, groups))
        return
    begin, sep, end = marks
    fields = sep.join(f"\\{g}" for g in range(groups + 1))
    column = pc.replace_substring_regex(pa.array(texts, pa.string()), pattern=pattern, replacement=begin + fields + end)
    for number, (text, marked) in enumerate(zip(texts, column, strict=True)):
        head, *pieces = marked.as_py().split(begin)
        at = len(head)
        for piece in pieces:
            body, rest = piece.split(end, 1)
            match, *found = body.split(sep)
            stop = at + len(match)
            line_end = text.find("\n", stop)
            line = text[text.rfind("\n", 0, at) + 1 : line_end if line_end >= 0 else len(text)]
            yield number, match, found, line
            at = stop + len(rest)


def _secret(rule: Rule, match: str, groups: list[str]) -> str | None:
    if rule.secret_group:
        return groups[rule.secret_group - 1] if rule.secret_group <= len(groups) else None
    return next((g for g in groups if g), match)


def _matches_any(values: list[str], patterns: Iterable[str]) -> list[bool]:
    hit = [False] * len(values)
    column = pa.array(values, pa.string())
    for p in patterns:
        found = pc.match_substring_regex(column, pattern=p).to_pylist()
        hit = [a or b for a, b in zip(hit, found, strict=True)]
    return hit


def _suppressed(allow: Allow, secrets, matches, lines) -> list[bool]:
    """Whether the allowlist hits each match, its path test left out."""
    target = {"match": matches, "line": lines}.get(allow.target, secrets)
    tests = []
    if allow.regexes:
        tests.append(_matches_any(target, allow.regexes))
    if allow.stopwords:
        tests.append([any(map(s.lower().__contains__, allow.stopwords)) for s in secrets])
    if not tests:
        return [allow.all_of and bool(allow.paths)] * len(secrets)
    join = all if allow.all_of else any
    return [join(t) for t in zip(*tests, strict=True)]


def _groups(rule_set: RuleSet) -> list[int]:
    return [_group_count(r.regex) if r.regex else 0 for r in rule_set.rules]


class _Scanner:
    """The rule table prepared once per task; ``groups`` of its patterns, if they are counted already."""

    def __init__(self, rule_set: RuleSet, groups: list[int] | None = None):
        self.rules = rule_set.rules
        self.allow = rule_set.allow
        self.guards = path_guards(rule_set)
        self.groups = _groups(rule_set) if groups is None else groups
        self.words = sorted({w for r in self.rules for w in r.gate_words})
        self.gate = KeywordGate(self.words)
        self.by_word: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for w in r.gate_words:
                self.by_word.setdefault(w, []).append(i)
        self.always = [i for i, r in enumerate(self.rules) if r.regex and not r.gate_words]
        self.path_only = [i for i, r in enumerate(self.rules) if not r.regex and r.path]

    def candidates(self, texts: pa.Array) -> dict[int, list[int]]:
        """Rows each rule has to look at: those that carry one of its keywords."""
        rows: dict[int, list[int]] = {i: list(range(len(texts))) for i in self.always}
        if not self.words:
            return rows
        found, word = self.gate.find(pc.utf8_lower(texts).cast(pa.binary()).to_pylist())
        due: dict[int, list[np.ndarray]] = {}
        for w in np.unique(word).tolist():
            for i in self.by_word[self.words[w]]:
                if self.rules[i].regex:
                    due.setdefault(i, []).append(found[word == w])
        rows.update((i, np.unique(np.concatenate(parts)).tolist()) for i, parts in due.items())
        return rows

    def hits(self, rule_ord: int, texts: pa.Array, rows: list[int]):
        """(row, guards) per surviving match; guards are path allowlists still to test."""
        rule = self.rules[rule_ord]
        matched = pc.match_substring_regex(texts.take(pa.array(rows)), pattern=rule.regex)
        hit = [row for row, m in zip(rows, matched.to_pylist(), strict=True) if m]
        found = []
        for a, b in runs([len(texts[row].as_buffer()) for row in hit], _SLICE):
            of_rows = [texts[row].as_py() for row in hit[a:b]]
            for number, match, groups, line in _spans(of_rows, rule.regex, self.groups[rule_ord]):
                secret = _secret(rule, match, groups)
                if secret is None or (rule.entropy and entropy(secret) <= rule.entropy):
                    continue
                found.append((hit[a + number], secret, match, line))
        if not found:
            return set()
        kept_rows, secrets, matches, lines = map(list, zip(*found, strict=True))
        gone = _suppressed(self.allow, secrets, matches, lines)
        unless: list[list[int]] = [[] for _ in found]
        for allow in rule.allow:
            hit = _suppressed(allow, secrets, matches, lines)
            if allow.paths and allow.all_of:
                conditional = hit
            elif allow.paths:
                gone = [a or b for a, b in zip(gone, hit, strict=True)]
                conditional = [True] * len(found)
            else:
                gone = [a or b for a, b in zip(gone, hit, strict=True)]
                continue
            guard = next(
                g for g, (o, a) in enumerate(self.guards) if o == rule_ord and a is allow
            )
            for i, c in enumerate(conditional):
                if c:
                    unless[i].append(guard)
        return {
            (row, tuple(u)) for row, u, g in zip(kept_rows, unless, gone, strict=True) if not g
        }


def _texts(content: pa.Array) -> pa.Array:
    try:
        return content.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([c.decode("utf-8", "replace") for c in content.to_pylist()], pa.string())


def scan_contents(units: DataFrame, rule_set: RuleSet) -> DataFrame:
    """(sha, content, path_only) → one row per blob, rule and set of open path guards.

    The rule table travels with the function; its size is the corpus, never the data. So do the
    numbers of groups: counting them compiles all patterns several times.
    """
    groups = _groups(rule_set)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(rule_set, groups)
        for batch in batches:
            sha = batch.column("sha").to_pylist()
            texts = _texts(batch.column("content"))
            out = []
            for rule_ord, rows in scanner.candidates(texts).items():
                out += [(sha[r], rule_ord, list(u)) for r, u in scanner.hits(rule_ord, texts, rows)]
            for row, wanted in enumerate(batch.column("path_only").to_pylist()):
                if wanted:
                    out += [(sha[row], i, []) for i in scanner.path_only]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW_HITS, strict=True)],
                schema=_ARROW_HITS,
            )

    return units.select("sha", "content", "path_only").mapInArrow(scan, HIT_SCHEMA)
