"""Chat formatting by incremental black-box rendering.

A template is any function from messages to a string. Nothing is assumed of how it
is written: the prefixes of a conversation are rendered one turn longer at a time,
and each output is compared with the one before. What was added is the turn's span;
an output that does not begin with the one before shows a template that rewrites
history. Inside a span, two probe texts in place of the turn's own tell the markers
before and after it from the text, which gives the loss mask of assistant turns.

Defined cases: a null role or text is empty; a row without conversation id is a
conversation of its own; turns sort by turn (null first), then role, then text, and
repeated rows stay; an empty table gives an empty result. Rows are streamed, sorted,
so only one conversation is held at a time. The work of rendering prefixes grows with
the square of the turns of one conversation, as the method has it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[tuple[str, str]]
Template = Callable[[Messages], str]

_ESCAPE = re.compile(r"(<)(?=\\*/?s>)|(\[)(?=\\*/?(?:INST|ROLE)\])")
_UNESCAPE = re.compile(r"(?:(<)\\(?=\\*/?s>))|(?:(\[)\\(?=\\*/?(?:INST|ROLE)\]))")
_PROBES = ("\x01", "\x02")


@functools.lru_cache(maxsize=4096)
def escape(text: str) -> str:
    r"""Break control strings by a backslash behind their first character: ``<s>`` is ``<\s>``."""
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group()[:-1], text)


def inst_template(messages: Messages) -> str:
    """Marks turns with ``[INST]``, ``</s>`` and, for other roles, ``[ROLE]``."""
    out = ["<s>"]
    for role, text in messages:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)}</s>")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {escape(text)}</s>")
    return "".join(out)


def parse_inst(formatted: str) -> Messages:
    """The messages of a string that ``inst_template`` made."""
    turns, at = [], len("<s>")

    def upto(mark: str) -> str:
        nonlocal at
        end = formatted.index(mark, at)
        text, at = formatted[at:end], end + len(mark)
        return unescape(text)

    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            at += len("[INST] ")
            turns.append(("user", upto(" [/INST]")))
        elif formatted.startswith("[ROLE]", at):
            at += len("[ROLE]")
            role = upto("[/ROLE] ")
            turns.append((role, upto("</s>")))
        else:
            at += 1
            turns.append(("assistant", upto("</s>")))
    return turns


def _common(a: str, b: str) -> int:
    """How many characters both begin with."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def render_turns(template: Template, messages: Messages) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The rendered conversation, where each turn's text stands in it, and the turns that rewrote history.

    A turn that rewrites history has an empty span, as have the turns before it: their
    places in the earlier output no longer hold.
    """
    before = template([])
    spans: list[tuple[int, int]] = []
    rewriting: list[int] = []
    for k, (role, _) in enumerate(messages):
        after = template(messages[: k + 1])
        if not after.startswith(before):
            rewriting.append(k)
            spans = [(len(after), len(after))] * (k + 1)
        else:
            # What two probes have in common behind the earlier turns are the markers.
            one, two = (template([*messages[:k], (role, probe)])[len(before) :] for probe in _PROBES)
            head = _common(one, two)
            tail = _common(one[head:][::-1], two[head:][::-1])
            spans.append((len(before) + head, len(after) - tail))
        before = after
    return before, spans, rewriting


def format_conversations(
    turns: DataFrame, template: Template = inst_template, trained_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (code points, of the
    trained role's texts), ``rewriting_turns``."""
    schema = (
        "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>, "
        "rewriting_turns array<long>"
    )
    arrow = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("formatted", pa.string()),
            ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("rewriting_turns", pa.list_(pa.int64())),
        ]
    )

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Messages]]:
        current, messages = None, []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if messages and (conv is None or conv != current):
                    yield current, messages
                    messages = []
                current = conv
                messages.append((role or "", text or ""))
        if messages:
            yield current, messages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conv, messages in conversations(batches):
            formatted, spans, rewriting = render_turns(template, messages)
            rows.append(
                {
                    "conv_id": conv,
                    "formatted": formatted,
                    "loss_spans": [
                        {"start": a, "end": b}
                        for (role, _), (a, b) in zip(messages, spans, strict=True)
                        if role == trained_role
                    ],
                    "rewriting_turns": rewriting,
                }
            )
            size += len(formatted)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # Rows without an id need not meet; their own values spread them.
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("_spread", spread)
        .repartition("conv_id", "_spread")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select(F.col("conv_id").cast("long"), "role", "text")
        .mapInArrow(run, schema)
    )
