import pytest
from hypothesis import given
from hypothesis import strategies as st

from fleetlens.llm.chat import escape, format_conversations, inst_template, parse_inst, render_turns, unescape

PIECES = st.lists(st.sampled_from(["<", "s>", "/", "[", "INST", "]", "\\", "ROLE", " ", "é", "\n", "</s>", "[INST] "]), max_size=12)


@given(PIECES.map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    masked = escape(text)
    assert unescape(masked) == text
    assert not any(c in masked for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>"]), PIECES.map("".join)), max_size=5))
def test_conversations_come_back(messages):
    formatted, spans, rewriting = render_turns(inst_template, messages)
    assert parse_inst(formatted) == messages and rewriting == []
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for _, t in messages]


def test_rewriting_templates_are_found():
    def forgetful(messages):
        """Drops the thoughts of all turns but the last."""
        last = len(messages) - 1
        return "".join(f"<{r}>{t if i == last else t.split('|')[-1]}</{r}>" for i, (r, t) in enumerate(messages))

    messages = [("user", "a"), ("assistant", "thought|b"), ("user", "c"), ("assistant", "d")]
    formatted, spans, rewriting = render_turns(forgetful, messages)
    assert rewriting == [2] and [formatted[a:b] for a, b in spans] == ["", "", "", "d"]


def test_any_template_is_located():
    def plain(messages):
        return "".join(f"## {r}\n{t}\n\n" for r, t in messages)

    messages = [("user", "\x01 hi"), ("assistant", ""), ("assistant", "##")]
    formatted, spans, _ = render_turns(plain, messages)
    assert [formatted[a:b] for a, b in spans] == ["\x01 hi", "", "##"]


def test_odd_and_empty_tables(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", None),
        (None, 0, "user", "x"), (None, 0, "user", "x"), (2, 0, None, None), (3, 0, "assistant", "long " * 100_000),
    ]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = sorted(((r.conv_id, parse_inst(r.formatted), len(r.loss_spans)) for r in format_conversations(turns).collect()), key=str)
    assert got == sorted(
        [
            (1, [("system", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")], 2),
            (None, [("user", "x")], 0), (None, [("user", "x")], 0), (2, [("", "")], 0),
            (3, [("assistant", "long " * 100_000)], 1),
        ],
        key=str,
    )
    assert format_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("turns", [400])
def test_long_conversations_are_cheap(turns):
    import time

    messages = [("user" if i % 2 else "assistant", f"text {i} " * 40) for i in range(turns)]
    start = time.process_time()
    render_turns(inst_template, messages)
    assert time.process_time() - start < 5
