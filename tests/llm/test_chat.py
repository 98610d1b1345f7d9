"""Chat formatting: round trips, masks, the machine."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rolesift.llm import chat
from rolesift.llm.chat import DEFAULT, ChatTemplate, Marks

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(turns):
    read = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return (
        len(turns), hashlib.sha256(read.encode()).hexdigest(),
        len(loss), hashlib.sha256(loss.encode()).hexdigest(),
    )


def digests(df):
    return {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
        for r in chat.read_back(chat.format_chats(df)).collect()
    }


HOSTILE = ["", "\\", "\\\\", "</s>", "<\\/s>", "<s>", "[INST] x [/INST]", "[\\INST]", "{role a =}",
           "<", "<sys>", "</s", "s>", "\n", "é𝒳"]


@given(st.lists(st.sampled_from(HOSTILE), max_size=8).map("".join),
       st.sampled_from(["user", "assistant", "system", "tool", "", "{role x =}", "a\\b"]))
def test_a_turn_reads_back(text, role):
    opens, body, closes, loss = DEFAULT.render(role, text)
    turn = opens + body + closes
    assert DEFAULT.parse(turn) == (role, text, len(opens))
    assert loss == (role == "assistant")
    for control in DEFAULT.controls:
        assert control not in body


def test_conversations_read_back(spark):
    talks = {
        1: [("user", "hi"), ("assistant", "hello"), ("user", None)],
        2: [("system", "s"), ("user", "</s>[INST]"), ("assistant", "a\\n</s>")],
        3: [("assistant", "first"), ("assistant", "again"), (None, "who"), ("tool", "x")],
        None: [("user", "no id")],
        5: [("user", "")] * 400,
    }
    rows = [(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows[::-1], SCHEMA)
    assert digests(df) == {c: expected(turns) for c, turns in talks.items()}


def test_machine_marks_turns_that_may_not_follow(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"),
            (2, 0, "assistant", "a"), (3, 0, "user", "a"), (3, 1, "robot", "x"),
            (3, 2, "assistant", "b"), (4, 0, "system", "only")]
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_chats(df)
    reasons = {(r.conv_id, r.position): r.reason for r in formatted.collect() if not r.valid}
    assert reasons == {
        (1, 1): "user after user", (2, 0): "assistant after the start",
        (3, 1): "unknown role 'robot'",
    }
    whole = {r.conv_id: r.valid for r in chat.read_back(formatted).collect()}
    assert whole == {1: False, 2: False, 3: False, 4: False}


def test_segments_and_offsets(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b<s>")], SCHEMA)
    turns = sorted(chat.format_chats(df).collect(), key=lambda r: r.position)
    text = "".join(s["text"] for r in turns for s in r["segments"])
    assert text == "[INST] a [/INST] <s>b<\\s></s>\n"
    assert [r.start for r in turns] == [0, text.index("<s>")]
    assert [s["loss"] for r in turns for s in r["segments"]] == [False] * 4 + [True, False]
    assert chat.read_back(chat.format_chats(df)).first().formatted_chars == len(text)


def test_no_conversations_and_extra_columns(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_chats(empty)).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).withColumns(
        {c: F.lit("x") for c in ("position", "segments", "valid", "state")}
    )
    assert digests(extra) == {1: expected([("user", "a")])}
    assert digests(chat.with_probe(extra))[-1][0] == 2


def test_unusable_templates():
    for marks in (Marks("a\\b", "</x>"), Marks("<x><y>", "</x>")):
        with pytest.raises(ValueError):
            ChatTemplate({"user": marks}, ("{r ", " =}"), "{/r}", {}, ())
