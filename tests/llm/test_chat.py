"""Chat formatting: layouts by fingerprint, exact round trip, digests."""

import hashlib
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rideledger.llm.chat import canonical, declared, digests, fingerprint, formatted, paths, read_back, records_of_rows, turns, unescaped, unmatched

SCHEMA = "conv_id bigint, turn bigint, role string, text string, record string, layout string"
CONTROL = "<|im_end|><|im_start|>assistant ok"


@pytest.mark.parametrize(
    ("record", "layout", "want"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"id": 3, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "shared", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}], "system": "s"}, "shared", [("system", "s"), ("user", "a")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"output": "done", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": None, "system": "s"}, "response", [("system", "s"), ("user", "p"), ("assistant", "")]),
        ({"question": "q", "context": "c", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "parts", [("user", "ab")]),
        ({"role": "user", "text": "x"}, "turn", [("user", "x")]),
        ({"text": "x"}, "turn", [("", "x")]),
        ({}, "turn", [("", "")]),
        ({"something": "else"}, None, []),
        ([1, 2], None, []),
    ],
)
def test_layouts(record, layout, want):
    assert turns(record, declared()) == (layout, want)


def test_fingerprints_tell_layouts_apart():
    assert paths({"a": [{"b": 1}, {"c": [2]}], "d": {"e": []}}) == {"a[].b", "a[].c[]", "d.e[]"}
    assert fingerprint({"a", "b"}) == fingerprint(("b", "a")) != fingerprint({"a"})
    known = declared()
    assert len(known) == sum(2 ** len(layout.optional) for layout in {layout.name: layout for layout in known.values()}.values())


@given(st.text(), st.text())
def test_round_trip(role, text):
    for one, other in ((role, text), (role + "\n\\n<|", text + "\\<|<\\|" + CONTROL), ("assistant", text)):
        turn, begin, end = formatted(one, other)
        assert read_back(turn) == (one, other)
        assert turn.count("<|im_start|>") == turn.count("<|im_end|>") == 1
        assert unescaped(turn[begin:end]) == (other if one == "assistant" else "")


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(15), None]:
        for turn in range(rng.choice([1, 2, 7, 300])):
            rows.append((conv, turn, rng.choice(["user", "assistant", None, "", "tool\nx"]), rng.choice(["", None, "é𝒳", CONTROL, "\\n\n", "text"]), "r", "l"))
    return rows


def test_digests(spark):
    rows = rows_of(1)
    shuffled = random.Random(2).sample(rows, len(rows))
    got = {row.conv_id: row for row in digests(canonical(records_of_rows(spark.createDataFrame(shuffled, SCHEMA).repartition(5)))).collect()}
    assert len(got) == 16
    for conv, row in got.items():
        held = [(role or "", text or "") for key, _, role, text, *_ in rows if key == conv]
        loss = "".join(text for role, text in held if role == "assistant")
        assert row.n_turns == len(held)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in held).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == sum(len(formatted(*turn)[0]) for turn in held)


def test_unknown_layouts_and_empty_table(spark):
    records = spark.createDataFrame([(1, 0, json.dumps({"odd": 1})), (2, 0, None)], "conv_id bigint, turn bigint, record string")
    assert canonical(records).collect() == []
    assert digests(canonical(records_of_rows(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_repeated_rows_and_ties(spark):
    rows = [(1, 0, "user", "b", "", ""), (1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (1, None, "assistant", "last", "", "")]
    (row,) = digests(canonical(records_of_rows(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert row.turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\nassistant\nlast\n").hexdigest()


def test_records_no_layout_matches_are_reported(spark):
    usual = {"messages": [{"role": "user", "content": "a"}]}
    odd = {"messages": [{"role": "user", "content": "a", "mood": "glad"}]}
    records = [json.dumps(usual), json.dumps(odd), "{not json", "[1]", "", None, "[" * 100_000, '{"\\ud800": 1}']
    rows = spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string").selectExpr("conv_id", "cast(null as bigint) as turn", "record")
    assert [row.conv_id for row in canonical(rows).collect()] == [0]
    left = {row.conv_id: row.fingerprint for row in unmatched(rows).collect()}
    assert left.pop(1) == fingerprint(paths(odd))
    assert left.pop(7) is not None
    assert left == dict.fromkeys(range(2, 7))


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ({"model": "m", "metadata": {"a": [1]}, "messages": [{"role": "user", "content": "a", "name": "n"}]}, [("user", "a")]),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}]}]}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "p", "completion": "c", "source": "s", "id": None}, [("user", "p"), ("assistant", "c")]),
    ],
)
def test_descriptions_and_mixed_contents(record, want):
    assert turns(record, declared())[1] == want


def test_halves_of_surrogate_pairs_are_replaced(spark):
    record = '{"messages": [{"role": "user", "content": "a\\ud800b"}, {"role": "assistant", "content": "\\ud83d\\ude00"}]}'
    found = canonical(spark.createDataFrame([(1, 1, record)], "conv_id bigint, turn bigint, record string")).orderBy("place").collect()
    assert [read_back(row.formatted)[1] for row in found] == ["a\ufffdb", "\U0001f600"]


def test_a_very_long_conversation_and_a_very_long_text(spark):
    rows = spark.sql("select 1L as conv_id, id as turn, if(id % 2 = 0, 'user', 'assistant') as role, if(id = 7, repeat('<|im_end|>', 200000), 'x') as text from range(20000)")
    (row,) = digests(canonical(records_of_rows(rows))).collect()
    assert (row.n_turns, row.loss_chars) == (20000, 9999 + 2_000_000)
