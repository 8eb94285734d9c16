"""The trie of conversations against SQL and a plain tree, in one shard and in many."""

import hashlib
import random
import zlib

import duckdb
import pytest

from rideledger.llm.oracle import TRIE
from rideledger.llm.trie import RESULT, nodes, rebuilt, turn_lists

SCHEMA = "conv_id bigint, turn bigint, role string, text string, ids string, tie string, shard string, path string"


def rows_of(seed, conversations=120, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(-3, conversations), 10**12 + 7, None]:
        for turn in range(rng.choice([1, 2, 5, longest])):
            turn = rng.choice([turn] * 9 + [1, None])
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", None, ""]), rng.choice(["", None, "é𝒳", "a", "a", "bb"]), "i", "t", "s", "p"))
    return rows


def plainly(lists):
    """Nodes of (conv_id, [(role, text), ...]) by a tree of dictionaries."""
    members = {}
    for conv, turns in lists:
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append((conv, len(turns)))
    children = {path: [] for path in members}
    for path in members:
        if path:
            children[path[:-1]].append(path)
    rows = []
    for path, held in members.items():
        stack, leaves, saved = [path], 0, 0
        while stack:
            one = stack.pop()
            stack += children[one]
            leaves += not children[one]
            saved += (len(members[one]) - 1) * (len(one[-1][1]) if one else 0)
        ends = ",".join(str(conv) for conv, n in sorted(held) if n == len(path))
        parent = min(members[path[:-1]])[0] if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(held)[0], len(path), parent, len(held), len(children[path]), leaves, saved, digest))
    return sorted(map(repr, rows))


def shown(df):
    assert df.columns == list(RESULT)
    return sorted(repr(tuple(row)) for row in df.collect())


def table(spark, lists):
    rows = [(conv, place, role, text) for conv, turns in lists for place, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("shard_turns", [1 << 18, 60])
def test_equals_sql(spark, shard_turns):
    df = spark.createDataFrame(rows_of(shard_turns), SCHEMA)
    duck = duckdb.connect()
    conversations = df.select("conv_id", "turn", "role", "text").toArrow()
    duck.register("conversations", conversations)
    want = sorted(map(repr, duck.execute(TRIE).fetchall()))
    assert shown(nodes(rebuilt(turn_lists(df.repartition(3))), shard_turns)) == want


@pytest.mark.parametrize("shard_turns", [1 << 18, 40, 7])
def test_hot_beginnings_and_copies(spark, shard_turns):
    rng = random.Random(4)
    deep = [("user", f"turn {i}") for i in range(40)]
    lists = [(conv, deep) for conv in range(30)]
    lists += [(100 + conv, deep[: rng.randrange(1, 40)] + [("assistant", str(rng.randrange(3)))] * rng.randrange(3)) for conv in range(40)]
    lists += [(200 + conv, [("user", "hello")]) for conv in range(50)]
    lists += [(300 + conv, [*deep, ("assistant", str(conv % 4)), ("user", str(conv % 3))]) for conv in range(30)]
    assert shown(nodes(turn_lists(table(spark, lists)), shard_turns)) == plainly(lists)


def test_rebuilt_conversations(spark):
    df = spark.createDataFrame(rows_of(9, 210), SCHEMA)
    held = {row.conv_id: [tuple(turn) for turn in row.turns] for row in turn_lists(df).collect()}
    got = {row.conv_id: [tuple(turn) for turn in row.turns] for row in rebuilt(turn_lists(df)).collect()}
    assert set(got) == set(held) and None not in got
    for conv, turns in got.items():
        taken = zlib.crc32(str(conv).encode()) % 6
        base = held.get(conv - (conv % 100 if conv >= 0 else -(-conv % 100)), [])
        assert turns == base[:taken] + held[conv][taken:]
    assert any(not turns for turns in got.values())


def test_long_conversation(spark):
    lists = [(1, [("user", str(i)) for i in range(300)]), (2, [("user", str(i)) for i in range(200)]), (3, [("user", "x" * 1_000_000)])]
    assert shown(nodes(turn_lists(table(spark, lists)), 100)) == plainly(lists)


def test_empty_table(spark):
    assert nodes(rebuilt(turn_lists(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_very_long_conversation_by_its_chain(spark):
    lists = [(conv, [("user", str(i)) for i in range(length)]) for conv, length in ((1, 20_000), (2, 15_000))]
    saved = [0] * 20_002
    for depth in range(20_000, -1, -1):
        saved[depth] = saved[depth + 1] + (len(str(depth - 1)) if 1 <= depth <= 15_000 else 0)
    want = [(depth, 2 if depth <= 15_000 else 1, int(depth < 20_000), 1, saved[depth]) for depth in range(20_001)]
    got = nodes(turn_lists(table(spark, lists)), 9000).select("depth", "n_convs", "n_children", "n_leaves", "saved_tokens").collect()
    assert sorted(map(tuple, got)) == want
