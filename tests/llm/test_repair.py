"""Repair against a search through all edits, and the rows that come out."""

import hashlib
import random
import re

import duckdb
import pytest

from rideledger.llm import repair
from rideledger.llm.oracle import REPAIR
from rideledger.llm.repair import LOST, audits, cheapest, damaged, digests, edits

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, damage string, copy string, part string"


def by_all_edits(kinds):
    """Every sequence of edits with up to two insertions in a row, as (cost, audit, initials)."""
    found = [(0, "", "")]
    for kind in [*kinds, None]:
        grown = []
        for cost, audit, said in found:
            grown.append((cost, audit, said))
            for _ in range(2):
                cost, audit, said = cost + 3, audit + "I", said + ("a" if said.endswith("u") else "u")
                grown.append((cost, audit, said))
        if kind is None:
            found = grown
            break
        found = []
        for cost, audit, said in grown:
            found.append((cost + 4, audit + "D", said))
            if kind != LOST:
                extra = 3 if kind & 4 else 0
                found.append((cost + 3 + extra, audit + "R", said + ("a" if said.endswith("u") else "u")))
                found.append((cost + extra, audit + "K", said + "suax"[kind & 3]))
        found = [one for one in found if re.fullmatch("s?(ua)*u?", one[2])]
    return min((cost, audit) for cost, audit, said in found if re.fullmatch("(s?(ua)+)?", said))


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_edits(seed):
    rng = random.Random(seed)
    kinds = bytes(rng.randrange(9) for _ in range(rng.randrange(0, 5)))
    assert cheapest(kinds) == by_all_edits(kinds)


def test_long_conversation_costs_what_its_audit_says():
    kinds = bytes(random.Random(1).randrange(9) for _ in range(5000))
    cost, audit = cheapest(kinds)
    rows = iter(kinds)
    paid = 0
    for edit in audit:
        kind = LOST if edit == "I" else next(rows)
        paid += {"I": 3, "D": 4, "R": 3, "K": 0}[edit] + (3 if edit in "RK" and kind & 4 else 0)
    assert paid == cost and next(rows, None) is None


def rows_of(seed, conversations=25):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "three", "", " \t\n", None, "One.", "é?\n ", "Four. \x0b", "a.b"]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            turn = rng.choice([turn, turn, turn, 2, None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "Tool"]), rng.choice(texts), "a", "b", "c", "d"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_sql(spark, seed):
    df = spark.createDataFrame(rows_of(seed), SCHEMA)
    rows = damaged(df.repartition(3))
    got = digests(edits(rows, audits(rows)))
    duck = duckdb.connect()
    conversations = df.select("conv_id", "turn", "role", "text").toArrow()
    duck.register("conversations", conversations)
    cursor = duck.execute(REPAIR)
    names = [column[0] for column in cursor.description]
    assert got.columns == names
    assert sorted(map(repr, (tuple(row) for row in got.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_repaired_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "no end"), (1, 3, "assistant", "Yes."), (1, 5, "tool", "What?"),
        (2, 0, "assistant", ""), (3, 0, "system", "Be."), (3, 1, "user", "So."), (3, 2, "assistant", "Done."),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {row.conv_id: row for row in audits(df).collect()}
    assert tuple(found[1]) == (1, 1, 0, 1, 1, 3, 12, "KDDKD")
    assert tuple(found[2]) == (2, 0, 1, 0, 0, 0, 4, "D")
    assert tuple(found[3]) == (3, 0, 0, 0, 0, 0, 0, "KKK")
    done = edits(df, audits(df))
    kept = [(row.conv_id, row.place, row.edit, row.role, row.text) for row in done.where("edit <> 'D'").orderBy("conv_id", "place").collect()]
    assert kept == [
        (1, 1, "K", "user", "Hi."), (1, 4, "K", "assistant", "Yes."),
        (3, 1, "K", "system", "Be."), (3, 2, "K", "user", "So."), (3, 3, "K", "assistant", "Done."),
    ]
    told = {row.conv_id: row.repaired_sha256 for row in digests(done).collect()}
    assert told[1] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest() and told[2] == hashlib.sha256(b"").hexdigest()


def test_very_long_conversation_and_text(spark):
    rows = [(1, turn, "user" if turn % 2 == 0 else "assistant", f"Turn {turn}.") for turn in range(20_000)] + [(2, 0, "user", "x" * 2_000_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {row.conv_id: row for row in digests(edits(df, audits(df))).collect()}
    assert (got[1].cost, got[1].audit) == (0, "K" * 20_000)
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in rows[:-1]).encode()).hexdigest()
    assert (got[2].truncated, got[2].cost, got[2].audit) == (1, 4, "D")


def test_empty_table(spark):
    rows = damaged(spark.createDataFrame([], SCHEMA))
    assert digests(edits(rows, audits(rows))).collect() == []
    assert repair.cheapest(b"") == (0, "")
