"""Mixing: targets by filling up, words near targets, schedule of low discrepancy."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rideledger.llm import mixing
from rideledger.llm.mixing import GOLDEN, mixture, schedule, taken, targets

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, size string, target string"


def filled(sizes):
    """Targets by giving out the excess again and again."""
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weights = {name: i % 3 + 1 for i, name in enumerate(names)}
    left, free, found = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weights[name] for name in free)
        over = {name for name in free if level * weights[name] > 3 * sizes[name]}
        if not over:
            return {**found, **{name: level * weights[name] for name in free}}
        found |= {name: 3.0 * sizes[name] for name in over}
        free -= over
        left -= sum(3 * sizes[name] for name in over)
    return found


def corpus(seed, sources):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        n = rng.choice([0, 1, 10, 60, 300])
        rows.append((i, " ".join(f"w{rng.randrange(99)}" for _ in range(n)), rng.choices(sources, range(1, len(sources) + 1))[0], 0, "x", "y"))
    return [*rows, (400, None, sources[0], 0, "", ""), (401, " \n", "only empty", 0, "", ""), (402, "a b  c", None, 0, "", "")]


def test_targets(spark):
    for seed in range(6):
        rng = random.Random(seed)
        sizes = {name: rng.choice([0, 1, 5, 100, 10_000, 1_000_000]) for name in ["b", "a", "", "é", "Z", None, "c", "𝒳", "\uffee"][: seed + 3]}
        got = {row.source: row.target for row in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys()
        for name, value in want.items():
            assert abs(got[name] - value) <= 1e-9 * max(1, value)


def test_words_come_near_targets(spark):
    rows = corpus(1, ["s1", "s2", "s3", "s4", "s5"])
    df = spark.createDataFrame(rows, SCHEMA)
    got = taken(df.repartition(3)).collect()
    again = taken(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    source = {key: name for key, _, name, *_ in rows}
    words = {key: len((text or "").split()) for key, text, *_ in rows}
    sums, sizes = defaultdict(int), defaultdict(int)
    for row in got:
        assert row.size == words[row.doc_id] and 0 <= row.taken <= 3 * row.size
        sums[source[row.doc_id]] += row.taken
        sizes[source[row.doc_id]] += row.size
    want = filled(sizes)
    for row in got:
        assert row.source_size == sizes[source[row.doc_id]]
        assert abs(row.target - want[source[row.doc_id]]) < 1e-6
    for name, value in want.items():
        assert abs(sums[name] - value) <= 0.01 * value + 2


def test_every_stretch_is_mixed_alike(spark):
    goals = spark.createDataFrame([("a", 10**7, 1e6), ("b", 10**7, 2e6), (None, 10**7, 3e6)], "source string, source_size bigint, target double")
    slots = schedule(goals, 6_000_000, 1000).orderBy("slot").collect()
    assert [row.slot for row in slots] == list(range(6000))
    for at in range(0, 6000, 100):
        counts = Counter(row.source for row in slots[at : at + 100])
        assert abs(counts["a"] - 100 / 6) < 4 and abs(counts["b"] - 200 / 6) < 4
    ranks = defaultdict(list)
    for row in slots:
        ranks[row.source].append(row.block + row.epoch * 10_000)
        point = row.slot * GOLDEN % 2**32 / 2**32
        assert row.source == ("a" if point < 1 / 6 - 1e-9 else "b" if point < 1 / 2 - 1e-9 else None)
    assert all(held == list(range(len(held))) for held in ranks.values())


def test_mixture_is_what_is_taken(spark):
    rows = corpus(2, ["s1", "s2", "s3"])
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixture(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    texts = {key: text for key, text, *_ in rows}
    for row in mixed.collect():
        words[row.doc_id] += len(row.text.split())
        assert row.n_chars == len(row.text)
        assert row.text == texts[row.doc_id] or " ".join(row.text.split()) in " ".join(texts[row.doc_id].split())
    assert dict(words) == {row.doc_id: row.taken for row in taken(df).collect() if row.taken}


def test_targets_are_met_by_sources_of_less_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 8)
    sizes = {"big": 3000, "tiny": 1, "small": 20, "less than a block": 300, None: 460, "other": 2000}
    rows, key = [], 0
    for name, size in sizes.items():
        while size:
            n = min(size, 37)
            rows.append((key, " ".join(f"w{key}x{i}" for i in range(n)), name, 0, "x", "y"))
            key, size = key + 1, size - n
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    total = sum(sizes.values())
    assert -(-total // mixing.SLOTS) > 700
    want, sums = filled(sizes), defaultdict(int)
    for row in taken(df).collect():
        sums[rows[row.doc_id][2]] += row.taken
        full = row.target // row.source_size
        assert full * row.size <= row.taken <= (full + 1) * row.size
    assert {name: abs(sums[name] - value) <= 0.5 + 1e-6 for name, value in want.items()} == dict.fromkeys(sizes, True)
    words = Counter(word for row in mixture(df).collect() for word in row.text.split())
    assert sum(words.values()) == sum(sums.values()) and max(words.values()) <= 3


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d", "s", 0, "", "")] * 5 + [(2, "e f", "t", 0, "", "")]
    got = taken(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 6
    assert got.agg(F.max(F.expr("taken - 3 * size"))).first()[0] <= 0
    assert sorted(map(repr, got.collect())) == sorted(map(repr, taken(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()))
    assert taken(spark.createDataFrame([], SCHEMA)).collect() == []
    none = taken(spark.createDataFrame([(1, None, "s", 0, "", ""), (2, "", None, 0, "", "")], SCHEMA)).collect()
    assert [(row.size, row.taken, row.target) for row in none] == [(0, 0, 0.0)] * 2
    assert mixture(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.SLOTS == 1 << 18
