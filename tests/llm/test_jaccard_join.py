"""The similarity join against a comparison of all pairs."""

import random
from itertools import combinations

import pytest

from rideledger.llm.jaccard_join import linked_documents, shingle_set, without_copies

SCHEMA = "doc_id bigint, text string, lang string, node string"


def shingles(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return frozenset()
    return frozenset(tuple(tokens[i : i + 4]) for i in range(max(1, len(tokens) - 3)))


def brute_force(rows):
    sets = [(key, shingles(text)) for key, text, *_ in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((repr(key), len(s), repr(least.get(find(i)))) for i, (key, s) in enumerate(sets))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, key = [], 0

    def add(text):
        nonlocal key
        rows.append((key, text, "en", "x"))
        key += 1

    base = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 80, 200]))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for tokens in base:
        for _ in range(rng.choice([1, 2, 6])):
            add(" ".join(tokens))
        for _ in range(14):  # chains of ever more changes, so that links are not transitive
            tokens = list(tokens)
            for _ in range(rng.choice([1, 1, 2])):
                tokens[rng.randrange(len(tokens))] = rng.choice(vocabulary)
            add(" ".join(tokens))
    for _ in range(25):
        add(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 8, 12, 40]))]))
    for _ in range(20):
        add(" ".join(rng.choice(vocabulary) for _ in range(40)).upper())
    rows += [(key, None, None, None), (key + 1, "", "", ""), (key + 2, " \n\t", "", ""), (key + 3, "One two", "", ""),
             (key + 4, "one  TWO", "", ""), (None, "one two", "", ""), (3, rows[3][1], "en", "x"), (key + 5, "É a b c", "", ""), (key + 6, "é a b c", "", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparison_of_all_pairs(spark, seed):
    rows = corpus(seed)
    got = linked_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_force(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = without_copies(df)
    assert kept.columns == df.columns
    got = sorted(repr(row.doc_id) for row in kept.collect())
    want = sorted({key for key, n, component in brute_force(rows) if n and key == component and key != "None"} | {key for key, n, _ in brute_force(rows) if not n})
    assert got == want


def test_empty_table(spark):
    assert linked_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    assert without_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_set_sizes_are_exact():
    for text in (None, "", "a", "a b c d", "a b c d a b c d", "A b C d e"):
        assert len(shingle_set(text)) == len(shingles(text))
