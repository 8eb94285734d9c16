"""Line deduplication against a comparison of all pairs of lines."""

import random

import pytest

from rideledger.llm.line_dedup import deduplicated

SCHEMA = "doc_id bigint, text string, place int, line string, h string"


def close(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 20 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def has_word(line):
    return line.strip(" \t\n\r\x0b\x0c") != ""


def brute_force(rows):
    """doc_id -> text; ids are distinct here."""
    seen, out = [], {}
    for key, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0)):
        if text is None:
            out[key] = None
            continue
        held = []
        for line in text.split("\n"):
            if not has_word(line):
                held.append(line)
                continue
            if not any(close(line, other) and (line == other or min(len(line), len(other)) >= 20) for other in seen):
                held.append(line)
            seen.append(line)
        out[key] = "\n".join(held)
    return out


def edit(rng, line):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("abé") + line[i + 1 :], line[:i] + rng.choice("abé") + line[i:]])


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeé  ") for _ in range(rng.choice([1, 5, 19, 20, 21, 40, 90, 400]))) for _ in range(60)]
    pool += ["a" * 30, "a" * 31, "ab" * 20, "x" * 25 + "y" * 25]
    rows = []
    for key in range(60):
        lines = []
        for _ in range(rng.randrange(8)):
            line = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = edit(rng, line) if line else line
            lines.append(line)
            if rng.random() < 0.3:
                pool.append(line)
        rows.append((key, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, " \n\t\n"), (None, "a line that is here first, before all\nother"), (63, "a line that is here first, before al\nother")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_comparison_of_all_lines(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(key, text, 7, "x", "y") for key, text in rows], SCHEMA).repartition(3)
    got = deduplicated(df)
    assert got.columns == [*df.columns, "_n_lines", "_n_removed"]
    got = got.collect()
    assert {row.doc_id: row.text for row in got} == brute_force(rows)
    texts = dict(rows)
    for row in got:
        assert row._n_lines == sum(map(has_word, (texts[row.doc_id] or "").split("\n")))
        assert (row.place, row.line, row.h) == (7, "x", "y")


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one line of some length here\ntwo", 1, "", "")] * 2 + [(1, "two\nthree", 1, "", "")]
    got = sorted((row.text, row._n_removed) for row in deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(got) == 3
    assert got.count(got[0]) == 2 or got.count(got[1]) == 2
    assert sum(text.count("two") for text, _ in got) in (1, 2)
    assert deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_native_operators(spark):
    plan = deduplicated(spark.createDataFrame(corpus(1), "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
