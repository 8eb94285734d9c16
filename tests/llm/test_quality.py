"""The cascade against plain definitions, whatever order its rules come in."""

import random
import re

from rideledger.llm import quality
from rideledger.llm.quality import RULES, Measures, estimated, judged

SCHEMA = "doc_id bigint, text string, kept string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, window in enumerate(windows) if windows.count(window) > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(60):
        vocabulary = rng.choice([["a", "b"], [f"wort{j}é" for j in range(40)], ["THE!!", "ENTIRE!!", "OTHER"], [f"x{j}%%%" for j in range(300)], [f"word{j}" for j in range(900)]])
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", " ", "  "]) for _ in range(rng.choice([0, 3, 49, 50, 51, 200])))
        rows.append((i, text, "x", "y"))
    rows += [(60, None, "", ""), (61, "", "", ""), (62, "same line here\n" * 40, "", ""), (None, "word " * 60, "", ""), (3, rows[3][1], "x", "y")]
    return rows


def test_equals_plain_definitions(spark):
    rows = corpus()
    got = judged(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {key: text for key, text, *_ in rows}
    for row in got:
        n, chars, symbols, dup, repeated = plain(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert row.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert row.kept == (not row.base_failed and not any(rule(Measures(texts[row.doc_id])) for rule in RULES.values()))


def test_order_changes_nothing_but_work(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), SCHEMA)
    want = sorted(judged(df).collect(), key=repr)
    monkeypatch.setattr(quality, "estimated", lambda docs, rules: [(name, 1.0, 0.0) for name in reversed(list(rules))])
    assert sorted(judged(df).collect(), key=repr) == want


def test_estimates(spark):
    told = estimated(spark.createDataFrame(corpus(), SCHEMA))
    assert {name for name, *_ in told} == set(RULES)
    ranks = [share / max(cost, 1e-9) for _, cost, share in told]
    assert ranks == sorted(ranks, reverse=True)


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_good_documents_stay(spark):
    """Labelled documents of good quality that pass the base conditions."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    told = judged(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").avg("n_words").collect()
    assert told
    kept = judged(docs).join(labels, "doc_id").where("not base_failed").selectExpr("quality", "cast(kept as int) kept").groupBy("quality").avg("kept")
    rates = {row.quality: row["avg(kept)"] for row in kept.collect()}
    assert rates[1] > 0.99 and rates[0] < 0.5
