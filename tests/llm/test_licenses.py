"""The licence scan against a plain reading of the same rules."""

import random
import re
from itertools import product

import pytest

from rideledger.llm.license_rules import BASE, GATES, rules
from rideledger.llm.licenses import scanned, summary

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, start int, label string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_force(key, text):
    tokens = WORDS.findall(lowered(text))
    joined = " " + " ".join(tokens) + " "
    found = []
    for rule in rules():
        for match in re.finditer(f" (?:{rule.pattern})(?= )", joined):
            start = joined[: match.start()].count(" ")
            found.append((rule.priority, -match.group().count(" "), start, rule.label))
    # Pairwise: a detection goes if a better one lies in it or around it.
    left = []
    by_word = {}
    for one in set(found):
        for word in range(one[2], one[2] - one[1]):
            by_word.setdefault(word, []).append(one)
    for one in set(found):
        first, last = one[2], one[2] - one[1]
        near = {other for word in range(first, last) for other in by_word[word] if other < one}
        if not any((o[2] <= first and o[2] - o[1] >= last) or (o[2] >= first and o[2] - o[1] <= last) for o in near):
            left.append(one)
    labels = {label for *_, label in left}
    covered = len({word for _, back, start, _ in left for word in range(start, start - back)})
    base = [(i, label) for phrase, label in BASE.items() for i in range(len(tokens)) if tokens[i : i + phrase.count(" ") + 1] == phrase.split()]
    own = {label for _, label in base}
    starts = [i for i, _ in base]
    return (key, len(tokens), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)),
            round(covered / len(tokens), 9) if tokens else 0.0)


def corpus():
    rng = random.Random(5)
    pieces = [
        "Released under the MIT License.", "mit license mit license", "MIT-License", "the mit\nlicense", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1", "Licensed under CC BY-NC 4.0.",
        "All rights reserved.", "SPDX-License-Identifier: GPL-2.0-or-later", "general public license general public license", "Apache License",
        "https://www.apache.org/licenses/LICENSE-2.0.html", "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "under the terms of the Foo Bar License", "éMIT license", "mit licenseé", "MİT License", "mit licence", "creative commons attribution non-commercial 4.0",
        "released into the public domain", "word", "Ünder", "a b c", "", "...", "published under BSD-3-Clause license", "kelvin K MIT LICENSE",
    ]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(pieces, k=rng.choice([0, 1, 2, 5, 30]))), 1, "x") for i in range(150)]
    rows += [(150, None, 1, "x"), (151, "", 1, "x"), (152, "MIT license " * 3000, 1, "x"), (3, rows[3][1], 1, "x"), (None, "mit license", 1, "x")]
    return rows


def test_equals_plain_reading(spark):
    rows = corpus()
    got = summary(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = sorted((tuple(row)[:-1] + (round(row.score, 9),) for row in got), key=repr)
    assert got == sorted((brute_force(key, text) for key, text, *_ in rows), key=repr)


def test_columns_pass_and_plan_is_native(spark):
    df = scanned(spark.createDataFrame(corpus(), SCHEMA))
    assert df.columns[:4] == ["doc_id", "text", "start", "label"]
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
    assert summary(spark.createDataFrame([], SCHEMA)).collect() == []


def test_gates_hold_for_every_rule():
    """A text without gate words must be one that no rule matches: every pattern holds one as a literal."""
    for rule in rules():
        held = rule.pattern.replace("licen[cs]e", "licence")
        assert any(gate.strip() in held or gate.strip() in rule.keyword for gate in GATES), rule


def wordings(parsed):
    """Texts that a parsed pattern matches, with every alternative, option and letter of a class."""
    parts = []
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            parts.append([chr(value)])
        elif kind == "NOT_LITERAL" or kind == "ANY":
            parts.append(["q"])
        elif kind == "IN":
            parts.append([chr(each if isinstance(each, int) else each[0]) for _, each in value])
        elif kind == "SUBPATTERN":
            parts.append(wordings(value[-1]))
        elif kind == "BRANCH":
            parts.append([text for branch in value[1] for text in wordings(branch)])
        else:
            least, _, inner = value
            assert kind in ("MAX_REPEAT", "MIN_REPEAT")
            parts.append(sorted({text * n for text in wordings(inner) for n in {least, max(1, least)}}))
    return ["".join(each) for each in product(*parts)]


def test_every_wording_holds_keyword_and_gate():
    for rule in rules():
        for text in wordings(re._parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text)
            assert rule.keyword in text, rule
            assert any(gate in f" {text} " for gate in GATES), rule


def test_cc0_by_its_name(spark):
    rows = [(1, "Creative Commons Zero 1.0 Universal"), (2, "Licensed under Creative Commons Zero"), (3, "creative commons zero, v1.0 universal"), (4, "CC0 1.0")]
    got = summary(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(row.labels, round(row.score * row.n_words)) for row in got] == [("cc0-1.0", 6), ("cc0-1.0", 5), ("cc0-1.0", 3), ("cc0-1.0", 3)]
    assert [tuple(row)[:-1] + (round(row.score, 9),) for row in got] == [brute_force(*row) for row in rows]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frame = docs.select("doc_id", "text").toPandas()
    want = sorted(brute_force(int(key), text) for key, text in zip(frame.doc_id, frame.text, strict=True))
    got = sorted(tuple(row)[:-1] + (round(row.score, 9),) for row in summary(docs).collect())
    assert got == want


GENERAL = ["under the terms of the {}", "subject to the {}", "This work is proprietary, under the terms of the {}", "licensed under the terms of the {}", "see the {} for details"]
TITLES = {
    "Mozilla Public License": "mpl", "Eclipse Public License, v2.0": "epl-2.0", "Artistic License": "artistic", "GNU Lesser General Public License": "gpl,lgpl",
    "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1", "GNU Affero General Public License": "agpl,gpl", "Boost Software License 1.0": "bsl-1.0",
    "Apache License": "apache", "European Union Public License 1.2": "eupl-1.2", "MIT License": "mit", "Python Software Foundation License": "python-2.0",
}


def test_titles_behind_general_rules(spark):
    """Labels written by hand; gpl, apache and mit come from the base phrases too."""
    rows, want = [], {}
    for i, (general, (title, label)) in enumerate(product(GENERAL, TITLES.items())):
        rows.append((i, general.format(title)))
        want[i] = label
    got = {row.doc_id: row.labels for row in summary(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_texts_of_licences_and_spellings(spark):
    said = {
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
        "GPLv3": "gpl-3.0", "LGPL-2.1+": "lgpl-2.1", "EUPL-1.2": "eupl-1.2", "gplv2 or later": "gpl-2.0", "AGPLv3": "agpl-3.0", "MPL-2.0": "mpl-2.0",
        "you may not use this file except in compliance with the License.": "apache-2.0", "bsd-3-clause": "bsd-3-clause",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights": "cc0-1.0", "a simple epl match": "",
        "All advertising materials mentioning features or use of this software must display": "bsd-4-clause",
    }
    rows = list(enumerate(said))
    got = {row.doc_id: row.labels for row in summary(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i, _ in rows] == list(said.values())
