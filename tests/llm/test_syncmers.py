"""Syncmer fingerprints against a plain search and the contract of the edited text."""

import hashlib
import random

import pytest

from rideledger.llm import syncmers as sy
from rideledger.llm.syncmers import K, S, anchors, edited, fingerprint, fingerprints, likeness, syncmers

SCHEMA = "doc_id bigint, text string, tie string, head string, n_chars string"


def brute_force(text):
    """Positions whose k-mer's least s-mer stands at an edge; hashes of s-mers as the operator has them."""
    at, hashes = [], []
    for i in range(len(text) - K + 1):
        inner = [smer_hash(text[i + j : i + j + S]) for j in range(K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            at.append(i)
            hashes.append(text[i : i + K])
    return at, hashes


def smer_hash(smer):
    mask, steps = (1 << 64) - 1, [int(x) for x in sy._STEPS]

    def run(points):
        if len(points) == 1:
            return points[0]
        half = len(points) // 2
        step = {2: 0, 4: 1, 8: 2}[len(points)]
        return (run(points[:half]) * steps[step] + run(points[half:])) & mask

    value = run([ord(c) for c in smer])
    value = ((value ^ (value >> 32)) * 0xE7037ED1A0B428DB) & mask
    return value ^ (value >> 29)


def text_of(rng, n):
    return "".join(rng.choice("abcdeé 日𝒳\n") for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 33, 500])
def test_equals_plain_search(n):
    text = text_of(random.Random(n), n)
    at, hashes = syncmers(text)
    want, kmers = brute_force(text)
    assert at.tolist() == want
    by_kmer = {}
    for kmer, value in zip(kmers, hashes.tolist(), strict=True):
        assert by_kmer.setdefault(kmer, value) == value
    assert len(set(by_kmer.values())) == len(by_kmer)


def test_anchors_do_not_depend_on_context():
    rng = random.Random(1)
    passage = text_of(rng, 300)
    one, other = (text_of(rng, n) + passage + text_of(rng, n) for n in (17, 90))
    a, b = (set(syncmers(text)[1].tolist()) for text in (one, other))
    assert len(a & b) >= len(set(syncmers(passage)[1].tolist()))


def test_likeness():
    rng = random.Random(2)
    text = text_of(rng, 4000)
    assert likeness(fingerprint(text), fingerprint(text)) == 1.0
    assert 0.4 < likeness(fingerprint(text), fingerprint(edited(text, text_of(rng, 4000)))) < 0.8
    assert likeness(fingerprint(text), fingerprint(text_of(rng, 4000))) < 0.05
    assert likeness(fingerprint(""), fingerprint("")) == 1.0
    assert likeness(fingerprint(""), fingerprint("a")) == 0.0


@pytest.mark.parametrize("stretch", [1, 7, 1024])
def test_contract(spark, monkeypatch, stretch):
    monkeypatch.setattr(sy, "STRETCH", stretch)
    rng = random.Random(3)
    rows = [(i * 7, text_of(rng, rng.choice([0, 1, 5, 40, 900])), "x", "y", "z") for i in range(120)]
    rows += [(5000, None, "x", "y", "z"), (5001, "", "x", "y", "z"), (rows[3][0] + 1, rows[3][1], "x", "y", "z")]
    order = sorted(rows)
    rng.shuffle(rows)
    got = {row.doc_id: row for row in fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(got) == len(rows)
    for place, (key, text, *_) in enumerate(order):
        text, after = text or "", order[(place + 1) % len(order)][1] or ""
        quarter = len(text) // 4
        want = text[: len(text) - quarter] + after[:quarter]
        row = got[key]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert row.fingerprint == fingerprint(text) and row.edited_fingerprint == fingerprint(want)
        assert row.near_edited == likeness(fingerprint(text), fingerprint(want))
        assert row.near_next == likeness(fingerprint(text), fingerprint(after))


@pytest.mark.parametrize("stretch", [1, 1024])
def test_repeated_rows_null_ids_and_empty_table(spark, monkeypatch, stretch):
    monkeypatch.setattr(sy, "STRETCH", stretch)
    rows = [(1, "a" * 50, "", "", ""), (1, "a" * 50, "", "", ""), (1, "b" * 50, "", "", ""), (None, "c" * 50, "", "", "")]
    got = fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4
    assert len({tuple(row) for row in got}) == 3
    assert fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fingerprints(spark.createDataFrame([(4, "abcdefgh", "", "", "")], SCHEMA)).collect()
    assert one[0].near_next == 1.0


def test_anchor_table(spark):
    text = text_of(random.Random(4), 200)
    got = anchors(spark.createDataFrame([(9, text, "", "", ""), (8, None, "", "", "")], SCHEMA)).collect()
    assert sorted(row.position for row in got) == syncmers(text)[0].tolist()
    assert {row.doc_id for row in got} == {9}
