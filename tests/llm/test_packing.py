"""Packing: every id once, in place, little padding, and neighbours that share words."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from rideledger.llm import packing
from rideledger.llm.packing import END, WINDOW, Neighbours, TokenIds, packed, windows

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, shard string, ids string"
ODD = ["", None, "It's we'll I'D don't", "a b\x1cc\x85d", "<|endoftext|> x", "\x01 a", "ΑΣ ας Σ", "İstanbul Kelvin K", "é ́x", "12 a1b2 ½ ²", "naïve CAFÉ, ..!?",
       "ﬁ ①x", "日本語 テスト。", "a" * 5000, "x.,y ,;: !", "don't.", "ǅ ß ẞ", " \n\t "]


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer():
    tokenizer, ids = Tokenizer.from_file(PATH), TokenIds(PATH)
    assert ids.direct
    for _ in range(2):
        assert [found.tolist() for found in ids(ODD)] == [plain(tokenizer, text) for text in ODD]


class Asked:
    """The tokenizer of words, with the number of times it was asked."""

    def __init__(self, words):
        self.words, self.calls = words, 0

    def encode_batch_fast(self, texts, **options):
        self.calls += 1
        return self.words.encode_batch_fast(texts, **options)


def test_new_words_of_a_call_go_to_the_model_at_once(monkeypatch):
    tokenizer, ids = Tokenizer.from_file(PATH), TokenIds(PATH)
    ids.words = Asked(ids.words)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeéÉö", k=rng.randint(1, 9))) + rng.choice(["", ".", ",!"]) for _ in range(40)) for _ in range(50)]
    want = [plain(tokenizer, text) for text in texts]
    assert [found.tolist() for found in ids(texts)] == want and ids.words.calls == 1
    assert [found.tolist() for found in ids(texts)] == want and ids.words.calls == 1
    monkeypatch.setattr(packing, "KEPT", 100)
    assert [found.tolist() for found in ids(texts)] == want and ids.words.calls == 2
    assert [found.tolist() for text in [[], ["", " a "], ["é1 ½,"]] for found in ids(text)] == [[], plain(tokenizer, "a"), plain(tokenizer, "é1 ½,")]


def corpus(seed):
    rng = random.Random(seed)
    words = ["river", "stone", "light", "Haus", "été", "über,", "42", "end."]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 50, 700, 5000]))), "s", "t") for i in range(60)]
    rows += [(100 + i, text, None, None) for i, text in enumerate(ODD)]
    rows += [(None, "no id", "", ""), rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_every_id_once_and_in_place(spark, seed):
    tokenizer, rows = Tokenizer.from_file(PATH), corpus(seed)
    got = packed(spark.createDataFrame(rows, SCHEMA).repartition(4), PATH).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for piece in got:
        sequences[piece.sequence_id].append(piece)
        documents[piece.doc_id].append(piece)
        assert len(piece.ids) == 4 * piece.length
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda piece: piece.offset)
        at = 0
        for piece in pieces:
            assert piece.offset == at and piece.length > 0
            at += piece.length
        assert at <= WINDOW
        padding += 0 if at & (at - 1) == 0 else WINDOW - at
    assert padding == 0
    texts = defaultdict(list)
    for key, text, *_ in rows:
        texts[key].append(text)
    for key, held in texts.items():
        pieces = sorted(documents[key], key=lambda piece: piece.start)
        want = np.array([*plain(tokenizer, held[0]), END], dtype="<u4")
        assert {piece.doc_tokens for piece in pieces} == {len(want)}
        assert sum(piece.length for piece in pieces) == len(want) * len(held)
        for piece in pieces:
            assert piece.ids == want[piece.start : piece.start + piece.length].tobytes()
            assert zlib.crc32(piece.ids) == zlib.crc32(want[piece.start : piece.start + piece.length].tobytes())


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_scores_are_bm25():
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint16) for _ in range(20)]
    index = Neighbours(documents)
    mean = np.mean([len(d) for d in documents])
    for asking in range(20):
        held = {int(t): sum(t in d for d in documents) for t in np.unique(documents[asking])}

        def weight(term, document):
            times = int((document == term).sum())
            idf = np.log1p((20 - held[term] + 0.5) / (held[term] + 0.5))
            return idf * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * len(document) / mean))

        terms = sorted((t for t in held if held[t] > 1), key=lambda t: (-weight(t, documents[asking]), t))[:12]
        want = [sum(weight(t, d) for t in terms) for d in documents]
        np.testing.assert_allclose(index.scores(asking), want, rtol=1e-9)


def test_windows_hold_likes():
    rng = np.random.default_rng(2)
    documents = [(rng.integers(0, 50, 300) + 1000 * (i % 4)).astype(np.uint16) for i in range(80)]
    mixed = [len({number % 4 for number, *_ in window}) for window in windows(documents)]
    assert np.mean(mixed) < 2


def test_likes_meet_and_statistics_are_of_all(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    monkeypatch.setattr(packing, "RANGE_DOCS", 64)
    rng = random.Random(3)
    rows = []
    for group in range(100):
        own = [f"{rng.choice('bdgkmt')}{rng.choice('aeiou')}{group}x{i}" for i in range(6)]
        rows += [(4 * group + copy, " ".join(["the", "of"] * 20 + own + [rng.choice(own)]), "s", "t") for copy in range(4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, of_all = packing.dealt(df, PATH)
    tokenizer = Tokenizer.from_file(PATH)
    documents = [[*plain(tokenizer, text), END] for _, text, *_ in rows]
    assert of_all.count == 400 and abs(of_all.mean - np.mean([len(d) for d in documents])) < 1e-9
    held = np.zeros(len(of_all.held), dtype=int)
    for ids in documents:
        held[list(set(ids))] += 1
    assert held.tolist() == of_all.held.tolist()
    # A hash would leave four near copies in one of seven ranges once in 343 times.
    ranges = defaultdict(list)
    for row in found.collect():
        ranges[row.doc_id // 4].append(row.range)
    assert len({each for own in ranges.values() for each in own}) > 3
    assert sum(len(set(own)) == 1 for own in ranges.values()) > 20
    pieces = packed(df, PATH).collect()
    assert sum(piece.length for piece in pieces) == sum(map(len, documents))
    assert sorted(map(repr, pieces)) == sorted(map(repr, packed(df.repartition(3), PATH).collect()))
    seen = defaultdict(int)
    for piece in pieces:
        seen[piece.sequence_id] += piece.length
    assert max(seen.values()) <= WINDOW
