"""Encoding with pieces against the library and against a plain search for the best pair."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rideledger.llm.pieces import MARK, PieceReader, digests, encoded
from rideledger.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, ids string, decoded string, n_tokens string"
PARTS = ["a", "the", "ing", " ", "  ", MARK, "\n", "é", "日本", "\x00", "😀", "<0x41>", "<s>", "</s>", "<unk>", "�", "́", "12", "."]


@pytest.fixture(scope="module")
def vocabulary():
    return PieceReader(PATH, kept=50)


def plainly_merged(vocabulary, text):
    """All pairs looked through for the best one, again after every merge."""
    symbols = list(text)
    while True:
        pairs = [(vocabulary.ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in vocabulary.ranks]
        if not pairs:
            return symbols
        at = min(pairs)[1]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


@given(text=st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=25).map("".join)))
def test_equals_the_library(vocabulary, text):
    assert vocabulary.encode([text, text + " a"])[0].tolist() == vocabulary.library.encode(text)


@pytest.mark.parametrize("seed", range(20))
def test_agenda_equals_plain_search(vocabulary, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abcdefinorst" + MARK) for _ in range(60))
    assert vocabulary.merged(text) == vocabulary._merged_short(text) == plainly_merged(vocabulary, text)
    assert vocabulary.merged(text[:20]) == vocabulary._merged_long(text[:20]) == plainly_merged(vocabulary, text[:20])


def test_stretches_do_not_change_the_result(vocabulary):
    text = MARK + "here  are   several words , some\n twice twice".replace(" ", MARK)
    assert vocabulary.encode(["here  are   several words , some\n twice twice"])[0].tolist() == [
        vocabulary.ids[symbol] if symbol in vocabulary.ids else vocabulary.bytes[symbol.encode()[0]] for symbol in vocabulary.merged(text)
    ]


def test_pieces_that_are_not_used_fall_apart(vocabulary):
    own = PieceReader(PATH)
    assert own.merged("the") == ["the"]
    own.unused = {"the"}
    assert own.merged("the") == ["t", "he"]


def test_documents(spark):
    long = "word " * 100_000 + "x" * 50_000
    rows = [(1, "A text."), (1, "A text."), (2, None), (3, ""), (None, "no id"), (4, "  two\nlines\t é😀 "), (5, long)]
    df = spark.createDataFrame([(*row, "a", "b", "c") for row in rows], SCHEMA).repartition(3)
    library = PieceReader(PATH).library
    got = sorted((repr(tuple(row)) for row in digests(encoded(df, PATH)).collect()))
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        listed = ",".join(map(str, ids)).encode()
        want.append(repr((doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())))
        assert library.decode(ids) == (text or "")
    assert got == sorted(want)


def test_real_ids_and_texts(spark):
    (row,) = encoded(spark.createDataFrame([(7, "Über 3 Wörter", "", "", "")], SCHEMA), PATH).collect()
    assert (row.doc_id, row.decoded) == (7, "Über 3 Wörter") and row.ids == PieceReader(PATH).library.encode("Über 3 Wörter")


def test_empty_table(spark):
    assert digests(encoded(spark.createDataFrame([], SCHEMA), PATH)).collect() == []


def test_another_kind_of_result_is_refused(vocabulary):
    own = PieceReader(PATH)
    own.ranks = {}
    with pytest.raises(ValueError, match="by the library"):
        own.checked(["the thing that they threw"])
    assert own.checked(["", "the thing"], every=2)[1] != vocabulary.checked(["the thing"])[0]
