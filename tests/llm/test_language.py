"""Language model: forward-backward against all paths, gradients, held-out accuracy, edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rideledger.llm.language import Model, Tagger, _by_step, held_out, learned, letter_words, marginals, predicted, traits, trained

SCHEMA = "doc_id bigint, text string, lang string, score string, source string"
FOLDER = "/root/testdata/sf0.01"


def model_of(rng, labels=3):
    return Model([f"l{i}" for i in range(labels)], {}, np.zeros((0, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels))


def all_paths(model, scores):
    """Label and move probabilities of one chain by going through every path."""
    n, labels = scores.shape
    total, single, moves = 0.0, np.zeros_like(scores), np.zeros((labels, labels))
    for path in itertools.product(range(labels), repeat=n):
        weight = np.exp(model.start[path[0]] + sum(scores[i, k] for i, k in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path)))
        total += weight
        for i, k in enumerate(path):
            single[i, k] += weight
        for a, b in itertools.pairwise(path):
            moves[a, b] += weight
    return single / total, moves / total


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    model = model_of(rng)
    sizes = np.array([6, 5, 5, 2, 1, 1])
    chains = [rng.normal(size=(n, 3)) * 2 for n in sizes]
    place = _by_step(sizes)
    assert sorted(place) == list(range(sizes.sum()))
    rows = np.empty((sizes.sum(), 3))
    rows[place] = np.concatenate(chains)
    chance, between = marginals(model, rows, sizes, with_moves=True)
    want = [all_paths(model, chain) for chain in chains]
    np.testing.assert_allclose(chance[place], np.concatenate([single for single, _ in want]), rtol=1e-9)
    np.testing.assert_allclose(between, sum(moves for _, moves in want), rtol=1e-9)


def segments():
    rng = random.Random(1)
    sounds = {"aa": ["ta", "ra", "ka"], "bb": ["shu", "mu", "zu"], "cc": ["eil", "ein", "ier"]}
    return [(name, ["".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(12)]) for name, parts in sounds.items() for _ in range(60)]


def test_words_of_mixed_text_get_their_languages():
    model = trained(segments(), epochs=4)
    assert (np.diag(model.moves) > model.moves.mean()).all()
    words = ["tara", "kataka", "ra", "shumu", "zuzu", "mushu", "eilein", "ier", "tara", "rata"]
    best = Tagger(model).word_labels(words).argmax(axis=1)
    assert [model.labels[k] for k in best] == ["aa"] * 3 + ["bb"] * 3 + ["cc"] * 2 + ["aa"] * 2


def test_looked_up_scores_are_summed_weights():
    model = trained(segments(), epochs=1)
    words = ["a", "ta", "tarashu", "xyz", "é", "eilein" * 30, "𝒳"]
    want = [model.weights[[model.index[t] for t in traits(word) if t in model.index]].sum(axis=0) for word in words]
    np.testing.assert_allclose(model.emissions(words), want, atol=1e-4)


def test_documents_alone_or_together_are_alike():
    model = trained(segments(), epochs=2)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["ta", "shu", "eil", "raka", "mu."], k=rng.randrange(0, 60))) for _ in range(80)]
    together = Tagger(model).documents(texts)
    for text, (label, score) in zip(texts, together, strict=True):
        ((alone, value),) = Tagger(model).documents([text])
        assert alone == label and abs(value - score) < 1e-4


def test_words():
    assert letter_words("Ab1cd, É-f_g ½") == ["ab", "cd", "é", "f", "g", "½"]
    for text in (None, "", " 12 ½ ²", "!?", "___"):
        assert letter_words(text) == []


@pytest.fixture(scope="module")
def told(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return predicted(docs, learned(docs)).withColumn("held", held_out()).toPandas()


def test_held_out_accuracy(told):
    held = told[told.held]
    assert len(held) > 150
    assert (held.lang == held._pred).mean() > 0.98
    assert told._score.between(0, 1).all()


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(i, text, lang, "s", "x") for i, (text, lang) in enumerate([("ta ra ka", "aa"), ("shu mu", "bb")] * 40)]
        + [(900, None, "aa", "", ""), (901, "", None, "", ""), (902, "12 ½", "aa", "", ""), (903, "tara", None, "", ""), (None, "ta", "aa", "", ""), (903, "tara", None, "", "")],
        SCHEMA,
    )
    told = predicted(docs, learned(docs))
    assert told.columns == [*docs.columns, "_pred", "_score"]
    got = {(row.doc_id, row.text): (row._pred, row._score) for row in told.collect()}
    assert told.count() == docs.count()
    for key in ((900, None), (901, ""), (902, "12 ½")):
        assert got[key] == ("und", 0.0)
    assert got[903, "tara"][0] == got[None, "ta"][0] == "aa"


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None, "", "")], SCHEMA)
    assert [(row._pred, row._score) for row in predicted(docs, learned(docs)).collect()] == [("und", 0.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert predicted(none, learned(none)).collect() == []


def test_learns_only_from_rows_that_are_not_held_out(spark):
    docs = spark.createDataFrame([(i, "ta ra", "aa", "", "") for i in range(40)], SCHEMA)
    changed = docs.withColumn("lang", F.when(held_out(), "zz").otherwise(F.col("lang")))
    assert learned(changed).labels == ["aa"]
