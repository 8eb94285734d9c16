"""The pipeline's stages on a small corpus, each against a plain version on its own input."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm.test_jaccard_join import brute_force as linked
from llm.test_line_dedup import brute_force as deduplicated
from rideledger.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SOUNDS = {"aa": ["ta", "ra", "ka", "na"], "bb": ["shu", "mu", "zu", "lu"], "cc": ["eil", "ein", "ier", "ich"]}


def corpus():
    rng = random.Random(11)

    def line(lang, n):
        return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 5))) for _ in range(n))

    rows, shared = [], {lang: line(lang, 12) for lang in SOUNDS}
    for key in range(150):
        lang = rng.choice(sorted(SOUNDS))
        lines = [line(lang, rng.randrange(3, 40)) for _ in range(rng.randrange(1, 7))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), shared[lang])
        rows.append((key, "\n".join(lines), lang, f"s{rng.randrange(4)}"))
    for key in range(150, 170):  # near copies: every line changed a little, so that lines stay and documents link
        _, text, lang, _ = rows[key - 150]
        rows.append((key, "\n".join(part + " " + part.split()[0][:2] + "x" for part in text.split("\n")), lang, "s9"))
    rows += [(170, rows[5][1], "aa", "s1"), (171, None, None, "s1"), (172, "", "aa", None), (173, "12 34 !!", "bb", "s2"), (174, shared["aa"], None, None)]
    rng.shuffle(rows)
    return [(key, text, lang, source, len(text or "")) for key, text, lang, source in rows]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The documents and what each stage made of them, written and read again in between."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], folder).write.parquet(f"{folder}/{name}")
        frames.append(spark.read.parquet(f"{folder}/{name}"))
    return folder, frames


def pairs(frame):
    return [(row.doc_id, row.text) for row in frame.collect()]


def test_stages_keep_the_columns(kept):
    for frame in kept[1][1:-1]:
        assert [f"{name} {kind}" for name, kind in frame.dtypes] == SCHEMA.split(", ")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "source_mixing", "retrieval_packing"]


def test_documents_without_a_language_go(kept):
    before, after = (dict(pairs(frame)) for frame in kept[1][:2])
    assert set(before) - set(after) == {171, 172, 173}
    assert all(before[key] == text for key, text in after.items())


def test_lines_are_cut_out(kept):
    before, after = (pairs(frame) for frame in kept[1][1:3])
    want = {key: text for key, text in deduplicated(before).items() if text.strip()}
    assert dict(after) == want and len(after) == len(want)
    assert 170 not in want  # an exact copy loses all its lines


def test_one_of_a_group_stays(kept):
    before, after = (pairs(frame) for frame in kept[1][2:4])
    want = {key for key, n, component in linked(before) if not n or key == component}
    assert {repr(key) for key, _ in after} == want and len(after) == len(want)


def test_mix_is_what_the_schedule_takes(kept):
    before, after = kept[1][3:5]
    taken = {row.doc_id: row.taken for row in mixing.taken(before).collect() if row.taken}
    words = Counter()
    for row in after.collect():
        words[row.doc_id] += len(row.text.split())
        assert row.n_chars == len(row.text)
    assert dict(words) == taken


def test_every_id_is_packed_once(kept):
    before, after = kept[1][4:]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want, got = Counter(), Counter()
    for _, text in pairs(before):
        want.update([*tokenizer.encode(text, add_special_tokens=False).ids, 1])
    lengths = Counter()
    for row in after.collect():
        got.update(np.frombuffer(row.ids, "<u4").tolist())
        lengths[row.sequence_id] += row.length
    assert got == want
    assert all(length <= 2048 and (length == 2048 or length & (length - 1) == 0) for length in lengths.values())


def test_run_does_the_stages(spark, kept):
    folder, frames = kept
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == frames[-1].columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, frames[-1].collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
