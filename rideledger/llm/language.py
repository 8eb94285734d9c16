"""Language of words and documents by a linear-chain conditional random field.

Every word (a run of letters) is a position of the chain and every learned language a label. A word
speaks through its affixes, its letter n-grams and whether it stands in the lexicon of the training
words; learned transitions say how likely the language changes from one word to the next.
Training mixes segments of different languages, so that chains switch. A text's words get
their label probabilities by forward-backward over the whole text; the document gets the
label with the largest sum, and the mean probability of that label as its score.

Training data: at most ``DOCS_PER_LANGUAGE`` different texts of a language (those of least hash among a share by hash) of the
``MOST_LANGUAGES`` most frequent languages, of each at most ``SEGMENTS_PER_DOC`` runs of ``SEGMENT`` words spread evenly over the whole
text. Nothing else is bounded; predictions read whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing can be learned; repeated rows each get a result; ties go to the label
first in code point order; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rideledger.llm.cluster import give_back, ship
from rideledger.llm.columns import apart

UNKNOWN = "und"
ADDED = ("_pred", "_score")
DOCS_PER_LANGUAGE = 300
MOST_LANGUAGES = 64
SEGMENTS_PER_DOC = 12
SEGMENT = 16
LEXICON = 3000
EPOCHS = 6
CHAIN_SEGMENTS = 4
WORDS_AT_ONCE = 300_000
DOCS_AT_ONCE = 2048
_KNOWN_WORDS = 150_000
_RUN = re.compile(r"[^\W\d_]+")


def letter_words(text: object) -> list[str]:
    """Runs of letters, in lower case."""
    if not isinstance(text, str):
        return []
    found = _RUN.findall(text.lower())
    if any(map(str.isalpha, found[:8])):  # numeric signs that are no letters are rare
        return found
    return found if any(map(str.isalpha, "".join(found))) else []


def affixes(word: str) -> list[str]:
    """A word's own feature and those of its beginning and end."""
    edged = f"^{word}$"
    return [f"={word}", edged[:4], edged[:5], edged[-4:], edged[-5:]]


def _code(gram: str) -> int:
    code = 0
    for letter in gram:
        code = code << 21 | ord(letter)
    return code


def traits(word: str) -> list[str]:
    """Features of a word: itself, its affixes, its letter pairs and triples."""
    edged = f"^{word}$"
    found = affixes(word)
    found += map("".join, zip(edged, edged[1:], strict=False))
    found += map("".join, zip(edged, edged[1:], edged[2:], strict=False))
    return found


@dataclass
class Model:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x label
    start: np.ndarray

    def __post_init__(self) -> None:
        grams = sorted((_code(gram), row) for gram, row in self.index.items() if len(gram) in (2, 3) and gram[0] != "=")
        self.codes = np.array([code for code, _ in grams], dtype=np.int64)
        self.rows = np.array([row for _, row in grams], dtype=np.int64)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Summed feature weights of each word; letter pairs and triples of all words are looked up at once."""
        nothing = len(self.index)
        weights = np.vstack([self.weights, np.zeros((1, len(self.labels)))]).astype(np.float32)
        get = self.index.get
        named = np.array([[get(t, nothing) for t in affixes(word)] for word in words], dtype=np.int64)
        out = weights[named].sum(axis=1)
        if not len(self.codes):
            return out
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            points = np.frombuffer("".join([f"^{word}$" for word in some]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            sizes = np.array([len(word) + 2 for word in some])
            starts = np.cumsum(sizes) - sizes
            ends = starts + sizes - 1
            summed = np.zeros((len(points), len(self.labels)), dtype=np.float32)
            codes = points
            for width in (2, 3):
                codes = codes[:-1] << 21 | points[width - 1 :]
                near = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
                rows = np.where(self.codes[near] == codes, self.rows[near], nothing)
                for back in range(width - 1):  # runs into the next word
                    rows[ends[ends - back < len(rows)] - back] = nothing
                summed[: len(rows)] += weights[rows]
            out[at : at + len(some)] += np.add.reduceat(summed, starts)
        return out


def _rows_at(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains of falling length: how many reach each step, and where each step's rows begin."""
    reach = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left") if len(sizes) else np.empty(0, np.int64)
    return reach, np.concatenate([[0], np.cumsum(reach)])


def marginals(model: Model, scores: np.ndarray, sizes: np.ndarray, with_moves: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every position, and if wanted the summed probabilities of every move.

    ``scores`` are rows by step: first the first word of every chain, then the second of all that
    have one, and so on; chains are in falling length. All chains of a step are computed together.
    """
    reach, begin = _rows_at(sizes)
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    moves = np.exp(model.moves - model.moves.max()).astype(local.dtype)
    first = np.exp(model.start - model.start.max()).astype(local.dtype)
    ahead, back = np.empty_like(local), np.empty_like(local)
    for step, count in enumerate(reach):
        rows = slice(begin[step], begin[step] + count)
        now = local[rows] * (first if step == 0 else ahead[begin[step - 1] : begin[step - 1] + count] @ moves)
        ahead[rows] = now / now.sum(axis=1, keepdims=True)
    between = np.zeros_like(moves)
    for step in range(len(reach) - 1, -1, -1):
        rows, on = slice(begin[step], begin[step] + reach[step]), reach[step + 1] if step + 1 < len(reach) else 0
        later = np.ones((reach[step], local.shape[1]), dtype=local.dtype)
        if on:
            after = slice(begin[step + 1], begin[step + 1] + on)
            pull = local[after] * back[after]
            later[:on] = pull @ moves.T
            # probability of each move: ahead x move x pull, each chain's summing to one
            if with_moves:
                grip = ahead[begin[step] : begin[step] + on]
                total = ((grip @ moves) * pull).sum(axis=1, keepdims=True)
                between += (grip / total).T @ pull * moves
        back[rows] = later / later.max(axis=1, keepdims=True)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True), between


def _by_step(sizes: np.ndarray) -> np.ndarray:
    """Places of the words of chains (given one after the other, of falling length) in rows by step."""
    reach, begin = _rows_at(sizes)
    steps = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return begin[steps] + np.repeat(np.arange(len(sizes)), sizes)


def trained(segments: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit a model to segments of words, each of one language."""
    segments = sorted((label, words) for label, words in segments if words)
    labels = sorted({label for label, _ in segments})
    number = {label: i for i, label in enumerate(labels)}
    seen = Counter(word for _, words in segments for word in words)
    lexicon = {word for word, _ in sorted(seen.items(), key=lambda item: (-item[1], item[0]))[: LEXICON * max(1, len(labels))]}
    held = {word: [t for t in traits(word) if t[0] != "=" or word in lexicon] for word in seen}
    often = Counter(t for word, times in seen.items() for t in held[word] for _ in range(min(times, 3)))
    index = {t: i for i, t in enumerate(sorted(t for t, times in often.items() if times >= 3))}
    features = {word: np.array([index[t] for t in own if t in index], dtype=np.int64) for word, own in held.items()}
    model = Model(labels, index, np.zeros((len(index), len(labels))), np.zeros((len(labels), len(labels))), np.zeros(len(labels)))
    pace = [np.full_like(part, 1e-3) for part in (model.weights, model.moves, model.start)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        chains = [order[at : at + CHAIN_SEGMENTS] for at in range(0, len(order), CHAIN_SEGMENTS)]
        for at in range(0, len(chains), 64):
            batch = sorted(chains[at : at + 64], key=lambda chain: -sum(len(segments[i][1]) for i in chain))
            words = [[word for i in chain for word in segments[i][1]] for chain in batch]
            truth = [np.concatenate([np.full(len(segments[i][1]), number[segments[i][0]]) for i in chain]) for chain in batch]
            sizes = np.array([len(w) for w in words])
            flat = [features[word] for chain in words for word in chain]
            widths = np.array([len(f) for f in flat])
            used, place = np.concatenate(flat), _by_step(sizes)
            owner = np.repeat(place, widths)
            scores = np.stack([np.bincount(owner, model.weights[used, k], len(place)) for k in range(len(labels))], axis=1)
            chance, moved = marginals(model, scores, sizes, with_moves=True)
            right = np.empty(len(place), dtype=np.int64)
            right[place] = np.concatenate(truth)
            slope = -chance
            slope[np.arange(len(right)), right] += 1
            step = np.zeros_like(model.weights)
            rows, back = np.unique(used, return_inverse=True)
            for k in range(len(labels)):
                step[rows, k] = np.bincount(back, slope[owner, k], len(rows))
            step -= 1e-2 * model.weights / max(1, len(chains) // 64)
            turned = -moved
            for chain in truth:
                np.add.at(turned, (chain[:-1], chain[1:]), 1)
            for part, gradient, grown in zip((model.weights, model.moves, model.start), (step, turned, slope[: len(batch)].sum(axis=0)), pace, strict=True):
                grown += gradient**2
                part += 0.2 * gradient / np.sqrt(grown)
    return model


class Tagger:
    """A model with the scores of the words seen lately."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.labels)), dtype=np.float32)

    def _places(self, words: list[str]) -> list[int]:
        new = list(set(words).difference(self.rows))
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.emissions(new)])
        return list(map(self.rows.__getitem__, words))

    def word_labels(self, words: list[str]) -> np.ndarray:
        """Label probabilities of the words of one text."""
        return self._chances([words])[0]

    def _chances(self, texts: list[list[str]]) -> list[np.ndarray]:
        sizes = np.array([len(words) for words in texts])
        place = _by_step(sizes)
        scores = np.empty((len(place), len(self.model.labels)), dtype=np.float32)
        places = self._places([word for words in texts for word in words])
        scores[place] = self.scores[places]
        chance, _ = marginals(self.model, scores, sizes)
        return np.split(chance[place], np.cumsum(sizes)[:-1])

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Label and score of each text."""
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.model.labels:
            return found
        words = [letter_words(text) for text in texts]
        order = sorted((i for i, own in enumerate(words) if own), key=lambda i: -len(words[i]))
        while order:
            count, held = 0, 0
            while count < len(order) and (not count or held + len(words[order[count]]) <= WORDS_AT_ONCE):
                held += len(words[order[count]])
                count += 1
            some, order = order[:count], order[count:]
            if len(self.rows) > _KNOWN_WORDS:
                self.clear()
            for i, chance in zip(some, self._chances([words[i] for i in some]), strict=True):
                mean = chance.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                found[i] = (self.model.labels[best], float(min(1.0, mean[best])))
        return found


def segments_of(labelled: DataFrame) -> list[tuple[str, list[str]]]:
    """Training segments of a bounded number of documents of every language."""
    labelled = labelled.where("lang is not null and text is not null").select("text", "lang")
    counts = {row.lang: row.n for row in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return []
    step = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, max(1, n // DOCS_PER_LANGUAGE))]), F.col("lang"))
    hashed = labelled.where(F.col("lang").isin(list(counts))).withColumn("hash", F.xxhash64("text"))
    some = hashed.where(F.pmod("hash", step) == 0).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    some = some.withColumn("place", least).where(F.col("place") <= DOCS_PER_LANGUAGE).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, runs = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = letter_words(text)
                places = range(0, len(words), SEGMENT)
                for place in places[:: max(1, -(-len(places) // SEGMENTS_PER_DOC))]:
                    langs.append(lang)
                    runs.append(words[place : place + SEGMENT])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.list_(pa.string()))], ["lang", "words"])

    return [(row.lang, row.words) for row in some.mapInArrow(cut, "lang string, words array<string>").collect()]


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``_pred`` and ``_score``, in place of such that have these names; only the text is looked at."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*ADDED)
    place, plain = docs.columns.index(text), apart(docs)
    names = list(plain.columns)
    schema = T.StructType([*plain.schema.fields, *[T.StructField(name, kind) for name, kind in zip(ADDED, (T.StringType(), T.DoubleType()), strict=True)]])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in (whole.slice(at, DOCS_AT_ONCE) for whole in batches for at in range(0, max(1, whole.num_rows), DOCS_AT_ONCE)):
            found = tagger.documents(batch.column(place).to_pylist())
            told = [pa.array([label for label, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*names, *ADDED])
        tagger.clear()
        give_back()

    return plain.mapInArrow(predict, schema).toDF(*docs.columns, *ADDED)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training, by the checksum of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame) -> Model:
    """A model from the rows that are not held out and have a language."""
    ship(docs.sparkSession)
    return trained(segments_of(docs.where(~held_out()).select("text", "lang")))
