"""Lexical retrieval packing into windows of fixed size.

Three passes over all documents. The first makes token ids, which stay in the shared folder, and
counts in how many documents each id stands. From these counts and the mean length the second gives
every document a key: its ``KEY_TERMS`` heaviest BM25 terms that another document holds, heaviest first.
In the order of these keys likes lie together, copies next to each other. Ranges of the order (splitters
come from a sample by hash; equal keys are parted by a hash of the row) are cut into shards of
``SHARD_DOCS`` documents. The third builds a BM25 inverted index for each shard, with the counts and
the mean length of all documents. A seed asks it with its ``QUERY_TERMS`` heaviest terms, and the
unused neighbours fill the seed's window greedily, best first. The one that no longer fits is cut,
and its rest becomes the next seed. What a document has in whole windows of its own leaves as
such before. So all windows of a shard are full but the last, which is parted into windows of
powers of two and needs no padding.

Limit: a seed meets the neighbours of its shard only. Likes whose heaviest terms differ can lie in other
shards; the README has the measured share of nearest neighbours that lie in a seed's shard.

Defined results: null text counts as empty; a document's ids are those of its text and then
id 1, so the empty document has one id; repeated rows and ids are packed each on its own; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import give_back, new_folder, remembered, ship
from rideledger.llm.words import portions

WINDOW = 2048
END = 1
SHARD_DOCS = 1024
QUERY_TERMS = 12
KEY_TERMS = 3
RANGE_DOCS = 8 * SHARD_DOCS
RANGE_SAMPLES = 64
K1, B = 1.2, 0.75
KEPT = 600_000
WORDS, STEMS = 4096, 32
TEXTS, BYTES = 4096, 1 << 24
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class TokenIds:
    """Token ids of texts, by way of the ids of the pieces between white space.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its
    pieces in a row. A piece is mostly a word and perhaps a point or comma. Words of letters go straight
    to the tokenizer's model, all new ones of a call at once, and are remembered; all other pieces go through
    the whole tokenizer, and so do texts with the string of a special token. A task remembers
    ``KEPT`` pieces and those of one call at most.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        # The model alone, for words as it reads them: one to a line, none is changed or cut.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # Byte-level models write a byte that cannot be printed as the next free character from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [byte for byte in range(256) if byte not in shown]
        self.letters = {byte: 256 + place for place, byte in enumerate(hidden) if byte != ord("\n")}
        self.special = [token.content.encode().lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        # Tokens at the end of a word: of letters, none but its last has the suffix.
        suffix, named = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.last = np.zeros(max(named.values(), default=0) + 1, bool)
        self.last[[number for token, number in named.items() if suffix and token.endswith(suffix)]] = True
        self.forget()
        # Whether this tokenizer lower-cases and works on bytes shows in what it makes of words.
        tried = ["a", "tokenizer", "naïveté", "größer", "señor", "ответ", "語"]
        wanted = [self._whole(word) for word in tried]
        got, sizes = self._of_words(pa.array([word.encode() for word in tried], pa.large_binary()))
        self.direct = got.tobytes() == b"".join(wanted) and sizes.tolist() == [len(ids) // got.itemsize for ids in wanted]

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _whole_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and their numbers."""
        made = [self._whole(piece.decode("utf-8", "surrogatepass")) for piece in pieces]
        ids = np.frombuffer(b"".join(made), self.code)
        return ids, np.array([len(each) // ids.itemsize for each in made], np.int64)

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of composed lower-case letters in a row, and their numbers."""
        found, sizes = [np.zeros(0, self.code)], [np.zeros(0, np.int64)]
        for start in range(0, len(words), WORDS):
            asked = words.slice(start, WORDS)
            lines = pc.binary_join(pa.ListArray.from_arrays([0, len(asked)], asked), pa.scalar(b"\n", asked.type))[0].as_py()
            lines = lines.decode() if lines.isascii() else lines.decode("latin-1").translate(self.letters)
            ids = np.array(self.words.encode_batch_fast([lines], add_special_tokens=False)[0].ids, self.code)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(asked):  # a model without such tokens
                each = [self.words.encode(word, add_special_tokens=False).ids for word in lines.split("\n")]
                ids, ends = np.array([number for own in each for number in own], self.code), np.cumsum([len(own) for own in each])
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(found), np.concatenate(sizes)

    def forget(self) -> None:
        """Remembered are pieces, their ids in a row, and how many each has."""
        self.known = pa.chunked_array([], pa.large_binary())
        self.ids, self.sizes = np.zeros(0, self.code), np.zeros(0, np.int64)

    def _add(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known = pa.chunked_array([*self.known.chunks, pieces], pa.large_binary())
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _places(self, pieces: pa.Array, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Places of different pieces among the remembered; those not there are made first."""
        places = pc.index_in(pieces, self.known)
        new = places.is_null()
        places = places.fill_null(-1).to_numpy().astype(np.int64)
        if len(missing := pieces.filter(new)):
            places[places < 0] = len(self.sizes) + np.arange(len(missing))
            self._add(missing, *make(missing))
        return places

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Places of pieces that are not remembered yet."""
        stems = pc.ascii_rtrim(pieces.view(pa.large_string()), PUNCTUATION.decode()).view(pa.large_binary())
        coded = stems.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        # Words: ASCII letters alone are lower ones here, other stems are looked at one by one.
        plain = pc.ascii_is_alpha(distinct.view(pa.large_string()))
        others = distinct.filter(pc.invert(plain)).to_pylist()
        others = [word for start in range(0, len(others), STEMS) for word in _words(others[start : start + STEMS])]
        words = pa.concat_arrays([distinct.filter(plain), pa.array([word for word in others if word], pa.large_binary())]).dictionary_encode()
        plain = plain.to_numpy(zero_copy_only=False)
        place = np.full(len(distinct), -1, np.int64)  # of a stem among the words
        place[plain] = np.arange(plain.sum())
        place[np.flatnonzero(~plain)[[bool(word) for word in others]]] = np.arange(plain.sum(), len(words))
        if len(words):
            place[place >= 0] = self._places(words.dictionary, self._of_words)[words.indices.to_numpy()][place[place >= 0]]
        of_word = place[at]
        # What stands behind the words.
        length = pc.binary_length(stems).to_numpy()
        behind = length < pc.binary_length(pieces).to_numpy()
        ended = pieces.filter(pa.array(behind))
        size = pc.binary_length(ended).to_numpy() - length[behind]
        ends = np.frombuffer(ended.buffers()[1], np.int64, len(ended), 8 * (ended.offset + 1)) if len(ended) else size
        letters = np.frombuffer(ended.buffers()[2] or b"", np.uint8)[_spans(ends - size, size)]
        bounds = pa.py_buffer(np.append(0, np.cumsum(size)))
        rests = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ended), [None, bounds, pa.py_buffer(letters)]).dictionary_encode()
        of_rest = np.full(len(pieces), -1, np.int64)
        of_rest[behind] = self._places(rests.dictionary, lambda found: self._whole_of(found.to_pylist()))[rests.indices.to_numpy()]
        # A piece is a word, or only punctuation, or both, or none of these (white space at an end of a text leaves an empty one).
        places = np.where(length == 0, of_rest, of_word)
        odd = places < 0
        both = behind & (of_word >= 0)
        places[odd] = len(self.sizes) + np.arange(odd.sum())
        self._add(found := pieces.filter(pa.array(odd)), *self._whole_of(found.to_pylist()))
        places[both] = len(self.sizes) + np.arange(both.sum())
        halves = np.stack([of_word[both], of_rest[both]], axis=1)
        self._add(pieces.filter(pa.array(both)), self._row(halves.ravel()), self.sizes[halves].sum(axis=1))
        return places

    def _row(self, places: np.ndarray) -> np.ndarray:
        """The ids of remembered pieces in a row."""
        return self.ids[_spans((np.cumsum(self.sizes) - self.sizes)[places], self.sizes[places])]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
        lower = [text.lower() for text in raw]
        if len(self.sizes) >= KEPT:
            self.forget()
        # The six white space characters of ASCII part pieces, as for ``bytes.split``.
        split = pc.ascii_split_whitespace(pa.array(lower if self.direct else raw, pa.large_binary()).view(pa.large_string()))
        coded = split.values.view(pa.large_binary()).dictionary_encode()
        places = pc.index_in(coded.dictionary, self.known)
        new = places.is_null()
        places = places.fill_null(-1).to_numpy().astype(np.int64)
        missing = coded.dictionary.filter(new)
        if self.direct:
            places[places < 0] = self._learn(missing)
        else:
            places[places < 0] = len(self.sizes) + np.arange(len(missing))
            self._add(missing, *self._whole_of(missing.to_pylist()))
        places = places[coded.indices.to_numpy()]
        ids = self._row(places)
        bounds = np.append(0, np.cumsum(self.sizes[places]))[split.offsets.to_numpy()].tolist()
        found = []
        for text, low, start, end in zip(texts, lower, bounds, bounds[1:]):
            if text and any(special in low for special in self.special):
                found.append(np.frombuffer(self._whole(text), ids.dtype))
            else:
                found.append(ids[start:end])
        return found


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans, one span behind the other."""
    ends = np.cumsum(size)
    return np.arange(size.sum()) + np.repeat(begin - (ends - size), size)


def _words(stems: list[bytes]) -> list[bytes | None]:
    """The words of composed lower-case letters that the tokenizer makes of stems; none for one that it may cut or change otherwise.

    Stems are looked at together, and by halves where one of them is none.
    """
    text = b"\n".join(stems).decode("utf-8", "surrogatepass")
    low = text.lower()
    if text.replace("\n", "").isalpha() and low.replace("\n", "").isalpha() and "Σ" not in text and is_normalized("NFC", text):
        return low.encode().split(b"\n")
    half = len(stems) // 2
    return _words(stems[:half]) + _words(stems[half:]) if half else [None]


def tokenizer_of(path: str) -> TokenIds:
    """The tokenizer at a path, kept from one task of a worker to the next."""
    return remembered(f"token ids {path}", lambda: TokenIds(path))


def token_ids(path: str, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of texts."""
    return tokenizer_of(path)(texts)


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order and how often each stands; numbers of 16 bits are sorted by radix."""
    ids = np.sort(ids, kind="stable" if ids.itemsize <= 2 else "quicksort")
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(np.append(first, len(ids)))


class Statistics(NamedTuple):
    """Of all documents: their number, their mean length and how many hold each token id."""

    count: int
    mean: float
    held: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        held = self.held[terms]
        return np.log1p((self.count - held + 0.5) / (held + 0.5))


def like_keys(documents: list[np.ndarray], of_all: Statistics) -> np.ndarray:
    """For each document its heaviest terms that another one holds, heaviest first, as one number; ties to the least term."""
    keys = np.zeros(len(documents), np.int64)
    lengths = np.array([len(ids) for ids in documents], np.int64)
    flat = np.repeat(np.arange(len(documents), dtype=np.int64) << 32, lengths) | np.concatenate([np.zeros(0, np.int64), *documents]).astype(np.int64)
    flat, times = counted(flat)
    shared = of_all.held[flat & 0xFFFFFFFF] > 1
    flat, times = flat[shared], times[shared]
    owners, terms = flat >> 32, flat & 0xFFFFFFFF
    weights = of_all.idf(terms) * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[owners] / max(of_all.mean, 1)))
    for _ in range(KEY_TERMS):
        keys <<= 21
        begin = np.flatnonzero(np.diff(owners, prepend=-1))
        if not len(begin):
            continue
        best = np.repeat(np.maximum.reduceat(weights, begin), np.diff(np.append(begin, len(owners))))
        at = np.flatnonzero(weights == best)
        at = at[np.flatnonzero(np.diff(owners[at], prepend=-1))]  # the first, which is the least term
        keys[owners[at]] |= np.minimum(terms[at], (1 << 21) - 1)
        left = np.ones(len(owners), bool)
        left[at] = False
        owners, terms, weights = owners[left], terms[left], weights[left]
    return keys


class Neighbours:
    """BM25 inverted index over the documents of a shard; what it knows of all documents weighs the terms."""

    def __init__(self, documents: list[np.ndarray], of_all: Statistics | None = None):
        count = len(documents)
        lengths = np.array([len(d) for d in documents], dtype=np.int64)
        owners = np.repeat(np.arange(count, dtype=np.int64), lengths)
        keys, times = np.unique(np.concatenate(documents).astype(np.int64) * count + owners, return_counts=True)
        terms, self.owners = keys // count, keys % count
        self.terms, self.starts, held = np.unique(terms, return_index=True, return_counts=True)
        self.ends = self.starts + held
        if of_all is None:
            idf, mean = np.log1p((count - held + 0.5) / (held + 0.5)), lengths.mean()
        else:
            idf, mean = of_all.idf(self.terms), of_all.mean
        idf = np.repeat(idf, held)
        norm = K1 * (1 - B + B * lengths / max(mean, 1))
        self.weights = idf * times * (K1 + 1) / (times + norm[self.owners])
        # The heaviest terms of each document; a term held by one document has no neighbour.
        place = np.repeat(np.arange(len(self.terms)), held)
        shared = np.repeat(held > 1, held)
        order = np.lexsort((place[shared], -self.weights[shared], self.owners[shared]))
        self.heavy, owners = place[shared][order], self.owners[shared][order]
        self.first = np.searchsorted(owners, np.arange(count + 1))
        self.count = count

    def scores(self, document: int) -> np.ndarray:
        """Score of every document of the shard for the heaviest terms of one."""
        asked = self.heavy[self.first[document] : min(self.first[document + 1], self.first[document] + QUERY_TERMS)]
        if not len(asked):
            return np.zeros(self.count)
        spans = [slice(self.starts[term], self.ends[term]) for term in asked]
        return np.bincount(
            np.concatenate([self.owners[span] for span in spans]),
            weights=np.concatenate([self.weights[span] for span in spans]),
            minlength=self.count,
        )


def windows(documents: list[np.ndarray], window: int = WINDOW, of_all: Statistics | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of one shard; each is a list of (document, start, length)."""
    rest: dict[int, int] = {}
    for number, ids in enumerate(documents):
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            yield [(number, start, window)]
        if len(ids) > whole:
            rest[number] = whole
    index = Neighbours(documents, of_all) if len(rest) > 1 else None
    unused = np.zeros(len(documents), dtype=bool)
    unused[list(rest)] = True
    waiting = iter(list(rest))
    seed = None
    while rest:
        if seed is None or not unused[seed]:
            seed = next(number for number in waiting if unused[number])
        filled, room, cut = [], window, None

        def take(number: int) -> None:
            nonlocal room, cut
            start = rest[number]
            length = min(room, len(documents[number]) - start)
            filled.append((number, start, length))
            room -= length
            if start + length < len(documents[number]):
                rest[number], cut = start + length, number
            else:
                del rest[number]
                unused[number] = False

        take(seed)
        if room and rest:
            scores = np.where(unused, index.scores(seed), -1.0)
            scores[filled[0][0]] = -1.0
            for number in np.argsort(-scores, kind="stable"):
                if not room or scores[number] < 0:
                    break
                take(int(number))
        if room:  # nothing is left: the last window is parted into powers of two
            yield from _powers(filled)
        else:
            yield filled
        seed = cut


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    total = sum(length for *_, length in pieces)
    pieces = list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        part, room = [], 1 << bit
        while room:
            number, start, length = pieces.pop(0)
            taken = min(room, length)
            part.append((number, start, taken))
            room -= taken
            if taken < length:
                pieces.insert(0, (number, start + taken, length - taken))
        yield part


def _with_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, tie, ids, code) of every document, and a row for each task that has its counts only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, tokens = np.zeros(0, dtype=np.int64), 0, 0

        def rows(doc_id: pa.Array, tie: pa.Array, ids: list, code: list, counts: list) -> pa.RecordBatch:
            columns = [doc_id, tie, pa.array(ids, pa.binary()), pa.array(code, pa.string())]
            columns += [pa.array([count] * len(ids), kind) for count, kind in zip(counts, (pa.binary(), pa.int64(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "ids", "code", "held", "documents", "tokens"])

        for batch in batches:
            for part in portions(batch, "text", TEXTS, BYTES):
                found = [np.append(ids, ids.dtype.type(END)) for ids in token_ids(tokenizer, part.column("text").to_pylist())]
                more = np.bincount(np.concatenate([counted(ids)[0] for ids in found]), minlength=len(held))
                more[: len(held)] += held
                held, documents, tokens = more, documents + len(found), tokens + sum(map(len, found))
                yield rows(part.column("doc_id"), part.column("tie"), [ids.tobytes() for ids in found], [ids.dtype.str for ids in found], [None] * 3)
        none = pa.nulls(1, pa.int64())
        yield rows(none, none, [None], [None], [held.astype("<i8").tobytes(), documents, tokens])
        tokenizer_of(tokenizer).forget()
        give_back()

    told = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("tie"))
    return told.mapInArrow(read, "doc_id bigint, tie bigint, ids binary, code string, held binary, documents bigint, tokens bigint")


def _statistics(rows: DataFrame) -> Statistics:
    """Sums of the tasks' counts: one row per token id reaches the driver."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for each in batch.column("held").to_pylist():
                held = np.frombuffer(each, "<i8")
                terms = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(held[terms], pa.int64())], ["term", "held"])

    counted = rows.where("held is not null")
    count, tokens = counted.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    sums = counted.select("held").mapInArrow(spread, "term bigint, held bigint").groupBy("term").agg(F.sum("held").alias("held")).toArrow()
    terms = sums.column("term").to_numpy()
    held = np.zeros(int(terms.max(initial=0)) + 1, dtype=np.int64)
    held[terms] = sums.column("held").to_numpy()
    return Statistics(count, tokens / max(count, 1), held)


def dealt(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, Statistics]:
    """(doc_id, tie, ids, code, key, range) of every document, and the statistics of all."""
    spark = docs.sparkSession
    ship(spark)
    path = new_folder(spark, "packing")
    _with_ids(docs, tokenizer).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    of_all = _statistics(stored)
    shared = spark.sparkContext.broadcast(of_all)
    rows = stored.where("ids is not null").select("doc_id", "tie", "ids", "code")

    def keyed(asked: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_all = shared.value
            for batch in batches:
                for part in portions(batch, "ids", TEXTS, BYTES):
                    documents = zip(part.column("ids").to_pylist(), part.column("code").to_pylist(), strict=True)
                    keys = like_keys([np.frombuffer(ids, code) for ids, code in documents], of_all)
                    places = [bisect_right(splitters, pair) for pair in zip(keys.tolist(), part.column("tie").to_pylist(), strict=True)]
                    yield part.append_column("key", pa.array(keys)).append_column("range", pa.array(places, pa.int64()))
            give_back()

        return asked.mapInArrow(read, "doc_id bigint, tie bigint, ids binary, code string, key bigint, range bigint")

    parts = max(1, -(-of_all.count // RANGE_DOCS))
    splitters: list[tuple[int, int]] = []
    if parts > 1:
        step = max(1, of_all.count // (parts * RANGE_SAMPLES))
        some = rows.where(F.pmod(F.xxhash64(F.lit("range"), "tie"), F.lit(step)) == 0)
        sample = sorted((row.key, row.tie) for row in keyed(some, []).select("key", "tie").collect())
        splitters = [sample[len(sample) * part // parts] for part in range(1, parts)] if sample else []
    return keyed(rows, splitters), of_all


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of packed sequences: document, place in it, ids (little-endian 32-bit), sequence and offset there."""
    rows, of_all = dealt(docs, tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(of_all)

    def pack(held: pa.Table) -> pa.Table:
        number = held.column("range")[0].as_py()
        held = held.sort_by([("key", "ascending"), ("tie", "ascending"), ("doc_id", "ascending"), ("ids", "ascending")])
        made, first = [], number << 32
        for start in range(0, held.num_rows, SHARD_DOCS):
            made.append(_pack_shard(held.slice(start, SHARD_DOCS), first, shared.value))
            first = made[-1].column("sequence_id")[-1].as_py() + 1
        return pa.concat_tables(made)

    return rows.groupBy("range").applyInArrow(
        pack, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


def _pack_shard(shard: pa.Table, first: int, of_all: Statistics) -> pa.Table:
    """Pieces of the documents of a shard, sequences numbered from ``first``."""
    documents = [np.frombuffer(ids, code) for ids, code in zip(shard.column("ids").to_pylist(), shard.column("code").to_pylist(), strict=True)]
    owners, starts, lengths, held, sequences, offsets = [], [], [], [], [], []
    for position, pieces in enumerate(windows(documents, of_all=of_all)):
        offset = 0
        for owner, start, length in pieces:
            owners.append(owner)
            starts.append(start)
            lengths.append(length)
            held.append(documents[owner][start : start + length].astype("<u4").tobytes())
            sequences.append(first + position)
            offsets.append(offset)
            offset += length
    return pa.table(
        {
            "doc_id": shard.column("doc_id").take(pa.array(owners, pa.int64())),
            "start": pa.array(starts, pa.int64()),
            "length": pa.array(lengths, pa.int64()),
            "ids": pa.array(held, pa.binary()),
            "doc_tokens": pa.array([len(documents[owner]) for owner in owners], pa.int64()),
            "sequence_id": pa.array(sequences, pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
        }
    )
