"""Encoding and decoding with merge-type vocabularies of subword pieces.

The symbols of a normalised text start as its characters. An agenda holds all adjacent pairs whose
joint string is a piece, best score first, leftmost among equals. Taking the best pair joins its
symbols and puts the pairs with the new neighbours on the agenda; a pair whose symbols have changed
meanwhile is passed over. What is no piece in the end is spelled in bytes, if the vocabulary has them.

No merge crosses the place between two characters that stand side by side in no piece. So a text is cut
there, first before its space marks and then within words, and the ids of words and of the stretches
that are left are remembered (twice ``KEPT`` of them at most).

Every batch is checked against the sentencepiece library, which also normalises and decodes: it encodes one text in
``CHECKED`` too, the first of a batch among them, and other ids raise an error. So a vocabulary of another kind (unigram, user-defined
symbols) is refused rather than read wrongly.

Defined results: null text counts as empty, which has no ids; null and repeated doc_ids stay as
they are, a row for a row; an empty table gives an empty result. Other columns are ignored. A text
is read whole, whatever its length; a task holds the ids of ``TEXTS`` texts or ``BYTES`` of text at a time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import remembered, ship
from rideledger.llm.words import portions

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
KEPT = 500_000
#: Up to so many characters a list is the faster agenda.
SHORT = 32
NO_PIECE = float("inf")
TEXTS, BYTES = 1024, 1 << 22
CHECKED = 4


class PieceReader:
    """Ids of texts by one vocabulary file."""

    def __init__(self, path: str, kept: int = KEPT):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.kept = kept
        pieces = range(self.library.get_piece_size())
        self.unknown = self.library.unk_id()
        self.bytes = {int(self.library.id_to_piece(i)[3:5], 16): i for i in pieces if self.library.is_byte(i)}
        apart = {i for i in pieces if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)}
        self.ids = {self.library.id_to_piece(i): i for i in pieces if i not in apart}
        self.ranks = {piece: -self.library.get_score(i) for piece, i in self.ids.items()}
        self.unused = {piece for piece, i in self.ids.items() if self.library.is_unused(i)}
        #: Neighbours inside some piece. No merge crosses a place between two characters that are none.
        self.inner = {piece[place : place + 2] for piece in self.ids for place in range(len(piece) - 1)}
        self.by_marks = not any(pair[1] == MARK != pair[0] for pair in self.inner)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The symbols that are left of a stretch when the agenda is empty."""
        return self._merged_short(text) if len(text) <= SHORT and not self.unused else self._merged_long(text)

    def _merged_short(self, text: str) -> list[str]:
        """With the agenda as a list in the order of places: the first of the best is found by looking through."""
        symbols, rank = list(text), self.ranks.get
        agenda = [rank(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) != NO_PIECE:
            left = agenda.index(best)
            symbols[left] = joint = symbols[left] + symbols[left + 1]
            del symbols[left + 1], agenda[left]
            if left:
                agenda[left - 1] = rank(symbols[left - 1] + joint, NO_PIECE)
            if left < len(agenda):
                agenda[left] = rank(joint + symbols[left + 1], NO_PIECE)
        return symbols

    def _merged_long(self, text: str) -> list[str]:
        """With the agenda as a heap."""
        symbols, ranks = list(text), self.ranks
        count = len(symbols)
        after, ahead = list(range(1, count + 1)), list(range(-1, count - 1))
        made: dict[str, tuple[str, str]] = {}
        agenda = []
        for left in range(count - 1):
            joint = symbols[left] + symbols[left + 1]
            if joint in ranks:
                agenda.append((ranks[joint], left, left + 1, 2))
                if joint in self.unused:
                    made[joint] = (symbols[left], symbols[left + 1])
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            one, other = symbols[left], symbols[right]
            if not one or not other or len(one) + len(other) != size:
                continue
            symbols[left], symbols[right] = one + other, ""
            after[left] = following = after[right]
            if following < count:
                ahead[following] = left
            for a, b in ((ahead[left], left), (left, following)):
                if a >= 0 and b < count:
                    joint = symbols[a] + symbols[b]
                    if joint in ranks:
                        heappush(agenda, (ranks[joint], a, b, len(joint)))
                        if joint in self.unused:
                            made[joint] = (symbols[a], symbols[b])
        found = [symbol for symbol in symbols if symbol]
        while made and any(symbol in made for symbol in found):  # a piece that is not to be used falls apart again
            found = [part for symbol in found for part in made.get(symbol, (symbol,))]
        return found

    def _stretch(self, text: str) -> bytes:
        found = array("i")
        for symbol in self.merged(text):
            number = self.ids.get(symbol)
            if number is not None:
                found.append(number)
            elif self.bytes:
                found.extend(self.bytes[byte] for byte in symbol.encode())
            else:
                found.append(self.unknown)
        return found.tobytes()

    def _remembered(self, text: str, make: Callable[[str], bytes]) -> bytes:
        ids = self.known.get(text)
        if ids is None:
            ids = self.before.get(text)
            if ids is None:
                ids = make(text)
            self.known[text] = ids
        return ids

    def _word(self, text: str) -> bytes:
        """Ids of what stands between two marks and the one before it, by way of the stretches no merge leaves."""
        if text[1:].isalpha():
            return self._stretch(text)
        inner, cuts = self.inner, [0]
        for place in range(1, len(text)):
            if text[place - 1 : place + 1] not in inner:
                cuts.append(place)
        if len(cuts) == 1:
            return self._stretch(text)
        return b"".join([self._remembered(text[a:b], self._stretch) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)])

    def encode(self, texts: list[str]) -> list[array]:
        """Ids of whole texts."""
        words = [self._words(self.library.normalize(text)) if text else [] for text in texts]
        if len(self.known) >= self.kept:  # two generations: what is still in use comes over from the one before
            self.before, self.known = self.known, {}
        ids = {word: self._remembered(word, self._word) for word in set().union(*words)}
        found = [array("i", b"".join(map(ids.__getitem__, own))) for own in words]
        if not self.bytes:  # unknown symbols in a row are one
            found = [array("i", [n for place, n in enumerate(own) if n != self.unknown or not place or own[place - 1] != n]) for own in found]
        return found

    def _words(self, normal: str) -> list[str]:
        """A text in parts that each begin with its marks."""
        if not self.by_marks:
            return [normal]
        return WORDS.findall(normal)

    def checked(self, texts: list[str], every: int = CHECKED) -> list[array]:
        """Ids of texts, held against the library's for one text in ``every``."""
        found = self.encode(texts)
        for place, wanted in enumerate(self.library.encode(texts[::every], num_threads=1)):
            ids = found[place * every]
            if ids != array("i", wanted):
                raise ValueError(f"text {place * every} of a batch: {len(ids)} ids by the agenda, {len(wanted)} by the library, or others")
        return found


def reader(path: str) -> PieceReader:
    """The vocabulary at a path, kept from one call of a worker to the next."""
    return remembered(f"pieces {path}", lambda: PieceReader(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, for every document."""
    ship(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = reader(path)
        for batch in batches:
            for part in portions(batch, "text", TEXTS, BYTES):
                ids = vocabulary.checked([text or "" for text in part.column("text").to_pylist()])
                decoded = vocabulary.library.decode([own.tolist() for own in ids])
                starts = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(read, "doc_id bigint, ids array<int>, decoded string")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
