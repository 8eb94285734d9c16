"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the least hash among its inner s-mers is that
of the first or the last one. Whether it is one depends on its own characters alone, so
an edit changes only the syncmers that touch it, and equal passages give equal anchors at any
position. ``anchors`` lists them with their positions; ``fingerprint`` keeps the least
``SKETCH`` distinct anchor hashes, from which the likeness of two texts is estimated as the
share they have in common among the least hashes of both together.

Defined results: null text counts as empty, the empty text has the empty fingerprint (like
itself 1, like anything else 0). A text without a syncmer (shorter than ``K``, or by chance
barely longer) has one anchor, the whole text. Rows with equal id and text are one document
in the order of documents; rows with equal id but other texts follow each other by a hash of
the text; a null id comes first. The document after the last is the first. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import ship

K = 20
S = 8
SKETCH = 64
STRETCH = 1024
MOST_STRETCHES = 65_536
SAMPLE_PER_STRETCH = 8
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return values ^ (values >> np.uint64(29))


def _joined(left: np.ndarray, right: np.ndarray, apart: int, step: int) -> np.ndarray:
    """Hash of each run that is made of a run in ``left`` and the one ``apart`` later in ``right``."""
    return left[: len(right) - apart] * _STEPS[step] + right[apart:]


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a text, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    two = _joined(points, points, 1, 0)
    four = _joined(two, two, 2, 1)
    eight = _joined(four, four, 4, 2)
    sixteen = _joined(eight, eight, 8, 3)
    whole = _joined(sixteen, four, 16, 4)
    inner = _mixed(eight)
    least = inner
    for shift in (1, 2, 4, 5):  # windows of 2, 4, 8 and K - S + 1 = 13
        least = np.minimum(least[:-shift], least[shift:])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[K - S :] == least))
    return at, _mixed(whole[at])


def _anchors_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    at, hashes = syncmers(text)
    if not len(at) and text:
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return np.zeros(1, np.int64), np.frombuffer(digest, np.uint64)
    return at, hashes


def fingerprint(text: str) -> str:
    """The least distinct anchor hashes of a text, eight hex digits each, in order."""
    least = np.unique((_anchors_of(text)[1] >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    return least.astype(">u4").tobytes().hex()


def likeness(one: str, other: str) -> float:
    """Estimated share of common anchors of two texts, from their fingerprints."""
    if one == other:
        return 1.0
    a, b = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (one, other))
    together = sorted(a | b)[:SKETCH]
    return sum(x in a and x in b for x in together) / len(together)


def edited(text: str, head: str) -> str:
    """The text with its last ``len(head)``-bounded quarter replaced by the start of another."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + head[:quarter]


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position and hash of every anchor of every text."""
    ship(docs.sparkSession)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at, hashes = _anchors_of(text)
                ids = pa.array([doc_id.as_py()] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(hashes.view(np.int64))], ["doc_id", "position", "hash"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(listed, "doc_id bigint, position bigint, hash bigint")


Key = tuple[bool, int, int]


def _key(doc_id: int | None, tie: int) -> Key:
    return doc_id is not None, doc_id or 0, tie


def _cuts(docs: DataFrame) -> list[Key]:
    """First keys of stretches of about ``STRETCH`` documents in a row, the first of all among them.

    Taken from a sample of keys, ``SAMPLE_PER_STRETCH`` for a stretch; every one is the key of a document.
    """
    count = docs.count()
    stretches = max(1, min(MOST_STRETCHES, -(-count // STRETCH)))
    step = max(1, count // (stretches * SAMPLE_PER_STRETCH))
    keys = docs.select("doc_id", "tie")
    sample = keys.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(step)) == 0).collect()
    first = keys.agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("first")).first().first
    found = sorted({_key(row.doc_id, row.tie) for row in sample})
    chosen = {found[len(found) * i // stretches] for i in range(stretches)} if found else set()
    return sorted(chosen | {_key(first.doc_id, first.tie)}) if first else []


class _Document:
    """A document with its fingerprint, which its neighbour asks for too."""

    def __init__(self, doc_id: int | None, tie: int, packed: bytes, unpack: zstandard.ZstdDecompressor):
        self.doc_id, self.key, self.times = doc_id, _key(doc_id, tie), 1
        self.text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
        self.fingerprint = fingerprint(self.text)

    def row(self, after: _Document) -> tuple:
        changed = edited(self.text, after.text)
        mark = fingerprint(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(self.fingerprint, mark), likeness(self.fingerprint, after.fingerprint)
        return self.doc_id, len(self.text), digest, self.fingerprint, mark, *near


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness to each other and the next document.

    The order of documents is cut into stretches that are sorted each on its own. The first document of a stretch
    also goes to the end of the one before, as the next document of its last. So texts are
    shuffled once, compressed, and a task holds two documents at a time.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    cuts = docs.sparkSession.sparkContext.broadcast(_cuts(docs))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = cuts.value
        places = {start: place for place, start in enumerate(starts)}
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows, stretches, guests = [], [], []
            for row, key in enumerate(map(_key, batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist())):
                stretch = bisect_right(starts, key) - 1
                rows.append(row)
                stretches.append(stretch)
                guests.append(False)
                if key in places:
                    rows.append(row)
                    stretches.append((stretch - 1) % len(starts))
                    guests.append(True)
            at = pa.array(rows, pa.int64())
            packed = pa.array([packer.compress(text.encode("utf-8", "surrogatepass")) for text in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(stretches, pa.int64()), pa.array(guests, pa.bool_()), batch.column("doc_id").take(at),
                    batch.column("tie").take(at), packed.take(at),
                ],
                ["stretch", "guest", "doc_id", "tie", "packed"],
            )

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: _Document | None = None
        stretch = None
        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(name).to_pylist() for name in ("stretch", "guest", "doc_id", "tie", "packed")]
            for now, guest, doc_id, tie, packed in zip(*columns, strict=True):
                if now != stretch:
                    stretch, held = now, None
                elif held is None:
                    continue  # a further row of the guest that has closed the stretch
                if held is not None and not guest and held.key == _key(doc_id, tie):
                    held.times += 1
                    continue
                document = _Document(doc_id, tie, packed, unpack)
                if held is not None:
                    done += [held.row(document)] * held.times
                held = None if guest else document
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names)

    moved = docs.select("doc_id", "text", "tie").mapInArrow(dealt, "stretch bigint, guest boolean, doc_id bigint, tie bigint, packed binary")
    ordered = moved.repartition("stretch").sortWithinPartitions("stretch", "guest", F.asc_nulls_first("doc_id"), "tie")
    return ordered.mapInArrow(
        finished,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
