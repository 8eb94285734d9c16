"""Exact set similarity join on word shingles that skips by set relations.

A document is the set of its distinct four-word shingles (A-Z lowered). Two documents link
when ``100 * |intersection| >= 85 * |union|``; the operator returns each document's set size
and the least document id of its connected component.

How the work is kept small, without losing a link:

* Equal sets are one node.
* Prefix index: every set is ordered by one global order (frequent shingles last, else by
  hash). Linked sets share a shingle among the first ``n - ceil(0.85 n) + 1``.
  What counts as frequent is taken from a bounded sample (``FREQUENCY_SAMPLE`` documents, at most
  ``FREQUENT`` shingles). It only arranges the order; any order gives the same links.
* Index-level skipping: the list of a shingle is cut into blocks of set sizes at most a
  factor 100/85 apart, and a set meets only its own and the two adjoining blocks.
* Answer-level skipping: the sets of a list are first compared with one pivot. Those linked
  with it share its component, so pairs among them are never formed. For the rest, the
  pivot's answers bound theirs: Jaccard distance is a metric, so x and y cannot link if
  ``d(p, x) - d(p, y) > 0.15``. The pivot is the set that stands in most lists.
* Bitmap filter, within the join of a list and before sets are moved: the parities of a set's members over cells (at least 512,
  and half as many as it has members) bound the symmetric difference of two sets from below.

Defined results: null text or no words give the empty set (size 0, linked with nothing, own
component); fewer than four words give one shingle, the whole sequence; repeated rows each
get a result; a null id is no candidate for a component id. Other columns are ignored.
Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import give_back, remembered, settled, ship
from rideledger.llm.columns import apart, back, held
from rideledger.llm.components import components
from rideledger.llm.marks import marked
from rideledger.llm.words import lower_words

SHINGLE = 4
PERCENT = 85
FREQUENCY_SAMPLE = 32_768
FREQUENT = 1 << 19
BITMAP_WORDS = 8
FILTER_BITS = 26
_KNOWN_WORDS = 100_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class _WordHashes(dict):
    """Hash of each word seen lately, as eight bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_digest(word)
        return value


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(29))


def shingle_set(text: object) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    tokens = lower_words(text)
    if len(tokens) < SHINGLE:
        if not tokens:
            return np.empty(0, np.uint64)
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), len(tokens))], dtype=np.uint64)
    hashes = np.frombuffer(b"".join(map(remembered("word hashes", _WordHashes).__getitem__, tokens)), dtype=np.uint64)
    total = hashes[: len(hashes) - SHINGLE + 1] * _ODD[0]
    for step in range(1, SHINGLE):
        total = total + hashes[step : len(hashes) - SHINGLE + 1 + step] * _ODD[step]
    return np.unique(_mixed(total))


def _node(members: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())))) if len(members) else None


def _prefix(members: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    length = len(members) - (PERCENT * len(members) + 99) // 100 + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        common = frequent[at] == members
        rare = members[~common]
        if len(rare) >= length:
            return rare[:length]
        return np.concatenate([rare, members[common][np.argsort(rank[at[common]], kind="stable")]])[:length]
    return members[:length]


def _parity(members: np.ndarray) -> np.ndarray:
    """Parities of a set over at least half as many cells as it has members, a power of two."""
    cells = max(64 * BITMAP_WORDS, 1 << max(0, (len(members) // 2 - 1)).bit_length())
    bits = np.bincount(((members >> np.uint64(17)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample, sorted, and the place of each from rare to frequent."""
    total = docs.count()
    step = max(1, total // FREQUENCY_SAMPLE)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text).view(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], ["token"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("text")  # of many copies of a text not all
    counted = settled(some.mapInArrow(sampled, "token bigint").groupBy("token").agg(F.count("*").alias("n")).where("n >= 2"))
    # The most frequent ones, all that are as frequent as the last, as long as they are few enough.
    left, least = FREQUENT, None
    for row in counted.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).toLocalIterator():
        left -= row.tokens
        if left < 0:
            break
        least = row.n
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    held = counted.where(F.col("n") >= least).toArrow()
    tokens, counts = held.column("token").to_numpy().view(np.uint64), held.column("n").to_numpy()
    place = np.argsort(tokens)
    order = np.empty(len(tokens), np.int32)
    order[np.lexsort((tokens, counts))] = np.arange(len(tokens), dtype=np.int32)
    return tokens[place], order[place]


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, set size, node, prefix and parity of every row."""
    frequent, rank = _frequent(docs)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        for batch in batches:
            sets = [shingle_set(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(members) for members in sets], pa.int64()),
                    pa.array([_node(members) for members in sets], pa.int64()),
                    _lists([_prefix(members, frequent, rank).view(np.int64) for members in sets]),
                    _lists([_parity(members) for members in sets]),
                ],
                ["doc_id", "n", "node", "prefix", "parity"],
            )
        give_back()

    schema = "doc_id bigint, n bigint, node bigint, prefix array<bigint>, parity array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(describe, schema)


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members) of at least the given nodes, computed again from the texts.

    Rows are chosen before anything moves by a bitmap over hashed document ids. It has a
    fixed size (2^26 bits); where it fills up, more sets are made than needed, none fewer.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("label"), F.lit(1 << FILTER_BITS))
    rows = (
        nodes.select(place.alias("h")).distinct()
        .groupBy(F.bitmap_bucket_number("h").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
        .collect()
    )
    wanted = spark.sparkContext.broadcast({row.bucket: bytes(row.bits) for row in rows})

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            places = zip(batch.column("bucket").to_pylist(), batch.column("position").to_pylist(), strict=True)
            rows = [row for row, (bucket, position) in enumerate(places) if bucket in bits and bits[bucket][position >> 3] >> (position & 7) & 1]
            sets = [shingle_set(text) for text in batch.column("text").take(pa.array(rows, pa.int64())).to_pylist()]
            sets = [found for found in sets if len(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(found) for found in sets], pa.int64()), _lists([found.view(np.int64) for found in sets])], ["node", "members"]
            )
        give_back()

    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(1 << FILTER_BITS))
    made = docs.select(
        "text", F.bitmap_bucket_number(hashed).alias("bucket"), F.bitmap_bit_position(hashed).alias("position")
    ).mapInArrow(members, "node bigint, members array<bigint>")
    return made.groupBy("node").agg(F.first("members").alias("members"))


def _possible(m: str, n: str) -> Column:
    """Whether sets of these sizes can link."""
    return F.expr(f"{PERCENT} * greatest({m}, {n}) <= 100 * least({m}, {n})")


def _least_apart(n_a: str, parity_a: str, n_b: str, parity_b: str) -> Column:
    """So many shingles at least are in one of two sets alone, by their sizes and parities."""
    length = F.least(F.size(parity_a), F.size(parity_b))  # of two sets that can link, one is at most twice the other

    def folded(side: str) -> Column:
        parts = F.slice(side, F.lit(1), length), F.slice(side, length + 1, length)
        return F.when(F.size(side) > length, F.zip_with(*parts, lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(side))

    differing = F.zip_with(folded(parity_a), folded(parity_b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.when(_possible(n_a, n_b), F.aggregate(differing, F.lit(0), lambda s, x: s + x))
    return F.greatest(apart, F.abs(F.col(n_a) - F.col(n_b))).cast("bigint")


def _open(apart: Column, n_a: str, n_b: str) -> Column:
    """Whether sets that are at least so far apart can link: |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|) if they do."""
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col(n_a) + F.col(n_b))


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sizes, labels and ``apart``: at least so many shingles are in one set alone."""
    known = nodes.select("node", "n", "parity", "label")
    for side in ("a", "b"):
        own = known.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in known.columns])
        pairs = pairs.join(own, side)
    return pairs.withColumn("apart", _least_apart("n_a", "parity_a", "n_b", "parity_b")).drop("parity_a", "parity_b")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact ``apart`` for the pairs whose bound leaves a link possible; the others keep their bound."""
    pairs = settled(pairs.withColumn("open", _open(F.col("apart"), "n_a", "n_b")))
    asked = pairs.where("open")
    ends = asked.select(F.explode(F.array(*[F.struct(F.col(s).alias("node"), F.col(f"label_{s}").alias("label")) for s in "ab"])).alias("e")).select("e.*")
    sets = _sets_of(docs, ends.distinct())
    met = (
        asked.select("a", "b", "n_a", "n_b")
        .join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b")
        .withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
        .select("a", "b", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("apart"))
    )
    union = (F.col("n_a") + F.col("n_b") + F.col("apart")) / 2
    met = met.withColumns({"distance": F.col("apart") / union, "linked": 100 * (union - F.col("apart")) >= PERCENT * union})
    told = pairs.where("not open").select("a", "b", "n_a", "n_b", "apart")
    told = told.withColumns({"distance": F.col("apart") / ((F.col("n_a") + F.col("n_b") + F.col("apart")) / 2), "linked": F.lit(False)})
    return settled(met.unionByName(told).select("a", "b", "distance", "linked"))


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and node (hash of the set): one row per row of ``docs``."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = settled(_described(docs))
    nodes = settled(
        rows.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("label"), F.first("n").alias("n"),
            F.first("prefix").alias("prefix"), F.first("parity").alias("parity"),
        )
    )
    posted = nodes.select(F.explode("prefix").alias("token"), "node", "n")
    shared = posted.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").drop("held")
    lists = settled(posted.join(shared, "token"))
    # The pivot of a list is the set that stands in most lists: the one the others were made from, if any.
    degree = lists.groupBy("node").agg(F.count("*").alias("degree"))
    central = lists.join(degree, "node").groupBy("token").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"))
    lists = settled(lists.join(central, "token"))

    first = lists.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    answers = _verified(docs, _bounded(first, nodes))
    near = components(answers.where("linked"), "a", "b")

    # What the pivots' answers leave open.
    told = answers.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "distance", "linked")
    roots = near.select("node", "root")
    listed = (
        lists.join(told, ["pivot", "node"], "left")
        .join(roots, "node", "left")
        .join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root")), "pivot", "left")
        .withColumns(
            {
                "root": F.coalesce("root", "node"),
                "answered": F.coalesce("root", "node") == F.coalesce("pivot_root", "pivot"),
                "block": F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101.0 / PERCENT))).cast("int"),
            }
        )
        .drop("pivot_root")
    )
    listed = settled(listed.join(listed.where("not answered").select("token").distinct(), "token", "left_semi"))
    listed = listed.join(nodes.select("node", "parity"), "node")
    left = listed.where("not answered").select(
        "token", F.explode(F.array(*[F.col("block") + step for step in (-1, 0, 1)])).alias("block"),
        F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("root_a"), F.col("distance").alias("away"), F.col("parity").alias("parity_a"),
    )
    right = listed.where("node <> pivot").select(
        F.col("token").alias("met_token"), F.col("block").alias("met_block"), F.col("node").alias("b"), "n", F.col("root").alias("root_b"), "answered", "distance", "linked", "parity"
    )
    skip = F.coalesce(F.col("linked") & (F.col("away") - F.col("distance") > 1 - PERCENT / 100 + 1e-9), F.lit(False))
    wanted = (
        (F.col("root_a") != F.col("root_b")) & (F.col("answered") | (F.col("a") < F.col("b"))) & _possible("m", "n") & ~skip
        & _open(_least_apart("m", "parity_a", "n", "parity"), "m", "n")
    )
    meeting = (F.col("token") == F.col("met_token")) & (F.col("block") == F.col("met_block")) & wanted
    second = left.join(right, meeting).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = _verified(docs, _bounded(second, nodes))
    links = answers.where("linked").select("a", "b").unionAll(rest.where("linked").select("a", "b"))
    member = components(links, "a", "b")
    labelled = nodes.select("node", "label").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("label").alias("component_id"))
    named = labelled.join(least, "root").select("node", "component_id")
    return (
        rows.select("doc_id", F.col("n").alias("n_shingles"), "node")
        .join(named, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay when each component keeps its document of least id; all columns.

    Of rows that repeat that id and set, the one with the least text stays. Documents
    without words stay.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("bigint")
    def node_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_node(shingle_set(text)) for text in texts], dtype="Int64")

    found = settled(linked_documents(docs).withColumn("id", F.col("doc_id").cast("bigint")))
    stays = F.col("node").isNull() | F.col("id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy("id").agg(F.count("*").alias("rows"), F.bool_and(stays).alias("stays"))
    keyed = apart(docs).withColumns({"text": held(docs, "text"), "id": held(docs, "doc_id").cast("bigint")})
    # A row whose id no other row has is told by its id alone; only the others are read again for their sets.
    once = keyed.join(ids.where("rows = 1 and stays and id is not null").select("id"), "id", "left_semi").select(*back(docs))
    shared = ids.where("rows > 1 or id is null").select(F.col("id").alias("shared_id"))
    tagged = marked(keyed, shared.withColumnRenamed("shared_id", "id"), ["id"]).where("_marked")
    tagged = tagged.join(shared, F.col("id").eqNullSafe(F.col("shared_id")), "left_semi").withColumn("node", node_of("text"))
    staying = found.where("node is not null and id <=> component_id").join(shared, F.col("id").eqNullSafe(F.col("shared_id")), "left_semi")
    staying = staying.select(F.col("node").alias("same"), F.col("component_id").alias("kept")).distinct()
    empty = tagged.where("node is null").select(*back(docs))
    met = tagged.join(staying, (F.col("node") == F.col("same")) & F.col("id").eqNullSafe(F.col("kept")))
    row = F.struct(*back(docs))
    # As JSON a row has an order whatever its types; of equal ones any will do.
    first = met.groupBy("node", "kept").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
    return once.unionAll(empty).unionAll(first.select(*[F.col("row")[name].alias(name) for name in docs.columns]))
