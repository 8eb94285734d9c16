"""Trie of the common beginnings of conversations, with counts for every node.

A turn is told by a 16-byte digest of its role and text, so texts stay where they are. Conversations
are ordered by their turns' digests and cut into range shards of about ``SHARD_TURNS`` turns; a cut can
fall between any two, equal ones too. A shard is read as padded matrices of turn digests,
``STRIP`` turns wide: ``np.lexsort`` brings equal beginnings together, changes from row to row,
OR-accumulated over the columns, mark where the nodes of every depth start, and ``reduceat`` aggregates them.

Only nodes on the path of a cut can lie in several shards. Those boundary nodes are told apart by a chained digest and
recombined: counts are added, and a node that m shards have is taken back m - 1 times from the sums of
its ancestors. All other nodes leave their shard finished.

A digest of member ids follows their order, so one task reads the ids of a boundary node's members, as a
stream. One conversation is one row of 20 bytes a turn. Cuts compare the first ``DEEP`` turns, a hash of all
turns and the conversation, so what reaches the driver is bounded (a sample of ``SAMPLES`` keys a shard, at most
``MOST_SHARDS`` shards).

Defined results: null role and text count as empty; turns are ordered by turn (nulls first), equal turn
numbers by the digest; repeated rows are repeated turns; rows without a conv_id belong to no conversation; an
empty table has no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import ship, stored

SHARD_TURNS = 1 << 18
MOST_SHARDS = 1 << 16
SAMPLES = 8
STRIP = 8
DEEP = 16
CHUNK = 1 << 13
ID = 16
ROOT = bytes(ID)
NOBODY = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order, each a digest and its text's code points."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), F.substring(digest, 1, ID).alias("id"), F.char_length(text).alias("chars")).alias("said"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda said: F.struct(said["id"].alias("id"), said["chars"].alias("chars"))))


def rebuilt(lists: DataFrame, family: int = 100, shared: int = 6) -> DataFrame:
    """Conversations whose first turns, fewer than ``shared`` by a checksum of conv_id, are those of their family's first one."""
    heads = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, shared - 1).alias("first"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(shared)).cast("int")
    own = lists.withColumn("head", F.col("conv_id") - F.col("conv_id") % family).withColumn("taken", taken)
    joined = own.join(heads, "head", "left")
    none = F.slice("turns", 1, 0)
    first = F.slice(F.coalesce("first", none), F.lit(1), F.col("taken"))
    rest = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


class Cut(NamedTuple):
    """Where a shard begins: the digests of the first turns, a hash of all turns and the conversation."""

    first: bytes
    tie: int
    conv_id: int


def _cuts(lists: DataFrame, shard_turns: int) -> list[Cut]:
    weight = F.size("ids") + 1
    total = lists.agg(F.sum(weight)).first()[0] or 0
    shards = min(MOST_SHARDS, -(-total // shard_turns))
    if shards <= 1:
        return []
    step = max(1, total // (shards * SAMPLES))
    times = F.expr(f"(pmod(xxhash64(conv_id), {step}L) + size(ids) + 1) div {step}L")
    found = lists.select(F.slice("ids", 1, DEEP).alias("first"), "tie", "conv_id", times.alias("times")).where("times > 0").collect()
    sample = sorted((Cut(b"".join(row.first), row.tie, row.conv_id), row.times) for row in found)
    reached = np.cumsum([count for _, count in sample])
    places = np.searchsorted(reached, reached[-1] * np.arange(1, shards) / shards, side="right") if sample else []
    return sorted({sample[place][0] for place in places if place < len(sample)})


class _Level:
    """The nodes of one depth in order, with what is known of them in this shard."""

    def __init__(self, count: np.ndarray, least: np.ndarray, chars: np.ndarray, parent: np.ndarray, row: np.ndarray):
        self.count, self.least, self.chars, self.parent, self.row = count, least, chars, parent, row
        self.children = np.zeros(len(count), np.int64)
        self.leaves = np.zeros(len(count), np.int64)
        self.saved = (count - 1) * chars
        #: Members that have no further turn: their node and their id, both ascending.
        self.enders = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def gather(self, below: _Level) -> None:
        """Take in the sums of the nodes one deeper, whose parents ascend."""
        begin = np.flatnonzero(np.diff(below.parent, prepend=-1))
        parents = below.parent[begin]
        self.children[parents] = np.diff(np.append(begin, len(below.parent)))
        self.leaves[parents] = np.add.reduceat(below.leaves, begin)
        self.saved[parents] += np.add.reduceat(below.saved, begin)


def levels(conv_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, chars: np.ndarray) -> list[_Level]:
    """Nodes of every depth of conversations given one after the other; ``ids`` has two numbers a turn."""
    starts = np.cumsum(lengths) - lengths
    rows = np.argsort(conv_ids, kind="stable")
    group = np.zeros(len(rows), np.int64)
    zero = np.zeros(1, np.int64)
    found = [_Level(np.array([len(rows)]), conv_ids[rows[:1]], zero, zero - 1, rows[:1])]
    depth = 0
    while True:
        over = lengths[rows] == depth
        if not depth:
            found[0].enders = group[over], conv_ids[rows[over]]
        left = lengths[rows] > depth
        rows, group = rows[left], group[left]
        if not len(rows):
            break
        width = int(min(STRIP, lengths[rows].max() - depth))
        there = (lengths[rows] - depth)[:, None] > np.arange(width)
        cells = np.where(there, (starts[rows] + depth)[:, None] + np.arange(width), 0)
        matrix = np.where(there[:, :, None], ids[cells], 0)
        keys = [key for column in reversed(range(width)) for key in (matrix[:, column, 1], matrix[:, column, 0], there[:, column])]
        order = np.lexsort([*keys, group])
        rows, group, there, cells, matrix = rows[order], group[order], there[order], cells[order], matrix[order]
        change = np.ones((len(rows), width), bool)
        change[1:] = (matrix[1:] != matrix[:-1]).any(axis=2) | (there[1:] != there[:-1])
        change[1:, 0] |= group[1:] != group[:-1]
        np.logical_or.accumulate(change, axis=1, out=change)
        for column in range(width):
            begin = np.flatnonzero(change[:, column])
            real = there[begin, column]
            own = conv_ids[rows]
            level = _Level(
                np.diff(np.append(begin, len(rows)))[real], np.minimum.reduceat(own, begin)[real],
                chars[cells[begin, column][real]], group[begin[real]], rows[begin[real]],
            )
            group = (np.cumsum(real) - 1)[np.cumsum(change[:, column]) - 1]
            over = there[:, column] & (lengths[rows] == depth + column + 1)
            level.enders = group[over], own[over]
            found.append(level)
        depth += width
    for depth in range(len(found) - 1, -1, -1):
        if depth + 1 < len(found):
            found[depth].gather(found[depth + 1])
        childless = found[depth].children == 0
        found[depth].leaves[childless] = 1
    return found


def _common(lengths: np.ndarray, ids: np.ndarray, cut: Cut | None) -> np.ndarray:
    """Depth down to which each conversation's nodes lie on the path of a cut; without a cut -1."""
    if cut is None:
        return np.full(len(lengths), -1)
    starts = np.cumsum(lengths) - lengths
    path = np.frombuffer(cut.first, ">u8").astype(np.uint64).reshape(-1, 2)
    common = np.zeros(len(lengths), np.int64)
    for depth, wanted in enumerate(path):
        rows = np.flatnonzero((common == depth) & (lengths > depth))
        common[rows[(ids[starts[rows] + depth] == wanted).all(axis=1)]] += 1
    if len(path) == DEEP:  # what follows is not in the cut; conversations that share it may be anywhere below
        common[common == DEEP] = np.iinfo(np.int64).max
    return common


FINISHED, CHILD, BOUNDARY, MEMBERS = range(4)
#: What a shard gives: finished nodes, finished nodes below a boundary node, boundary nodes, and the latter's members.
OUT = pa.schema(
    [
        ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()), ("chars", pa.int64()), ("childless", pa.int64()), ("members", pa.list_(pa.int64())),
    ]
)
OUT_DDL = (
    "kind int, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, chars bigint, childless bigint, members array<bigint>"
)


def _decimal(conv_ids: np.ndarray) -> bytes:
    return ",".join(map(str, conv_ids.tolist())).encode()


def _ends(level: _Level) -> list[str]:
    """Digest of the ids of each node's members without a further turn."""
    found = [NOBODY] * len(level.count)
    nodes, members = level.enders
    begin = np.flatnonzero(np.diff(nodes, prepend=-1))
    for node, own in zip(nodes[begin].tolist(), np.split(members, begin[1:]), strict=False):
        found[node] = hashlib.sha256(_decimal(own)).hexdigest()
    return found


def _shard(conv_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, chars: np.ndarray, low: Cut | None, high: Cut | None) -> Iterator[pa.RecordBatch]:
    """What a shard between two cuts gives, depth by depth."""
    starts = np.cumsum(lengths) - lengths
    common = np.maximum(_common(lengths, ids, low), _common(lengths, ids, high))
    above_keys: list[bytes | None] = []  # of the nodes one higher; none for those that are no boundary
    above: _Level | None = None

    def batch(count: int, **columns: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in OUT], schema=OUT)

    for depth, level in enumerate(levels(conv_ids, lengths, ids, chars)):
        split = common[level.row] >= depth
        parents = level.parent.tolist()
        keys: list[bytes | None] = [None] * len(parents)
        for node in np.flatnonzero(split).tolist():
            own = ids[starts[level.row[node]] + depth - 1].astype(">u8").tobytes() if depth else b""
            keys[node] = hashlib.blake2b(above_keys[parents[node]] + own, digest_size=ID).digest() if depth else ROOT
        below = np.array([bool(depth) and above_keys[parent] is not None for parent in parents], bool)
        ends = np.array(_ends(level), object)
        for kind, chosen in ((FINISHED, ~split & ~below), (CHILD, ~split & below), (BOUNDARY, split)):
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            columns: dict[str, object] = {
                "kind": np.full(len(at), kind, np.int32), "conv_id": level.least[at], "depth": np.full(len(at), depth), "n_convs": level.count[at],
                "n_children": level.children[at], "n_leaves": level.leaves[at], "saved_tokens": level.saved[at],
            }
            if kind == FINISHED:
                columns["parent_conv_id"] = above.least[level.parent[at]] if above is not None else [None] * len(at)
            else:
                columns["parent_key"] = [above_keys[parents[node]] if depth else None for node in at]
            if kind == BOUNDARY:
                columns |= {"chars": level.chars[at], "childless": (level.children[at] == 0).astype(np.int64)}
                columns["key"] = [keys[node] for node in at]
            else:
                columns["ends_sha256"] = ends[at]
            yield batch(len(at), **columns)
        nodes, members = level.enders
        for node in np.unique(nodes[split[nodes]]).tolist():
            own = members[slice(*np.searchsorted(nodes, [node, node + 1]))]
            for start in range(0, len(own), CHUNK):
                some = own[start : start + CHUNK]
                yield batch(1, kind=[MEMBERS], key=[keys[node]], conv_id=some[:1], members=[some])
        above_keys, above = keys, level


def _shards(lists: DataFrame, cuts: list[Cut]) -> DataFrame:
    """What all shards give."""
    shared = lists.sparkSession.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("ids").to_pylist(), batch.column("tie").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            places = [bisect_right(shared.value, Cut(b"".join(own[:DEEP]), tie, conv_id)) for own, tie, conv_id in keys]
            yield batch.append_column("shard", pa.array(places, pa.int64()))

    def read(shard: pa.Table) -> pa.Table:
        place, lists = shard.column("shard")[0].as_py(), shard.column("ids").combine_chunks()
        ids = np.frombuffer(b"".join(lists.flatten().to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        chars = shard.column("chars").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        conv_ids = shard.column("conv_id").to_numpy()
        bounds = [None, *shared.value, None]
        return pa.Table.from_batches(list(_shard(conv_ids, lengths, ids, chars, bounds[place], bounds[place + 1])), OUT)

    dealt = lists.mapInArrow(deal, "conv_id bigint, ids array<binary>, chars array<int>, tie bigint, shard bigint")
    return dealt.groupBy("shard").applyInArrow(read, OUT_DDL)


def _member_digests(rows: DataFrame) -> DataFrame:
    """key and digest of all member ids of boundary nodes, from chunks that ascend and do not overlap."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, found = [], []
            for key, members in zip(batch.column("key").to_pylist(), batch.column("members"), strict=True):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        found.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(_decimal(members.values.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    chunks = rows.where(F.col("kind") == MEMBERS).select("key", "conv_id", "members")
    return chunks.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(read, "key binary, ends_sha256 string")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _summed_up(values: DataFrame, depth: int) -> DataFrame:
    """Sums over all nodes below each one, itself included, of (key, above, value...), in as many rounds as ``depth`` has bits.

    After round k a node has the sums of the 2^k levels from itself down and knows its ancestor 2^k levels up.
    """
    names = values.columns[2:]
    for _ in range(depth.bit_length()):
        lower = values.where("above is not null").groupBy(F.col("above").alias("key")).agg(*[F.sum(name).alias(f"lower_{name}") for name in names])
        upper = values.select(F.col("key").alias("above"), F.col("above").alias("next"))
        summed = values.join(lower, "key", "left").join(upper, "above", "left")
        added = [(F.col(name) + F.coalesce(f"lower_{name}", F.lit(0))).alias(name) for name in names]
        values = stored(summed.select("key", F.col("next").alias("above"), *added), "trie-sums")
    return values.drop("above")


def _recombined(rows: DataFrame) -> DataFrame:
    """Boundary nodes with the sums of all shards: the result's columns and key, parent_key."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = rows.where(F.col("kind") == BOUNDARY).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.max("chars").alias("chars"),
        F.count("*").alias("shards"), F.sum("childless").alias("childless"), *[F.sum(name).alias(name) for name in sums],
    )
    merged = stored(merged, "trie-boundary")
    several = merged.where("shards > 1")
    counted = several.groupBy(F.col("parent_key").alias("key")).agg(F.sum(1 - F.col("shards")).alias("more_n_children"))
    more = _summed_up(several.select(
        "key", F.col("parent_key").alias("above"), (F.when(F.col("childless") == F.col("shards"), 1).otherwise(0) - F.col("childless")).alias("more_n_leaves"),
        ((F.col("shards") - 1) * F.col("chars")).alias("more_saved_tokens"),
    ), several.agg(F.max("depth")).first()[0] or 0)
    whole = merged.join(more, "key", "left").join(counted, "key", "left").join(_member_digests(rows), "key", "left")
    return whole.select(
        "key", "parent_key", "conv_id", "depth", "n_convs", *[(F.col(name) + F.coalesce(f"more_{name}", F.lit(0))).alias(name) for name in sums[1:]],
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )


def nodes(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of (conv_id, turns): smallest member, depth, parent, counts and the digest of those that end there."""
    ship(lists.sparkSession)
    told = lists.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))
    told = stored(told.withColumn("tie", F.xxhash64("ids")), "turn-lists")
    cuts = _cuts(told, shard_turns)
    rows = _shards(told, cuts)
    if not cuts:
        return rows.select(*RESULT)
    rows = stored(rows, "trie-shards")
    boundary = stored(_recombined(rows), "trie-nodes")
    parents = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    finished = rows.where(F.col("kind") == FINISHED).select(*RESULT)
    children = rows.where(F.col("kind") == CHILD).drop("parent_conv_id").join(parents, "parent_key").select(*RESULT)
    return finished.unionAll(children).unionAll(boundary.join(parents, "parent_key", "left").select(*RESULT))
