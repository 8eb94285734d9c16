"""Pages as WARC archives, and their capture histories by an external merge of index runs.

Writing: every page becomes a WARC/1.1 record with its HTTP response as block. Of pages with equal
payloads of at least ``REVISIT_BYTES``, the one with the largest id keeps the payload and the
others become revisit records that refer to it; other pages are written where they are read. Spark's text writer writes the archives: the
two line breaks that end a record are its line separator.

Reading: archives are read as whole files and parted by Content-Length alone, payload digests are
computed again and compared. Each archive gives one run of captures sorted by
(URL key, timestamp, page id).

Merging: splitters from a sample of keys cut every run into sorted segments of ranges of about
``RANGE_CAPTURES`` captures, and each range's segments are merged by a loser tree. Ranges in order
are the capture histories of all URLs in global order. The key holds time and id too, so the
captures of a single URL may lie in many ranges.

Defined results: null html is an empty payload; a null url has no target field and the empty URL
key; a null page id stays null, is captured first and is never referred to unless all
equal payloads lack an id, in which case all are responses; rows that repeat the largest id are
all responses; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm.cluster import new_folder, settled, ship
from rideledger.llm.marks import marked

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 4096
RANGE_CAPTURES = 4096
MOST_RANGES = 65_536
SAMPLE_PER_RANGE = 8
FIRST_CAPTURE = "2024-01-01 00:00:00"
BREAK = "\r\n"
FIELDS = ["key", "url_key", "captured_at", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "archive_offset"]
KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
TYPES = ["string", "string", "string", "bigint", "bigint", "string", "string", "bigint", "string", "bigint"]


def _lines(*parts: Column) -> Column:
    """Header lines, those that are null left out."""
    return F.concat(F.concat_ws(BREAK, *parts), F.lit(BREAK + BREAK))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """One WARC record (``value``) per page, without the two line breaks at its end."""
    html = F.coalesce("html", F.lit(""))
    held = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"))
    held = held.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "n": F.octet_length("html").cast("bigint")})
    shared = (
        held.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("times"))
        .where("times > 1 and keeper is not null").select("digest", "keeper")
    )
    # Only pages that may have an equal are shuffled.
    told = marked(held, shared, ["digest"])
    alone = told.where("not _marked").withColumn("keeper", F.lit(None).cast("bigint"))
    met = told.where("_marked").join(shared, "digest", "left").unionByName(alone).drop("_marked")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(False))
    met = met.withColumn("again", again)
    http = _lines(
        F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _field("Content-Length", F.col("n").cast("string"))
    )
    met = met.withColumn("block", F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html"))))
    when = F.date_format(
        F.to_timestamp(F.lit(FIRST_CAPTURE)) + F.make_dt_interval(secs=F.coalesce(F.col("page_id") % 1_000_000_000, F.lit(0)).cast("decimal(18,6)")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    head = _lines(
        F.lit("WARC/1.1"),
        _field("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Date", when),
        _field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("again"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("again"), _field("WARC-Refers-To", _urn(F.col("keeper")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        _field("Content-Length", F.octet_length("block").cast("string")),
    )
    return met.select(F.concat(head, F.col("block")).alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    """Write the archives of pages, gzip-compressed, at most ``RECORDS_PER_FILE`` records each."""
    writer = records(pages).write.option("lineSep", BREAK * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parsed(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of every record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split(BREAK)
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        begin, length = end + 4, int(fields["Content-Length"])
        if archive[begin + length : begin + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end where it says")
        yield at, fields, archive[begin : begin + length]
        at = begin + length + 4


def url_key(url: str | None) -> str:
    """Host labels from the top level down, then path and query; scheme, ``www.`` and fragment don't count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def capture(offset: int, fields: dict[str, str], block: bytes, archive: str) -> tuple:
    """Index entry of a record; the payload's digest is computed again."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload of the record at {offset} is not what its header says")
    page_id, key = _id(fields["WARC-Record-ID"]), url_key(fields.get("WARC-Target-URI"))
    # The sign and digits of an id sort like the number.
    number = "" if page_id is None else f"{page_id + (1 << 63):020d}"
    order = f"{key}\x00{fields['WARC-Date']}\x00{number}"
    refers = _id(fields["WARC-Refers-To"]) if revisit else None
    return order, key, fields["WARC-Date"], page_id, length, digest, fields["WARC-Type"], refers, archive, offset


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archive: its captures as lists, sorted by key."""
    ship(spark)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name, packed = path.as_py(), content.as_py()
                archive = zlib.decompress(packed, 31) if packed else b""
                found = sorted((capture(*record, name) for record in parsed(archive)), key=lambda entry: (entry[0], entry[9]))
                columns = list(zip(*found, strict=True)) or [[]] * len(FIELDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([list(values)], pa.list_(kind)) for values, kind in zip(columns, KINDS, strict=True)], FIELDS
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    schema = ", ".join(f"{name} array<{kind}>" for name, kind in zip(FIELDS, TYPES, strict=True))
    return files.select("path", "content").mapInArrow(index, schema)


class LoserTree:
    """Merges sorted lists: an inner node holds the loser of its match, so a step replays one path only."""

    def __init__(self, lists: list[list[str]]):
        self.lists = lists
        self.at = [0] * len(lists)
        size = 1
        while size < len(lists):
            size *= 2
        self.size = size
        self.losers = [0] * size
        winners = [0] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            left, right = winners[2 * node], winners[2 * node + 1]
            ahead = self._ahead(left, right)
            winners[node], self.losers[node] = (left, right) if ahead else (right, left)
        self.winner = winners[1] if lists else 0

    def _ahead(self, one: int, other: int) -> bool:
        """Whether list ``one`` comes before list ``other``; lists that are used up come last."""
        if other >= len(self.lists) or self.at[other] >= len(self.lists[other]):
            return True
        if one >= len(self.lists) or self.at[one] >= len(self.lists[one]):
            return False
        a, b = self.lists[one][self.at[one]], self.lists[other][self.at[other]]
        return a < b or a == b and one < other

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, place) of all entries in order."""
        for _ in range(sum(map(len, self.lists))):
            winner = self.winner
            yield winner, self.at[winner]
            self.at[winner] += 1
            node = (winner + self.size) // 2
            while node:
                if self._ahead(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.winner = winner


def merged(sorted_runs: DataFrame) -> DataFrame:
    """All captures with ``position``, their place in the global order of (URL key, timestamp, page id)."""
    count = sorted_runs.agg(F.sum(F.size("key"))).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, -(-count // RANGE_CAPTURES)))
    step = max(1, count // (ranges * SAMPLE_PER_RANGE))
    keys = sorted_runs.select(F.explode("key").alias("key")).where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0)
    sample = sorted(row.key for row in keys.collect())
    splitters = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys = batch.column("key")[row].as_py()
                ends = [0, *(bisect_left(keys, splitter) for splitter in splitters), len(keys)]
                held = [i for i in range(len(ends) - 1) if ends[i] < ends[i + 1]]
                columns = [
                    pa.array([batch.column(name)[row].values.slice(ends[i], ends[i + 1] - ends[i]).to_pylist() for i in held], pa.list_(kind))
                    for name, kind in zip(FIELDS, KINDS, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *columns], ["range", *FIELDS])

    lists = ", ".join(f"{name} array<{kind}>" for name, kind in zip(FIELDS, TYPES, strict=True))
    segments = settled(sorted_runs.mapInArrow(cut, f"range bigint, {lists}"))
    base, bases = 0, {}
    for row in segments.groupBy("range").agg(F.sum(F.size("key")).alias("n")).orderBy("range").collect():
        bases[row.range] = base
        base += row.n

    def merge(segment: pa.Table) -> pa.Table:
        segment = segment.sort_by([("archive0", "ascending")]).drop_columns("archive0")
        held = {name: segment.column(name).to_pylist() for name in FIELDS}
        order = list(LoserTree(held["key"]))
        columns = {name: pa.array([held[name][run][place] for run, place in order], kind) for name, kind in zip(FIELDS, KINDS, strict=True)}
        first = bases[segment.column("range")[0].as_py()]
        return pa.table({**columns, "position": pa.array(range(first, first + len(order)), pa.int64())})

    schema = ", ".join(f"{name} {kind}" for name, kind in zip(FIELDS, TYPES, strict=True)) + ", position bigint"
    return segments.withColumn("archive0", F.col("archive")[0]).groupBy("range").applyInArrow(merge, schema).drop("key")


def histories(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as archives, read them back, and give every capture in global order."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archives")
    write(pages, folder)
    return merged(settled(runs(spark, folder)))
