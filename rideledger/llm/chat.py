"""Chat formatting: layouts found by schema fingerprints, turns marked by a reversible template.

A record (JSON) is fingerprinted by its nested field paths: they are listed (``messages[].role``),
sorted and hashed, and the hash selects one of the declared ``LAYOUTS``. Its mapping turns the
record into canonical turns of role and text. A new layout is a new declaration, not new code.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` for every turn (without the spaces). Inside roles and
texts a backslash doubles and ``<|`` becomes ``<\\|``, so no control string can arise from a text and
reading back restores it exactly; a line break inside a role becomes ``\\n`` spelled out. The
loss mask covers the texts of assistant turns and nothing else.

A conversation is a sequence of formatted turns in order. It is written and read turn by turn
in sorted partitions, so no task holds a whole conversation, however long it is.

Fields that only describe a record (``METADATA``) are left out of its fingerprint.

Defined results: null role and null text count as empty (a missing field is another
fingerprint, which is declared); a record that no layout matches has no turns and is one row of
``unmatched``, with its fingerprint, or without one if it is null, no JSON, no object or nested beyond what the
reader takes. Halves of surrogate pairs, which JSON can spell and UTF-8
cannot, become U+FFFD. A very long conversation is read by one task, which holds one batch of it. Equal turn numbers are ordered by the formatted turn, null numbers come last;
repeated rows are repeated turns; a null conversation id is one conversation; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import ship

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Paths of fields that describe a record and say nothing.
METADATA = {
    "id", "model", "source", "lang", "created", "timestamp", "metadata", "messages[].id", "messages[].name", "messages[].weight", "conversations[].weight",
}


class Layout(NamedTuple):
    name: str
    #: Leaf paths that are always there, and those that may be.
    paths: tuple[str, ...]
    optional: tuple[str, ...]
    #: One turn for each (role, fields): the fields that are there, joined by a blank line.
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: Or a list of turns: its field, and the fields of role and text in an entry.
    listed: tuple[str, str, str] | None = None
    #: Whether roles are renamed to the canonical ones.
    renamed: bool = True


LAYOUTS = (
    Layout("turn", (), ("role", "text"), listed=("", "role", "text"), renamed=False),
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), (("system", ("system",)),), ("messages", "role", "content")),
    Layout("parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), (), (), ("messages", "role", "content")),
    Layout(
        "some_parts",
        ("messages[].role", "messages[].content", "messages[].content[].type", "messages[].content[].text"),
        (),
        (),
        ("messages", "role", "content"),
    ),
    Layout("shared", ("conversations[].from", "conversations[].value"), ("system",), (("system", ("system",)),), ("conversations", "from", "value")),
    Layout("completion", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(
        "instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))
    ),
    Layout("question", ("question", "answer"), ("context",), (("user", ("context", "question")), ("assistant", ("answer",)))),
)


def paths(value: object, prefix: str = "") -> set[str]:
    """Paths of all leaves of a record; entries of lists share ``[]``."""
    if isinstance(value, dict):
        return {path for key, inner in value.items() for path in paths(inner, f"{prefix}.{key}" if prefix else key)}
    if isinstance(value, list):
        return {path for inner in value for path in paths(inner, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def fingerprint(found: set[str] | tuple[str, ...]) -> str:
    """Hash of a set of field paths, those of metadata left out."""
    told = sorted(path for path in found if path not in METADATA and not path.startswith(("metadata.", "metadata[]")))
    return hashlib.blake2b("\n".join(told).encode(errors="surrogatepass"), digest_size=8).hexdigest()


def declared(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Every fingerprint a layout can have, with and without its optional fields."""
    return {
        fingerprint({*layout.paths, *some}): layout
        for layout in layouts
        for count in range(len(layout.optional) + 1)
        for some in combinations(layout.optional, count)
    }


def _text(value: object) -> str:
    if isinstance(value, list):
        return "".join(_text(part.get("text")) for part in value)
    text = "" if value is None else str(value)
    try:
        text.encode()
    except UnicodeEncodeError:  # a surrogate without its other half
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def parsed(record: str | None) -> tuple[object, str | None]:
    """The object a record spells and its fingerprint; both None if it spells none."""
    try:
        value = json.loads(record) if record is not None else None
        return (value, fingerprint(paths(value))) if isinstance(value, dict) else (None, None)
    except (ValueError, RecursionError):
        return None, None


def turns(record: object, known: dict[str, Layout], told: str | None = None) -> tuple[str | None, list[tuple[str, str]]]:
    """Name of the layout and canonical turns of a record, whose fingerprint may be given."""
    layout = known.get(told or fingerprint(paths(record))) if isinstance(record, dict) else None
    if layout is None:
        return None, []
    found = []
    for role, fields in layout.turns:
        held = [_text(record[field]) for field in fields if field in record]
        if held:
            found.append((role, "\n\n".join(held)))
    if layout.listed:
        field, role, text = layout.listed
        for entry in record[field] if field else [record]:
            name = _text(entry.get(role))
            found.append((ROLES.get(name, name) if layout.renamed else name, _text(entry.get(text))))
    return layout.name, found


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda match: "\n" if match[1] == "n" else match[1], text, flags=re.DOTALL)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where the loss mask begins and ends in it (nowhere: both 0)."""
    head = f"{START}{escaped(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escaped(text)
    mask = (len(head), len(head) + len(body)) if role == LEARNED_ROLE else (0, 0)
    return f"{head}{body}{END}\n", *mask


def read_back(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (turn.startswith(START) and turn.endswith(f"{END}\n") and turn.count("<|") == 2):
        raise ValueError("not a formatted turn")
    role, _, body = turn[len(START) : -len(END) - 1].partition("\n")
    return unescaped(role), unescaped(body)


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Formatted turns of (conv_id, turn, record): conv_id, turn, place in the record, layout, formatted, mask."""
    return _converted(records, layouts).where("layout is not null").drop("fingerprint")


def unmatched(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records that no layout matches, to be declared or mended: conv_id, turn, fingerprint."""
    return _converted(records, layouts).where("layout is null").select("conv_id", "turn", "fingerprint")


def _converted(records: DataFrame, layouts: tuple[Layout, ...]) -> DataFrame:
    ship(records.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = declared(layouts)
        for batch in batches:
            rows, prints, places, names, texts, begins, ends = columns = [], [], [], [], [], [], []
            for row, record in enumerate(batch.column("record").to_pylist()):
                value, told = parsed(record)
                name, found = turns(value, known, told)
                lines = [(place, name, *formatted(role, text)) for place, (role, text) in enumerate(found)]
                for line in lines or [(None,) * 5]:
                    for column, held in zip(columns, (row, told, *line), strict=True):
                        column.append(held)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id").take(at), batch.column("turn").take(at), pa.array(prints, pa.string()), pa.array(places, pa.int64()), pa.array(names, pa.string()),
                    pa.array(texts, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()),
                ],
                ["conv_id", "turn", "fingerprint", "place", "layout", "formatted", "mask_begin", "mask_end"],
            )

    rows = records.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "record")
    return rows.mapInArrow(
        convert, "conv_id bigint, turn bigint, fingerprint string, place bigint, layout string, formatted string, mask_begin bigint, mask_end bigint"
    )


def in_order(formatted_turns: DataFrame) -> DataFrame:
    """Turns dealt by conversation and sorted within partitions: the conversations as they are written."""
    return formatted_turns.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_last("turn"), "place", "formatted"
    )


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns = self.loss_chars = self.chars = 0
        self.read, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turn: str, begin: int, end: int) -> None:
        role, text = read_back(turn)
        masked = unescaped(turn[begin:end])
        self.turns += 1
        self.chars += len(turn)
        self.loss_chars += len(masked)
        self.read.update(f"{role}\n{text}\n".encode())
        self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.read.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted_turns: DataFrame) -> DataFrame:
    """What reading the formatted conversations gives, one row per conversation."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def told(done: list[_Digest]) -> pa.RecordBatch:
            columns = list(zip(*[one.row() for one in done], strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names)

        now: _Digest | None = None
        for batch in batches:
            done = []
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "formatted", "mask_begin", "mask_end")]
            for conv_id, turn, begin, end in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now)
                    now = _Digest(conv_id)
                now.add(turn, begin, end)
            yield told(done)
        if now is not None:
            yield told([now])

    return in_order(formatted_turns).mapInArrow(
        read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def records_of_rows(conversations: DataFrame) -> DataFrame:
    """Records of a table with one row per turn; null fields are left out of a record."""
    return conversations.select("conv_id", "turn", F.to_json(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))).alias("record"))
