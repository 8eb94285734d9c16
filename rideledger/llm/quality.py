"""Quality rules as a short-circuit cascade.

A document is kept when no rule rejects it. On a bounded sample every rule is timed and its
rejections counted; rules are then tried in order of rejections per second, and a document
leaves the cascade at the first rule that rejects it. The verdict does not depend on the
order, so neither the sample nor the clock can change a result.

Defined results: null text has no words; a document that fails the base conditions (fewer than
50 words, or more than half of its words in repeated three-word windows) is not kept and
enters no rule; repeated rows each get a result; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import ship
from rideledger.llm.words import words

SAMPLE = 2000
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Measures:
    """What the rules look at, each measured when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        windows = list(zip(self.words, self.words[1:], self.words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        found = Counter(windows)
        covered, until = 0, 0
        for start, window in enumerate(windows):
            if found[window] > 1:
                covered += start + 3 - max(start, until)
                until = start + 3
        return covered

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def _odd_word_length(doc: Measures) -> bool:
    return not 3 * doc.n_words <= doc.word_chars <= 10 * doc.n_words


def _many_symbols(doc: Measures) -> bool:
    return 10 * doc.n_symbols > doc.n_words


def _repeated_lines(doc: Measures) -> bool:
    return 2 * doc.n_dup_lines > len(doc.lines)


def _shouting(doc: Measures) -> bool:
    return 2 * sum(map(bytes.isupper, doc.words)) > doc.n_words


def _few_letters(doc: Measures) -> bool:
    return 10 * sum(1 for word in doc.words if _LETTER.search(word)) < 7 * doc.n_words


def _one_word(doc: Measures) -> bool:
    return 10 * Counter(doc.words).most_common(1)[0][1] > 3 * doc.n_words


def _cut_lines(doc: Measures) -> bool:
    return 10 * sum(line.rstrip(WHITE).endswith(("...", "…")) for line in doc.lines) > 3 * len(doc.lines)


#: Each rule says whether it rejects a document that has words.
RULES: dict[str, Callable[[Measures], bool]] = {
    "odd_word_length": _odd_word_length,
    "many_symbols": _many_symbols,
    "repeated_lines": _repeated_lines,
    "shouting": _shouting,
    "few_letters": _few_letters,
    "one_word": _one_word,
    "cut_lines": _cut_lines,
}


def estimated(docs: DataFrame, rules: dict[str, Callable[[Measures], bool]] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share that it rejects and those before it don't) on a sample, in the order of the cascade.

    A rule costs what it takes beside the contract's measures, which every document gets. Next comes the rule
    with the most rejections per second among the documents that are still there.
    """
    ship(docs.sparkSession)
    step = max(1, docs.count() // SAMPLE)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, costs = [], []
            for text in batch.column(0).to_pylist():
                read = Measures(text)
                if read.base_failed:
                    continue
                read.word_chars, read.n_symbols, read.n_dup_lines  # noqa: B018  judged has them anyway
                mask, seconds = 0, []
                for place, rejects in enumerate(rules.values()):
                    doc = copy(read)
                    began = time.perf_counter()
                    mask |= bool(rejects(doc)) << place
                    seconds.append(time.perf_counter() - began)
                masks.append(mask)
                costs.append(seconds)
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(costs, pa.list_(pa.float64()))], ["mask", "seconds"])

    key = ["doc_id", "text"] if "doc_id" in docs.columns else ["text"]  # copies of a text are not all taken or all left
    sample = docs.where(F.pmod(F.xxhash64(*key), F.lit(step)) == 0).select("text")
    told = sample.mapInArrow(timed, "mask bigint, seconds array<double>")
    held = told.groupBy("mask").agg(F.count("*").alias("n"), *[F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(len(rules))]).collect()
    count = max(1, sum(row.n for row in held))
    cost = {name: max(sum(row[f"s{i}"] for row in held) / count, 1e-9) for i, name in enumerate(rules)}
    places = {name: i for i, name in enumerate(rules)}
    order: list[tuple[str, float, float]] = []
    while places:
        gain = {name: sum(row.n for row in held if row.mask >> i & 1) / count for name, i in places.items()}
        best = max(places, key=lambda name: gain[name] / cost[name])
        order.append((best, cost[best], gain[best]))
        bit = places.pop(best)
        held = [row for row in held if not row.mask >> bit & 1]
    return order


def judged(docs: DataFrame, rules: dict[str, Callable[[Measures], bool]] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every row."""
    ship(docs.sparkSession)
    order = [name for name, *_ in estimated(docs, rules)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [rules[name] for name in order]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in [*names, "base_failed", "kept"]}
            for text in batch.column(1).to_pylist():
                doc = Measures(text)
                for name in names:
                    columns[name].append(getattr(doc, name))
                columns["base_failed"].append(doc.base_failed)
                columns["kept"].append(not doc.base_failed and not any(rejects(doc) for rejects in cascade))
            kinds = [*[pa.int64()] * len(names), pa.bool_(), pa.bool_()]
            arrays = [pa.array(values, kind) for values, kind in zip(columns.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        judge,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean",
    )
