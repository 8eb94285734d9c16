"""Licence scan by ordered signature rules, in DataFrame functions only.

A text is read as words (A-Z lowered; ASCII letters and digits and everything beyond ASCII) parted by
single spaces. Texts without any gate word are done. For the others, the rules whose keyword
stands in the text are tried: every place where a rule's pattern matches whole words is a
detection with first and last word, priority and label. Of two detections of which one lies within the other, the
one of lower priority number stays, whichever is the longer, so a title silences the general phrase around it and
the general title inside it; of equal priorities the longer stays, then the earlier.

Besides, all places of three base phrases are counted. Their labels stay in any case.

Everything happens within a row: no shuffle, nothing grows with the table.

Defined results: null text counts as empty; without words or detections the labels are empty, the
score 0 and the word places null; repeated rows each get a result; an empty table gives an
empty result. All columns pass through, but for such as have the name of an added one (``ADDED``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.llm.columns import apart, back, held
from rideledger.llm.license_rules import BASE, GATES, Rule, rules

#: What parts words: ASCII without letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\x01"
ADDED = ("_n_words", "_base", "_found", "_swept")
SPAN = "array<struct<start:int,end:int,priority:double,label:string>>"


def _word_text(text: Column) -> Column:
    """The words, each with a space before it, and a space at the end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """First and last-but-one word of every match of a pattern: (start, end) with end behind it.

    Matches are marked by a word of their own that no text can hold, and counted off.
    """
    whole = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    marked = F.split(F.regexp_replace(words, whole, F.lit(f" {MARK}$0")), " ")
    lengths = F.transform(F.regexp_extract_all(words, whole, F.lit(0)), _spaces)
    at = F.filter(F.transform(marked, lambda word, i: F.when(word == MARK, i)), lambda i: i.isNotNull())
    return F.transform(at, lambda i, k: F.struct((i - 1 - k).alias("start"), (i - 1 - k + F.get(lengths, k)).alias("end")))


def _detected(words: Column, table: list[Rule]) -> Column:
    """Detections of all rules whose keyword stands in the text, in order of the sweep."""
    known = F.from_json(
        F.lit(json.dumps([rule._asdict() for rule in table])), "array<struct<priority:double,label:string,keyword:string,pattern:string>>"
    )
    tried = F.filter(known, lambda rule: words.contains(rule["keyword"]))
    found = F.flatten(
        F.transform(
            tried,
            lambda rule: F.transform(
                _places(words, rule["pattern"]),
                # the negative end puts the longest of equal starts first
                lambda place: F.struct(place["start"].alias("start"), (-place["end"]).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label")),
            ),
        )
    )
    return F.transform(
        F.sort_array(found), lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["priority"].alias("priority"), x["label"].alias("label"))
    )


def _left(run: Column) -> Column:
    """Detections of a run that no better one lies in or around; better is a lower priority, then the longer, then the earlier one."""

    def rank(one: Column) -> Column:
        return F.struct(one["priority"], one["start"] - one["end"], one["start"], one["label"])

    def within(one: Column, other: Column) -> Column:
        return (one["start"] >= other["start"]) & (one["end"] <= other["end"])

    return F.filter(run, lambda one: ~F.exists(run, lambda other: (rank(other) < rank(one)) & (within(one, other) | within(other, one))))


def _covered(run: Column) -> Column:
    """Words that detections in order of their first words cover."""
    state = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("covered"))
    return F.aggregate(
        run,
        state,
        lambda s, one: F.struct(
            F.greatest(s["reach"], one["end"]).alias("reach"),
            (s["covered"] + F.greatest(F.lit(0), one["end"] - F.greatest(one["start"], s["reach"]))).alias("covered"),
        ),
        lambda s: s["covered"],
    )


def _swept(found: Column) -> Column:
    """Labels of the detections that are not suppressed, and how many words they cover.

    Detections are read by first word. A run of overlapping ones is resolved when the next one begins behind it.
    """
    nothing = F.struct(F.lit(0).alias("reach"), F.array().cast(SPAN).alias("run"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("covered"))

    def closed(state: Column) -> tuple[Column, Column]:
        left = _left(state["run"])
        return F.array_union(state["labels"], F.transform(left, lambda one: one["label"])), state["covered"] + _covered(left)

    def sweep(state: Column, one: Column) -> Column:
        labels, covered = closed(state)
        behind = F.struct(one["end"].alias("reach"), F.array(one).alias("run"), labels.alias("labels"), covered.alias("covered"))
        joined = F.struct(
            F.greatest(state["reach"], one["end"]).alias("reach"), F.array_append(state["run"], one).alias("run"), state["labels"].alias("labels"), state["covered"].alias("covered")
        )
        return F.when(one["start"] >= state["reach"], behind).otherwise(joined)

    def done(state: Column) -> Column:
        labels, covered = closed(state)
        return F.struct(labels.alias("labels"), covered.alias("covered"))

    return F.aggregate(found, nothing, sweep, done)


def scanned(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """All columns with ``_n_words``, ``_base`` (places of the base phrases), ``_found`` (every detection) and ``_swept``."""
    table = rules() if table is None else table
    words = F.col("words")
    gated = F.lit(False)
    for gate in GATES:
        gated = gated | words.contains(gate)
    base = F.from_json(
        F.lit(json.dumps([{"priority": 0, "label": label, "keyword": phrase, "pattern": phrase} for phrase, label in BASE.items()])),
        "array<struct<priority:double,label:string,keyword:string,pattern:string>>",
    )
    places = F.flatten(
        F.transform(
            F.filter(base, lambda rule: words.contains(rule["keyword"])),
            lambda rule: F.transform(_places(words, rule["pattern"]), lambda place: F.struct(place["start"].alias("start"), rule["label"].alias("label"))),
        )
    )
    read = apart(docs).withColumn("words", _word_text(held(docs, "text"))).withColumns(
        {
            "_n_words": F.when(words == "  ", 0).otherwise(_spaces(words) - 1),
            "_base": F.when(words.contains(" license"), places).otherwise(F.array().cast("array<struct<start:int,label:string>>")),
            "_found": F.when(gated, _detected(words, table)).otherwise(F.array().cast(SPAN)),
        }
    )
    return read.withColumn("_swept", _swept(F.col("_found"))).select(*back(docs, ADDED), *ADDED)


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base phrases' places and labels, all labels, and the share of words detections cover."""
    seen = scanned(docs.select("doc_id", "text"))
    starts = F.transform("_base", lambda place: place["start"])
    own = F.transform("_base", lambda place: place["label"])
    return seen.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("_n_words").cast("bigint").alias("n_words"),
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.col("_swept.labels"))), ",").alias("labels"),
        F.coalesce(F.try_divide(F.col("_swept.covered").cast("double"), F.col("_n_words").cast("double")), F.lit(0.0)).alias("score"),
    )
