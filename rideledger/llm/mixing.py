"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources by code point (null last) weigh 1, 2, 3, 1, 2, 3 and so on and share the words of all
documents; a source's target stops at ``EPOCHS`` times its size, and what that frees goes to
the others by weight until none is above.

Schedule: a slot for every ``block`` words of the mix. Slot i takes the golden-ratio point
``i * 2654435769 mod 2^32`` through the cumulative targets to a source, so that every stretch
of the schedule is mixed alike; its rank among the slots of its source says which block it plays.
The blocks of a source are equal parts of its target, of about ``block`` words, so it gets its target
(rounded to words) at every size; a source that no point meets plays its target in one slot, chosen by hash.
Blocks lie one behind the other in the source's documents in shuffled order, which begin
anew with every epoch. Blocks and documents are joined on (source, cell of ``block`` words).

Work at scale: positions within a source are prefix sums in two steps, over ranges of the
shuffle hash and within a range, and ranks of slots likewise over stretches of the schedule, so no
task orders a whole source. Only the table of sources (one row each) is ordered in one task.

Defined results: null text has no words and is never taken; a null source is a source of its
own, the last; rows that repeat id and text lie next to each other and are told apart arbitrarily
(the multiset of results is the same on every run); an empty table or one without words gives rows
with nothing taken. All columns pass through ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rideledger.llm.cluster import settled
from rideledger.llm.columns import apart, back, held
from rideledger.llm.words import WORD, word_count

EPOCHS = 3
SLOTS = 1 << 18
MOST_BLOCK = 1 << 20
GOLDEN = 2_654_435_769
STRETCH = 1 << 14
RANGE_BITS = 14
CELL = 1 << 20
SEED = "mix"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Filling up level by level: sources in order of limit per weight, the first ones at their limit as
    long as an equal share of the rest per weight would exceed it.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    limit = F.col("source_size") * float(EPOCHS)
    rising = Window.orderBy(limit / F.col("weight"), F.asc_nulls_last("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    behind = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    levels = weighed.withColumns({"limit": limit, "level": level, "place": F.row_number().over(rising)})
    # The level holds from the first source on that it doesn't lift above its limit.
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))).over(all_)["level"]
    return levels.select("source", "source_size", F.least("limit", F.coalesce(final, F.lit(0.0)) * F.col("weight")).alias("target"))


def _placed(docs: DataFrame) -> DataFrame:
    """Documents with words: how many words of their source lie before them in its shuffled order."""
    shuffled = F.xxhash64(F.lit(SEED), "doc_id", "tie")
    keyed = docs.where("size > 0").withColumn("shuffled", shuffled).withColumn("range", F.shiftright("shuffled", 64 - RANGE_BITS))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("shuffled", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))
    return placed.join(sums, same).withColumn("begin", F.col("base") + F.col("inner")).drop("_source", "_range", "base", "inner", "range", "shuffled")


def schedule(goals: DataFrame, total: int, block: int) -> DataFrame:
    """What every slot of the mix plays: (slot, source, block, epoch, first, last, source_size).

    ``block`` counts the blocks of a source over all epochs, ``epoch`` is the one it begins in, and its words
    are those from ``first`` up to ``last`` of the source's documents, read as often as needed.
    """
    whole = 1 << 32
    slots = -(-total // block)
    ordered = Window.orderBy(F.asc_nulls_last("source"))
    mark = F.floor(F.sum("target").over(ordered) / F.sum("target").over(Window.partitionBy()) * float(whole))
    goal = F.round("target").cast("bigint")
    arcs = goals.where("target > 0").withColumns({"high": mark, "goal": goal}).withColumns(
        {
            "low": F.coalesce(F.lag("high").over(ordered), F.lit(0)),
            "high": F.when(F.lead("high").over(ordered).isNull(), F.lit(whole)).otherwise(F.col("high")),
        }
    )
    # Points meet arcs by equal cells of the circle; an arc lies in each cell it touches.
    cells = arcs.where("low < high").select(
        "source", "source_size", "goal", "low", "high", F.explode(F.expr(f"sequence(low div {CELL}, (high - 1) div {CELL})")).alias("cell")
    )
    points = goals.sparkSession.range(slots).select(
        F.col("id").alias("slot"), F.expr(f"id div {STRETCH}").alias("stretch"), F.expr(f"(id % {whole}) * {GOLDEN} % {whole}").alias("point")
    )
    drawn = points.withColumn("cell", F.expr(f"point div {CELL}")).join(cells, "cell").where("low <= point and point < high")
    drawn = drawn.select("slot", "stretch", "source", "source_size", "goal")
    counts = drawn.groupBy("stretch", "source").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    blocks = F.sum("n").over(Window.partitionBy("source"))
    counts = counts.select(F.col("stretch").alias("_stretch"), F.col("source").alias("_source"), base.alias("base"), blocks.alias("blocks"))
    inner = F.row_number().over(Window.partitionBy("stretch", "source").orderBy("slot")) - 1
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("stretch") == F.col("_stretch"))
    ranked = drawn.withColumn("inner", inner).join(counts, same).select(
        "slot", "source", (F.col("base") + F.col("inner")).alias("block"), "blocks", "source_size", "goal"
    )
    # Sources of less than a block can lie between all points.
    missed = arcs.join(counts.select("_source").distinct(), F.col("source").eqNullSafe(F.col("_source")), "left_anti").select(
        F.pmod(F.xxhash64(F.lit(SEED), "source"), F.lit(slots)).alias("slot"), "source",
        F.lit(0).cast("bigint").alias("block"), F.lit(1).cast("bigint").alias("blocks"), "source_size", "goal",
    )
    # floor(block * goal / blocks), without the large product
    first = F.expr("block * (goal div blocks) + block * (goal % blocks) div blocks")
    last = F.expr("(block + 1) * (goal div blocks) + (block + 1) * (goal % blocks) div blocks")
    played = ranked.unionAll(missed).withColumns({"first": first, "last": last}).where("first < last")
    return played.select("slot", "source", "block", F.expr("first div source_size").alias("epoch"), "first", "last", "source_size")


def _measured(docs: DataFrame) -> DataFrame:
    return settled(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "source", word_count(F.col("text")).alias("size"))
    )


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sizes; sources with their targets; and the parts that the mix plays.

    A part is what one slot takes of one document: slot, epoch, source, doc_id, tie, size, begin
    (which tells repeated rows apart), first word and number of words.
    """
    rows = _measured(docs)
    sizes = settled(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = targets(sizes)
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, min(MOST_BLOCK, -(-total // SLOTS)))
    cut = _placed(rows).withColumn("cell", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    turns = schedule(goals, total, block).select(
        "slot", F.col("source").alias("_source"), "first", "last", "source_size",
        F.explode(F.expr("sequence(first div source_size, (last - 1) div source_size)")).alias("epoch"),
    )
    # Words of the source, from 0 in every epoch.
    start = F.col("epoch") * F.col("source_size")
    turns = turns.select(
        "slot", "_source", "epoch", F.greatest(F.lit(0), F.col("first") - start).alias("from"), F.least("source_size", F.col("last") - start).alias("to")
    )
    turns = turns.withColumn("_cell", F.explode(F.expr(f"sequence(`from` div {block}, (`to` - 1) div {block})")))
    parts = cut.join(turns, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell")))
    first = F.greatest(F.lit(0), F.col("cell") * block - F.col("begin"), F.col("from") - F.col("begin"))
    last = F.least(F.col("size"), (F.col("cell") + 1) * block - F.col("begin"), F.col("to") - F.col("begin"))
    parts = parts.where(first < last)
    parts = parts.select("slot", "epoch", "source", "doc_id", "tie", "size", "begin", first.alias("first"), (last - first).alias("n"))
    return rows, goals, parts


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words the mix takes of each row, repeats counted."""
    rows, goals, parts = mix(docs)
    sums = parts.groupBy("source", "begin", "doc_id", "tie").agg(F.sum("n").alias("n"))
    # Rows that repeat id, text and source are alike: the largest share goes to the first.
    held = sums.groupBy("doc_id", "tie", "source").agg(F.sort_array(F.collect_list("n"), asc=False).alias("each"))
    number = F.row_number().over(Window.partitionBy("doc_id", "tie", "source").orderBy("doc_id")) - 1
    rows = rows.withColumn("number", number).alias("r").join(
        held.alias("h"),
        F.expr("r.doc_id <=> h.doc_id and r.tie <=> h.tie and r.source <=> h.source"),
        "left",
    )
    rows = rows.select("r.doc_id", "r.source", "r.size", F.coalesce(F.expr("get(h.each, r.number)"), F.lit(0)).cast("bigint").alias("taken"))
    rows = rows.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "taken")


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns: a row for every epoch that plays a document.

    A document of which an epoch plays only a part (at most one for a source and epoch, where the
    target is reached) is cut to those words, joined by spaces.
    """
    _, _, parts = mix(docs)
    plays = parts.groupBy("source", "begin", "doc_id", "tie", "size", "epoch").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    plays = plays.groupBy("doc_id", "tie", "source", "size", "epoch").agg(F.collect_list(F.struct("first", "n")).alias("plays"))
    number = F.row_number().over(Window.partitionBy("id", "tie", "of").orderBy("id")) - 1
    keyed = apart(docs).withColumns({"id": held(docs, "doc_id").cast("bigint"), "of": held(docs, "source"), "text": held(docs, "text")})
    keyed = keyed.withColumn("tie", F.xxhash64("text")).withColumn("number", number)
    plays = plays.select(F.col("doc_id").alias("play_id"), F.col("source").alias("play_of"), F.col("tie").alias("play_tie"), "size", "epoch", "plays")
    same = F.col("id").eqNullSafe(F.col("play_id")) & (F.col("tie") == F.col("play_tie")) & F.col("of").eqNullSafe(F.col("play_of"))
    met = keyed.join(plays, same).withColumn("play", F.expr("get(plays, cast(number as int))")).where("play is not null")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("play.first").cast("int") + 1, F.col("play.n").cast("int")), " ")
    met = met.withColumn("text", F.when(F.col("play.n") == F.col("size"), F.col("text")).otherwise(part))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    places = [f"column {place}" for place, name in enumerate(docs.columns) if name in changed]
    met = met.withColumns({place: changed[docs.columns[int(place.split()[1])]] for place in places})
    return met.select(*back(docs))
