"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line goes when an earlier line (of any document; order: doc_id, then place in the text) is
equal to it or, from ``MIN_CHARS`` characters on, within ``EDITS`` = 1 edit of it. The earlier line
counts whether or not it goes itself, so the result does not depend on any order of work.

Method. Two lines are one edit apart exactly if deleting the same position from both leaves
the same text (substitution), or if deleting one position of the longer leaves the shorter
(insertion). So every line emits all variants with at most one deletion as hashed keys, and
equal variants meet. The earliest line of each meeting is found by aggregation, never
by pairing, and the edit distance to it is then verified on the texts.

Lines that cannot have a partner emit nothing: one edit leaves the first or the second half
of the shorter line's length intact at one end, so every line first emits its halves (for its
own length and for that minus one), and only lines that share a half with another go on. Among
them a block of about sqrt(length) characters is taken out first, and only where two lines share
what is left do single deletions in that block follow. Work for a line of length n that goes
on is n * sqrt(n), not its square.

Defined results: lines part at ``\\n``; lines without a word stay and are not counted; null text
stays null and has no lines; rows with equal id and text are one document shown twice and lose
the same lines; rows with equal id and other texts follow each other by a hash of the text; a null
id comes first; an empty table gives an empty result. All columns pass through, but for such as have
the name of an added one (``ADDED``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import settled
from rideledger.llm.columns import apart, back, held
from rideledger.llm.marks import marked

EDITS = 1
MIN_CHARS = 20
ADDED = ("_n_lines", "_n_removed")
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: its document's key, its place, two hashes, its length and itself."""
    lines = docs.select("doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.where(F.col("line").rlike(HAS_WORD)).select(
        "doc_id", "tie", "place", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g"),
        F.char_length("line").alias("n"), "line",
    )


def _halves(lines: DataFrame) -> DataFrame:
    """(end, h): hashes of both ends of every line long enough, as one of a pair whose shorter line has a length."""
    ends = []
    for longer in (0, 1):
        m = f"(n - {longer})"
        ends.append(F.expr(f"xxhash64({m}, 0, left(line, cast({m} div 2 as int)))"))
        ends.append(F.expr(f"xxhash64({m}, 1, right(line, cast({m} - {m} div 2 as int)))"))
    return lines.where(F.col("n") >= MIN_CHARS).select(F.explode(F.array(*ends)).alias("end"), "h")


def _variants(lines: DataFrame) -> DataFrame:
    """(h, g, variant, place): texts with at most one character deleted, hashed.

    ``place`` is the deleted position from 1, and 0 for the line as it is. A variant of length v is
    cut into blocks of ``size``; its key is made of the number and text of a block and the hashes
    of what lies before and after it. Only blocks whose surroundings two lines share emit.
    """
    cut = lines.select("h", "g", "line", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("gone"))
    cut = cut.withColumn("v", F.col("n") - F.col("gone"))
    cut = cut.withColumn("size", F.ceil(F.sqrt("v")).cast("int"))
    blocks = cut.select("*", F.explode(F.expr("sequence(0, cast((v - 1) div size as int))")).alias("block")).select(
        "h", "g", "gone", "block", "size",
        F.expr("xxhash64(v, block, left(line, block * size), substring(line, (block + 1) * size + gone + 1))").alias("around"),
        F.expr("substring(line, block * size + 1, size + gone)").alias("inner"),
    )
    blocks = settled(blocks)
    shared = blocks.groupBy("around").agg(F.count("*").alias("held")).where("held > 1").select("around")
    blocks = blocks.join(shared, "around", "left_semi")
    whole = blocks.where("gone = 0").select("h", "g", F.xxhash64("around", "inner").alias("variant"), F.lit(0).alias("place"))
    deleted = blocks.where("gone = 1").select("*", F.explode(F.expr("sequence(1, length(inner))")).alias("at")).select(
        "h", "g",
        F.expr("xxhash64(around, concat(left(inner, at - 1), substring(inner, at + 1)))").alias("variant"),
        F.expr("block * size + at").alias("place"),
    )
    return whole.unionAll(deleted)


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, place) of every line that goes. ``docs`` hold doc_id, tie (a hash of the text) and text."""
    lines = _lines(docs)
    occurrences = lines.select("doc_id", "tie", "place", "h", "g")
    groups = occurrences.groupBy("h", "g").agg(F.min(F.struct("doc_id", "tie", "place")).alias("first"), F.count("*").alias("times"))
    groups = settled(groups.select("h", "g", "first.*", "times"))
    # Lines that share a half with another line.
    ends = _halves(lines)
    shared = ends.groupBy("end").agg(F.min("h").alias("one"), F.max("h").alias("other")).where("one <> other").select("end")
    hashes = ends.join(shared, "end", "left_semi").select("h").distinct()
    open_ = settled(groups.join(hashes, "h", "left_semi").drop("times"))
    texts = settled(
        marked(docs, open_, ["doc_id", "tie"]).where("_marked").join(open_.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
        .select("h", "g", F.struct("doc_id", "tie", "place").alias("first"), F.element_at(F.split("text", "\n"), F.col("place") + 1).alias("line"))
        .dropDuplicates(["h", "g"])
        .withColumn("n", F.char_length("line"))
    )
    known = texts.select("h", "g", "first")
    variants = settled(_variants(texts).join(known, ["h", "g"]).select("variant", "place", F.struct("first", "h", "g").alias("line")))
    shorter, longer = variants.where("place = 0").withColumnRenamed("line", "short").drop("place"), variants.where("place > 0")
    # Substitution: the earliest line that loses the same place and becomes the same.
    same = longer.groupBy("variant", "place").agg(F.min("line").alias("best"), F.max("line").alias("last")).where("best <> last").drop("last")
    replaced = longer.join(same, ["variant", "place"]).select("line", "best")
    # Insertion: the line that a longer one becomes, and the earliest of the longer ones.
    met = longer.join(shorter, "variant").select("line", "short")
    grown = met.groupBy("short").agg(F.min("line").alias("best")).select(F.col("short").alias("line"), "best")
    candidates = replaced.unionAll(met.select("line", F.col("short").alias("best"))).unionAll(grown)
    candidates = candidates.where("best.first < line.first").select("line.h", "line.g", F.col("best.h").alias("bh"), F.col("best.g").alias("bg")).distinct()
    near = (
        candidates.join(texts.select("h", "g", "line"), ["h", "g"])
        .join(texts.select(F.col("h").alias("bh"), F.col("g").alias("bg"), F.col("line").alias("best")), ["bh", "bg"])
        .where(F.levenshtein("line", "best", EDITS) >= 0)
        .select("h", "g")
        .distinct()
        .withColumn("near", F.lit(True))
    )
    going_on = groups.join(near, ["h", "g"], "left").where("times > 1 or near").select(
        "h", "g", F.struct("doc_id", "tie", "place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")
    )
    going = F.col("near") | ~F.struct("doc_id", "tie", "place").eqNullSafe(F.col("first"))
    return occurrences.join(going_on, ["h", "g"]).where(going).select("doc_id", "tie", "place")


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns, the lines that go taken out of text, and ``_n_lines`` and ``_n_removed``."""
    keyed = apart(docs).withColumns({"id": held(docs, "doc_id").cast("bigint"), "tie": F.xxhash64(held(docs, "text")), "text": held(docs, "text")})
    gone = duplicate_lines(keyed.select(F.col("id").alias("doc_id"), "tie", "text"))
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).agg(F.collect_set("place").alias("gone"))
    cleaned = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("tie") == F.col("gone_tie")), "left")
    lines = F.split("text", "\n")
    going = F.map_from_arrays("gone", "gone")
    kept = F.filter(lines, lambda line, place: ~F.map_contains_key(going, place))
    counted = F.size(F.filter(lines, lambda line: line.rlike(HAS_WORD)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))
    changed = cleaned.withColumn(f"column {docs.columns.index('text')}", text)
    return changed.select(
        *back(docs, ADDED),
        F.when(F.col("text").isNotNull(), counted).otherwise(0).cast("bigint").alias("_n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("_n_removed"),
    )
