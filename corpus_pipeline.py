"""From documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and gives documents to the next one; the last gives
pieces of packed sequences. Each stage works on all that its predecessor kept:

1. language_id: documents in no language (no letter, or no label that holds half of their
   words) go. The model is learned from the labelled documents among those given.
2. line_dedup: lines that stand in an earlier document or place, but for one edit, are cut out;
   a document that loses all its lines goes.
3. jaccard_join: of every group of near copies the document of least id stays.
4. source_mixing: documents are repeated or left out so that sources meet their targets.
5. retrieval_packing: documents are packed into windows with lexically near ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm import jaccard_join, language, line_dedup, mixing, packing
from rideledger.llm.cluster import new_folder
from rideledger.llm.queries import table, tokenizer_path

LEAST_SCORE = 0.5
#: Mixing draws on random order and a language model on training, which SQL cannot state.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = language.predicted(docs, language.learned(docs))
    kept = (F.col("_pred") != language.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)
    return told.where(kept).drop("_pred", "_score")


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicated(docs)
    emptied = (F.col("_n_lines") > 0) & (F.col("_n_lines") == F.col("_n_removed"))
    measured = cleaned.where(~emptied).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return measured.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", deduplicate_lines),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("retrieval_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what lies between them is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
