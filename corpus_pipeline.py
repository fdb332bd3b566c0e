"""From raw documents to packed sequences: toxicity, line dedup, n-gram Jaccard join, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns
documents (doc_id, text, lang, source, n_chars) or, the last, the places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import read_table, stash
from tickloom.llm.jaccard_join import jaccard_components
from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.packing import best_fit_pack, with_lengths
from tickloom.llm.toxicity import score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.7; the model learns from the labels outside the held-out fold."""
    docs = docs.select(*COLUMNS)
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, out="_score").where(F.col("_score") < REJECT).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the text that line dedup keeps, and that text's length; a null text becomes empty."""
    out = dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles at 0.8 hold together, the document of least id.

    Documents without a word stay. Rows equal in id and text are one document. Rows of a null id
    stay if no document with an id is in their group.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard_components(docs, words=5, percent=80)
    stay = found.where(F.col("component_id").eqNullSafe(F.col("doc_id")) | (F.col("n_shingles") == 0)).select(F.col("doc_id").alias("_stay")).distinct()
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang")
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay")), "left_semi")
    return kept.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return best_fit_pack(with_lengths(docs))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_copies), ("best_fit_packing", pack)]

#: SQL expresses neither the classifier nor the order of the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
