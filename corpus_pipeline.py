"""Documents to packed training sequences: toxicity, quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's
docs. All but the last return the columns of documents, and other columns that docs may have, whatever their names.

Edge cases, of every stage: a null text counts as empty, and an empty text is neither toxic nor bad, has no lines to lose and
no near duplicates; a null doc_id stays a row of its own; rows that repeat are judged alike, so all of them stay or go,
but their lines and packed pieces are theirs; a text may have any length; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumage.llm import common, line_dedup, minhash, packing, quality, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject by the threshold of their language."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly taught scorer keeps."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those that have lost every line go."""
    cut, lost = line_dedup.dedup_lines(docs, ("_n_lines", "_n_removed")), F.col("_n_removed") > 0
    cut = cut.where(~(lost & (F.trim("text") == "")))
    return cut.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five words, a similarity of 0.8."""
    found = minhash.near_duplicates(docs, k=5, similarity_percent=80)
    gone = common.materialize(found.where("not kept").select("doc_id").distinct())
    side = F.broadcast(gone) if common.is_small(gone, minhash.BROADCAST_ROWS) else gone
    return docs.join(side, "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, packing.read_json())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Classifiers and tokenizers have no SQL form; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
