"""From raw documents to packed sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has written, and returns a DataFrame. All but
the last return the columns of documents. A null text passes every filter and is packed as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import op1_packing, op2_toxicity, op3_line_dedup, op8_decontamination, op10_near_dedup, tokens
from lumenfold.session import cut, discard, read_table, shared_path

#: A table of decisions is broadcast up to this many rows, counted before; beyond it the join is by key.
BROADCAST_ROWS = 1_000_000
#: Similarity, in hundredths, from which the near-duplicate stage links; op10's query has its own.
NEAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier takes for toxic."""
    scored = op2_toxicity.score_toxicity(docs, read_table(spark, sf_dir, "labels"), whole=True)
    return scored.where("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier document, or the same one earlier, has; drops texts of which nothing is left."""
    cleaned = op3_line_dedup.remove_repeated(docs, names=("__lf_lines", "__lf_exact", "__lf_near"), every=True)
    emptied = (F.size("__lf_exact") + F.size("__lf_near") > 0) & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return cleaned.where(~emptied).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    kept = op10_near_dedup.near_duplicates(docs, least=NEAR)
    gone = cut(kept.where(~F.col("kept")).select(F.col("doc_id").alias("__lf_doc")).distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(few, F.col("doc_id") == F.col("__lf_doc"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth or more."""
    found = op8_decontamination.find_benchmark(docs, read_table(spark, sf_dir, "benchmark"), whole=True)
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.where(~contaminated).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 ids."""
    # The small table: other stages leave their executors little memory.
    return op1_packing.digest(op1_packing.pack_documents(docs, table=tokens.PIECES))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the classifier or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet to the shared folder and read again.

    What a stage has written goes when the next one's is there; only the last one's, which the result reads, stays.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
