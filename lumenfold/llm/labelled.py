"""A bounded sample of labelled documents, and the folds that contracts hold out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves that remainder; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, most: int) -> list[Row]:
    """(doc_id, text, label 0/1) of at most `most` labelled rows of a fold, those whose doc_ids hash lowest.

    Rows with a null doc_id or label are left out; several labels of a doc_id are averaged, ties count as 1. Of several
    documents with one doc_id the one whose text hashes lowest is taken, before anything is collected.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & fold)
    own = known.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # `most` rows of two numbers.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), (F.max("label") >= 0.5).cast("int").alias("label"))
    return sorted(one.toLocalIterator(), key=lambda r: r["doc_id"])
