"""Token files: every text's ids, Simple-8b coded, in ascending order of doc_id.

Texts are dealt by range of doc_id, encoded where they lie, and written as images of at most SEGMENT ids
(simple8b.py has the format) into a table of (part, segment, before, n_ids, n_docs, image) in a folder that all
executors share. A part is a range of doc_ids, so parts and segments in order are the corpus in order; `before` counts
the ids ahead of an image in its part, so a reader needs one more number a part to place an image, and images are
never moved. Rows of one doc_id, however many, are split over parts by a further key.

Nulls: a null text is an empty one, which is its end id alone; null doc_ids come first. Equal doc_ids stay beside
each other in no set order. A text longer than a segment is an image of its own, whole. An empty table makes no image.
Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import read_table, shared_path, ship

SEGMENT = 1_000_000
END_ID = 0
#: Entries of the encoder's table of pieces: some 170 MB, and a fifth less time than with half as many.
PIECES = 800_000
#: Bytes of text for a part at most, by the size that the plan gives; more parts than shuffle partitions where needed.
PART_BYTES = 128_000_000
IMAGES = "part long, segment long, before long, n_ids long, n_docs long, image binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _writer(path: str | None, segment: int, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenfold.llm.simple8b import write_image
        from lumenfold.llm.tokens import encoder

        own = encoder(path or tokenizer_path(), PIECES)
        end = np.array([end_id], "<u4").tobytes()
        part, number, before, docs, texts, n = 0, 0, 0, [], [], 0

        def image() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in texts], np.int64)
            ids = np.frombuffer(b"".join(texts), "<u4")
            row = [[part], [number], [before], [len(ids)], [len(docs)], [write_image(docs, lengths, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64()] * 5 + [pa.binary()], strict=True)], ["part", "segment", "before", "n_ids", "n_docs", "image"])

        for batch in batches:
            parts, names = batch.column(0), batch.column(1)
            for i, text in enumerate(batch.column(2)):
                coded = own.encode(text.as_py()) + end
                if docs and n + len(coded) // 4 > segment:
                    yield image()
                    number, before, docs, texts, n = number + 1, before + n, [], [], 0
                part = parts[i].as_py()
                docs.append(names[i].as_py())
                texts.append(coded)
                n += len(coded) // 4
        if docs:
            yield image()

    return write


def spread(df: DataFrame, parts: int | None = None) -> int:
    """Tasks to deal rows to: the session's shuffle partitions, or more where PART_BYTES asks for them."""
    if parts:
        return parts
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A plan without statistics says a number beyond all tables.
    return max(usual, -(-planned // PART_BYTES)) if planned < 1 << 60 else usual


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, segment: int = SEGMENT, end_id: int = END_ID, parts: int | None = None) -> None:
    """Write documents (doc_id long, text string; other columns are left out) as token files into a new folder.

    path: the tokenizer's file, on every executor; None takes the public byte-level one.
    """
    spark = docs.sparkSession
    ship(spark)
    n = spread(docs.select("doc_id", "text"), parts)
    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")).repartitionByRange(n, "doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    dealt.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text").mapInArrow(_writer(path, segment, end_id), IMAGES).write.parquet(folder)


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenfold.llm.simple8b import read_image

        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, lengths, ids = read_image(image.as_py())
                data = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                pieces = [data[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return read


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    ship(spark)
    images = spark.read.schema(IMAGES).parquet(folder)
    # One total a part, as many as the writing job had tasks; the images stay where they are.
    totals, ahead, starts = images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), 0, []
    for row in sorted(totals, key=lambda r: r["part"]):
        starts.append((row["part"], ahead))
        ahead += row["n"]
    first = F.broadcast(spark.createDataFrame(starts, "part long, _ahead long"))
    placed = images.join(first, "part").select((F.col("_ahead") + F.col("before")).alias("_start"), "image")
    return placed.mapInArrow(_reader(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, with_ids=False)
