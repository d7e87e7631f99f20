"""Quality classifier: zstandard dictionaries of good and of bad text, and how much better one of them compresses.

Half of a bounded labelled sample trains the two dictionaries, the other half the calibration, so that the sizes that
it sees are those of texts that no dictionary knows. A text is compressed whole three times: with either dictionary
and with none; the score is a logistic function of the normalised difference, the three ratios and the length.

A null or empty text has ratios of 0 and gets the score of such a text. Nulls in labels leave a row out; several
labels of a doc_id are averaged. Equal rows are scored alike. Without both labels every document scores the sample's
rate (0 if there is none). A text of any length is compressed whole. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.held import release
from lumenfold.llm.labelled import held_out, labelled_sample
from lumenfold.llm.linear import Calibration
from lumenfold.session import read_table, ship

#: Labelled documents to train on at most.
SAMPLE = 12_000
DICTIONARY = 65_536
LEVEL = 3
PIECE = 2_000
#: Pieces of training text for a dictionary at most, dealt evenly over all pieces.
PIECES = 8_000
ACCEPT = 0.7
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def dictionary(texts: list[str]) -> bytes:
    """Content for a dictionary: trained where there is enough text, else the texts' pieces themselves."""
    pieces = [p.encode() for t in texts for k in range(0, len(t), PIECE) if (p := t[k : k + PIECE])]
    pieces = [pieces[i] for i in np.linspace(0, len(pieces) - 1, min(len(pieces), PIECES)).astype(int)] if pieces else []
    if len(pieces) >= 200:
        try:
            return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(pieces)[-DICTIONARY:] or b" " * 8


class Sizes:
    """The features of texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        plain = {"level": level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.none = zstandard.ZstdCompressor(**plain)
        self.both = []
        for content in (good, bad):
            own = zstandard.ZstdCompressionDict(content)
            own.precompute_compress(level=level)
            self.both.append(zstandard.ZstdCompressor(dict_data=own, **plain))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 5))
        for k, text in enumerate(texts):
            if data := (text or "").encode():
                g, b = (len(c.compress(data)) for c in self.both)
                out[k] = (b - g) / (b + g), g / len(data), b / len(data), len(self.none.compress(data)) / len(data), np.log1p(len(data))
        return out


def train(texts: list[str], good: np.ndarray):
    """-> (good dictionary, bad dictionary, calibration), or the rate if one of the labels is missing."""
    if len(texts) < 4 or good.all() or not good.any():
        return float(good.mean()) if len(texts) else 0.0
    turn = np.zeros(len(texts), bool)
    for y in (True, False):
        turn[np.flatnonzero(good == y)[::2]] = True
    first = {y: [t for t, g, k in zip(texts, good, turn, strict=True) if k and g == y] for y in (True, False)}
    dictionaries = dictionary(first[True]), dictionary(first[False])
    rest = ~turn if len(set(good[~turn])) == 2 else np.ones(len(texts), bool)
    x = Sizes(*dictionaries)([t for t, k in zip(texts, rest, strict=True) if k])
    return *dictionaries, Calibration(x, good[rest].astype(float))


def _mapper(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        fitted = model.value
        sizes = None if isinstance(fitted, float) else Sizes(*fitted[:2])
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                p = np.full(part.num_rows, fitted) if sizes is None else fitted[2](sizes(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= ACCEPT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    rows = labelled_sample(docs, labels, "quality", ~held_out(4, 2), sample)
    fitted = spark.sparkContext.broadcast(train([r["text"] for r in rows], np.array([r["label"] for r in rows], bool)))
    return docs.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "text").mapInArrow(_mapper(fitted), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
