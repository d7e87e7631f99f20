"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Each document is cut every `size` ids. Full pieces are sequences by themselves; the remainders of a group of
documents are sorted by length and each goes into the first open sequence with room for it, which a tournament tree
(each node: the most room below it) finds in logarithmic time. Groups are packed independently, so a group's size is
bounded and padding per group is about the square root of its rows.

Groups are random: rows are dealt round robin, in an order of hashes, and within a task come in the order of a seeded
hash, a group being the next rows of that order. Both orders depend on the rows alone, so a task that runs again after
a lost executor packs the same rows into the same sequences.

Nulls: a null text is empty, so its piece is the end id alone. Rows are packed one by one: equal rows and equal or
null doc_ids are packed like any others. A text of any length is cut, whole, into pieces. An empty table has no
sequences. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.op4_token_files import END_ID, PIECES as TABLE, spread, tokenizer_path
from lumenfold.session import read_table, ship

SIZE = 1024
#: Ids in a group at most, beyond its last document.
GROUP_IDS = 4_000_000
SEED = 11
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Tournament:
    """Bins in the order in which they were opened; `first(n)`: the earliest with room for n, or a new one."""

    def __init__(self, size: int, bins: int):
        self.size = size
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [size] * (2 * self.leaves)
        self.opened = 0

    def first(self, length: int) -> tuple[int, int]:
        """-> bin, offset in it. The bins not yet opened have all their room, so there is always one."""
        room, node = self.room, 1
        if length > self.size or length > room[1]:
            raise ValueError("no bin holds this piece")
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        chosen, offset = node - self.leaves, self.size - room[node]
        room[node] -= length
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        self.opened = max(self.opened, chosen + 1)
        return chosen, offset


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """-> (bin, offset) of each, in the order given; ties go in that order too."""
    tree, out = Tournament(size, max(1, len(lengths))), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.first(lengths[i])
    return out


def pack_group(coded: list[bytes], size: int, first_id: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """coded: each document's ids, 4 bytes each -> (document, start, length, sequence, offset) by piece, next free id."""
    pieces, tails, used = [], [], first_id
    for k, ids in enumerate(coded):
        n = len(ids) // 4
        full = n // size
        for j in range(full):
            pieces.append((k, j * size, size, used, 0))
            used += 1
        if n > full * size:
            tails.append((k, full * size, n - full * size))
    placed = first_fit_decreasing([t[2] for t in tails], size)
    pieces += [(*t, used + b, offset) for t, (b, offset) in zip(tails, placed, strict=True)]
    return pieces, used + max((b + 1 for b, _ in placed), default=0)


def _packer(path: str | None, size: int, group_ids: int, end_id: int, table: int = TABLE):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenfold.llm.tokens import encoder

        own = encoder(path or tokenizer_path(), table)
        end = np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        coded: list[bytes] = []
        total, next_id = 0, 0

        def packed() -> pa.RecordBatch:
            nonlocal next_id
            pieces, next_id = pack_group(coded, size, next_id)
            k, start, length, sequence, offset = (list(x) for x in zip(*pieces, strict=True))
            columns = [
                pa.array([docs[i] for i in k], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([len(coded[i]) // 4 for i in k], pa.int64()), pa.array([part + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()),
                pa.array([coded[i][4 * a : 4 * (a + n)] for i, a, n in zip(k, start, length, strict=True)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        part = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py() << 40
            for name, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs.append(name)
                coded.append(own.encode(text.as_py()) + end)
                total += len(coded[-1]) // 4
                if total >= group_ids:
                    yield packed()
                    docs, coded, total = [], [], 0
        if docs:
            yield packed()

    return pack


def pack_documents(docs: DataFrame, size: int = SIZE, path: str | None = None, group_ids: int = GROUP_IDS, end_id: int = END_ID, parts: int | None = None, seed: int = SEED, table: int = TABLE) -> DataFrame:
    """documents (doc_id, text; other columns are left out) -> a row a piece, with its ids and place.

    sequence_id is unique over all; the pieces of a sequence lie at gapless offsets from 0. `table`: entries of the
    encoder's table at most.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select("doc_id", "text")
    # Round robin, not by a key: rows of one doc_id are dealt out as evenly as any others.
    dealt = own.repartition(spread(own, parts)).sortWithinPartitions(F.xxhash64(F.lit(seed), "doc_id", "text"), "doc_id", "text")
    return dealt.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text").mapInArrow(_packer(path, size, group_ids, end_id, table), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(read_table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
