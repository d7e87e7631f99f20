"""Exact nearest neighbours in a group of vectors, without trying all pairs.

Vectors go into blocks by a tree: a cell that is too large deals its vectors out to the nearest of some of its own
vectors, round by round. A block, and each cell above it, has a centre and a radius, and no vector of it is closer to
one of another block than the distance of the centres less both radii. A block's own vectors bound how far its k-th
neighbours can be; with that bound each block goes down the tree and leaves out all cells beyond it. Closer blocks are
tried first, which makes the bound tighter for the rest, and a vector goes into a block only if its own bound reaches
the block's ball. Distances are tried as a matrix product and then made exactly.

Blocks that lie beside each other in the tree make a tile of bounded size. A task holds a tile with what it has found so
far, and the blocks that any of its own are to meet come past one after another; so a block is sent once a tile and not
once a pair of blocks, a bound grows tighter with each block, and a vector's k nearest are all that is written. Tiles
are as many as cores, or go in waves of so many, and what a wave was sent is deleted before the next; so the disk that
is taken grows with the vectors and the cores, not with the square of the vectors. Vectors lie in four bytes a number
where that keeps each number, and a table that another one takes the place of goes at once.

Equal vectors are one until the end: the first k + 1 of them, by id, stand for all, so a group of copies costs what a
single vector does. How much is left out depends on the data: vectors that spread over few dimensions, as states along
a text do, need a small share of the pairs; of vectors that fill many dimensions evenly no exact method can leave out
much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.vectors import distance
from lumenfold.session import Stored, ship
from lumenfold.session import clean_cut as cut

#: Vectors of a block, and cells that a cell is dealt out to.
BLOCK, FAN = 512, 32
#: Bytes of a tile's vectors at most, at eight a number; tasks for each core, more than tiles, so that few meet in one.
TILE_BYTES, TASKS = 32_000_000, 4
#: Bytes of centres that go to all executors, and through the driver, at once.
SENT_BYTES = 8_000_000
#: A cell that keeps this share of the one above it isn't dealt out again.
STUCK = 0.9
#: Allowance for rounding in bounds; what passes is compared exactly.
SLACK = 1e-9


def _matrix(ids: pa.Scalar, x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = ids.values.to_numpy(zero_copy_only=False)
    return own, _unpacked(x.as_py(), len(own))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _arrow(group: T.DataType, **fields: pa.DataType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("g", to_arrow_type(group)), *fields.items()])


IDS, XS = pa.list_(pa.int64()), pa.list_(pa.float64())


def _merged(schema: pa.Schema, most: int, finish: Callable[[np.ndarray, np.ndarray], tuple] = lambda ids, x: (ids, _packed(x))):
    """Rows of one (g, cell) that follow each other, as rows of up to `most` vectors."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, cell, above = (batch.column(k).to_pylist() for k in range(3))
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            ids, x = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(4)
            ends = np.cumsum(sizes)
            out, at, row = [], 0, 0
            while row < len(g):
                last = row
                while last + 1 < len(g) and cell[last + 1] == cell[row] and g[last + 1] == g[row]:
                    last += 1
                names, own = ids[at : ends[last]], np.concatenate([_unpacked(x[k].as_py(), sizes[k]) for k in range(row, last + 1)])
                out += [(g[row], cell[row], above[row], *finish(names[k : k + most], own[k : k + most])) for k in range(0, len(names), most)]
                at, row = ends[last], last + 1
            yield _rows(schema, out)

    return merge


def _offered(schema: pa.Schema, fan: int, turn: int):
    """Of each row the vectors whose numbers hash lowest, as pivots."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                ids, x = _matrix(batch.column(3)[k], batch.column(4)[k])
                h = (ids.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
                h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)).astype(np.int64)
                out += [(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), h[i], x[i]) for i in np.argsort(h, kind="stable")[:fan]]
            yield _rows(schema, out)

    return offer


def _dealt(schema: pa.Schema):
    """Rows with their cell's pivots -> rows by nearest pivot; the first of equally near ones."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                ids, x = _matrix(batch.column(2)[k], batch.column(3)[k])
                pivots = batch.column(4)[k].values.to_numpy(zero_copy_only=False).reshape(-1, max(1, x.shape[1]))
                goes = ((pivots**2).sum(1) - 2 * (x @ pivots.T)).argmin(1) if x.shape[1] else np.zeros(len(x), int)
                for child in np.unique(goes):
                    own = goes == child
                    out.append((batch.column(0)[k].as_py(), f"{batch.column(1)[k].as_py()}/{child}", batch.column(5)[k].as_py(), ids[own], _packed(x[own])))
            yield _rows(schema, out)

    return deal


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0)


def closest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other's row, distance) of each row's k nearest others that are no farther than `most`, ties by id."""
    shift = x.mean(0) if len(x) else 0
    squares = _squares(x - shift, y - shift)
    squares[ids[:, None] == others[None, :]] = np.inf
    error = SLACK * (np.abs(x - shift).max(initial=0) ** 2 + np.abs(y - shift).max(initial=0) ** 2) * max(1, x.shape[1])
    bound = np.minimum(most**2, np.partition(squares, k - 1, 1)[:, k - 1] if squares.shape[1] >= k else np.inf)
    i, j = np.nonzero((squares <= (bound * (1 + SLACK) + error)[:, None]) & np.isfinite(squares))
    d = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
    near = d <= most[i]
    i, j, d = i[near], j[near], d[near]
    order = np.lexsort((others[j], d, i))
    i, j, d = i[order], j[order], d[order]
    begin = np.searchsorted(i, np.arange(len(x)))
    kept = np.arange(len(i)) - begin[i] < k
    return i[kept], j[kept], d[kept]


def _ball(k: int):
    """A block's ids and vectors, centre, radius, and the distance to each vector's k-th neighbour within."""

    def finish(ids: np.ndarray, x: np.ndarray) -> tuple:
        centre = x.mean(0)
        i, _, d = closest(ids, x, ids, x, k, np.full(len(x), np.inf))
        reach = np.full(len(x), np.inf)
        full = np.bincount(i, minlength=len(x)) == k
        last = np.searchsorted(i, np.arange(len(x)), side="right") - 1
        reach[full] = d[last[full]]
        return ids, _packed(x), centre, float(np.sqrt(((x - centre) ** 2).sum(1)).max()), float(reach.max())

    return finish


def _packed(x: np.ndarray) -> bytes:
    """Vectors in four bytes a number where that keeps each number, or else in eight; the first byte says which."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return b"\4" + short.tobytes() if np.array_equal(short, x) else b"\x08" + x.astype("<f8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<f{data[0]}", offset=1).astype(float).reshape(n, -1)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, id, v) -> (g, id, x), each vector packed by itself and equal ones alike."""
    for batch in batches:
        v = batch.column(2)
        flat, ends = v.flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))
        flat[np.isnan(flat)] = np.nan
        x = [_packed(flat[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["g", "id", "x"])


def packed(points: DataFrame) -> DataFrame:
    """(g, id, v) -> g, id, x, in a third to a half of the bytes."""
    return points.select("g", F.col("id").cast("long").alias("id"), "v").mapInArrow(_single, f"g {points.schema['g'].dataType.simpleString()}, id long, x binary")


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(1))


class Held:
    """A block of a tile: its vectors, and as products with others' give squares of distances."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, radius: float):
        self.ids, self.x, self.centre, self.radius = ids, x, centre, radius
        off = x - centre
        self.norms = np.sqrt((off**2).sum(1))
        self.wide = np.hstack([-2 * off, (off**2).sum(1)[:, None], np.ones((len(x), 1))])
        self.short = self.wide.astype("f4") if self.norms.max(initial=0) < 1e15 else None

    def squares(self, own: np.ndarray | slice, y: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray]:
        """Squares of distances to others' vectors, and how far each row of them may be off; in four bytes a number where
        that is little beside a usual square."""
        off = y - self.centre
        sums = (off**2).sum(1)
        scale = (self.norms[own] + np.sqrt(sums.max(initial=0))) ** 2
        wide = np.hstack([off, np.ones((len(y), 1)), sums[:, None]])
        least = (y.shape[1] + 8) * float(np.finfo("f4").eps)
        if self.short is not None and least * scale.max(initial=0) <= min(0.02 * usual, 1e30):
            return self.short[own] @ wide.astype("f4").T, least * scale
        return self.wide[own] @ wide.T, (y.shape[1] + 8) * float(np.finfo("f8").eps) * scale


#: Pairs whose distances are made at once.
PAIRS = 1 << 16
NO_ID = np.iinfo(np.int64).max


class Seeker(Held):
    """A block whose vectors look for their k nearest."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, radius: float, k: int):
        super().__init__(ids, x, centre, radius)
        self.k, self.tried = k, 0
        self.d, self.others = np.full((len(x), k), np.inf), np.full((len(x), k), NO_ID)

    def meet(self, others: np.ndarray, y: np.ndarray, centre: np.ndarray, radius: float, same: bool) -> None:
        most = self.d[:, -1]
        own = lengths(self.x, centre) - radius <= most * (1 + SLACK) + SLACK
        if not own.any():
            return
        at = np.flatnonzero(own)
        own = slice(None) if len(at) == len(own) else at
        self.tried += len(at) * len(others)
        most = most[own]
        with np.errstate(over="ignore", invalid="ignore"):
            sizes = most**2
            known = sizes[np.isfinite(sizes)]
            squares, error = self.squares(own, y, float(np.median(known)) if len(known) else np.inf)
            if same:
                squares[np.arange(len(at)), at] = np.inf
            limit = sizes * (1 + SLACK) + error
            if len(known) < len(at) and squares.shape[1] >= self.k:
                limit = np.fmin(limit, np.partition(squares, self.k - 1, 1)[:, self.k - 1] * (1 + SLACK) + 2 * error)
            if squares.dtype == np.float32:
                limit = np.nextafter(limit.astype("f4"), np.float32(np.inf))
        # What isn't a number passes too, and is compared exactly.
        i, j = np.nonzero(~(squares > limit[:, None]))
        for start in range(0, len(i), PAIRS):
            a, b = at[i[start : start + PAIRS]], j[start : start + PAIRS]
            d = lengths(self.x[a], y[b])
            near = (d <= self.d[a, -1]) & (self.ids[a] != others[b])
            self._take(a[near], others[b[near]], d[near])

    def _take(self, a: np.ndarray, others: np.ndarray, d: np.ndarray) -> None:
        if not len(a):
            return
        rows, place = np.unique(a, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(rows)), self.k), place])
        d, others = np.concatenate([self.d[rows].ravel(), d]), np.concatenate([self.others[rows].ravel(), others])
        order = np.lexsort((others, d, place))
        kept = order[np.arange(len(order)) - np.searchsorted(place[order], np.arange(len(rows)))[place[order]] < self.k]
        self.d[rows], self.others[rows] = d[kept].reshape(-1, self.k), others[kept].reshape(-1, self.k)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    """Rows of each (g, tile) in turn, as they come past."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            at = {name: batch.column(n) for n, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                one = {name: at[name][row] for name in ("g", "tile", "leaf", "meets")}
                one = {name: value.as_py() for name, value in one.items()}
                if not at["ids"][row].is_valid:  # a block of the tile itself
                    yield one | {"ids": None}
                    continue
                ids, c = (at[name][row].values.to_numpy(zero_copy_only=False) for name in ("ids", "c"))
                yield one | {"ids": ids, "c": c, "r": at["r"][row].as_py(), "x": _unpacked(at["x"][row].as_py(), len(ids)), "lost": at["lost"][row]}

    for _, of in groupby(rows(), key=lambda row: (row["g"], row["tile"])):
        yield of


def _met(row: dict, own: dict[str, Held]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """ids, vectors, centre and radius of the block that comes past, which may be one of the tile's own."""
    if row["ids"] is None:
        held = own[row["leaf"]]
        return held.ids, held.x, held.centre, held.radius
    return row["ids"], row["x"], row["c"], row["r"]


def _sought(schema: pa.Schema, k: int):
    """A tile's own blocks and then those that they meet -> (g, id, others, d, tried) of the vectors' nearest; the pairs
    that were tried stand at a row without id."""

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches):
            own: dict[str, Seeker] = {}
            for row in rows:
                g = row["g"]
                if row["meets"] is None:
                    own[row["leaf"]] = Seeker(row["ids"], row["x"], row["c"], row["r"], k)
                    continue
                met = _met(row, own)
                for name in row["meets"]:
                    own[name].meet(*met, name == row["leaf"])
            for held in own.values():
                full = (held.others != NO_ID).sum(1)
                out = [(g, i, others[:n], d[:n], None) for i, others, d, n in zip(held.ids.tolist(), held.others, held.d, full.tolist(), strict=True)]
                yield _rows(schema, [*out, (g, None, None, None, held.tried)])

    return seek


class Counter(Held):
    """A block whose vectors count others that are closer than given ones, whose distances are learnt first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, radius: float, lost: dict[int, list[int]]):
        super().__init__(ids, x, centre, radius)
        self.lost = np.full((len(ids), max(map(len, lost.values()), default=0)), NO_ID)
        for n, i in enumerate(ids.tolist()):
            self.lost[n, : len(lost.get(i, ()))] = lost.get(i, ())
        self.d, self.closer = np.full(self.lost.shape, -np.inf), 0

    def learn(self, others: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(others)
        place = np.minimum(np.searchsorted(others, self.lost, sorter=order), len(others) - 1)
        i, m = np.nonzero(others[order[place]] == self.lost)
        self.d[i, m] = lengths(self.x[i], y[order[place[i, m]]])

    def meet(self, others: np.ndarray, y: np.ndarray, centre: np.ndarray, radius: float, same: bool) -> None:
        far = self.d.max(initial=-np.inf)
        if not far >= 0 or lengths(self.centre[None], centre[None])[0] - self.radius - radius > far * (1 + SLACK) + SLACK:
            return
        goal = np.where(self.d >= 0, self.d**2, -np.inf)
        known = goal[goal > -np.inf]
        squares, error = self.squares(slice(None), y, float(np.median(known)))
        if same:
            squares[np.arange(len(y)), np.arange(len(y))] = np.inf
        for m in range(goal.shape[1]):
            sure = (goal[:, m] * (1 - SLACK) - error).astype(squares.dtype)[:, None]
            most = (goal[:, m] * (1 + SLACK) + error).astype(squares.dtype)[:, None]
            sure, most = np.nextafter(sure, -np.inf, dtype=squares.dtype), np.nextafter(most, np.inf, dtype=squares.dtype)
            most = np.where(goal[:, m, None] > -np.inf, most, -np.inf)
            closer = squares < sure
            self.closer += np.count_nonzero(closer)
            near = ~(closer | (squares > most))
            if not near.any():
                continue
            i, j = np.nonzero(near)
            for start in range(0, len(i), PAIRS):
                a, b = i[start : start + PAIRS], j[start : start + PAIRS]
                d = lengths(self.x[a], y[b])
                less = (d < self.d[a, m]) | ((d == self.d[a, m]) & (others[b] < self.lost[a, m]))
                self.closer += int((less & (self.ids[a] != others[b])).sum())


def _counted(schema: pa.Schema):
    """A tile's own blocks with what they look for, all blocks of the group, and all once more -> g, closer."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches):
            own: dict[str, Counter] = {}
            for row in rows:
                g = row["g"]
                if row["meets"] is None:
                    own[row["leaf"]] = Counter(row["ids"], row["x"], row["c"], row["r"], {p["id"]: p["others"] for p in row["lost"].as_py() or ()})
                    continue
                met = _met(row, own)
                for name, held in own.items():
                    if row["meets"]:
                        held.learn(*met[:2])
                    else:
                        held.meet(*met, name == row["leaf"])
            yield _rows(schema, [(g, sum(held.closer for held in own.values()))])

    return count


class Blocks:
    """Distinct vectors (g, id, v), or (g, id, x) as `packed` has them, in blocks below a tree of cells.

    `spent` is dropped as soon as the points have been read. The blocks stay in the shared folder until `drop`.
    """

    def __init__(self, points: DataFrame, k: int, block: int = BLOCK, fan: int = FAN, spent: Stored | None = None):
        self.k, self.block, self.kind = k, block, points.schema["g"].dataType
        base = {"cell": pa.string(), "above": pa.int64()}
        schema = _arrow(self.kind, **base, ids=IDS, x=pa.binary())
        ddl = f"g {self.kind.simpleString()}, cell string, above long, ids array<long>, x binary"
        given = points if "x" in points.columns else packed(points)
        first = given.select("g", F.lit("root").alias("cell"), F.lit(None).cast("long").alias("above"), F.array("id").alias("ids"), "x")
        # The root needn't be together anywhere; rows of one group follow each other by chance or sort.
        open_, closed, turn = Stored(first.sortWithinPartitions("g").mapInArrow(_merged(schema, block), ddl), "cells"), [], 0
        if spent is not None:
            spent.drop()
        while True:
            sized = open_.df.groupBy("g", "cell").agg(F.sum(F.size("ids")).alias("n"), F.first("above").alias("up"))
            large = cut(sized.where((F.col("n") > block) & (F.col("up").isNull() | (F.col("n") <= STUCK * F.col("up")))).select("g", "cell", "n"))
            if large.isEmpty():
                closed.append(open_)
                break
            closed.append(Stored(open_.df.join(F.broadcast(large), ["g", "cell"], "left_anti").select(open_.df.columns), "cells"))
            rest = open_.df.join(F.broadcast(large), ["g", "cell"])
            offers = rest.select("g", "cell", "above", "ids", "x").mapInArrow(_offered(_arrow(self.kind, cell=pa.string(), h=pa.int64(), x=XS), fan, turn), f"g {self.kind.simpleString()}, cell string, h long, x array<double>")
            # As many pivots as halves of blocks, so that cells end near a block's size.
            chosen = offers.withColumn("rank", F.row_number().over(Window.partitionBy("g", "cell").orderBy("h"))).where(F.col("rank") <= fan)
            chosen = chosen.join(large, ["g", "cell"]).where(F.col("rank") <= F.greatest(F.lit(2), F.ceil(2 * F.col("n") / block)))
            pivots = chosen.groupBy("g", "cell").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("h", "x"))), lambda p: p["x"])).alias("pivots"))
            dealt = rest.join(pivots, ["g", "cell"]).select("g", "cell", "ids", "x", "pivots", "n").mapInArrow(_dealt(schema), ddl)
            before, open_ = open_, Stored(self._gathered(dealt, schema, ddl, block), "cells")
            before.drop()
            turn += 1
        self.single = not turn
        all_ = closed[0].df
        for more in closed[1:]:
            all_ = all_.unionByName(more.df)
        whole = _arrow(self.kind, **base, ids=IDS, x=pa.binary(), c=XS, r=pa.float64(), reach=pa.float64())
        leaves = self._gathered(all_, whole, ddl + ", c array<double>, r double, reach double", block, _ball(k))
        name = F.concat("cell", F.lit("/#"), F.element_at("ids", 1).cast("string"))
        self.stored = Stored(leaves.select("g", name.alias("leaf"), F.size("ids").cast("long").alias("n"), "ids", "x", "c", "r", "reach"), "blocks")
        self.leaves = self.stored.df
        for one in closed:
            one.drop()

    def drop(self) -> None:
        self.stored.drop()

    def _gathered(self, rows: DataFrame, schema: pa.Schema, ddl: str, most: int, finish=None) -> DataFrame:
        """Rows of a cell together, in as many parts as its size calls for."""
        parts = F.greatest(F.lit(1), F.ceil(F.coalesce("above", F.lit(0)) / (16 * self.block))).cast("int")
        salted = rows.withColumn("salt", F.pmod(F.hash(F.element_at("ids", 1)), parts)).repartition("g", "cell", "salt").sortWithinPartitions("g", "cell").drop("salt")
        return salted.mapInArrow(_merged(schema, most, finish) if finish else _merged(schema, most), ddl)

    def nodes(self) -> DataFrame:
        """g, name, parent, n, c, r, leaf (whether it is one) of all cells and blocks."""
        parts = F.split("leaf", "/")
        names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        below = self.leaves.select("g", F.explode(names).alias("name"), "leaf", "n", "c", "r")
        summed = below.select("g", "name", "n", F.posexplode("c").alias("i", "x")).groupBy("g", "name", "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        centre = summed.groupBy("g", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("at"))
        off = below.join(centre, ["g", "name"]).withColumn("off", distance(F.col("c"), F.col("at")) + F.col("r"))
        sized = off.groupBy("g", "name").agg(F.sum("n").alias("n"), F.max("off").alias("r"), F.first("at").alias("c"))
        return sized.select("g", "name", F.regexp_replace("name", "/?[^/]*$", "").alias("parent"), "n", "c", "r", F.col("name").contains("#").alias("is_leaf"))

    def pairs(self) -> DataFrame:
        """g, leaf, other, least (distance between vectors of theirs), apart (of their centres): no block is left out that
        may have one of the k nearest of a vector of `leaf`."""
        nodes = cut(self.nodes())
        self.levels = []
        here = self.leaves.select("g", "leaf", "c", "r", "reach", "n")
        above = nodes.where(~F.col("is_leaf")).select("g", "name", F.col("c").alias("nc"), F.col("r").alias("nr"), F.col("n").alias("nn"))
        up = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("leaf", "/")) - 1), lambda i: F.array_join(F.slice(F.split("leaf", "/"), F.lit(1), i), "/")))
        over = here.select("g", "leaf", "c", "r", up.alias("name")).join(above, ["g", "name"]).where(F.col("nn") > self.k)
        over = over.groupBy("g", "leaf").agg(F.min(distance(F.col("c"), F.col("nc")) + F.col("r") + F.col("nr")).alias("over"))
        front = here.join(over, ["g", "leaf"], "left").select("g", "leaf", F.least("reach", F.coalesce("over", F.lit(float("inf")))).alias("most"), F.lit("root").alias("parent"))
        # Centres, of which there is one a block, go to the pairs that need them and are not kept with each pair. So many
        # go at once as the driver holds with ease, and the pairs of a level are made in as many steps.
        size = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_leaf").alias("leaves"), F.max(F.size("c")).alias("dims")).first()
        steps = lambda n: max(1, -(-n * (8 * (size["dims"] or 1) + 200) // SENT_BYTES))
        of, to = steps(size["leaves"]), steps(size["n"])
        some = lambda df, name, k, n: df.where(F.pmod(F.xxhash64("g", name), F.lit(n)) == k) if n > 1 else df
        centres = here.select("g", "leaf", "c", "r")
        below = nodes.select("g", "parent", "name", F.col("c").alias("nc"), F.col("r").alias("nr"), "is_leaf")
        front = cut(front) if of * to > 1 else front
        found = []
        while True:
            level = None
            for i, j in product(range(of), range(to)):
                met = some(front, "leaf", i, of).join(F.broadcast(some(below, "name", j, to)), ["g", "parent"]).join(F.broadcast(some(centres, "leaf", i, of)), ["g", "leaf"])
                met = met.withColumn("apart", distance(F.col("c"), F.col("nc"))).withColumn("least", F.greatest(F.col("apart") - F.col("r") - F.col("nr"), F.lit(0.0)))
                met = met.where(F.col("least") <= F.col("most") * (1 + SLACK) + SLACK).select("g", "leaf", "most", "name", "is_leaf", "least", "apart")
                if level:
                    level.append(met)
                else:
                    level = Stored(met, "levels")
            self.levels.append(level)
            met = self.levels[-1].df
            found.append(met.where("is_leaf").select("g", "leaf", F.col("name").alias("other"), "least", "apart"))
            front = met.where("NOT is_leaf").select("g", "leaf", "most", F.col("name").alias("parent"))
            if front.isEmpty():
                break
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def tiled(self) -> DataFrame:
        """g, leaf, tile, wave, part: neighbours in the tree share a tile. A group's tiles take turns in self.waves waves,
        so that no more of them than there are cores go at once; `part` is the task of a wave that a tile goes to."""
        shape = self.leaves.agg(F.sum("n").alias("n"), F.max(F.size("c")).alias("dims")).first()
        cores, bytes_ = self.leaves.sparkSession.sparkContext.defaultParallelism, max(1, shape["dims"] or 1) * 8
        size = (shape["n"] or 0) * bytes_
        tiles = max(cores, -(-size // TILE_BYTES))
        self.waves, self.parts = -(-tiles // cores), TASKS * cores
        before = F.sum("n").over(Window.partitionBy("g").orderBy("leaf")) - F.col("n")
        tile = F.floor(before * bytes_ / max(1, -(-size // tiles))).cast("int")
        part = F.pmod(F.hash("g") + F.floor(F.col("tile") / self.waves), F.lit(self.parts)).cast("int")
        return cut(self.leaves.select("g", "leaf", "n").withColumn("tile", tile).select("g", "leaf", "tile", F.pmod("tile", F.lit(self.waves)).alias("wave"), part.alias("part")))

    def _waves(self, tiles: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What `run` makes of the tiles of each wave, one wave after another."""
        out = cut(run(tiles.where("wave = 0")))
        for wave in range(1, self.waves):
            out = out.union(cut(run(tiles.where(F.col("wave") == wave))))
        return out

    def _past(self, tiles: DataFrame, needs: DataFrame, lost: DataFrame | None = None) -> DataFrame:
        """Rows of each tile together: its own blocks, then those of `needs` (g, part, tile, leaf, turn, place, meets)."""
        columns = ["g", "part", "tile", "turn", "place", "leaf", "meets", "lost", "ids", "x", "c", "r"]
        kind = "array<struct<id: long, others: array<long>>>"
        payload = self.leaves.select("g", "leaf", "ids", "x", "c", "r")
        own = payload.join(tiles.drop("wave"), ["g", "leaf"]).withColumn("turn", F.lit(-1)).withColumn("place", F.lit(0)).withColumn("meets", F.lit(None).cast(needs.schema["meets"].dataType))
        own = own.join(lost, ["g", "leaf"], "left") if lost is not None else own.withColumn("lost", F.lit(None).cast(kind))
        # A tile has its own blocks already.
        home = payload.join(F.broadcast(tiles.select("g", "leaf", F.col("tile").alias("home"))), ["g", "leaf"], "left")
        met = home.join(needs, ["g", "leaf"]).withColumn("lost", F.lit(None).cast(kind))
        met = met.withColumns({c: F.when(~F.col("home").eqNullSafe(F.col("tile")), F.col(c)) for c in ("ids", "x", "c")})
        rows = own.select(columns).union(met.select(columns)).repartitionById(self.parts, F.col("part"))
        return rows.sortWithinPartitions("g", "tile", "turn", "place", "leaf").drop("part", "turn", "place")

    def lists(self) -> DataFrame:
        """g, id, others, d of each vector's k nearest, the nearest first; `tried` counts the distances that were made."""
        tiles, self.levels = self.tiled(), []
        if self.single:
            pairs = self.leaves.select("g", "leaf", F.col("leaf").alias("other"), F.lit(1).alias("place"))
        else:
            pairs = self.pairs().withColumn("place", F.row_number().over(Window.partitionBy("g", "leaf").orderBy(F.col("leaf") != F.col("other"), "apart", "other")))
        meets = F.array_sort(F.collect_list(F.col("leaf"))).alias("meets")
        needs = lambda own: pairs.join(F.broadcast(own), ["g", "leaf"]).groupBy("g", "part", "tile", F.col("other").alias("leaf")).agg(F.min("place").alias("place"), meets).withColumn("turn", F.lit(0))
        schema = _arrow(self.kind, id=pa.int64(), others=IDS, d=XS, tried=pa.int64())
        seek = _sought(schema, self.k), f"g {self.kind.simpleString()}, id long, others array<long>, d array<double>, tried long"
        found = self._waves(tiles, lambda own: self._past(own, needs(own)).mapInArrow(*seek))
        for level in self.levels:
            level.drop()
        self.tried = found.agg(F.coalesce(F.sum("tried"), F.lit(0))).first()[0]
        return found.where("id IS NOT NULL").select("g", "id", "others", "d")

    def nearest(self) -> DataFrame:
        """g, id, other, d, rank of each vector's k nearest; `tried` counts the distances that were made."""
        return exploded(self.lists())

    def closer(self, pairs: DataFrame) -> DataFrame:
        """pairs (g, id, other) of vectors -> g, closer: over a group's pairs, how many vectors are closer to the first
        one than the second one is, ties by id. All blocks of a group go past its tiles twice."""
        tiles = self.tiled()
        at = self.leaves.select("g", "leaf", F.explode("ids").alias("id"))
        listed = pairs.groupBy("g", "id").agg(F.array_sort(F.collect_list(F.col("other").cast("long"))).alias("others"))
        lost = at.join(listed, ["g", "id"]).groupBy("g", "leaf").agg(F.collect_list(F.struct("id", "others")).alias("lost"))
        first = F.explode(F.array(F.array(F.lit("")), F.array().cast("array<string>")))
        schema = _arrow(self.kind, closer=pa.int64())

        def counted(own: DataFrame) -> DataFrame:
            ends = own.select("g", "part", "tile").distinct()
            needs = self.leaves.select("g", "leaf").join(F.broadcast(ends), "g").select("*", first.alias("meets"), F.lit(0).alias("place")).withColumn("turn", (F.size("meets") == 0).cast("int"))
            return self._past(own, needs, lost).mapInArrow(_counted(schema), f"g {self.kind.simpleString()}, closer long")

        return self._waves(tiles, counted).groupBy("g").agg(F.sum("closer").alias("closer"))


def exploded(lists: DataFrame, group: str = "g") -> DataFrame:
    """(group, id, others, d) -> group, id, other, d, rank."""
    listed = lists.select(group, "id", F.posexplode(F.arrays_zip("others", "d")).alias("at", "p"))
    return listed.select(group, "id", F.col("p.others").alias("other"), F.col("p.d").alias("d"), (F.col("at") + 1).alias("rank"))


def listed(near: DataFrame, *key: str) -> DataFrame:
    """(key, other, d, rank), key ending with an id -> key, others, d, the nearest first."""
    *by, point = key
    rows = near.groupBy(*by, F.col(point).cast("long").alias(point)).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("other").cast("long").alias("other"), "d"))).alias("l"))
    return rows.select(*key, F.transform("l", lambda x: x["other"]).alias("others"), F.transform("l", lambda x: x["d"]).alias("d"))


def neighbour_lists(vectors: DataFrame, k: int, group: str = "group", state: str = "state", block: int = BLOCK, fan: int = FAN, spent: Stored | None = None) -> DataFrame:
    """`neighbours` as a row a vector: group, id (long), others, d, the nearest first. `spent` is dropped as soon as the
    vectors have been read."""
    points = vectors.select(F.col(group).alias("g"), F.col("id").cast("long").alias("id"), F.transform(state, lambda x: x.cast("double")).alias("v")).where("g IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL")
    ship(vectors.sparkSession)
    points = packed(points)
    distinct = Stored(points.groupBy("g", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vectors")
    members = counts = None
    if not distinct.df.where("n > 1").isEmpty():
        members = cut(points.join(distinct.df.select("g", "x", F.col("id").alias("rep")), ["g", "x"]).select("g", "id", "rep"))
        counts = cut(distinct.df.select("g", F.col("id").alias("rep"), "n"))
    if spent is not None:
        spent.drop()
    blocks = Blocks(distinct.df.select("g", "id", "x"), k, block, fan, distinct)
    lists = blocks.lists()
    blocks.drop()
    if members is not None:
        order = lambda key: F.row_number().over(Window.partitionBy("g", key).orderBy("d", "other"))
        near = exploded(lists).select("g", F.col("id").alias("rep"), F.col("other").alias("of"), "d")
        # Others before which closer ones and copies already are as many as are asked for stand for none.
        sized = near.join(counts.withColumnRenamed("rep", "of"), ["g", "of"]).join(counts.withColumnRenamed("n", "own"), ["g", "rep"])
        sized = sized.withColumn("most", F.sum("n").over(Window.partitionBy("g", "rep").orderBy("d"))).withColumn("tied", F.sum("n").over(Window.partitionBy("g", "rep", "d")))
        near = sized.where(F.col("most") - F.col("tied") + F.col("own") <= k).select("g", "rep", "of", "d")
        some = members.withColumn("r", F.row_number().over(Window.partitionBy("g", "rep").orderBy("id"))).where(F.col("r") <= k + 1)
        meant = near.join(some.select("g", F.col("rep").alias("of"), F.col("id").alias("other")), ["g", "of"]).select("g", "rep", "other", "d")
        meant = meant.union(some.select("g", "rep", F.col("id").alias("other"), F.lit(0.0).alias("d")))
        of = meant.withColumn("r", order("rep")).where(F.col("r") <= k + 1).groupBy("g", "rep").agg(F.array_sort(F.collect_list(F.struct("r", "other", "d"))).alias("l"))
        # A member's own place is left out of its representative's list, which has one more for that.
        own = members.join(of, ["g", "rep"]).select("g", "id", F.slice(F.filter("l", lambda p: p["other"] != F.col("id")), 1, k).alias("l"))
        lists = cut(own.select("g", "id", F.transform("l", lambda p: p["other"]).alias("others"), F.transform("l", lambda p: p["d"]).alias("d")).where(F.size("others") > 0))
    return lists.withColumnRenamed("g", group)


def neighbours(vectors: DataFrame, k: int, group: str = "group", state: str = "state", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(group, id, state) -> group, id, other, d, rank for the k nearest in the same group; ties by id.

    ids are whole numbers, one a vector of a group; a group's vectors have one length. Rows without group, id or vector
    take no part. A group of k or fewer others gives all of them.
    """
    kind = vectors.schema["id"].dataType
    near = exploded(neighbour_lists(vectors, k, group, state, block, fan), group)
    return near.select(group, F.col("id").cast(kind).alias("id"), F.col("other").cast(kind).alias("other"), "d", "rank")
