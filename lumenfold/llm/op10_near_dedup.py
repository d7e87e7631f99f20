"""MinHash near-dedup: a chosen-path set similarity join and connected components.

Texts with equal shingle sets are one class, represented by its smallest doc_id. Each of several independent trees
sends every class down from its root: a node takes one coordinate of the classes' MinHash sketches, or two with
probability 1 / similarity - 1, and a class goes to the child named by the coordinate and its own value there; so two
classes of that similarity meet in one child a level on average. Only ids go down. Nodes of at most LEAF classes end
there and are compared exhaustively. A node that keeps TIGHT of its parent's classes holds near copies of each other,
which further levels would hardly part: it ends there as a dense node, and so does one that is still large at DEPTH.
The number of trees follows from the target recall (`survival`, `trees_for`).

Comparing goes in rounds, since links and not pairs are asked for. First each class of a node is held against the
node's smallest. Small nodes that the first round left in different components are then compared in pairs. Dense nodes
that share a class are one cluster; what the first round left outside a cluster's largest component is held against
all of the cluster, in blocks of bounded size, and a block gives no more links than join its components. Every link is
confirmed on the full shingle sets.

Sketches are written once, and what a table of ids needs of them or of the sets is picked by these ids. Where sets or
sketches go to pairs they go in waves, and a wave leaves no shuffle files; so the disk that is taken at once grows with
the documents, not with the pairs.

A null text, or one without words, has an empty set and is linked with nothing. Rows of one doc_id are one document,
whatever their texts. A row with a null doc_id is linked with nothing, has no component and is kept. A text of any
length has its whole set; a very long one makes a block of its own. Other columns are left out. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.held import held, release
from lumenfold.session import Stored, cleaning, discard, read_table, shared_path, ship
from lumenfold.session import clean_cut as cut

WORDS = 5
#: Links: MOST * intersection >= least * union; LEAST is the query's, callers may give their own.
LEAST, MOST = 85, 100
#: Share of the pairs at the threshold that the trees bring together.
TARGET = 0.99995
SEEDS = 2
DEPTH = 12
#: Levels that a pair which is not in a dense node goes down as a rule; the recall is stated for these.
USUAL = 5
LEAF = 24
#: Hundredths of its parent's classes from which a node holds near copies.
TIGHT = 60
#: Rows of ids, and of sketches, that a task takes where a table that has been counted is read again.
ID_ROWS, SKETCH_ROWS = 200_000, 20_000
#: Classes of a cluster's block on average, up to so many blocks; beyond these, classes and shingles of one at most.
BLOCK, BLOCKS, BLOCK_MOST, BLOCK_SHINGLES = 512, 8, 4096, 1_000_000
#: Bytes that a wave sends, or that share of all sets where it is more.
WAVE_BYTES, WAVE_SHARE = 128_000_000, 16
#: Parts by print that sketches are written in, and rows from which a part is taken by itself.
BUCKETS, BUCKET_ROWS = 8, 50_000
COORDINATES = 128
#: Pairs whose sketches agree in a share so many standard deviations under the threshold are not confirmed.
DEVIATIONS = 5
BROADCAST_BYTES = 24_000_000
CHUNK_BYTES = 400_000

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_STEP = int(_rng.integers(1, 1 << 62)) * 2 + 1
_BACK = pow(_STEP, -1, 1 << 64)
_TURNS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> list[np.ndarray]:
    out = []
    for base in (_STEP, _BACK):
        own = np.full(n, base, np.uint64)
        own[0] = 1
        out.append(np.multiply.accumulate(own))
    return out


def powers(n: int) -> list[np.ndarray]:
    """Of the step and of its inverse modulo 2^64, so that a word's hash doesn't depend on its place.

    Those of a chunk's length are kept; those of a longer text are made for it.
    """
    usual = CHUNK_BYTES + 1
    return held("powers", lambda: _grown(usual)) if n <= usual else _grown(n)


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """data: bytes of all texts in a row; ends: of each. -> each text's distinct shingle hashes, ascending."""
    begins = np.r_[0, ends[:-1]]
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(ends)
    solid = ~_SPACE[data]
    before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
    full = ends > begins
    before[begins[full]] = False
    after[ends[full] - 1] = False
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)])]
    word = mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _TURNS[15])
    owner = np.searchsorted(ends, first, side="right")
    counts = np.bincount(owner, minlength=len(ends))
    stops = np.cumsum(counts)
    rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        rolled += word[k : k + len(rolled)] * _TURNS[k]
    rolled = mixed(rolled)
    out = []
    for stop, n in zip(stops.tolist(), counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rolled[stop - n : stop - words + 1]))
        elif n:
            short = (word[stop - n : stop] * _TURNS[:n]).sum(dtype=np.uint64, keepdims=True) + np.full(1, n, np.uint64) * _TURNS[14]
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, (1 << 32) - 1, np.uint64)
    for k in range(0, len(own), 2048):
        least = np.minimum(least, ((_A[:, None] * own[None, k : k + 2048] + _B[:, None]) >> np.uint64(32)).min(axis=1))
    return least.astype(np.uint32).view(np.int32)


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """In the order of the texts, chunk by chunk; a text is never cut."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield from shingle_sets(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at])
        at = to


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, sketches = [], [], []
        for own in sets_of(batch.column(1)):
            sizes.append(len(own))
            prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            sketches.append(sketch(own) if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "print", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.tobytes() for own in sets_of(batch.column(1))], pa.binary())], ["r", "set"])


def _confirm(least: int, most: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                same = len(p) + len(q) - len(np.unique(np.concatenate((p, q)))) if most * min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
                keep.append(most * same >= least * (len(p) + len(q) - same) and same > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _within_block(least: int, most: int):
    """Links between the strangers (side 0) and the members (side 1) of a block, as many as join its components."""

    def compare(rows: pa.Table) -> pa.Table:
        release()
        side, r, component = (rows.column(n).to_numpy() for n in ("side", "r", "component"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        members = np.flatnonzero(side == 1)
        x, y, parent = [], [], {c: c for c in component.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        if len(members):
            sizes = np.array([len(sets[k]) for k in members])
            known, at = np.unique(np.concatenate([sets[k] for k in members]), return_inverse=True)
            offsets = np.r_[0, np.cumsum(sizes)[:-1]]
            for k in np.flatnonzero(side == 0):
                own = sets[k]
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                mark = np.zeros(len(known), np.int32)
                mark[place[known[place] == own]] = 1
                both = np.add.reduceat(mark[at], offsets)
                for m in members[most * both >= least * (sizes + len(own) - both)]:
                    if (a := root(int(component[k]))) != (b := root(int(component[m]))):
                        parent[a] = b
                        x.append(int(r[k]))
                        y.append(int(r[m]))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return compare


def survival(least: int, levels: int) -> float:
    """Probability that two classes whose sketches agree in least / MOST of the coordinates are together at that level."""
    share, lost = least / MOST, 0.0
    twice = min(1.0, 1 / share - 1)
    for _ in range(levels):
        child = 1 - share + share * lost
        lost = child * (1 - twice) + child * child * twice
    return 1 - lost


def trees_for(target: float, least: int = LEAST, levels: int = USUAL) -> int:
    """Trees of which one at least brings together that share of the pairs at the threshold."""
    return math.ceil(math.log(1 - target) / math.log(1 - survival(least, levels)))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def tasks(rows: int, each: int = ID_ROWS) -> int:
    return max(1, -(-rows // each))


def written(df: DataFrame, each: int = ID_ROWS) -> DataFrame:
    """df checkpointed, to be read by as many tasks as its rows ask for, so that small tables don't make many small files."""
    kept = cut(df)
    return kept.coalesce(tasks(kept.count(), each))


def nodes(reps: DataFrame, first: int, last: int, known: DataFrame | None = None, depth: int = DEPTH, leaf: int = LEAF, least: int = LEAST) -> DataFrame:
    """node, r, component, n (the node's classes), center (its smallest), dense (larger than a leaf) of end nodes.

    reps: r, sketch. known: r, component; without it each class is a component. A node all of whose classes are known to
    be linked is closed: it has nothing to find.
    """
    coordinate = lambda node, turn: F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(COORDINATES)).cast("int")
    child = lambda node, turn: F.xxhash64(node, coordinate(node, turn), F.get("sketch", coordinate(node, turn)))
    twice = F.pmod(F.xxhash64("node", F.lit("two")), F.lit(1000)) < 1000 * MOST // least - 1000
    start = F.explode(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda t: F.xxhash64(t.cast("long")))).alias("node")
    rows, out = reps.select("r", F.col("r").alias("component"), "sketch", start).withColumn("n", F.lit(0).cast("long")), None
    for level in range(1, depth + 1):
        branch = F.explode(F.array_compact(F.array(child(F.col("node"), "one"), F.when(twice, child(F.col("node"), "other")))))
        own = ["r", "component"] if level > 1 else ["r"]
        # Dealt by node once, for the counts and for the join.
        down = rows.select(*own, F.col("n").alias("above"), branch.alias("node")).repartition("node")
        low = own[-1]
        counts = down.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("above"), F.min("r").alias("center"), F.min(low).alias("low"), F.max(low).alias("high"))
        sized = down.drop("above").join(counts.where("low <> high").drop("low", "high"), "node")
        if level > 1:
            sized = written(sized)
        elif known is None:
            sized = written(sized.withColumn("component", F.col("r")))
        else:
            # Components are looked up for what shares a node, not for each class of each tree.
            sized = written(sized.join(known, "r"))
            ends = sized.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("node")
            sized = written(sized.join(ends, "node", "left_semi"))
        large = F.col("n") > leaf
        over = ~large if level < depth else F.lit(True)
        if level > 1:
            over = over | (100 * F.col("n") >= TIGHT * F.col("above"))
        ends = sized.where(over).select("node", "r", "component", "n", "center", large.alias("dense"))
        out = ends if out is None else out.union(ends)
        rest = sized.where(~over)
        if level == depth or rest.isEmpty():
            break
        rows = rest.select("r", "node", "component", "n").join(picked(reps, rest.select("r")), "r")
    return out


def picked(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """r and sketch of the classes that the one column of ids names."""
    return reps.select("r", "sketch").join(small(ids.toDF("r").distinct(), 32), "r", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """Edges (x, y) of numbers -> v, component: the smallest number reachable, of every number in an edge.

    Large stars and small stars in turn; each round is checkpointed and compared with the last.
    """
    now, last = cut(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct()), None
    n = tasks(now.count())
    while True:
        now = now.coalesce(n)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(n)
        linked = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").coalesce(n).distinct().coalesce(n)
        low = linked.groupBy("u").agg(F.min("v").alias("m")).coalesce(n)
        star = linked.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(star.where("u != v").coalesce(n).distinct().coalesce(n))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    roots = now.select("v").distinct().select("v", F.col("v").alias("component"))
    return now.select(F.col("u").alias("v"), F.col("v").alias("component")).union(roots).groupBy("v").agg(F.min("component").alias("component"))


def agreeing(least: int) -> int:
    """Coordinates in which the sketches of a pair must agree to be confirmed."""
    share = least / MOST
    return int(COORDINATES * (share - DEVIATIONS * (share * (1 - share) / COORDINATES) ** 0.5))


def alike(x: str, y: str, least: int = LEAST):
    """Whether enough of two sketches agrees."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e) >= agreeing(least)


def waves(sent: int, whole: int) -> int:
    """Waves in which `sent` bytes go; whole: bytes of all sets."""
    return max(1, -(-sent // max(WAVE_BYTES, whole // WAVE_SHARE)))


def in_waves(rows: DataFrame, n: int, run: Callable[[DataFrame], DataFrame], *key: str) -> DataFrame:
    """What `run` makes of each wave's rows, dealt out by the key, one wave after another."""
    out = written(run(rows if n == 1 else rows.where(F.pmod(F.xxhash64(*key), F.lit(n)) == 0)))
    for wave in range(1, n):
        out = out.union(written(run(rows.where(F.pmod(F.xxhash64(*key), F.lit(n)) == wave))))
    return out


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, sizes: DataFrame, least: int = LEAST) -> DataFrame:
    """Of pairs (x, y) of classes, those linked; both sketches are held against each other before the sets are.

    sizes: r, n_shingles.
    """
    pairs = written(pairs)
    whole = 8 * (sizes.agg(F.sum("n_shingles")).first()[0] or 0)

    def resembling(some: DataFrame) -> DataFrame:
        known = picked(reps, some.select("x").union(some.select("y")))
        side = lambda name: known.select(F.col("r").alias(name), F.col("sketch").alias(f"s{name}"))
        return some.join(side("x"), "x").join(side("y"), "y").where(alike("sx", "sy", least)).select("x", "y").distinct()

    def linked(some: DataFrame) -> DataFrame:
        sets = sets_for(docs, some.select("x").union(some.select("y")))
        own = lambda name: sets.select(F.col("r").alias(name), F.col("set").alias(f"set_{name}"))
        both = some.join(own("x"), "x").join(own("y"), "y").select("x", "y", "set_x", "set_y")
        return both.mapInArrow(_confirm(least, MOST), "x long, y long").distinct()

    # A pair goes with what it has of one side, and both sides' own go once.
    likely = in_waves(pairs, waves(3 * 4 * COORDINATES * pairs.count(), whole), resembling, "x", "y")
    shingles = likely.join(sizes.select(F.col("r").alias("x"), "n_shingles"), "x").agg(F.sum("n_shingles")).first()[0] or 0
    return in_waves(likely, waves(3 * 8 * shingles, whole), linked, "x", "y")


def sets_for(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """r and its full set, of the documents that the one column of ids names."""
    wanted = small(ids.toDF("doc_id").distinct(), 32)
    return docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "r long, set binary")


def clustered(dense: DataFrame, sizes: DataFrame, docs: DataFrame, least: int = LEAST) -> DataFrame | None:
    """Links (x, y) that join the components of open dense nodes (node, r, component, center), or None without such nodes.

    sizes: r, n_shingles. Strangers are the classes outside a cluster's largest component; blocks of them meet blocks of
    all the cluster's, in waves of so many pairs of blocks. So the rows that go grow with strangers x cluster / block and
    those that are on disk at once with the cluster, and nothing grows with pairs.
    """
    if dense.isEmpty():
        return None
    home = components(dense.select(F.col("center").alias("x"), F.col("r").alias("y"))).select(F.col("v").alias("r"), F.col("component").alias("cluster"))
    members = written(dense.select("r", "component").distinct().join(home, "r").join(sizes, "r"))
    parts = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    # A row a cluster, of those in which the first round left something open.
    blocks = lambda n, s: F.greatest(F.least(F.ceil(n / BLOCK), F.lit(BLOCKS)), F.ceil(n / BLOCK_MOST), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    rest = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", -F.col("component"), "s")).alias("most"))
    rest = rest.where(F.col("n") > F.col("most.n"))
    strange = F.col("s") - F.col("most.s")
    rest = written(rest.select("cluster", "main", "s", strange.alias("t"), blocks(F.col("n"), F.col("s")).alias("q"), blocks(F.col("n") - F.col("most.n"), strange).alias("p")))
    open_rows = written(members.drop("n_shingles").join(rest, "cluster"))
    full = Stored(open_rows.join(sets_for(docs, open_rows.select("r")), "r"), "sets")
    deal = lambda seed, n: F.pmod(F.xxhash64("r", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    given = ["cluster", "r", "component", "set"]
    strangers = full.df.where("component != main").select(*given, F.lit(0).alias("side"), deal("stranger", "p").alias("i"), every("q").alias("j"))
    others = full.df.select(*given, F.lit(1).alias("side"), deal("member", "q").alias("j"), every("p").alias("i"))
    sent, whole = rest.agg(F.sum(F.col("t") * F.col("q") + F.col("s") * F.col("p")), F.sum("s")).first()
    met = lambda some: some.groupBy("cluster", "i", "j").applyInArrow(_within_block(least, MOST), "x long, y long").distinct()
    out = in_waves(strangers.unionByName(others), waves(8 * (sent or 0), WAVE_SHARE * 8 * (whole or 0)), met, "cluster", "i", "j")
    full.drop()
    return out


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.select(F.col("v").alias("r"), "component"), "r", "left").withColumn("component", F.coalesce("component", "r"))


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, Stored]:
    """Rows (doc_id, n_shingles, print), classes (print, r, n_shingles), and r and sketch of these as a table.

    Sketches are written in parts by print, and a part goes as soon as its classes are known.
    """
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "rows")
    schema = "doc_id long, n_shingles long, print binary, sketch array<int>"
    with cleaning(spark):
        docs.mapInArrow(_prepare, schema).withColumn("bucket", F.pmod(F.xxhash64("print"), F.lit(BUCKETS)).cast("int")).write.partitionBy("bucket").parquet(path)
    given = spark.read.schema(f"{schema}, bucket int").parquet(path)
    rows = written(given.select("doc_id", "n_shingles", "print"))
    turns = min(BUCKETS, tasks(rows.count(), BUCKET_ROWS))
    classes = None
    for wave in range(turns):
        some = [b for b in range(BUCKETS) if b % turns == wave]
        own = given.where(F.col("bucket").isin(some) & F.col("print").isNotNull() & F.col("doc_id").isNotNull())
        own = own.groupBy("print").agg(F.min("doc_id").alias("r"), F.max("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
        if classes:
            classes.append(own)
        else:
            classes = Stored(own, "classes")
        for b in some:
            discard(spark, f"{path}/bucket={b}")
    discard(spark, path)
    return rows, written(classes.df.drop("sketch")), classes


def near_duplicates(docs: DataFrame, target: float = TARGET, least: int = LEAST) -> DataFrame:
    """documents (doc_id, text) -> a row for each: doc_id, n_shingles, component_id, kept; links from least / MOST on."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows, classes, sketches = prepared(docs)
    reps = sketches.df.select("r", "sketch")
    sizes = classes.groupBy("r").agg(F.max("n_shingles").alias("n_shingles"))
    # Rows of one doc_id with different texts are one document.
    repeated = rows.join(classes.select("print", "r"), "print").where("doc_id != r").select(F.col("r").alias("x"), F.col("doc_id").alias("y")).join(classes.select(F.col("r").alias("y")).distinct(), "y", "left_semi").distinct()
    repeated = written(repeated.select("x", "y"))
    # The first trees hold each class against one other, the smallest that it meets.
    seeds = nodes(reps, 1, SEEDS, least=least)
    links = confirmed(seeds.groupBy("r").agg(F.min("center").alias("x")).where("r != x").select("x", F.col("r").alias("y")), reps, docs, sizes, least).union(repeated)
    known = written(labelled(classes.select("r").distinct(), components(links)))
    ends = nodes(reps, 1, trees_for(target, least), known, least=least)
    stars = ends.where("r != center").select(F.col("center").alias("x"), F.col("r").alias("y")).distinct()
    stars = stars.join(known.select(F.col("r").alias("x"), F.col("component").alias("cx")), "x").join(known.select(F.col("r").alias("y"), F.col("component").alias("cy")), "y").where("cx <> cy").select("x", "y")
    links = links.union(confirmed(stars, reps, docs, sizes, least))
    split = labelled(ends.drop("component"), components(links))
    open_nodes = split.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("node")
    split = written(split.join(open_nodes, "node", "left_semi"))
    groups = split.where(~F.col("dense")).groupBy("node").agg(F.collect_list(F.struct("r", "component")).alias("m"))
    within = F.flatten(F.transform("m", lambda p: F.transform(F.filter("m", lambda q: (p["component"] != q["component"]) & (p["r"] < q["r"])), lambda q: F.struct(p["r"].alias("x"), q["r"].alias("y")))))
    second = groups.select(F.explode(F.array_distinct(within)).alias("p")).select("p.x", "p.y")
    links = links.union(confirmed(second.distinct(), reps, docs, sizes, least))
    sketches.drop()
    crossed = clustered(split.where("dense").select("node", "r", "component", "center"), sizes, docs, least)
    links = links if crossed is None else links.union(crossed)
    final = written(labelled(classes.select("print", "r"), components(links)).select("print", "component"))
    joined = rows.join(final, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.least("component", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The query's rows in DuckDB's SQL: all pairs of documents that share a shingle, and closure over their links.
SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {WORDS - 1}) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE {MOST} * c >= {LEAST} * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS v, y AS r FROM edges UNION SELECT v, y FROM reach JOIN edges ON r = x),
lowest AS (SELECT v, least(v, min(r)) AS component FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN lowest ON v = w.doc_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
