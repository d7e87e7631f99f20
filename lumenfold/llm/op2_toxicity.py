"""Toxicity: a subsequence string-kernel machine on Nystroem landmarks.

The kernel counts common subsequences of three letters, each occurrence weighted by DECAY to the length that it spans
(SPAN at most), normalised; gaps and inserted characters lower it but don't break it. Units are a sentence's words
with signs taken out, digits and signs inside read as the letters they stand for, and runs of single letters joined.

Training takes a bounded sample of labelled documents, apart into sentences. A document's label holds for its sentences
together: all sentences of one that isn't toxic are negative, and of a toxic one some sentence is positive, which one
is to be learnt. So it goes in rounds. In each, a clean sentence stands for its unit of the highest value, as a negative
example, and the sentences of toxic documents that are positive so far stand for the units that make them so. Landmarks
are drawn from both; a squared-hinge machine is trained on the Nystroem features of the examples, each weighted by its
sentences, and its values choose the next round's positive sentences and hardest negative ones, until no clean sentence
is new among these. In the first round the log-odds of units in toxic documents choose.
Machine and landmarks fold into one table of weights by subsequence, so that scoring a word is a few look-ups, equal to
the sum over landmarks. A document's score is a calibrated function of its two highest units and its length.

A null or empty text has no units and still gets a score, that of no evidence. A text of any length is scored whole; a
word beyond LONGEST letters counts by its best window of that many. Nulls in labels leave a row out of
training; several labels of a doc_id are averaged. Equal rows are scored alike. Without both labels in the sample
each document scores the sample's rate (0 if there is none). Other columns are never read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.held import held, trim
from lumenfold.llm.labelled import held_out, labelled_sample
from lumenfold.llm.linear import Calibration, svm
from lumenfold.session import read_table, ship

#: Labelled documents to train on at most.
SAMPLE = 5_000
LANDMARKS = 160
#: Rounds of training at most, and negative examples of a round: so many of the hardest, and as many others.
ROUNDS = 4
EXAMPLES = 3_000
DECAY = 0.7
SPAN = 6
LETTERS = 64
LONGEST = 40
UNITS = 200_000
CHUNK = 4_000
#: Letters that digits and signs stand for inside a word.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
STRIPPED = "\"'`.,;:!?()[]{}<>*#$%&|-_=+/\\~^@…“”‘’«»¡¿"
#: What ends a sentence.
ENDS = re.compile(r"[.!?\u2026]+(?=\s)|\n+")
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def unit(token: str) -> str:
    inner = token.strip(STRIPPED)
    if inner.isalpha():
        return inner
    return "".join(filter(str.isalpha, inner.translate(STANDS_FOR)))


def joined(tokens: list[str]) -> Iterator[str]:
    """Runs of three or more single letters, as one word."""
    run: list[str] = []
    for token in [*tokens, "  "]:
        if len(inner := token.strip(STRIPPED)) == 1:
            run.append(inner.translate(STANDS_FOR))
        else:
            if len(run) >= 3:
                yield "".join(filter(str.isalpha, run))
            run = []


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all words in a row, each after a mark of its start, and which word each belongs to."""
    text = "".join("\x00" + w for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.cumsum(code == 0) - 1
    plain = (code >= 97) & (code <= 122)
    return np.where(code == 0, 0, np.where(plain, code - 96, 27 + code % (LETTERS - 27))), owner


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, subsequence and weight of each occurrence of three letters that span SPAN at most."""
    code, owner = letters(words)
    found = []
    for b in range(2, SPAN):
        if len(code) <= b:
            break
        at = np.flatnonzero(owner[:-b] == owner[b:])
        for a in range(1, b):
            found.append((owner[at], (code[at] * LETTERS + code[at + a]) * LETTERS + code[at + b], np.full(len(at), DECAY ** (b + 1))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """subsequences() summed by word and subsequence and scaled to length one."""
    owner, code, weight = subsequences(words)
    key, at = np.unique(owner * LETTERS**3 + code, return_inverse=True)
    value = np.bincount(at, weight, len(key)) if len(key) else np.zeros(0)
    owner = key // LETTERS**3
    norm = np.sqrt(np.bincount(owner, value**2, len(words))) if len(key) else np.zeros(len(words))
    return owner, key % LETTERS**3, value / norm[owner] if len(key) else value


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    owner, code, value = vectors(landmarks)
    used, at = np.unique(code, return_inverse=True)
    place = np.full(LETTERS**3, -1, np.int32)
    place[used] = np.arange(len(used))
    dense = np.zeros((len(used), len(landmarks)), np.float32)
    dense[at, owner] = value
    out = np.zeros((len(words), len(landmarks)))
    for start in range(0, len(words), 1000):
        o, c, v = vectors(words[start : start + 1000])
        hit = place[c] >= 0
        part = np.zeros((min(1000, len(words) - start), len(used)), np.float32)
        part[o[hit], place[c[hit]]] = v[hit]
        out[start : start + 1000] = part @ dense
    return out


class Scorer:
    """Positive part of the machine's value for single words, by table; known words are kept, UNITS at most."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.known: dict[str, float] = {}
        shape = np.arange(LONGEST + 2)
        self.least = np.sqrt(sum((b - 1) * np.maximum(shape - b, 0) * DECAY ** (2 * (b + 1)) for b in range(2, SPAN))) + 1e-9

    def score(self, words: list[str]) -> np.ndarray:
        """Words beyond LONGEST letters count by their best window of that many."""
        if any(len(w) > LONGEST for w in words):
            pieces = [(i, w[k : k + LONGEST]) for i, w in enumerate(words) for k in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2)]
            out = np.zeros(len(words))
            np.maximum.at(out, [i for i, _ in pieces], self.score([p for _, p in pieces]))
            return out
        if len(words) > CHUNK:
            return np.concatenate([self.score(words[k : k + CHUNK]) for k in range(0, len(words), CHUNK)])
        owner, code, weight = subsequences(words)
        raw = np.bincount(owner, self.table[code] * weight, len(words)) if len(owner) else np.zeros(len(words))
        # No norm is below that of a word without repeated subsequences, so few words need theirs.
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        near = np.flatnonzero(raw / self.least[size] > 0.2)
        out = np.zeros(len(words))
        if len(near):
            o, c, v = vectors([words[i] for i in near])
            out[near] = np.maximum(0, np.bincount(o, self.table[c] * v, len(near)))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: highest unit, second highest, logarithm of its tokens."""
        if len(texts) > 100:
            return np.concatenate([self.features(texts[k : k + 100]) for k in range(0, len(texts), 100)])
        known, units = self.known, []
        for text in texts:
            tokens = (text or "").lower().split()
            found = set(tokens)
            found.update("\x01" + j for j in joined(tokens))
            units.append((found, len(tokens)))
        new = {t for found, _ in units for t in found if t not in known}
        if len(known) + len(new) > UNITS:
            known.clear()
            new = {t for found, _ in units for t in found}
        fresh = list(new)
        known.update(zip(fresh, self.score([t[1:] if t[0] == "\x01" else unit(t) for t in fresh]).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        for k, (found, n) in enumerate(units):
            first = second = 0.0
            for v in map(known.__getitem__, found):
                if v > second:
                    first, second = (v, first) if v > first else (first, v)
            out[k] = first, second, math.log1p(n)
        return out


class Sentences:
    """Units of all sentences of all texts, as numbers in one array, with each sentence's begin and its text."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        flat, begins, owner = array("i"), array("i"), array("i")
        for k, text in enumerate(texts):
            for sentence in ENDS.split((text or "").lower()):
                tokens = sentence.split()
                units = {u for u in map(unit, set(tokens)) if 2 <= len(u) <= LONGEST} | {j for j in joined(tokens) if len(j) <= LONGEST}
                if units:
                    begins.append(len(flat))
                    owner.append(k)
                    flat.extend([known.setdefault(u, len(known)) for u in sorted(units)])
        self.units = list(known)
        self.flat, self.begins, self.owner = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (flat, begins, owner))
        self.lengths = np.diff(np.r_[self.begins, len(self.flat)])

    def documents_with(self, chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen texts each unit is."""
        owner = np.repeat(self.owner, self.lengths)
        mine = chosen[owner]
        pairs = np.unique(owner[mine].astype(np.int64) * len(self.units) + self.flat[mine])
        return np.bincount(pairs % max(1, len(self.units)), minlength=len(self.units))

    def best(self, value: np.ndarray) -> np.ndarray:
        """Each sentence's unit of the highest value."""
        most = np.repeat(np.maximum.reduceat(value[self.flat], self.begins), self.lengths)
        at = np.flatnonzero(value[self.flat] == most)
        which = np.repeat(np.arange(len(self.begins)), self.lengths)[at]
        return self.flat[at[np.unique(which, return_index=True)[1]]]


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS):
    """-> (table of weights by subsequence, calibration), or the rate if one of the labels is missing."""
    if len(texts) == 0 or toxic.all() or not toxic.any():
        return float(toxic.mean()) if len(texts) else 0.0
    rng = np.random.default_rng(5)
    said = Sentences(texts)
    if not len(said.begins):
        return float(toxic.mean())
    bad, good = said.documents_with(toxic), said.documents_with(~toxic)
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    least = 3 if n_bad > 100 else 2
    odds = np.log((bad + 0.5) / n_bad) - np.log((good + 0.5) / n_good)
    # Units that toxic documents have so much more often may make a sentence positive, however rare they are.
    telling = bad / n_bad > 8 * good / n_good
    weight = np.where(telling & (bad >= least), bad * odds, 0)
    # The likelihood ratio against chance must outweigh the number of units tried; a small sample may have none such.
    rate = (bad + good) / len(texts)
    ratio = bad * np.log(np.maximum(bad / n_bad, 1e-9) / rate) + good * np.log(np.maximum(good / n_good, 1e-9) / rate)
    beyond = (weight >= 0.05 * weight.max()) & (weight > 0) & (ratio >= math.log(10 * len(odds)))
    sure = np.flatnonzero(beyond if beyond.any() else (weight > 0) & (weight >= 0.05 * weight.max()))
    if not len(sure) or not (good > 0).any():
        return float(toxic.mean())
    value = np.full(len(odds), -1.0)
    value[sure] = odds[sure]
    of_toxic = toxic[said.owner]
    n_clean = np.zeros(len(odds), np.int64)
    table, positives, negatives = None, sure, np.zeros(0, np.int64)
    for number in range(ROUNDS):
        best = said.best(value)
        clean, times = np.unique(best[~of_toxic], return_counts=True)
        n_clean[clean] = np.maximum(n_clean[clean], times)
        if table is not None:
            # Sentences of toxic documents that are positive by now: by units that are written like a sure one.
            found = np.flatnonzero(telling & (value > 0.5))
            like = kernel([said.units[u] for u in found], [said.units[u] for u in sure]).max(axis=1) if len(found) else np.zeros(0)
            positives = np.union1d(sure, found[like > 0.7])
        clean = np.setdiff1d(clean, positives)
        wrong = clean[value[clean] > 0.35]
        if table is not None and not len(np.setdiff1d(wrong, negatives)):
            break
        # The hardest examples, and at first a draw from all, so that the matrix is of a bounded size.
        hard = wrong[np.argsort(-value[wrong], kind="stable")[:EXAMPLES]]
        drawn = clean[rng.permutation(len(clean))[: 0 if number else EXAMPLES]]
        common = clean[np.argsort(-n_clean[clean], kind="stable")[: 0 if number else EXAMPLES]]
        negatives = np.setdiff1d(np.unique(np.r_[negatives, hard, drawn, common]), positives)
        if not len(negatives):
            break
        n_positive, n_negative = bad[positives], np.maximum(1, n_clean[negatives])
        by_count = positives[np.argsort(-n_positive, kind="stable")][: landmarks // 2]
        # Half of the landmarks of negative sentences are the hardest of them, the others any.
        spread = np.r_[negatives[np.argsort(-value[negatives], kind="stable")[: landmarks // 4]], negatives[rng.permutation(len(negatives))]]
        points = [said.units[u] for u in dict.fromkeys([*by_count.tolist(), *spread.tolist()])][:landmarks]
        inner = kernel(points, points) + 1e-6 * np.eye(len(points))
        scale, vector = np.linalg.eigh(inner)
        half_inverse = (vector / np.sqrt(np.maximum(scale, 1e-8))) @ vector.T
        examples = [said.units[u] for u in np.r_[positives, negatives]]
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        share = np.r_[n_positive / n_positive.sum(), n_negative / n_negative.sum()]
        # A common example counts by the root of its sentences: one word must not be all that is learnt.
        share = np.sqrt(share)
        share = np.r_[share[: len(positives)] / share[: len(positives)].sum(), share[len(positives) :] / share[len(positives) :].sum()]
        w, bias = svm(kernel(examples, points) @ half_inverse, y, share * 50)
        owner, code, v = vectors(points)
        table = np.bincount(code, v * (half_inverse @ w)[owner], LETTERS**3)
        # Values are read against the bias: 1 is a unit on the positive margin, 0.5 on the boundary.
        table = table / max(1e-6, 2 * -bias if bias < 0 else 1.0)
        value = Scorer(table).score(said.units)
    if table is None:
        return float(toxic.mean())
    del said
    return table.astype(np.float32), Calibration(shaped(Scorer(table).features(texts)), toxic.astype(float))


def shaped(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.maximum(0, x[:, 0] - 0.5), np.maximum(0, x[:, 1] - 0.5)]


def _mapper(model, whole: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        own = None if isinstance(fitted, float) else held(("scorer", hash(fitted[0].tobytes())), lambda: Scorer(fitted[0]))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(2).field("text") if whole else part.column(2)
                if own is None:
                    p = np.full(part.num_rows, fitted)
                else:
                    p = fitted[1](shaped(own.features(texts.to_pylist())))
                columns = [part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [part.column(2)] * whole, ["doc_id", "held_out", "score", "predicted"] + ["row"] * whole)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, whole: bool = False) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted.

    whole: with the document's columns, in a struct `row` where their names clash with nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = labelled_sample(docs, labels, "toxic", ~held_out(5, 0), sample)
    fitted = spark.sparkContext.broadcast(train([r["text"] for r in rows], np.array([r["label"] for r in rows], bool)))
    del rows
    trim()
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if whole else F.col("text")
    own = docs.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), given)
    schema = T.StructType([*T.StructType.fromDDL(RESULT).fields, *own.schema.fields[2:][: int(whole)]])
    return own.mapInArrow(_mapper(fitted, whole), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
