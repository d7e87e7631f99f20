"""Scalar text functions. Patterns carry (?U), so that words and blanks are those of Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), the value computed once a row, also where the body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def method_key(c: Column | str) -> Column:
    """Lower case, runs of blanks, dashes and underscores as one underscore, other signs left out."""
    joined = F.regexp_replace(strip(F.lower(col(c))), r"(?U)[_\-\s]+", "_")
    return F.regexp_replace(joined, "[^a-z0-9_]", "")


def plain(c: Column | str) -> Column:
    """Lower case with straight apostrophes and without emphasis marks."""
    return F.regexp_replace(F.replace(F.lower(col(c)), F.lit("’"), F.lit("'")), "[*`]+", "")


def truncated(c: Column | str, most: int = 100) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("..."))).otherwise(col(c))


def parsed(c: Column | str, schema: str) -> tuple[Column, Column]:
    """(value, error) of a JSON text: null value and a message where it can't be read."""
    valid = F.try_parse_json(col(c)).isNotNull()
    return F.when(valid, F.from_json(col(c), schema)), F.when(~valid & col(c).isNotNull(), F.lit("invalid JSON"))


def pieces(c: Column | str, delimiter: str) -> Column:
    """Split at a literal delimiter."""
    return F.split(col(c), r"\Q" + delimiter + r"\E", -1)


#: Numbers that `running` adds up one by one before it starts a new array.
CHUNK = 128


def running(numbers: Column, chunk: int = CHUNK) -> Column:
    """Sums up to and with each number. Arrays that grow are bounded by the chunk and by the number of chunks."""
    none = F.array().cast("array<bigint>")
    add = lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + x))

    def joined(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x))
        sums = lambda ahead: F.transform(chunks, lambda c, k: F.transform(F.aggregate(c, none, add), lambda x: x + F.when(k > 0, F.get(ahead, k - 1)).otherwise(F.lit(0))))
        return F.flatten(let(F.aggregate(totals, none, add), sums))

    def chunks(all_of: Column) -> Column:
        numbered = F.when(F.size(all_of) > 0, F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbered, lambda k: F.slice(all_of, k * chunk + 1, F.lit(chunk)))

    return let(let(numbers, chunks), joined)


def spans(text: Column, pattern: Column) -> Column:
    """array<struct<start, end>> of a pattern's matches, from the lengths of what matches and what lies between."""
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("gaps"))
    lengths = lambda f: F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["whole"])), f["whole"], lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n")))
    ends = lambda steps: running(F.transform(steps, lambda x: (x["gap"] + x["n"]).cast("bigint")))
    placed = lambda steps: F.zip_with(ends(steps), steps, lambda e, x: F.struct((e - x["n"]).cast("int").alias("start"), e.cast("int").alias("end")))
    return F.when(F.rlike(text, pattern), let(let(found, lengths), placed)).otherwise(F.array().cast("array<struct<start: int, end: int>>"))
