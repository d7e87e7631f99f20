"""Secret scans: known shapes by pattern, and unknown ones by the entropy of a window sliding over candidate strings.

All of it is SQL functions. Offsets are running sums of the lengths of what a pattern matches and of what lies between.
A candidate is a run of CANDIDATE characters. A window of WINDOW characters slides over it; the state keeps how often
each character is in the window, and how many are of each class. The character that enters and the one that leaves
change two of the counts, and with them the sum of n log n that the entropy comes from, so each step costs the same. A
window tells by its class: hexadecimal, one letter case with digits, mixed case with digits, or mixed case without,
each with a threshold of its own in bits a character. A candidate with a telling window is reported whole, unless it is
on the allow-list or overlaps a known shape.

A path is allowed where at least half of the pieces between its slashes are plain words, so a key that holds slashes
by chance is not taken for one.

A null or empty text has no spans. A text of any length, or with any number of matches, is scanned whole, in time in
proportion to both. Rows are scanned one by one, so equal rows and null or equal doc_ids don't matter; other columns
are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import let, running
from lumenfold.session import read_table, spread

#: The contract's patterns, in the order of its kinds; group whose length counts, and the least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Patterns that match nothing shorter than what counts, where leaving short matches out can't move the others.
FINDERS = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character from which a window tells.
HEX_BITS, CASE_BITS, MIXED_BITS, LETTER_BITS = 3.0, 3.4, 3.6, 4.0
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[0-9/_=+-]*$",  # numbers and rules
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,}",
    r"(?i)^(sha(1|256|384|512)|md5)-",  # integrity marks
    r"^\d{4}-\d{2}-\d{2}",  # dates
)
#: Character codes from which the window's counts run, and how many: those of CANDIDATE lie among them.
FIRST_CODE, CODES = ord("+"), ord("z") - ord("+") + 1
PLAIN_WORD = "^[A-Z]?[a-z]*$"
SPAN = "struct<start: int, kind: int, end: int>"


def placed(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<struct<start, kind, end, s>> of a pattern's matches whose group is long enough, in their order."""
    regex = F.lit(pattern)
    found = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"), F.regexp_extract_all(text, regex, F.lit(group)).alias("part"), F.split(text, pattern, -1).alias("gaps"))

    def ended(f: Column) -> Column:
        return running(F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["whole"])), f["whole"], lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint")))

    def spans(f: Column) -> Column:
        own = F.zip_with(F.arrays_zip(f["whole"].alias("whole"), f["part"].alias("part")), ended(f), lambda m, end: F.struct((end - F.length(m["whole"])).cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), m["whole"].alias("s"), F.length(m["part"]).alias("counted")))
        return F.transform(F.filter(own, lambda m: m["counted"] >= least), lambda m: m.dropFields("counted"))

    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.array().cast("array<struct<start: int, kind: int, end: int, s: string>>"))


def telling(s: Column, window: int = WINDOW) -> Column:
    """Whether some window of the string has the entropy of a secret."""
    n_log_n = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    kinds = {"lower": (97, 122), "upper": (65, 90), "digit": (48, 57)}

    def step(codes: Column, a: Column, i: Column) -> Column:
        """a: the state before the character at i enters and, once the window is full, the one `window` before it leaves."""
        enters, leaves = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
        of = lambda c, low, high: c.between(low, high).cast("int")
        is_hex = lambda c: of(c, 48, 57) + of(c, 65, 70) + of(c, 97, 102)
        counts = {k: a[k] + of(enters, *r) - of(leaves, *r) for k, r in kinds.items()} | {"hex": a["hex"] + is_hex(enters) - is_hex(leaves)}
        has = F.get(a["n"], enters - FIRST_CODE)
        log = lambda n: F.get(n_log_n, n)
        # With the entering character in, what leaves is counted with it where they are the same.
        had = F.when(i >= window, F.get(a["n"], leaves - FIRST_CODE) + (enters == leaves).cast("int"))
        total = a["sum"] + log(has + 1) - log(has) + F.coalesce(log(had - 1) - log(had), F.lit(0.0))
        kept = F.transform(a["n"], lambda n, k: n + (k == enters - FIRST_CODE).cast("int") - (k == leaves - FIRST_CODE).cast("int"))
        bits = F.lit(math.log2(window)) - total / window
        mixed = (counts["lower"] > 0) & (counts["upper"] > 0)
        one_case = (counts["digit"] > 2) & (counts["lower"] + counts["upper"] > 2)
        hexadecimal = (counts["hex"] == window) & (counts["digit"] > 2) & (counts["digit"] < window)
        high = (mixed & (counts["digit"] > 1) & (bits >= MIXED_BITS)) | (mixed & (bits >= LETTER_BITS)) | (one_case & ~hexadecimal & (bits >= CASE_BITS)) | (hexadecimal & (bits >= HEX_BITS))
        return F.struct(kept.alias("n"), total.alias("sum"), *(counts[k].alias(k) for k in counts), (a["tells"] | ((i >= window - 1) & high)).alias("tells"))

    zero = F.struct(F.array_repeat(F.lit(0), CODES).alias("n"), F.lit(0.0).alias("sum"), *(F.lit(0).alias(k) for k in (*kinds, "hex")), F.lit(False).alias("tells"))

    def walk(codes: Column) -> Column:
        # After a telling window the rest of the string is skipped.
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, lambda a, i: F.when(a["tells"], a).otherwise(step(codes, a, i)), lambda a: a["tells"])

    return let(F.transform(F.split(s, ""), F.ascii), walk)


def overlapped(base: Column, run: Column) -> Column:
    """Whether one of the spans, which are in order and apart from each other, overlaps the run; by halving."""
    start = F.struct(F.lit(0).alias("low"), F.size(base).alias("high"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        before = F.get(base, middle)["start"] < run["end"]
        halved = F.struct(F.when(before, middle + 1).otherwise(a["low"]).alias("low"), F.when(before, a["high"]).otherwise(middle).alias("high"))
        return F.when(a["low"] >= a["high"], a).otherwise(halved)

    # The last span that starts before the run ends.
    last = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(base) + 1)).cast("int") + 1), start, halve, lambda a: a["low"] - 1)
    return F.coalesce(F.get(base, last)["end"] > run["start"], F.lit(False))


def path(s: Column) -> Column:
    return s.contains("/") & let(F.split(s, "/"), lambda p: 2 * F.size(F.filter(p, lambda w: w.rlike(PLAIN_WORD))) >= F.size(p))


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """documents (doc_id, text) -> doc_id, text, base and added: array<struct<start, kind, end>>, by start and kind.

    Kinds 0 to 2 are BASE's, 3 is a candidate of high entropy; offsets in code points, end exclusive. Without an
    allow-list nothing is suppressed.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bare = lambda spans: F.transform(spans, lambda s: s.dropFields("s"))
    base = [bare(placed(text, FINDERS.get(name, pattern), group, least, kind)).alias(name) for kind, (name, pattern, group, least) in enumerate(BASE)]
    suppressed = lambda s: F.lit(False) if not allowed else s.rlike("|".join(f"(?:{p})" for p in allowed)) | path(s)
    clear = lambda r: reduce(lambda a, b: a & b, (~overlapped(F.col(f"_base.{name}"), r) for name, *_ in BASE))
    likely = lambda s: s.rlike("[0-9]") | (s.rlike("[a-z]") & s.rlike("[A-Z]"))
    rows = rows.withColumn("_base", F.struct(*base)).withColumn("_runs", F.filter(placed(text, CANDIDATE, 0, WINDOW, len(BASE)), lambda r: likely(r["s"]) & ~suppressed(r["s"])))
    added = bare(F.filter("_runs", lambda r: clear(r) & telling(r["s"])))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*(F.col(f"_base.{name}") for name, *_ in BASE))).alias("base"), added.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    names = [name for name, *_ in BASE] + ["entropy"]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, names)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def _matches(kind: int, pattern: str, group: int, least: int) -> str:
    text, p = "coalesce(text, '')", pattern.replace("'", "''")
    return f"SELECT doc_id, {kind} AS kind, {least} AS least, regexp_extract_all({text}, '{p}', 0) AS whole, regexp_extract_all({text}, '{p}', {group}) AS part, string_split_regex({text}, '{p}') AS gaps FROM documents"


_KINDS = [*((k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(BASE)), (len(BASE), CANDIDATE, 0, WINDOW)]
_CLASS = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "hexa": "0-9a-fA-F"}
#: The query's rows in DuckDB's SQL, each window's entropy counted anew.
SQL = f"""WITH m AS ({" UNION ALL ".join(_matches(*k) for k in _KINDS)}),
one AS (SELECT doc_id, kind, least, unnest(whole) AS s, unnest(part) AS part, unnest(gaps[1:len(whole)]) AS gap, generate_subscripts(whole, 1) AS k FROM m WHERE len(whole) > 0),
placed AS (SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM one),
span AS (SELECT doc_id, kind, s, (stop - length(s))::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE length(part) >= least),
base AS (SELECT * FROM span WHERE kind < {len(BASE)}),
run AS (SELECT * FROM span r WHERE kind = {len(BASE)} AND (regexp_matches(s, '[0-9]') OR regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]')) AND NOT ({" OR ".join(f"regexp_matches(s, '{p}')" for p in ALLOWED)})
  AND NOT (contains(s, '/') AND 2 * len([w FOR w IN string_split(s, '/') IF regexp_matches(w, '{PLAIN_WORD}')]) >= len(string_split(s, '/')))
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r.stop AND r.start < b.stop)),
win AS (SELECT doc_id, start, w, list_entropy(string_split(w, '')) AS bits, {", ".join(f"length(regexp_replace(w, '[^{c}]', '', 'g')) AS {n}" for n, c in _CLASS.items())} FROM (SELECT doc_id, start, substr(s, i, {WINDOW}) AS w FROM (SELECT *, unnest(range(1, length(s) - {WINDOW} + 2)) AS i FROM run))),
tells AS (SELECT DISTINCT doc_id, start FROM (SELECT *, hexa = {WINDOW} AND digit > 2 AND digit < {WINDOW} AS is_hex FROM win)
  WHERE lower > 0 AND upper > 0 AND (digit > 1 AND bits >= {MIXED_BITS} OR bits >= {LETTER_BITS}) OR is_hex AND bits >= {HEX_BITS} OR NOT is_hex AND digit > 2 AND lower + upper > 2 AND bits >= {CASE_BITS}),
kept AS (SELECT * FROM base UNION ALL SELECT run.* FROM run JOIN tells USING (doc_id, start)),
shown AS (SELECT doc_id, kind, start, ['{"', '".join([n for n, *_ in BASE] + ["entropy"])}'][kind + 1] || ':' || start || ':' || stop AS t FROM kept),
found AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(t, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS of_base, string_agg(t, ',' ORDER BY start, kind) AS spans FROM shown GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(of_base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN found USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))))
