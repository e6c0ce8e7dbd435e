"""Secret scans (operator 8), in DataFrame functions only.

Base kinds are regexes: assign, access and hex. The method adds ``entropy`` spans: candidate
strings of the base64 alphabet fall into character classes (hex, letters alone in both cases,
mixed) and are slid over by a window of WINDOW characters whose
symbol counts are kept incrementally (one in, one out); the highest Shannon entropy of a
window is held against the threshold of the candidate's character class, and candidates on
the allow list (placeholders, runs, identifiers) are suppressed. The allow list never touches
base spans.

Positions: the pieces that ``split`` leaves around a regex's matches and the matches
themselves, in turn, add up to code-point offsets. The running sums go by blocks of about the
square root of their number, so many matches in one text cost no square.

Defined cases: null text is empty; a text without secrets has zero counts, the digest of the
empty string and an empty span list; overlapping spans of different kinds all count; repeated
rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds, in the order they are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
#: Candidates mix letters and digits, or capitals and small letters; digits alone are a number.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])|(?=[a-z]*[A-Z])(?=[A-Z]*[a-z]))[A-Za-z0-9+/_=-]{20,}"
IS_HEX, IS_LETTERS = r"\A[0-9A-Fa-f]+\z", r"\A[A-Za-z]+\z"
#: Bits a character of the richest window, by class; joined words stay below the letters' 4.1.
HEX_BITS, LETTER_BITS, BASE64_BITS = 2.8, 4.1, 3.7
# The allow list, matched in lower case anywhere in a candidate.
ALLOWED = r"example|sample|placeholder|changeme|dummy|your[_-]?|xxxx|0000000|1234567|abcdefg|\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def _sums(sizes):
    """Running sums of a short array."""
    return F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))


def running(sizes):
    """Running sums of an array, by blocks of about the square root of its length."""
    width = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / width).cast("int")), lambda b: F.slice(sizes, b * width + 1, width))
    inside = F.transform(blocks, _sums)
    # where each block begins; zip_with makes both of its arrays once, a lambda would for each element
    begins = F.concat(F.array(F.lit(0)), _sums(F.transform(inside, lambda x: F.element_at(x, -1))))
    moved = F.zip_with(inside, F.slice(begins, F.lit(1), F.size(begins) - 1), lambda x, b: F.transform(x, lambda v: v + b))
    return F.when(F.size(sizes) > 0, F.flatten(moved)).otherwise(F.array().cast("array<int>"))


def with_spans(rows: DataFrame, text: str, regex: str, kind: int, name: str, keep=None) -> DataFrame:
    """``rows`` with all matches as structs (start, kind, end, value) in order, in the column
    ``name``; ``keep`` filters values."""
    own = rows.columns
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    some = F.col(text).rlike(regex)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    # step by step, so that each array is made once
    rows = rows.withColumn("_values", F.when(some, found))
    rows = rows.withColumn("_turns", F.when(F.col("_values").isNotNull(), F.zip_with(F.slice(F.split(text, regex), F.lit(1), F.size("_values")), "_values", lambda p, v: F.length(p) + F.length(v))))
    rows = rows.withColumn("_ends", running(F.col("_turns")))
    spans = F.zip_with("_ends", "_values", lambda e, v: F.struct((e - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), v.alias("value")))
    spans = F.filter(spans, lambda s: keep(s["value"])) if keep else spans
    return rows.select(*own, F.when(F.col("_values").isNotNull(), spans).otherwise(none).alias(name))


def _xlog(c):
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)


def window_entropy(value):
    """Highest Shannon entropy, in bits, of WINDOW consecutive characters of a candidate.

    A step takes one character in and one out and adjusts the sum of c * log2(c) by what their
    two counts become; the characters ride in the accumulator, so they are split once."""
    zero = F.struct(F.split(value, "").alias("x"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def count(x, first, size, c):
        return F.size(F.filter(F.slice(x, first, size), lambda v: v == c))

    def step(acc, i):
        x, begin = acc["x"], F.greatest(i - WINDOW, F.lit(1))
        more = count(x, begin, i - begin, F.element_at(x, i))
        s = acc["s"] + _xlog(more + 1) - _xlog(more)
        less = count(x, begin, i - begin + 1, F.element_at(x, begin))
        s = F.when(i > WINDOW, s + _xlog(less - 1) - _xlog(less)).otherwise(s)
        bits = F.log2(F.lit(float(WINDOW))) - s / WINDOW
        return F.struct(x.alias("x"), s.alias("s"), F.when(i >= WINDOW, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), zero, step, lambda a: a["best"])


def _random(value):
    limit = F.when(value.rlike(IS_HEX), HEX_BITS).when(value.rlike(IS_LETTERS), LETTER_BITS).otherwise(BASE64_BITS)
    return ~F.lower(value).rlike(ALLOWED) & (window_entropy(value) >= limit)


def _joined(spans):
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy per row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = with_spans(rows, "t", ASSIGN, 0, "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 6)
    rows = with_spans(rows, "t", ACCESS, 1, "access")
    rows = with_spans(rows, "t", HEX, 2, "hex")
    rows = with_spans(rows, "t", CANDIDATE, 3, "entropy", _random).drop("t")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.withColumns({"base": base, "every": F.array_sort(F.concat("assign", "access", "hex", "entropy"))})
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts[:3], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), counts[3])
