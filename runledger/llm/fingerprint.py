"""Document fingerprints by one-permutation MinHash (operator 7), in DataFrame functions only.

Five-word shingles are hashed once; the top bits of a hash choose one of BINS bins, which
keeps its smallest hash. An empty bin is filled by optimal densification: every bin has its
own pseudo-random order of all bins and borrows from the first non-empty one, so equal sets
of non-empty bins borrow alike. Four low-order bits of each bin are kept, packed as one hex
digit; likeness is the share of equal digits, corrected for the 1/16 that agree by chance.

Defined cases: null text is empty; a text of fewer than five words has one shingle, the
whole sequence; without words the fingerprint is the empty string, which is like another
empty one (1.0) and unlike anything else (0.0); repeated rows (equal doc_id and text) are one
document in the order and get equal results; rows of one doc_id with different texts are
ordered by the texts' hashes; a null doc_id comes last in descending order; the only document
of a table is its own next; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import NON_SPACE_WORD, cut, slots, tidy

BINS, SHIFT, CHANCE = 128, 57, 1 / 16
SHINGLE = 5


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as hex digits in column ``out``."""
    keep = [c for c in df.columns if c != out]
    # each step's arrays are used more than once by the next, so they are computed once a row
    w = df.withColumn("__w", F.transform(F.regexp_extract_all(text, F.lit(NON_SPACE_WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    n = F.size("__w")
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(SHINGLE)]))
    h = w.withColumn("__h", F.sort_array(F.when(n >= SHINGLE, each).when(n > 0, F.array(F.xxhash64("__w"))).otherwise(F.array().cast("array<bigint>"))))
    low = F.filter("__h", lambda x, i: (i == 0) | (F.shiftright(x, SHIFT) != F.shiftright(F.get("__h", i - 1), SHIFT)))
    m = h.select(*keep, low.alias("__m"))
    m = m.withColumn("__b", F.transform("__m", lambda x: F.shiftright(x, SHIFT) + BINS // 2)).select(*keep, "__m", "__b")

    def filled(i):
        own = F.array_position("__b", i)
        # the non-empty bin that comes first in bin i's order; its place rides in the low bits
        lent = F.array_min(F.transform("__b", lambda b, j: F.shiftrightunsigned(F.xxhash64(i, b), 8) * 128 + j)) % 128
        at = F.when(own > 0, own - 1).otherwise(lent).cast("int")
        return F.hex(F.get("__m", at).bitwiseAND(F.lit(15)))

    digits = F.lower(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), filled), ""))
    return m.select(*keep, F.when(F.size("__m") > 0, digits).otherwise("").alias(out))


def likeness(a: str, b: str):
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1)))) / BINS
    fair = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - CHANCE) / (1 - CHANCE)))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(fair)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as (k, h, t): doc_id with null as the smallest long, hash of the text, text. Both
    joins of the texts use exactly these columns, so they share one shuffle."""
    t = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))


def _chain(docs: DataFrame) -> DataFrame:
    """Per distinct document (k, h): n, fp, and nk, nh, nfp of the next by descending id.

    Only ids and fingerprints are sorted; positions come from range partitions, and the
    step from a partition's last row to the next one's first from one row a partition."""
    meta = with_fingerprint(_keyed(docs).select("k", "h", F.length("t").cast("long").alias("n"), "t"), "t", "fp").select("k", "h", "n", "fp")
    one = meta.groupBy("k", "h").agg(F.first("n").alias("n"), F.first("fp").alias("fp"))
    one = cut(one, "fingerprints")
    at = one.select("k", "h").repartitionByRange(slots(docs), F.desc("k"), "h").sortWithinPartitions(F.desc("k"), "h").withColumn("pos", F.monotonically_increasing_id())
    at = cut(at, "order")
    part = F.shiftright("pos", 33)
    ends = at.groupBy(part.alias("p")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    by, whole = Window.orderBy("p"), Window.partitionBy()
    ends = ends.select("last", F.coalesce(F.lead("first").over(by), F.min("first").over(whole)).alias("jump"))
    nxt = at.join(ends, at["pos"] == ends["last"], "left").select("k", "h", F.coalesce("jump", F.col("pos") + 1).alias("pos"))
    nxt = nxt.join(at.select(F.col("k").alias("nk"), F.col("h").alias("nh"), "pos"), "pos").select("k", "h", "nk", "nh")
    after = one.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("fp").alias("nfp"))
    return cut(nxt.join(one, ["k", "h"]).join(after, ["nk", "nh"]), "chain")


@tidy
def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    chain = _chain(docs)
    rows = _keyed(docs)
    lends = chain.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.col("k").alias("rk"), F.col("h").alias("rh"), F.floor(F.col("n") / 3).cast("int").alias("need"), "n", "fp", "nfp")
    lent = rows.join(lends, ["k", "h"]).select("rk", "rh", F.substring(F.col("t"), F.lit(1), F.col("need")).alias("tail"), "need", "n", "fp", "nfp")
    lent = lent.dropDuplicates(["rk", "rh"]).withColumnsRenamed({"rk": "k", "rh": "h"})
    both = rows.join(lent, ["k", "h"])
    edited = F.concat(F.substring(F.col("t"), F.lit(1), (F.col("n") - F.col("need")).cast("int")), F.col("tail"))
    both = both.select(F.nullif(F.col("k"), F.lit(-(1 << 63))).alias("doc_id"), F.col("n").alias("n_chars"), edited.alias("edited"), F.col("fp").alias("fingerprint"), "nfp")
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    both = with_fingerprint(both, "edited", "edited_fingerprint")
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "nfp").alias("near_next"))
