"""Fuzzy line dedup by MinHash (operator 2).

Lines (trimmed, lower-cased) become sets of character shingles: SHINGLE characters from every
character on. Equal lines are one node, told apart by 128 bits of BLAKE2. A node's signature is
a one-permutation MinHash of BINS bins, empty bins borrowing from the first non-empty bin in
their own pseudo-random order; BANDS bands of two bins each give a recall of 0.9997 at a
similarity of 0.8. Nodes that meet in a band are verified by their exact Jaccard similarity.
Bands that hold more than ``wide`` nodes (one passage in many different lines, say) do not try
all their pairs: their nodes are joined by the rarest part of their shingles, which any linked
partner must share, with positional bounds. Links make components by distributed union-find,
and one occurrence of one line per component stays: the first by (doc_id, line_no).

Shingles, signatures and overlaps are numpy over whole Arrow batches (``mapInArrow``); joins,
grouping and components are Spark's. DataFrame functions alone took 1,325 CPU seconds a GB for
the shingles of every character.

Defined cases: null text and blank lines give no row; a line shorter than a shingle is its
own shingle; ties go to the smaller (doc_id, line_no), null doc_id last; rows with equal
(doc_id, line_no) and line share their decision; empty tables give no rows; other columns are
ignored; doc_id is cast to long. Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import connected_components, cut, tidy
from .posting import WIDE, id_filter, linked_roots, meet, near_sizes, shared_posts

SHINGLE, BINS, BANDS = 12, 16, 8
#: Counters of the frequency sketch that orders shingles; fixed, so its broadcast is 2 MB at any size.
SKETCH = 1 << 18
#: Bits of a band's hash: it only proposes pairs, which are verified, and takes 5 bytes of disk instead of 8.
BAND_BITS = 40
#: Characters shingled at a time, unless one line is longer: what the nearest caches hold.
CHUNK = 1 << 16
_SPACE = " \t\n\x0b\x0c\r"
#: A shingle's hash is a polynomial in BASE over mixed code points, built from its parts of 1, 2, 4 and 8.
_BASE = 0x9E3779B97F4A7C15
_POWER = [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(SHINGLE)]
_CODE = tn.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
#: The order in which bin i looks for a bin to borrow from: a fixed pseudo-random permutation each.
_LENDERS = np.argsort(tn.mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(7)).reshape(BINS, BINS), 1)
_ORDER = np.array([[i, *[j for j in row if j != i]] for i, row in enumerate(_LENDERS.tolist())])


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(line_no, line) of the lines that are not blank; line_no counts all lines."""
    return [(i, x) for i, x in enumerate(s.strip(_SPACE) for s in (text or "").lower().split("\n")) if x]


def chunks(sizes: list[int]):
    """Runs i..j of about CHUNK characters."""
    i = 0
    while i < len(sizes):
        j, n = i + 1, sizes[i]
        while j < len(sizes) and n + sizes[j] <= CHUNK:
            n += sizes[j]
            j += 1
        yield i, j
        i = j


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the distinct shingles of each line, ordered by line, then hash."""
    size = np.array([len(x) for x in lines], np.int64)
    text = "".join(lines)
    try:
        points = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.itemsize == 1 or points.max() < len(_CODE):
        codes = _CODE.take(points)
    else:
        codes = tn.mix(points.astype(np.uint64) + np.uint64(1))
    begin = np.cumsum(size) - size
    count = np.maximum(size - SHINGLE, 0) + 1
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), count)
    at = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(count) - count), count)
    two = codes[:-1] * _POWER[1] + codes[1:]
    four = two[:-2] * _POWER[2] + two[2:]
    whole = (four[:-4] * _POWER[4] + four[4:])[:-4] * _POWER[4] + four[8:] if len(codes) >= SHINGLE else codes
    h = whole.take(at, mode="clip")  # beyond the end are short lines only
    for i in np.flatnonzero(size < SHINGLE).tolist():  # a short line is one shingle
        k = int(size[i])
        x = (codes[begin[i] : begin[i] + k] * np.array(_POWER[:k], np.uint64)).sum(dtype=np.uint64) + np.uint64(k)
        h[int(np.searchsorted(owner, np.uint64(i)))] = x
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    # one sort of whole words: the line above, as many bits of the hash below as are left
    bits = np.uint64(max(1, (len(lines) - 1).bit_length()))
    key = owner << (np.uint64(64) - bits) | h >> bits
    key.sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key = key[fresh]
    return (key >> (np.uint64(64) - bits)).astype(np.int64), key << bits


def signatures(line: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, band hashes) of each of n lines, from ``shingles``."""
    count = np.bincount(line, minlength=n)
    cell = line * BINS + (h >> np.uint64(64 - (BINS.bit_length() - 1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
    low = np.zeros(n * BINS, np.uint64)
    full = np.zeros(n * BINS, bool)
    # the lowest bits of a hash depend on how many lines were shingled together
    low[cell[first]], full[cell[first]] = h[first] >> np.uint64(24), True
    low, full = low.reshape(n, BINS), full.reshape(n, BINS)
    out = low + np.arange(BINS, dtype=np.uint64)
    some = np.flatnonzero(~full.all(1))  # lines with an empty bin: most are short
    if len(some):
        from_ = _ORDER[np.arange(BINS), full[some][:, _ORDER].argmax(2)]
        out[some] = low[some[:, None], from_] + from_.astype(np.uint64)
    out = out.reshape(n, BANDS, BINS // BANDS)
    bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    for j in range(BINS // BANDS):
        bands = tn.mix(bands * np.uint64(0x9E3779B97F4A7C15) + out[:, :, j])
    bands >>= np.uint64(64 - BAND_BITS)
    return count, bands


def _scan(batches):
    """(doc_id, line_no, node, n, toks) of every line."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        each = [lines_of(t) for t in texts]
        row = np.repeat(np.arange(len(each)), [len(x) for x in each])
        number = [i for x in each for i, _ in x]
        lines = [s for x in each for _, s in x]
        parts = [signatures(*shingles(lines[i:j]), j - i) for i, j in chunks([len(s) for s in lines])]
        if not parts:
            continue
        count, bands = (np.concatenate(x) for x in zip(*parts))
        node = [blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in lines]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row)), pa.array(number, pa.int64()), pa.array(node, pa.binary()), pa.array(count, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * BANDS), pa.array(tn.signed(bands.ravel())))],
            ["doc_id", "line_no", "node", "n", "toks"],
        )


def _texts(wanted):
    """(node, line) of the lines that a bit map of nodes lets through."""

    def run(batches):
        bits = wanted.value
        top = len(bits) * 8 - 1
        for batch in batches:
            seen: dict[bytes, str] = {}
            for text in batch.column(0).to_pylist():
                for _, s in lines_of(text):
                    node = blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    at = int.from_bytes(node[:8], "big") & top
                    if bits[at >> 3] >> (at & 7) & 1:
                        seen[node] = s
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.string())], ["node", "line"])

    return run


def _place(node: str):
    """The first 8 bytes of a node as a long, for bit maps."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def _overlaps(num: int, den: int):
    """The pairs (a, b, la, lb) whose exact similarity is num/den or more."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(left), bool)
            for i, j in chunks([len(x) + len(y) for x, y in zip(left, right)]):
                n = j - i
                # both sides in one call, so that equal shingles have equal hashes
                line, h = shingles(left[i:j] + right[i:j])
                size = np.bincount(line, minlength=2 * n)
                # a word a shingle, in order of (pair, hash): equal neighbours are shared
                bits = np.uint64(max(1, (2 * n - 1).bit_length()))
                key = np.sort((line % n).astype(np.uint64) << (np.uint64(64) - bits) | h >> bits)
                same = key[1:][key[1:] == key[:-1]]
                both = np.bincount((same >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)
                keep[i:j] = den * both >= num * (size[:n] + size[n:] - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _sketch(batches):
    """Counts of shingles in SKETCH slots, one row a task and slot in use."""
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        lines = batch.column(0).to_pylist()
        for i, j in chunks([len(x) for x in lines]):
            total += np.bincount((shingles(lines[i:j])[1] >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "often"])


def _rarest(order, num: int, den: int):
    """(node, n, toks): of each line the shingles that come first in a global order by
    frequency, one more than a linked partner may lack."""

    def run(batches):
        for batch in batches:
            nodes, lines = batch.column(0), batch.column(1).to_pylist()
            size, toks = [], []
            for i in range(len(lines)):
                # alone, so that a shingle has the same hash wherever it stands
                u = shingles(lines[i : i + 1])[1] >> np.uint64(1)
                by = np.lexsort((u, order.value[(u >> np.uint64(39)).astype(np.int64) % SKETCH]))
                size.append(len(u))
                toks.append(tn.signed(u[by][: len(u) - -(-num * len(u) // den) + 1]))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(size, pa.int32()), tn.lists(toks, pa.int64())], ["node", "n", "toks"])

    return run


def _links(docs: DataFrame, nodes: DataFrame, num: int, den: int, wide: int) -> DataFrame:
    """(a, b) of distinct lines: enough links to connect each component."""
    spark = docs.sparkSession
    posts = shared_posts(nodes).withColumn("pos", F.lit(0))  # bands have no order
    few = cut(near_sizes(meet(posts.where(F.col("c") <= wide)), num, den), "pairs")
    many = posts.where(F.col("c") > wide).select("node").distinct()
    wanted = few.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("many")).union(many.withColumn("many", F.lit(True)))
    wanted = cut(wanted.groupBy("node").agg(F.max("many").alias("many")), "wanted")
    bits = id_filter(wanted.select(_place("node").alias("at")), "at")
    lines = docs.select("text").mapInArrow(_texts(bits), "node binary, line string")
    texts = cut(lines.join(wanted, "node").groupBy("node", "many").agg(F.first("line").alias("line")), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        # pairs move the lines, which are an eighth of their shingles' size
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
        return both.select("a", "b", "la", "lb").mapInArrow(_overlaps(num, den), "a binary, b binary")

    links = verify(few)
    rest = texts.where("many").select("node", "line")
    if rest.isEmpty():
        return links
    often = rest.select("line").mapInArrow(_sketch, "slot int, often long").groupBy("slot").agg(F.sum("often").alias("often"))
    rank = np.zeros(SKETCH, np.int64)
    for slot, n in often.toLocalIterator():  # SKETCH rows at most, whatever the input
        rank[slot] = n
    order = spark.sparkContext.broadcast(rank)
    prefixes = cut(rest.mapInArrow(_rarest(order, num, den), "node binary, n int, toks array<long>"), "prefixes")
    return links.union(linked_roots(prefixes, verify, num, den, wide).select(F.col("node").alias("a"), F.col("root").alias("b")))


@tidy
def _roots(docs: DataFrame, nodes: DataFrame, num: int, den: int, wide: int) -> DataFrame:
    """(node, root) of the lines that have a link; what is cut for it goes before lines are told their class."""
    return connected_components(_links(docs, nodes.select("node", "n", "toks"), num, den, wide))


@tidy
def line_components(docs: DataFrame, num: int = 80, den: int = 100, wide: int = WIDE) -> DataFrame:
    """Per line: doc_id, line_no, n_shingles, first_doc_id, first_line_no of its component,
    and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(docs.mapInArrow(_scan, "doc_id long, line_no long, node binary, n int, toks array<long>"), "lines")
    # null doc_id last
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    nodes = cut(found.groupBy("node").agg(F.first("n").alias("n"), F.first("toks").alias("toks"), F.min(place).alias("low")), "nodes")
    lows = nodes.select("node", "low")
    linked = cut(lows.join(_roots(docs, nodes, num, den, wide), "node"), "linked")
    best = linked.groupBy("root").agg(F.min("low").alias("best"))
    classes = linked.join(best, "root").select("node", "best")
    # most lines have no link: they are the class of their own equal lines
    out = found.select("doc_id", "line_no", "node", "n").join(lows, "node").join(classes, "node", "left").withColumn("best", F.coalesce("best", "low"))
    return out.select("doc_id", "line_no", F.col("n").cast("long").alias("n_shingles"), F.col("best.doc_id").alias("first_doc_id"), F.col("best.line_no").alias("first_line_no"), place.eqNullSafe(F.col("best")).alias("kept"))


@tidy
def deduplicated(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id and text of each document with only the lines that stay and its blank lines, as
    they were, in their order; documents of which no line stays give no row. Rows of one
    doc_id with different texts stay apart; equal ones are one row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").distinct()
    # numbered in the operator's order, by doc_id with null last
    rows = cut(rows.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    found = line_components(rows.select(F.col("row").alias("doc_id"), "text"), num, den)
    keep = found.where("kept").select(F.col("doc_id").alias("row"), F.col("line_no"), F.lit(True).alias("kept"))
    each = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).join(keep, ["row", "line_no"], "left")
    each = each.where(F.col("kept") | (F.btrim("line", F.lit(_SPACE)) == ""))
    each = each.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"), F.max("kept").alias("kept"))
    return each.where("kept").select("doc_id", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))
