"""N-gram Jaccard join by vertical partitioning (operator 9).

Documents are sets of word n-grams. Texts with equal sets collapse into one *class* first,
so a group of exact copies costs one row. A global n-gram order (frequency class from a
fixed-size count sketch, then hash) is cut at pivots into FRAGMENTS ranges that hold about
equally many n-gram occurrences; every class is cut into segments, one a fragment. The
overlap of two classes is the sum of what they share in each fragment: each fragment counts
its part on its own, only the counts travel on, and they are summed per pair.

Which pairs are counted is settled by the rare end of the order: two classes can link only
if they share an n-gram of their prefixes (size - ceil(t * size) + 1 n-grams from the rare
end), within length and positional bounds. An n-gram shared by more than ``wide`` classes
first links every class to a few leaders of its list; only classes that are still in
different components are then compared with each other, so a big group of copies does not
become all its pairs, and no link between components is lost. Components come from
distributed union-find.

Defined cases: null or blank text has no n-grams and links with nothing; fewer words than n
make one n-gram of the whole sequence; repeated rows each get a result row; a null doc_id is
a row like any other, and gives way to a non-null id as the smallest of its component;
other columns are ignored; doc_id is cast to long. N-grams are compared by 64-bit hash,
classes by a 64-bit hash of the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import cut, fresh, tidy, without
from .posting import WIDE, id_filter, linked_roots, passing

#: Counters of the frequency sketch, in blocks of BLOCK; fixed, so the broadcast is 8 MB at any size.
SKETCH, BLOCK = 1 << 23, 1 << 16
FRAGMENTS = 8


def _set_hash(u: np.ndarray) -> int:
    if not len(u):
        return 0
    x = (int(tn.mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) + len(u) * 0x9E3779B97F4A7C15) % (1 << 64)
    return x - (1 << 64) * (x >> 63)


def _sets(n: int, with_sketch: bool):
    """Per row (id, n_shingles, node); at the end of a task its sketch in blocks."""

    def run(batches):
        total, waiting = np.zeros(SKETCH, np.uint32), []

        def add() -> None:
            if waiting:
                total[:] += np.bincount(np.concatenate(waiting), minlength=SKETCH).astype(np.uint32)
                waiting.clear()

        for batch in batches:
            count, node = [], []
            for w in tn.words(batch.column(1), "space"):
                own = list(tn.shingle_sets(w, n))
                count += map(len, own)
                node += map(_set_hash, own)
                if with_sketch and own:
                    waiting.append((np.concatenate(own) & np.uint64(SKETCH - 1)).astype(np.int32))
                    if sum(map(len, waiting)) > SKETCH // 4:
                        add()
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(node, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], ["id", "n", "node", "block", "counts"])
        add()
        if with_sketch and total.any():
            parts = [pa.compress(total[i : i + BLOCK].tobytes(), "zstd", asbytes=True) for i in range(0, SKETCH, BLOCK)]
            rows = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.array(range(rows), pa.int32()), pa.array(parts, pa.binary())], ["id", "n", "node", "block", "counts"])

    return run


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(pa.decompress(counts, BLOCK * 4, "zstd"), np.uint32)
            total[block] = total[block] + part if block in total else part.copy()
    out = [(b, np.minimum(255, np.round(8 * np.log2(1.0 + t))).astype(np.uint8).tobytes()) for b, t in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([t for _, t in out], pa.binary())], ["block", "classes"])


def _order_keys(u: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places in the global order: frequency class above, hash below."""
    return rank[(u & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | u >> np.uint64(8)


def pivots(rank: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Keys that cut the global order into ranges of about equally many occurrences. Within a
    frequency class hashes are uniform, so a cut inside one is a share of its hash range."""
    load = np.bincount(rank, minlength=256) * (np.exp2(np.arange(256) / 8.0) - 1)
    if not load.sum():
        return np.zeros(fragments - 1, np.uint64)
    upto = np.concatenate([[0.0], np.cumsum(load)])
    out = []
    for part in range(1, fragments):
        at = upto[-1] * part / fragments
        k = min(int(np.searchsorted(upto, at, "right")) - 1, 255)
        share = (at - upto[k]) / load[k] if load[k] else 0.0
        out.append((k << 56) + int(share * ((1 << 56) - 1)))
    return np.array(out, np.uint64)


def _prefixes(n: int, num: int, den: int, order):
    """One row for each non-empty text: class, size, and its prefix in the global order."""

    def run(batches):
        rank, _ = order.value
        for batch in batches:
            node, size, toks = [], [], []
            for w in tn.words(batch.column(0), "space"):
                for u in tn.shingle_sets(w, n):
                    if len(u):
                        keep = len(u) - -(-num * len(u) // den) + 1
                        node.append(_set_hash(u))
                        size.append(len(u))
                        toks.append(tn.signed(u[np.lexsort((u, _order_keys(u, rank)))[:keep]]))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int32()), tn.lists(toks, pa.int64())], ["node", "n", "toks"])

    return run


def _segments(n: int, order, wanted):
    """(class, fragment, n-grams) of the classes that the filter lets through: their segments
    between the pivots of the global order."""

    def run(batches):
        bits, (rank, cuts_at) = wanted.value, order.value
        top = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            node, frag, parts = [], [], []
            for w in tn.words(batch.column(0), "space"):
                for u in tn.shingle_sets(w, n):
                    if not len(u):
                        continue
                    h = _set_hash(u)
                    at = int(np.uint64(h & 0xFFFFFFFFFFFFFFFF) & top)
                    if bits[at >> 3] >> (at & 7) & 1:
                        keys = _order_keys(u, rank)
                        by = np.argsort(keys, kind="stable")
                        ends = [0, *np.searchsorted(keys[by], cuts_at).tolist(), len(u)]
                        for f in range(len(ends) - 1):
                            if ends[f] < ends[f + 1]:
                                node.append(h)
                                frag.append(f)
                                parts.append(tn.signed(u[by[ends[f] : ends[f + 1]]]))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), tn.lists(parts, pa.int64())], ["node", "frag", "grams"])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int, order) -> DataFrame:
    """The pairs (a, b, na, nb) whose similarity is at least num/den: partial overlaps counted
    fragment by fragment, summed per pair.

    Both sides of a pair read the same shuffle of segments by (class, fragment); a segment is
    moved once more, to the pair, as the other side needs it."""
    wanted = id_filter(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    # the class of a group of copies is built once per task and merged by its key
    found = docs.select("text").mapInArrow(_segments(n, order, wanted), "node long, frag int, grams array<long>").groupBy("node", "frag").agg(F.first("grams").alias("grams"))
    left = found.select(F.col("node").alias("a"), "frag", F.col("grams").alias("ga"))
    right = found.select(F.col("node").alias("b"), "frag", F.col("grams").alias("gb"))
    each = pairs.withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    part = each.join(right, ["b", "frag"]).join(left, ["a", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("both"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return total.where(f"{den} * both >= {num} * (na + nb - both)").select("a", "b")


@tidy
def similarity_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = cut(docs.mapInArrow(_sets(n, True), "id long, n long, node long, block int, counts binary"), "sets")
    sets = scanned.where("block is null").select(F.col("id").alias("doc_id"), "n", "node")
    rank = np.zeros(SKETCH, np.uint8)
    blocks = scanned.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_add_up, "block int, classes binary")
    for block, classes in blocks.toLocalIterator():  # SKETCH bytes in all, whatever the input
        rank[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(classes, np.uint8)
    order = spark.sparkContext.broadcast((rank, pivots(rank)))

    prefix = docs.select("text").mapInArrow(_prefixes(n, num, den, order), "node long, n int, toks array<long>")
    prefix = prefix.groupBy("node").agg(F.first("n").alias("n"), F.first("toks").alias("toks"))
    nodes = cut(prefix, "prefixes")
    roots = linked_roots(nodes, lambda pairs: _verified(docs, pairs, n, num, den, order), num, den, wide, lambda ids: passing(nodes.select("node", "toks"), ids))

    first = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    classes = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(best, "root").select(F.col("node").alias("k"), "component_id")
    out = sets.join(classes, (F.col("node") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@tidy
def one_per_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without near copies: of each component one row stays, the one with the smallest
    doc_id (null last), then the smallest hash of its text. Rows, not ids, are told apart: rows
    that repeat a doc_id or have none stay when alone, as each row without n-grams does. All
    columns are kept, whatever their names."""
    row = fresh("row", docs.columns)
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    return without(rows, F.col(row), _dropped(rows, row, n, num, den)).select(*docs.columns)


@tidy
def _dropped(rows: DataFrame, row: str, n: int, num: int, den: int) -> DataFrame:
    """The ids (column ``row``) of the rows that go."""
    own = rows.select(F.col(row).alias("row"), "doc_id", "text")
    found = similarity_components(own.select(F.col("row").alias("doc_id"), "text"), n, num, den).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    best = own.select("row", place.alias("place")).join(found, "row").groupBy("group").agg(F.min("place").alias("place"))
    return found.select("row").join(best.select(F.col("place.row").alias("row")), "row", "left_anti").select(F.col("row").alias(row))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM d UNION SELECT e.b, r.low FROM r JOIN e ON r.node = e.a WHERE r.low < e.b)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(min(r.low), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""
