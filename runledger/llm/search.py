"""Ranked lexical search over a two-level quantised index (operator 12).

``build_index`` writes one row per document, each posting on two levels: level 1 is the hash
of the term and one byte, the term's share of a score rounded up to a multiple of STEP; level
2 is what the exact share is made of (tf, and the document's length factor m). A search reads
level 1 of every document, in blocks of documents against a block of items, and adds bytes
times weights: an upper bound of each (item, document) score and, as a byte says at least one
more than STEP times the byte below it, a lower bound. The k-th largest lower bound of an item
is a floor of its k-th best score, so only documents whose upper bound reaches it are rescored
from level 2, with exact integers. No document whose score could be among the best is left
out, and no candidate is capped; a task sends on what reaches the k-th lower bound of its own
documents, the rest is decided against the bound of all.

Terms are maximal runs of ASCII letters and digits and all other characters, A-Z lower-cased,
told apart by 64-bit hashes. A term's weight is floor(1000 ln((2N+2)/(2df+1))), a document's
m is 50 + (50 n N) div L, its score the sum of w * ((10^9 tf) div (1000 tf + 20 m)).

Items come to the driver, and are broadcast, in blocks of at most ITEMS items and TERMS (item,
term) entries (one item alone may have more); the documents are read once per block. The
index is never broadcast or collected.

Defined cases: null and empty texts have no terms: such documents are in no ranking and
uncounted, such items have no rows; rows that share an item_id (null too) are one item with
the terms of all; equal scores stand by ascending doc_id, null first, and every row of a
repeated doc_id has a rank of its own; other columns are ignored; very long texts are handled
whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .common import cut, tidy
from .posting import passing

#: A share is below 10^6, so a byte of STEP holds any.
STEP = 3922
ITEMS, TERMS = 256, 1 << 20
#: Cells (items x documents) of a block of bounds.
CELLS = 1 << 22
INDEX = "key long, doc_id long, m long, terms array<long>, tfs array<long>, bytes binary"


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _counts(batches):
    """Terms of each text with their repeats."""
    for batch in batches:
        parts = [np.diff(w.off) for w in tn.words(batch.column(0), "alnum", hashes=False)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())], ["n"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""
    n = docs.select("text").mapInArrow(_counts, "n long")
    row = n.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row["docs"], row["terms"]


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The index of ``docs`` (doc_id, text) as a table in the shared folder, and N."""
    n_docs, n_terms = corpus_size(docs)

    def run(batches):
        key = TaskContext.get().partitionId() << 33  # the same however often the task runs
        for batch in batches:
            doc_id = batch.column(0)
            for w in tn.words(batch.column(1), "alnum"):
                n = np.diff(w.off)
                rows = np.flatnonzero(n)
                if not len(rows):
                    continue
                of = np.repeat(np.arange(w.n), n)
                order = np.lexsort((w.hash, of))
                h, of = w.hash[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(h))).astype(np.int64)
                m = 50 + (50 * n.astype(np.int64) * n_docs) // n_terms
                g = share(tf, m[of[at]])
                size = np.bincount(of[at], minlength=w.n)[rows]
                off = np.zeros(len(rows) + 1, np.int32)
                np.cumsum(size, out=off[1:])
                ends = pa.array(off, pa.int32())
                level1 = ((g + STEP - 1) // STEP).astype(np.uint8)
                level1 = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(level1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(rows)), pa.int64()), doc_id.slice(w.first, w.n).take(pa.array(rows)), pa.array(m[rows]), pa.ListArray.from_arrays(ends, pa.array(tn.signed(h[at]))), pa.ListArray.from_arrays(ends, pa.array(tf)), level1],
                    ["key", "doc_id", "m", "terms", "tfs", "bytes"],
                )
                key += len(rows)

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "index"), n_docs


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct term hashes of the rows that share an item_id."""

    def run(batches):
        for batch in batches:
            for w in tn.words(batch.column(1), "alnum"):
                sets = [tn.signed(np.unique(w.hash[w.off[i] : w.off[i + 1]])) for i in range(w.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), tn.lists(sets, pa.int64())], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<long>")
    return rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of a bounded size, by ascending item_id."""
    block, size = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        if block and (len(block) == ITEMS or size + len(r["terms"]) > TERMS):
            yield block
            block, size = [], 0
        block.append((r["item_id"], np.sort(np.array(r["terms"], np.int64))))
        size += len(r["terms"])
    if block:
        yield block


def _wanted(flat: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which postings are of one of the (sorted) terms, and of which."""
    at = np.searchsorted(terms, flat)
    at[at == len(terms)] = 0
    found = np.flatnonzero(terms[at] == flat)
    return found, at[found]


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """df of each of the sorted ``terms``."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            total += np.bincount(_wanted(batch.column(0).flatten().to_numpy(), sent.value)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "df"])

    df = np.zeros(len(terms), np.int64)
    for r in index.select("terms").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["t"]] = r["df"]
    return df


class _Query:
    """A block of items against the index: terms, their weights, and the items that have each."""

    def __init__(self, block: list[tuple], index: DataFrame, n_docs: int):
        self.n = len(block)
        self.terms, which = np.unique(np.concatenate([t for _, t in block]), return_inverse=True)
        df = frequencies(index, self.terms)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        item = np.repeat(np.arange(self.n), [len(t) for _, t in block])
        order = np.argsort(which, kind="stable")
        self.items, self.begin = item[order], np.searchsorted(which[order], np.arange(len(self.terms) + 1))

    def add(self, t: np.ndarray, row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
        """Sum of value over each item's terms, for every item and row; a row has a term once."""
        out = np.zeros((self.n, n_rows), np.int64)
        order = np.argsort(t, kind="stable")
        t, row, value = t[order], row[order], value[order]
        at = np.flatnonzero(np.diff(t, prepend=-1))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(t)]):
            for i in self.items[self.begin[t[a]] : self.begin[t[a] + 1]].tolist():
                out[i, row[a:b]] += value[a:b]
        return out


def candidates(index: DataFrame, query: _Query, k: int) -> DataFrame:
    """(item, key, low, high): bounds of the scores that may be among the item's k best."""
    sent = index.sparkSession.sparkContext.broadcast(query)

    def run(batches):
        q, best = sent.value, None
        width = max(64, CELLS // max(1, q.n))
        for batch in batches:
            for first in range(0, batch.num_rows, width):
                part = batch.slice(first, width)
                key, terms, codes = part.column(0).to_numpy(), part.column(1), part.column(2)
                row = np.repeat(np.arange(len(key)), np.diff(terms.offsets.to_numpy()))
                found, t = _wanted(terms.flatten().to_numpy(), q.terms)
                code = np.frombuffer(b"".join(codes.to_pylist()), np.uint8)[found].astype(np.int64)
                w = q.weight[t]
                high = q.add(t, row[found], w * code * STEP, len(key))
                low = high - q.add(t, row[found], w * (STEP - 1), len(key))
                # the k largest lower bounds of each item so far
                best = low if best is None else np.concatenate([best, low], 1)
                if best.shape[1] > k:
                    best = -np.partition(-best, k - 1, 1)[:, :k]
                floor = best.min(1) if best.shape[1] == k else np.zeros(q.n, np.int64)
                item, at = np.nonzero((high > 0) & (high >= floor[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(key[at]), pa.array(low[item, at]), pa.array(high[item, at])], ["item", "key", "low", "high"])

    rows = cut(index.select("key", "terms", "bytes").mapInArrow(run, "item int, key long, low long, high long"), "bounds")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    floors = rows.select("item", "low", place.alias("place")).where(F.col("place") <= k).groupBy("item").agg(F.min("low").alias("floor"), F.count("*").alias("n"))
    return rows.join(F.broadcast(floors.where(F.col("n") == k)), "item", "left").where("floor is null or high >= floor")  # a row per item of the block


def rescored(index: DataFrame, query: _Query, found: DataFrame) -> DataFrame:
    """(item, doc_id, score) of candidates (item, key), exactly, from level 2."""
    per = cut(found.groupBy("key").agg(F.collect_set("item").alias("of")), "found")  # of a block's items at most
    sent = index.sparkSession.sparkContext.broadcast(query)
    rows = passing(index.select("key", "doc_id", "m", "terms", "tfs"), per.select(F.col("key").alias("node"))).join(per, "key")

    def run(batches):
        q = sent.value
        for batch in batches:
            terms = batch.column(3)
            size = np.diff(terms.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            hit, t = _wanted(terms.flatten().to_numpy(), q.terms)
            row, tf, m = row[hit], batch.column(4).flatten().to_numpy()[hit], batch.column(2).to_numpy()
            score = q.add(t, row, q.weight[t] * share(tf, m[row]), len(size))
            of = batch.column(5)
            item, at = of.flatten().to_numpy(), np.repeat(np.arange(len(size)), np.diff(of.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), batch.column(1).take(pa.array(at)), pa.array(score[item, at])], ["item", "doc_id", "score"])

    return rows.select("key", "doc_id", "m", "terms", "tfs", "of").mapInArrow(run, "item int, doc_id long, score long")


@tidy
def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    index, n_docs = build_index(docs)
    return search_index(index, n_docs, items, k)


def search_index(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` over a built index."""
    spark, kind, parts = index.sparkSession, items.schema["item_id"].dataType.simpleString(), []
    for block in blocks(item_terms(items)):
        query = _Query(block, index, n_docs)
        scores = rescored(index, query, candidates(index, query, k)).where("score > 0")
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {kind}")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
        best = scores.withColumn("rank", rank).where(F.col("rank") <= k)
        parts.append(cut(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))  # a row per item of the block
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY 1, 2),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
m AS (SELECT r, doc_id, 50 + ((50 * len(ts) * n_docs) // n_terms) AS m FROM d, c WHERE len(ts) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 50
"""
