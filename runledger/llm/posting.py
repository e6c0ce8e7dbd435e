"""Linking sets that meet in posting lists.

``nodes`` has rows (node, n, toks): a node of size ``n`` meets others on any of its tokens,
which are a prefix of its set in a global order, so places bound what two nodes can still
share. Lists of up to ``wide`` nodes try all their pairs. A wider list first links its nodes
to a few leaders of about their size (the one with the fewest rarer tokens, and LEADERS by
hash); after components are known, only nodes of it that are still apart meet each other,
each pair once, at its first common token, and only if the common part of their prefixes
leaves a link possible. So a big group of copies does not become all its pairs, and no two
linked nodes end up apart. Posts carry no arrays; ``prefixes_of`` gives the tokens of the few
nodes that are still apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

WIDE, LEADERS = 32, 2


def id_filter(ids: DataFrame, column: str, most_bits: int = 1 << 26):
    """A broadcast bit map of the ids, of at most most_bits bits (8 MB): lets every wanted id
    through, and few others. The bits travel as counts of the set positions, or as whole
    blocks once those are fewer."""
    spark = ids.sparkSession
    n = ids.count()
    size = min(most_bits, max(1 << 16, 1 << math.ceil(math.log2(64 * n + 1))))
    bits = np.zeros(size // 8, np.uint8)
    at = F.expr(f"{column} & {size - 1}L")
    # 32768 bits to a block, as bitmap_construct_agg makes them
    for block, part in ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("block")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).toLocalIterator():
        part = np.frombuffer(part, np.uint8)
        lo = block * 4096
        bits[lo : lo + len(part)] |= part[: len(bits) - lo]
    return spark.sparkContext.broadcast(bits)


def _there(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = ids & np.int64(len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def passing(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose first column is one of ``ids`` (column node), and few others: what a bit
    map of bounded size lets through, before anything is shuffled."""
    wanted = id_filter(ids, "node")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_there(batch.column(0).to_numpy(zero_copy_only=False), wanted.value)))

    return rows.mapInArrow(run, rows.schema)


def shared_posts(nodes: DataFrame) -> DataFrame:
    """(tok, node, n, pos, c): one row for each token of a node that c > 1 nodes have.

    Most tokens of a prefix are rare, so tokens alone are counted first (with map-side
    combine), and only posts that a bit map of the shared tokens lets through are shuffled."""
    shared = nodes.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    shared = cut(shared, "shared")
    wanted = id_filter(shared, "tok")

    def run(batches):
        for batch in batches:
            toks = batch.column(2)
            flat, size = toks.flatten().to_numpy(), np.diff(toks.offsets.to_numpy())
            keep = np.flatnonzero(_there(flat, wanted.value))
            row = np.repeat(np.arange(len(size)), size)[keep]
            pos = keep - (np.cumsum(size) - size)[row]
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(pos.astype(np.int32))], ["tok", "node", "n", "pos"])

    kind = nodes.schema["node"].dataType.simpleString()
    posts = nodes.select("node", F.col("n").cast("int"), "toks").mapInArrow(run, f"tok long, node {kind}, n int, pos int")
    return cut(posts.join(shared, "tok"), "posts")


def led(posts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of each node with the leaders of its list, of its own class of size and the
    next smaller, within the length and positional bounds."""
    posts = posts.withColumn("size", F.floor(F.log("n") / math.log(den / num))) if num < den else posts.withColumn("size", F.col("n"))
    me = F.struct("node", "n", "pos")
    ranks = [F.col("pos"), *[F.xxhash64("node", F.lit(i)) for i in range(LEADERS)]]
    leaders = posts.groupBy("tok", "size").agg(F.array(*[F.min(F.struct(r.alias("at"), me.alias("me")))["me"] for r in ranks]).alias("leaders"))
    each = posts.select("tok", me.alias("me"), F.explode(F.array("size", F.col("size") - 1)).alias("size"))
    near = F.expr(f"filter(array_distinct(leaders), x -> x.node <> me.node AND {den} * least(x.n, me.n) >= {num} * greatest(x.n, me.n) AND least(x.n - x.pos, me.n - me.pos) * {num + den} >= {num} * (x.n + me.n))")
    pairs = each.join(leaders, ["tok", "size"]).select("me", F.explode(near).alias("by"))
    pairs = pairs.select(F.least("me", "by").alias("a"), F.greatest("me", "by").alias("b"))
    return pairs.selectExpr("a.node AS a", "b.node AS b", "a.n AS na", "b.n AS nb", "a.pos AS pa", "b.pos AS pb")


def meet(x: DataFrame, also: str = "true") -> DataFrame:
    """The pairs of nodes in one list, the smaller node first, for which ``also`` holds."""
    more = [c for c in x.columns if c in ("root", "toks")]
    left = x.select("tok", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), *[F.col(c).alias(f"{c}_a") for c in more])
    right = x.select("tok", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), *[F.col(c).alias(f"{c}_b") for c in more])
    return left.join(right, "tok").where("a < b").where(also).select("a", "b", "na", "nb", "pa", "pb")


def near_sizes(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes allow a Jaccard similarity of num/den, each once."""
    return pairs.where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)").select("a", "b", "na", "nb").distinct()


def linked_roots(nodes: DataFrame, verify: Callable[[DataFrame], DataFrame], num: int, den: int, wide: int = WIDE, prefixes_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of all nodes that have a link. ``verify`` keeps, of pairs (a, b, na, nb),
    those (a, b) whose Jaccard similarity is num/den or more."""
    posts = shared_posts(nodes)
    prefixes_of = prefixes_of or (lambda ids: nodes.select("node", "toks"))

    def bounded(x: DataFrame) -> DataFrame:
        """Length and positional bounds of a pair with sizes na, nb and places pa, pb."""
        most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        return near_sizes(x.where(most * (num + den) >= num * (F.col("na") + F.col("nb"))), num, den)

    few = meet(posts.where(F.col("c") <= wide))
    pairs = cut(bounded(few.union(led(posts.where(F.col("c") > wide), num, den))), "pairs")
    links = cut(verify(pairs), "links")
    roots = connected_components(links)

    many = posts.where(F.col("c") > wide)
    if many.isEmpty():
        return roots
    rooted = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
    left = cut(rooted.join(mixed, "tok", "left_semi"), "apart")
    if left.isEmpty():
        return roots
    left = left.join(prefixes_of(left.select("node").distinct()), "node")
    # what the prefixes share, and at most all that follows the shorter one's end
    apart = f"root_a <> root_b and {den} * least(na, nb) >= {num} * greatest(na, nb) and least(na - pa, nb - pb) * {num + den} >= {num} * (na + nb)"
    # in one lambda, so that a pair's prefixes are intersected once
    apart += f" and exists(array(array_intersect(toks_a, toks_b)), x -> get(x, 0) = tok and (size(x) + greatest(na - size(toks_a), nb - size(toks_b))) * {num + den} >= {num} * (na + nb))"
    apart = meet(left, apart)
    more = cut(bounded(apart).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return roots
    return connected_components(links.union(verify(more)))
