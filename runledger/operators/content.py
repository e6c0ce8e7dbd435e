"""Content digests of tables, and the rows in which two versions of a table differ.

A digest does not depend on the order or the partitions of rows: it is the count and two sums
of row hashes, so it adds up map-side, over groups, and over levels of a tree. ``tree`` keeps
the digests of key ranges at every level; two trees are compared from the roots down, and only
the rows of the ranges that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import durable

BITS = 60


def row_hashes(columns: list[Column]) -> tuple[Column, Column]:
    """Two 60-bit hashes of a row: of the lengths and texts of its columns, null apart from
    the empty text."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    text = F.md5(F.concat_ws("|", *parts))
    return tuple(F.conv(F.substring(text, at, BITS // 4), 16, 10).cast("decimal(20,0)") for at in (1, 1 + BITS // 4))


def content_digest(rows: DataFrame, columns: list[str], by: list[Column | str] = ()) -> DataFrame:
    """(by, n, d1, d2) of the rows' multiset, of each group of ``by``."""
    h1, h2 = row_hashes([F.col(c) for c in columns])
    sums = [(F.sum(h) % F.lit(1 << BITS).cast("decimal(20,0)")).cast("long") for h in (h1, h2)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), sums[0].alias("d1"), sums[1].alias("d2"))


def tree(rows: DataFrame, key: str, columns: list[str], width: int, fanout: int = 16, levels: int = 4) -> DataFrame:
    """(level, node, n, d1, d2): digests of ranges of ``key`` (a whole number). A leaf (level 0)
    is ``width`` wide, a node above holds ``fanout`` of the level below. The rows are read and
    hashed once; upper levels add up the leaves."""
    leaves = durable(content_digest(rows, columns, [F.floor(F.col(key) / width).alias("node")]).select(F.lit(0).alias("level"), "node", "n", "d1", "d2"))
    out, below = leaves, leaves
    for level in range(1, levels):
        sums = [(F.sum(F.col(d).cast("decimal(20,0)")) % F.lit(1 << BITS).cast("decimal(20,0)")).cast("long").alias(d) for d in ("d1", "d2")]
        below = below.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(F.sum("n").alias("n"), *sums).select(F.lit(level).alias("level"), "node", "n", "d1", "d2")
        out = out.unionByName(below)
    return out


def differing(a: DataFrame, b: DataFrame, fanout: int = 16, levels: int = 4) -> DataFrame:
    """(level, node) of the nodes that differ, from the roots down: a level's nodes are looked
    at only below nodes that differ."""
    wanted, out = None, None
    for level in range(levels - 1, -1, -1):
        x, y = (t.where(F.col("level") == level).select("node", F.struct("n", "d1", "d2").alias(name)) for t, name in ((a, "x"), (b, "y")))
        if wanted is not None:
            under = wanted.select(F.col("node").alias("up"))
            x, y = (t.join(under, F.floor(F.col("node") / fanout) == F.col("up"), "left_semi") for t in (x, y))
        wanted = durable(x.join(y, "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select(F.lit(level).alias("level"), "node"))
        out = wanted if out is None else out.union(wanted)
    return out


def in_ranges(rows: DataFrame, key: str, nodes: DataFrame, width: int) -> DataFrame:
    """The rows of the leaf ranges ``nodes``. Their hull is two numbers and reaches the scan."""
    lo, hi = nodes.agg(F.min("node"), F.max("node")).first()
    if lo is None:
        return rows.limit(0)
    hull = rows.where((F.col(key) >= lo * width) & (F.col(key) < (hi + 1) * width))
    return hull.join(nodes.select("node"), F.floor(F.col(key) / width) == F.col("node"), "left_semi")


def range_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str], nodes: DataFrame, width: int) -> DataFrame:
    """(columns, n_a, n_b): the rows that one version holds more often than the other, among
    the rows of the leaf ranges that differ."""
    sides = [in_ranges(t, key, nodes, width).select(*columns, F.lit(x).alias("in_a"), F.lit(1 - x).alias("in_b")) for t, x in ((a, 1), (b, 0))]
    counted = sides[0].union(sides[1]).groupBy(*columns).agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"))
    return counted.where("n_a <> n_b")
