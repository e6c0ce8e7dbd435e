"""Mixing sources to target weights (operator 3), in DataFrame functions only.

Sizes (words) are summed per source with map-side combine. Sources in code-point order,
null last, take weights cyclically and share the size of the whole; a target stops at
``cap`` times its source's size and the excess is shared again by weight. That fixed point
is a water level, found with running sums over the sources (one row each) in order of
cap / weight. A document is taken floor(rate) times, and once more where a hash of its id and
of ``seed`` lies under the fraction of the rate: one draw, so the chance of the extra copy is
the fraction for every document, whatever else its source holds, and no document order and no
per-source task is needed. A source's taken words miss its target by the luck of the draw
only, which shrinks as the source grows.

Defined cases: null text has size 0; null source is a source of its own, the last; sources
without words have target 0 and their documents are taken 0 times; repeated rows (equal
doc_id) get the same decision; null doc_id hashes as the word null; empty input gives no
rows; other columns are ignored, or kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import NON_SPACE_WORD, cut, fresh, tidy


def word_count(text):
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(NON_SPACE_WORD), F.lit(0))), F.lit(0)).cast("long")


def _running(rows: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums (name of the sum: column) in the given order, without any
    task that sees all of them: sums inside range partitions, and of the partitions before."""
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ordered")
    totals = parts.groupBy("part").agg(*[F.sum(c).alias(f"{k}_all") for k, c in sums.items()])  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *[F.coalesce(F.sum(f"{k}_all").over(before), F.lit(0)).alias(f"{k}_off") for k in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(offsets), "part")
    return out.select(*rows.columns, *[(F.sum(c).over(inside) + F.col(f"{k}_off")).alias(k) for k, c in sums.items()])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows. Sources may be many (web
    domains): their order and the water level come from sums over range partitions."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    per = _running(per, [F.col("source").asc_nulls_last()], {"nth": "one"}).drop("one")
    per = per.select("source", "source_size", (F.col("nth") - 1).alias("place"), F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights)).cast("int") + 1).alias("w"))
    per = per.withColumns({"most": cap * F.col("source_size"), "bound": cap * F.col("source_size") / F.col("w")})
    per = _running(per, ["bound", "place"], {"most_to": "most", "w_to": "w"})
    whole = per.agg(F.sum("source_size").alias("t"), F.sum("w").alias("ws"))  # one row
    per = per.crossJoin(F.broadcast(whole))
    per = per.withColumn("level", (F.col("t") - (F.col("most_to") - F.col("most"))) / (F.col("ws") - (F.col("w_to") - F.col("w"))))
    per = cut(per.withColumn("full", F.col("bound") <= F.col("level")), "levels")
    water = per.agg(F.max(F.when(~F.col("full"), F.col("level"))).alias("water"))  # one row
    capped = F.col("most").cast("double")
    per = per.crossJoin(F.broadcast(water)).withColumn("target", F.when(F.col("full"), capped).otherwise(F.least(capped, F.col("w") * F.col("water"))))
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def _copies(rate, doc_id, seed: int):
    """floor(rate), and one more where the document's draw (8 hex digits, uniform by doc_id and
    seed) is below the fraction of the rate."""
    draw = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"#{seed}"))), 1, 8)
    under = F.lower(F.lpad(F.hex(F.floor((rate - F.floor(rate)) * 4294967296).cast("long")), 8, "0"))
    return F.floor(rate) + F.when(draw < under, 1).otherwise(0)


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


@tidy
def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, copies."""
    sizes = cut(_sizes(docs), "sizes")
    per = cut(source_targets(sizes, weights, cap), "targets").withColumnRenamed("source", "s")
    rows = sizes.join(per, F.expr("source <=> s")).withColumn("copies", _copies(F.col("rate"), F.col("doc_id"), seed))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as many times as it is taken."""
    source, rate, copy = (fresh(c, docs.columns) for c in ("of_source", "of_rate", "of_copy"))
    per = _rates(docs, weights, cap).select(F.col("source").alias(source), F.col("rate").alias(rate))
    rows = docs.join(per, docs["source"].eqNullSafe(per[source]))
    copies = _copies(F.col(rate), F.col("doc_id"), seed).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


@tidy
def _rates(docs: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    return source_targets(cut(_sizes(docs), "sizes"), weights, cap)


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
numbered AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM per),
run AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS t, CAST(sum(w) OVER () AS BIGINT) AS ws,
  CAST(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS BIGINT) - 3 * source_size AS before_,
  CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS BIGINT) - w AS wb FROM numbered),
lev AS (SELECT *, (t - before_) / (ws - wb) AS level, 3 * source_size / w <= (t - before_) / (ws - wb) AS full_ FROM run),
tgt AS (SELECT source, source_size, CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE) ELSE least(CAST(3 * source_size AS DOUBLE), w * (max(CASE WHEN NOT full_ THEN level END) OVER ())) END AS target FROM lev),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM tgt),
limits AS (SELECT *, lower(lpad(to_hex(CAST(floor((rate - floor(rate)) * 4294967296) AS BIGINT)), 8, '0')) AS under FROM rates)
SELECT s.doc_id, s.size, l.source_size, l.target, CAST(s.size * c.copies AS BIGINT) AS taken, CAST(c.copies AS BIGINT) AS copies
FROM s JOIN limits l ON s.source IS NOT DISTINCT FROM l.source,
LATERAL (SELECT floor(l.rate) + CASE WHEN substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), 'null') || '#0'), 1, 8) < l.under THEN 1 ELSE 0 END AS copies) c
"""
