"""Nested JSON states as rows: leaf-path diff, deep overrides, validation.

A document is JSON text, parsed once to a variant. Levels are walked together for all
documents: one narrow step per level of nesting (no shuffle), cut by a checkpoint so that no
level is walked twice; the walk ends at the deepest document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BARRED
from .graph import durable

MAP = "map<string,variant>"
STRING_MOST, LIST_MOST = 200, 50


def fields(v: Column) -> Column:
    """The fields of a variant object; null for anything else."""
    return F.try_variant_get(v, "$", MAP)


def _known(v: Column) -> Column:
    """A variant null is no value."""
    return F.when(~F.is_variant_null(v), v)


def same(a: Column, b: Column) -> Column:
    """Whether two variants are one value; missing and null are, and so are 1, 1.0 and true.
    Whole numbers are compared by their digits, other numbers as doubles, containers by text."""
    x, y = F.to_json(_known(a)), F.to_json(_known(b))
    whole = x.rlike(r"\A-?[0-9]+\z") & y.rlike(r"\A-?[0-9]+\z")
    numbers = x.rlike(r"\A[-0-9tf]") & y.rlike(r"\A[-0-9tf]") & ~whole
    number = lambda t, v: F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(F.try_variant_get(v, "$", "double"))
    return x.eqNullSafe(y) | F.coalesce(numbers & (number(x, a) == number(y, b)), F.lit(False))


def quoted(s: Column) -> Column:
    """A string as JSON text."""
    listed = F.to_json(F.array(s))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def shown(v: Column) -> Column:
    """JSON text of a variant, long strings and lists cut and marked as cut."""
    text = F.to_json(_known(v))
    string = F.when(text.startswith('"'), F.try_variant_get(v, "$", "string"))
    mark = F.concat(F.substring(string, 1, STRING_MOST), F.lit("...(truncated, total "), F.length(string).cast("string"), F.lit(" chars)"))
    items = F.when(text.startswith("["), F.try_variant_get(v, "$", "array<variant>"))
    short = F.concat(F.slice(items, 1, LIST_MOST), F.array(F.parse_json(F.lit('"...(truncated)"'))))
    return F.when(F.length(string) > STRING_MOST, quoted(mark)).when(F.size(items) > LIST_MOST, F.to_json(short)).otherwise(text)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaf_diff(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """(keys, path, before, after) of the paths at which two JSON objects differ.

    Where both sides are objects their fields are compared one by one, anywhere else the two
    values are, whole: so an object against a scalar is one difference, at its own path. Lists
    are leaves; missing and null are the same; null documents are empty objects."""
    root = lambda c: F.coalesce(fields(F.try_parse_json(c)), F.create_map().cast(MAP))
    level = rows.select(*keys, F.lit(None).cast("string").alias("path"), root(before).alias("ma"), root(after).alias("mb"))
    found = []
    while True:
        pairs = F.map_zip_with("ma", "mb", lambda k, x, y: F.struct(x.alias("a"), y.alias("b")))
        each = level.select(*keys, "path", F.explode(pairs).alias("key", "v"))
        each = each.select(*keys, F.concat_ws(".", "path", "key").alias("path"), F.col("v.a").alias("a"), F.col("v.b").alias("b")).where(~same(F.col("a"), F.col("b")))
        each = durable(each.withColumns({"ma": fields(F.col("a")), "mb": fields(F.col("b"))}))
        both = F.col("ma").isNotNull() & F.col("mb").isNotNull()
        found.append(each.where(~both).select(*keys, "path", shown(F.col("a")).alias("before"), shown(F.col("b")).alias("after")))
        level = each.where(both)
        if level.isEmpty():
            return _union(found)


def shred(docs: DataFrame, keys: list[str], doc: str, dotted: bool = False) -> DataFrame:
    """(keys, path array, value JSON text, cut): the leaves of JSON objects, one row each.

    Lists, scalars, nulls and empty objects are leaves. With ``dotted`` the documents are
    patches: a top-level key with dots is a path, and an object under such a key replaces what
    was there, which a row of null value and cut = true says. Elsewhere an object says nothing
    about its siblings; cut is true of every leaf but an empty object."""
    top = F.explode(fields(F.try_parse_json(doc))).alias("key", "v")
    level = docs.select(*keys, top)
    path = F.when(F.lit(dotted) & F.col("key").contains("."), F.split("key", r"\.")).otherwise(F.array("key"))
    level = level.select(*keys, path.alias("path"), "v", (F.lit(dotted) & F.col("key").contains(".")).alias("whole"))
    found = []
    while True:
        level = durable(level.withColumn("m", fields(F.col("v"))))
        inner = F.size(F.coalesce("m", F.create_map().cast(MAP))) > 0
        leaves = level.where(~inner).select(*keys, "path", F.to_json("v").alias("value"), (F.col("m").isNull() | F.col("whole")).alias("cut"))
        found += [leaves, level.where(inner & F.col("whole")).select(*keys, "path", F.lit(None).cast("string").alias("value"), F.lit(True).alias("cut"))]
        deeper = level.where(inner).select(*keys, "path", F.explode("m").alias("key", "v"))
        level = deeper.select(*keys, F.concat("path", F.array("key")).alias("path"), "v", F.lit(False).alias("whole"))
        if level.isEmpty():
            return _union(found)


def _prefixes(path: Column, least: int) -> Column:
    """The proper prefixes of a path, from ``least`` parts on."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(path)), lambda n: (n >= least) & (n < F.size(path))), lambda n: F.slice(path, F.lit(1), n))


def deep_override(layers: DataFrame, keys: list[str], order: str, doc: str) -> DataFrame:
    """(keys, path, value): the leaves of documents patched in order, the first layer the base.

    ``layers`` has the keys, a place in the order, and JSON text. Patches merge deeply: what
    they don't name stays, lists are replaced, a scalar written over an object ends every path
    below it, and a path written below a scalar ends the scalar. As rows: a leaf stays if no
    later row cuts its path or one above (the prefix tombstones, joined over the prefixes of
    the leaf), and no later row stands below it. An object of which nothing is left is empty."""
    rows = shred(layers.select(*keys, order, doc), [*keys, order], doc, dotted=True)
    rows = durable(rows.withColumn("name", F.array_join("path", "\x00")))
    id_ = [*keys, "name"]
    # the last row that cuts each path, and the last that makes each path an object
    cuts = rows.where("cut").groupBy(*id_).agg(F.max(order).alias("last_cut"))
    above = rows.select(*keys, order, F.explode(_prefixes(F.col("path"), 1)).alias("up")).select(*keys, F.array_join("up", "\x00").alias("name"), order)
    below = above.groupBy(*id_).agg(F.max(order).alias("last_below"))
    own = rows.where("value is not null").groupBy(*id_).agg(F.max_by(F.struct("path", "value", "cut"), order).alias("r"), F.max(order).alias("at"))
    own = own.join(cuts, id_, "left").join(below, id_, "left")
    # an empty object is made by its row, but does not end what is below it
    alive = F.coalesce(F.col("last_cut") <= F.col("at"), F.lit(True)) & F.coalesce(F.col("last_below") <= F.col("at"), F.lit(True))
    own = own.where(alive).select(*keys, "name", "at", "r.path", "r.value", F.col("r.cut").alias("cut"))
    up = own.select(*id_, "at", F.explode_outer(_prefixes(F.col("path"), 1)).alias("up")).select(*id_, "at", F.array_join("up", "\x00").alias("over"))
    ended = up.join(cuts.withColumnRenamed("name", "over"), [*keys, "over"]).where(F.col("last_cut") > F.col("at")).select(*id_).distinct()
    left = own.join(ended, id_, "left_anti")
    # objects of which something is left need no row of their own
    held = left.select(*keys, F.explode(_prefixes(F.col("path"), 1)).alias("up")).select(*keys, F.array_join("up", "\x00").alias("name")).distinct()
    empty = left.where("value = '{}'").join(held, id_, "left_anti")
    return left.where("value <> '{}'").unionByName(empty).select(*keys, F.array_join("path", ".").alias("path"), "value")


#: Parts that a dot path may have.
DEPTH = 5


def first_offence(docs: DataFrame, keys: list[str], doc: str, bad_key: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, path, reason) of the first offending path of each document, paths in order of
    their text; documents without one have no row. Barred keys at any level, dot paths of more
    than DEPTH parts or with an empty or non-word part at the top level, and the names of
    non-finite numbers as values (nan, inf, -inf, as the event sink writes them) offend."""
    level = docs.select(*keys, F.lit(None).cast("string").alias("path"), fields(F.try_parse_json(doc)).alias("m"))
    found, top = [], True
    while True:
        each = level.select(*keys, "path", F.explode("m").alias("key", "v"))
        each = each.select(*keys, F.concat_ws(".", "path", "key").alias("path"), "key", "v", fields(F.col("v")).alias("m"))
        parts = F.split("key", r"\.")
        barred = F.arrays_overlap(parts, F.array(*map(F.lit, BARRED))) if top else F.col("key").isin(BARRED)
        reason = F.when(barred, "barred")
        if top:
            reason = reason.when(F.size(parts) > DEPTH, "deep").when(~F.col("key").rlike(r"\A[\p{L}\p{N}_]+(\.[\p{L}\p{N}_]+)*\z"), "name")
        if bad_key is not None:
            reason = reason.when(bad_key(F.col("key")), "key")
        reason = reason.when(F.to_json("v").isin('"nan"', '"inf"', '"-inf"'), "number")
        each = durable(each.withColumn("reason", reason))
        found.append(each.where("reason is not null").select(*keys, "path", "reason"))
        level, top = each.where("m is not null").select(*keys, "path", "m"), False
        if level.isEmpty():
            return _union(found).groupBy(*keys).agg(F.min(F.struct("path", "reason")).alias("r")).select(*keys, "r.path", "r.reason")
