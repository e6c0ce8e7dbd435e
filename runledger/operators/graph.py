"""Graph questions over edge tables (src, dst): closures by paths that double each round.

Each round is checkpointed, so plans stay small and lost executors cost one round; rounds stop
at the fixed point, after the logarithm of the longest path, whatever the graph's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    done = df.checkpoint()
    # new names of the columns: a checkpoint still carries what its plan said of the old ones
    return done.select(*[F.col(f"`{c}`").alias(c) for c in done.columns])


def _composed(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.alias("x").join(y.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of every path of one edge or more. Each round joins the pairs that the last
    one found with all that are known, on either side, so paths double and no old pair is made
    again."""
    reach = new = durable(edges.select("src", "dst").distinct())
    while not new.isEmpty():
        step = _composed(new, reach).union(_composed(reach, new)).distinct()
        new = durable(step.join(reach, ["src", "dst"], "left_anti"))
        reach = reach.union(new)
    return reach


def cycle_nodes(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    return (reach or closure(edges)).where("src = dst").select(F.col("src").alias("node"))


def scc_members(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(node, scc): scc is the smallest name of the strongly connected component."""
    reach = reach or closure(edges)
    mutual = reach.alias("a").join(reach.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).select(F.col("a.src").alias("node"), F.col("a.dst").alias("other"))
    alone = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return mutual.union(alone.select("node", F.col("node").alias("other"))).groupBy("node").agg(F.min("other").alias("scc"))


def topo_levels(edges: DataFrame) -> DataFrame:
    """Length of the longest path into each node of an acyclic graph, by rounds of nodes that
    are one edge further; a cycle is an error."""
    edges = durable(edges.select("src", "dst").distinct())
    level = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    nodes, level, depth = level.count(), durable(level.withColumn("level", F.lit(0))), 0
    frontier = level.select("node")
    while not frontier.isEmpty():
        depth += 1
        if depth > nodes:
            raise ValueError("the graph has a cycle")
        frontier = durable(frontier.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct())
        level = durable(level.union(frontier.withColumn("level", F.lit(depth))).groupBy("node").agg(F.max("level").alias("level")))
    return level


def unknown_deps(edges: DataFrame, stages: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("stage")).distinct().join(stages, "stage", "left_anti")


def route_only(edges: DataFrame, order: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Targets that run only when routed to; order (node, idx): places of declaration.

    A target that does not lead back to its router is one. On a loop, a target with a static
    parent is not (it starts the loop), one without is if its component has a static parent
    from outside; of the others, pure loops of routers, the first declared starts."""
    reach = reach or closure(edges)
    scc = durable(scc_members(edges, reach))
    static, routed = edges.where("kind = 'static'"), edges.where("kind = 'conditional'").select("src", "dst").distinct()
    back = routed.join(reach.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    forward = routed.join(back, ["src", "dst"], "left_anti").select(F.col("dst").alias("node"))
    inner = back.select(F.col("dst").alias("node")).distinct().join(static.select(F.col("dst").alias("node")), "node", "left_anti")
    of = scc.select(F.col("node").alias("dst"), F.col("scc").alias("to")), scc.select(F.col("node").alias("src"), F.col("scc").alias("at"))
    entered = static.select("src", "dst").join(of[0], "dst").join(of[1], "src").where(F.col("at") != F.col("to")).select(F.col("to").alias("scc")).distinct()
    inner = inner.join(scc, "node").join(entered.withColumn("entered", F.lit(True)), "scc", "left").join(order, "node")
    pure = inner.where("entered is null")
    first = pure.agg(F.min_by("node", "idx").alias("node"))
    rest = inner.where("entered").select("node").union(pure.select("node").join(first, "node", "left_anti"))
    # a target exempted as the start of a pure loop stays out even if another router leads to it
    return forward.join(first, "node", "left_anti").union(rest).distinct()


def gate_sets(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(node, gate): route-only nodes among the static ancestors of a node."""
    reach = closure(edges.where("kind = 'static'"))
    return reach.join(route_only(edges, order).withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("src").alias("gate"))


def router_rule_violations(edges: DataFrame) -> DataFrame:
    """Static edges that break the routing rules: children of a router that are not among its
    targets, and targets that depend on a router."""
    routers = edges.where("kind = 'conditional'").select("src").distinct()
    children = edges.where("kind = 'static'").join(routers, "src", "left_semi").select("src", "dst")
    stray = children.join(edges.where("kind = 'conditional'").select("src", "dst"), ["src", "dst"], "left_anti")
    targets = edges.where("kind = 'conditional'").select("dst").distinct()
    return stray.union(children.join(targets, "dst", "left_semi").select("src", "dst")).distinct()


def observed(steps: DataFrame, routers: Column, successors: int = 2) -> DataFrame:
    """Graph of the transitions that runs make: (src, dst, kind, key, max_visits).

    ``steps`` has run_id, pos, stage. A stage's static edges lead to its most frequent
    successors among later names (so they make no circle); the stages for which ``routers``
    holds get conditional edges to their most frequent successors of any name, keyed k1, k2,
    ..., with a bound on visits where they lead back."""
    follows = F.lead("stage").over(Window.partitionBy("run_id").orderBy("pos"))
    pairs = steps.select("run_id", F.col("stage").alias("src"), follows.alias("dst")).where("src <> dst")
    counts = pairs.groupBy("src", "dst").agg(F.count("*").alias("c"))  # a row per pair of stages from here on
    by = Window.partitionBy("src").orderBy(F.desc("c"), "dst")
    static = counts.where("src < dst").withColumn("r", F.row_number().over(by)).where(F.col("r") <= successors)
    routed = counts.where(routers).withColumn("r", F.row_number().over(by)).where(F.col("r") <= successors)
    static = static.select("src", "dst", F.lit("static").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("max_visits"))
    routed = routed.select("src", "dst", F.lit("conditional").alias("kind"), F.concat(F.lit("k"), F.col("r").cast("string")).alias("key"), F.when(F.col("dst") < F.col("src"), 3).alias("max_visits"))
    return durable(static.union(routed))
