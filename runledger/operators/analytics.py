"""Questions about runs: diffs, retention, sizes, attempts, events, fuses, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable


def diff(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Rows whose value differs between a and b; missing and null are the same."""
    left, right = a.select(*keys, F.col(value).alias("before")), b.select(*keys, F.col(value).alias("after"))
    return left.join(right, keys, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def diff_stages(rows: DataFrame, saves: DataFrame) -> DataFrame:
    """Per stage of every run and the run before it (rows: run_id, stage, status, input_hash,
    visits): pairs, and whether the input changed (null where either side has no hash)."""
    pairs = previous_runs(saves)
    old = rows.join(pairs.withColumnsRenamed({"run_id": "later", "before": "run_id"}), "run_id").drop("run_id").withColumnRenamed("later", "run_id")
    new = rows.join(pairs.select("run_id"), "run_id", "left_semi")
    sides = [x.select("run_id", "stage", *[F.col(c).alias(f"{c}_{s}") for c in ("status", "input_hash", "visits")]) for x, s in ((old, "a"), (new, "b"))]
    rows = sides[0].join(sides[1], ["run_id", "stage"], "full_outer")
    changed = F.when(F.col("input_hash_a").isNotNull() & F.col("input_hash_b").isNotNull(), F.col("input_hash_a") != F.col("input_hash_b"))
    return rows.select("run_id", "stage", "status_a", "status_b", changed.alias("input_changed"), F.coalesce("visits_a", F.lit(0)).alias("visits_a"), F.coalesce("visits_b", F.lit(0)).alias("visits_b"))


def prune_plan(saves: DataFrame, keep: int) -> DataFrame:
    """Runs to drop per task: all but the newest ``keep`` by (last save, run_id), and the latest."""
    runs = saves.groupBy("task_id", "run_id").agg(F.max("ts").alias("ts"), F.max("save_seq").alias("seq"))
    by = Window.partitionBy("task_id")
    runs = runs.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("ts"), F.desc("run_id"))), "newest": F.max("seq").over(by)})
    return runs.withColumn("drop", (F.col("rank") > keep) & (F.col("seq") != F.col("newest"))).select("task_id", "run_id", "rank", "drop")


def sweep_plan(references: DataFrame, drop: DataFrame) -> DataFrame:
    """(path): tables that a dropped run names and no run that stays does. References (run_id,
    path) hold for each run all that its state reads, also what it got by forking."""
    named = references.join(drop.select("run_id").distinct().withColumn("gone", F.lit(True)), "run_id", "left")
    return named.groupBy("path").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("free")).where("free").select("path")


def latest_run(saves: DataFrame) -> DataFrame:
    return saves.groupBy("task_id").agg(F.max_by("run_id", "save_seq").alias("run_id"))


def state_stats(state: DataFrame) -> DataFrame:
    size = F.length("value")
    return state.groupBy("run_id").agg(F.count("*").alias("n_keys"), F.sum(size).alias("total_chars"), F.max(size).alias("max_chars"))


def top_keys(state: DataFrame, n: int = 10) -> DataFrame:
    by = Window.partitionBy("run_id").orderBy(F.desc("chars"), "key")
    return state.select("run_id", "key", F.length("value").alias("chars")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def stage_timings(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("run_id", "stage").agg(F.round(F.sum("duration"), 3).alias("seconds"))


def attempt_audit(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("stage").agg(F.count("*").alias("attempts"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.countDistinct("run_id").alias("runs"), F.max("attempt").alias("most"))


def failure_triage(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.round(F.sum("cost"), 2).alias("cost"), F.max(F.substring("summary", 1, 2048)).alias("sample"))


def trace_summary(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per task: runs, latest run and attempts."""
    a = attempts.groupBy("run_id").agg(F.count("*").alias("n"))
    return runs.join(a, "run_id", "left").groupBy("task_id").agg(F.countDistinct("run_id").alias("total_runs"), F.max_by("run_id", "save_seq").alias("latest"), F.sum(F.coalesce("n", F.lit(0))).alias("attempts"))


def trace(saves: DataFrame, visits: DataFrame) -> DataFrame:
    """Per task its latest run: (task_id, run_id, total_runs, statuses, skipped, attempts).

    visits (run_id, stage, pos, status, attempt) with a row per attempt. statuses is a JSON
    object of each stage's last status, stages in order; a skipped stage counts as done there,
    and only ``skipped`` (names in order, comma-joined) tells. Attempts are those that ran."""
    newest = latest_run(saves).join(saves.groupBy("task_id").agg(F.countDistinct("run_id").alias("total_runs")), "task_id")
    own = visits.join(newest.select("run_id"), "run_id", "left_semi")
    last = own.groupBy("run_id", "stage").agg(F.max_by("status", F.struct("pos", "attempt")).alias("status"), F.count(F.when(F.col("status") != "skipped", 1)).alias("n"))
    shown = F.struct("stage", F.when(F.col("status") == "skipped", "done").otherwise(F.col("status")).alias("status"))
    per = last.groupBy("run_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(shown)))).alias("statuses"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "skipped", F.col("stage")))), ",").alias("skipped"), F.sum("n").alias("attempts"))
    return newest.join(per, "run_id").select("task_id", "run_id", "total_runs", "statuses", "skipped", "attempts")


def fork_preview(before: DataFrame, after: DataFrame, order: DataFrame, stage: str) -> DataFrame:
    """What a fork from ``stage`` would change: (run_id, key, before, after, reruns), the last
    being the stages from it on in order of declaration, comma-joined; order (stage, idx)."""
    at = order.where(F.col("stage") == stage).select(F.col("idx").alias("first"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("idx", "stage"))), lambda x: x["stage"])
    reruns = order.crossJoin(F.broadcast(at)).where("idx >= first").agg(F.array_join(names, ",").alias("reruns"))  # stages of one graph
    return diff(before, after, ["run_id", "key"]).crossJoin(F.broadcast(reruns))


def sink_lines(events: DataFrame) -> DataFrame:
    """(seq, line): events (seq, event, data) as lines of JSON. ``data`` is a map of doubles;
    those that are not finite are written by name, so that every line parses."""
    number = lambda v: F.when(F.isnan(v), '"nan"').when(v == float("inf"), '"inf"').when(v == float("-inf"), '"-inf"').otherwise(F.coalesce(v.cast("string"), F.lit("null")))
    pairs = F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), number(e["value"])))
    return events.select("seq", F.concat(F.lit('{"event":"'), F.col("event"), F.lit('","data":{'), F.array_join(pairs, ","), F.lit("}}")).alias("line"))


def sink_errors(events: DataFrame, most: int = 200) -> DataFrame:
    """(reason, first, n): events (seq, error) that could not be written, once for each reason
    (cut at ``most`` characters), with the first of them and their number."""
    bad = events.where("error is not null").select("seq", F.substring("error", 1, most).alias("reason"))
    return bad.groupBy("reason").agg(F.min("seq").alias("first"), F.count("*").alias("n"))


def unpaired(events: DataFrame, start: str, end: str) -> DataFrame:
    """Starts without their end: an end closes the latest open start before it of its (run,
    stage), and one without an open start closes nothing. Rows have run_id, stage, seq and the
    number of the start (visit).

    Starts count up and ends down; a start is open if the count never falls below what it
    was at the start again. Both sums are running ones, so a long run is sorted, not held."""
    by = Window.partitionBy("run_id", "stage")
    up = F.when(F.col("event") == start, 1).otherwise(-1)
    forth = by.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.where(F.col("event").isin(start, end)).withColumns({"depth": F.sum(up).over(forth), "visit": F.sum(F.greatest(up, F.lit(0))).over(forth).cast("int")})
    rows = rows.withColumn("lowest", F.min("depth").over(by.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)))
    still = F.col("lowest").isNull() | (F.col("lowest") >= F.col("depth"))
    return rows.where((F.col("event") == start) & still).select("run_id", "stage", "visit", "seq")


def in_flight(events: DataFrame, start: str, end: str) -> DataFrame:
    return unpaired(events, start, end).groupBy("run_id").agg(F.count("*").alias("open"))


def debounced(events: DataFrame, column: str) -> DataFrame:
    """Events whose value differs from the run's previous one."""
    last = F.lag(column).over(Window.partitionBy("run_id").orderBy("seq"))
    return events.withColumn("_last", last).where(~F.col(column).eqNullSafe(F.col("_last"))).drop("_last")


def heartbeats(stages: DataFrame, interval: float) -> DataFrame:
    return stages.withColumn("beats", F.floor(F.col("duration") / interval).cast("long"))


def visit_fuse(visits: DataFrame, most: int) -> DataFrame:
    """First position at which a stage of a run would start its visit number most + 1."""
    rows = visits.withColumn("visit", F.row_number().over(Window.partitionBy("run_id", "stage").orderBy("pos")))
    return rows.where(F.col("visit") == most + 1).select("run_id", "stage", "pos")


def step_fuse(steps: DataFrame, most: int) -> DataFrame:
    """Steps with the attempts made before them, and whether the fuse stops them."""
    by = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("attempts").over(by), F.lit(0)).cast("long")
    return steps.withColumn("used", used).withColumn("stopped", F.col("used") >= most)


def backoff_cap(attempt, most: float):
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def route_decisions(routers: DataFrame, edges: DataFrame) -> DataFrame:
    """Where each router decision leads; edges (stage, route, target)."""
    return routers.join(edges, ["stage", "route"])


def unmapped_routes(routers: DataFrame, edges: DataFrame) -> DataFrame:
    return routers.join(edges, ["stage", "route"], "left_anti")


def next_stage(order: DataFrame, done: DataFrame) -> DataFrame:
    """Per run the first stage of the order that is not done; order (stage, idx)."""
    todo = done.select("run_id").distinct().crossJoin(order).join(done.select("run_id", "stage").distinct(), ["run_id", "stage"], "left_anti")
    return todo.groupBy("run_id").agg(F.min_by("stage", "idx").alias("next"))


def last_decisions(decisions: DataFrame, mapping: DataFrame) -> DataFrame:
    """(run_id, router, target, seq): where each router of a run led last; decisions (run_id,
    router, route, seq), mapping (router, route, target)."""
    last = decisions.groupBy("run_id", "router").agg(F.max_by("route", "seq").alias("route"), F.max("seq").alias("seq"))
    return last.join(mapping, ["router", "route"]).select("run_id", "router", "target", "seq")


def stale_routes(decided: DataFrame, visits: DataFrame, reach: DataFrame) -> DataFrame:
    """(run_id, router, target, seq, stray, last): last decisions after which a stage ran that
    is neither the target nor reachable from it. visits (run_id, pos, stage), reach (src, dst).

    Visits are reduced to the last one of each stage first, with map-side combine, so the as-of
    join meets stages, not visits."""
    last = visits.groupBy("run_id", "stage").agg(F.max("pos").alias("last"))
    later = decided.join(last, "run_id").where((F.col("last") > F.col("seq")) & (F.col("stage") != F.col("target")))
    allowed = reach.select(F.col("src").alias("target"), F.col("dst").alias("stage"))
    return later.join(allowed, ["target", "stage"], "left_anti").select("run_id", "router", "target", "seq", F.col("stage").alias("stray"), "last")


def orphan_stages(stages: DataFrame, decided: DataFrame, visits: DataFrame, mapping: DataFrame, reach: DataFrame) -> DataFrame:
    """(run_id, stage): stages that a run never reached, and that none of its routers covers. A
    router whose last decision is not stale covers all its targets and what they lead to."""
    done = visits.select("run_id", "stage").distinct()
    stale = stale_routes(decided, visits, reach).select("run_id", "router").distinct()
    fresh = decided.select("run_id", "router").join(stale, ["run_id", "router"], "left_anti")
    targets = mapping.select("router", F.col("target").alias("stage")).distinct()
    beyond = targets.withColumnRenamed("stage", "src").join(reach, "src").select("router", F.col("dst").alias("stage"))
    covered = fresh.join(targets.union(beyond).distinct(), "router").select("run_id", "stage")
    every = done.groupBy("run_id").agg(F.collect_set("stage").alias("had")).crossJoin(F.broadcast(stages.agg(F.collect_set("stage").alias("named"))))  # one row of stage names
    todo = every.select("run_id", F.explode(F.array_except("named", "had")).alias("stage"))
    return todo.join(covered, ["run_id", "stage"], "left_anti")


def skippable(visits: DataFrame, history: DataFrame, static: DataFrame) -> DataFrame:
    """(run_id, stage, same, skipped): whether a stage's input is the one of its last done visit
    in the history, and whether the stage can be skipped: it and all its static ancestors are
    the same. visits and history (run_id, stage, input_hash), static (src, dst).

    Stages that are not the same block their children, round by round of the graph's levels:
    each round only carries on what the last one newly blocked. An ancestor that either side
    lacks blocks as well."""
    old = history.select("run_id", "stage", F.col("input_hash").alias("old"))
    same = durable(visits.join(old, ["run_id", "stage"], "left").select("run_id", "stage", F.coalesce(F.col("input_hash") == F.col("old"), F.lit(False)).alias("same")))
    edges = static.select("src", "dst").distinct()
    runs = same.select("run_id").distinct().crossJoin(F.broadcast(edges.select(F.col("src").alias("stage")).distinct()))  # stages of one graph
    lacking = runs.join(same.select("run_id", "stage"), ["run_id", "stage"], "left_anti")
    blocked = new = durable(same.where(~F.col("same")).select("run_id", "stage").union(lacking))
    while not new.isEmpty():
        children = new.join(edges, F.col("stage") == F.col("src")).select("run_id", F.col("dst").alias("stage")).distinct()
        new = durable(children.join(blocked, ["run_id", "stage"], "left_anti"))
        blocked = blocked.union(new)
    held = blocked.withColumn("held", F.lit(True))
    return same.join(held, ["run_id", "stage"], "left").select("run_id", "stage", "same", F.col("held").isNull().alias("skipped"))


def skip_candidates(visits: DataFrame) -> DataFrame:
    """Visits (run_id, stage, pos, input_hash) whose input hash equals that of the stage's visit
    before in the same run; runs are many, so no stage's visits meet in one task."""
    before = F.lag("input_hash").over(Window.partitionBy("run_id", "stage").orderBy("pos"))
    return visits.withColumn("_b", before).where(F.col("input_hash") == F.col("_b")).drop("_b")


def previous_runs(saves: DataFrame) -> DataFrame:
    """(run_id, before): each run of a task and the run saved last before it; saves (task_id,
    run_id, save_seq). Ids say nothing about the order, the sequence of saves does."""
    runs = saves.groupBy("task_id", "run_id").agg(F.max("save_seq").alias("seq"))
    by = Window.partitionBy("task_id").orderBy("seq")
    return runs.withColumn("before", F.lag("run_id").over(by)).where("before is not null").select("run_id", "before")


def diff_pairs(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen runs against chosen others: rows (run_id, keys, value) that differ, missing and
    null being the same; pairs (run_id, before)."""
    old = rows.join(pairs.withColumnsRenamed({"run_id": "later", "before": "run_id"}), "run_id").drop("run_id").withColumnRenamed("later", "run_id")
    return diff(old, rows.join(pairs.select("run_id"), "run_id", "left_semi"), ["run_id", *keys])


def diff_with_previous(rows: DataFrame, saves: DataFrame, keys: list[str]) -> DataFrame:
    """Every run against the one saved before it."""
    return diff_pairs(rows, previous_runs(saves), keys)


def incompatible(runs: DataFrame) -> DataFrame:
    """(run_id, workflow_hash, newest): runs whose structure is not that of the task's latest
    run; runs (task_id, run_id, save_seq, workflow_hash)."""
    newest = runs.groupBy("task_id").agg(F.max_by("workflow_hash", "save_seq").alias("newest"))
    return runs.join(newest, "task_id").where("workflow_hash <> newest").select("run_id", "workflow_hash", "newest")
