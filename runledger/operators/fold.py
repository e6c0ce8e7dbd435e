"""Folds over the run ledger: state, point in time, provenance, forks, merges.

A ledger log is a DataFrame with (run_id, pos, stage, key, value): the value that the stage
completed at position ``pos`` of the run wrote to the key. Every fold is one hash aggregate
(``max_by`` has map-side partials), so a long run costs no sort and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable


def state_fold(log: DataFrame) -> DataFrame:
    """Last write of each key wins; a last write of null stays null."""
    return log.groupBy("run_id", "key").agg(F.max_by("value", "pos").alias("value"))


def producers(log: DataFrame) -> DataFrame:
    """State with the stage and position that produced each key."""
    return log.groupBy("run_id", "key").agg(F.max_by("value", "pos").alias("value"), F.max_by("stage", "pos").alias("producer"), F.max("pos").alias("pos"))


def before(log: DataFrame, stage: str) -> DataFrame:
    """Log rows before the first completion of ``stage``; runs without it keep all rows."""
    stop = log.where(F.col("stage") == stage).groupBy("run_id").agg(F.min("pos").alias("stop"))
    return log.join(stop, "run_id", "left").where(F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).drop("stop")


def state_before(log: DataFrame, stage: str) -> DataFrame:
    return state_fold(before(log, stage))


def as_document(state: DataFrame) -> DataFrame:
    """(run_id, state): each run's state as one JSON object, keys in order."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return state.groupBy("run_id").agg(F.to_json(pairs).alias("state"))


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``."""
    payload = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(payload, order).alias("r")).select(*keys, "r.*")


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "visit") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def align_visits(done: DataFrame, deltas: DataFrame, keep: DataFrame) -> DataFrame:
    """Pair the n-th completion of a stage with its delta.

    done (run_id, pos, stage), deltas (run_id, stage, visit_idx, ...), keep (run_id, stage,
    kc): a run with any keep row is a fork. A fork's first kc completions count from the
    front, all other completions from the tail of the deltas.
    """
    by = Window.partitionBy("run_id", "stage")
    rows = done.withColumns({"occ": F.row_number().over(by.orderBy("pos")) - 1, "total": F.count("*").over(by)})
    n = deltas.groupBy("run_id", "stage").agg(F.count("*").alias("n"))
    forks = keep.select("run_id").distinct().withColumn("fork", F.lit(True))
    rows = rows.join(n, ["run_id", "stage"]).join(keep, ["run_id", "stage"], "left").join(forks, "run_id", "left")
    front = F.coalesce("fork", F.lit(False)) & (F.col("occ") < F.coalesce("kc", F.lit(0)))
    rows = rows.withColumn("visit_idx", F.when(front, F.col("occ")).otherwise(F.col("n") - F.col("total") + F.col("occ")))
    rows = rows.where((F.col("visit_idx") >= 0) & (F.col("visit_idx") < F.col("n")))
    after = F.coalesce("fork", F.lit(False)) & (F.col("occ") >= F.coalesce("kc", F.lit(0)))
    rows = rows.select("run_id", "stage", "pos", "occ", "visit_idx", after.alias("after_cut"))
    return rows.join(deltas, ["run_id", "stage", "visit_idx"])


def fork_state(log: DataFrame, cut: DataFrame, overrides: DataFrame, merge=None) -> DataFrame:
    """State of forked runs: fold before the cut, overrides laid on top, later writes last.

    cut (run_id, boundary): first position after the fork; overrides (run_id, key, value).
    Both phases are conditional aggregates over one reading of the log.
    ``merge(old, new)`` combines a value with its override (default: replace).
    """
    merge = merge or (lambda old, new: new)
    late = F.coalesce(F.col("pos") >= F.col("boundary"), F.lit(False))
    last = lambda on: F.max_by(F.when(on, F.col("value")), F.when(on, F.col("pos")))
    both = log.join(cut, "run_id", "left").groupBy("run_id", "key").agg(last(~late).alias("old"), last(late).alias("value"), F.bool_or(late).alias("late"))
    given = overrides.select("run_id", "key", F.col("value").alias("new"), F.lit(True).alias("given"))
    out = both.join(given, ["run_id", "key"], "full_outer")
    early = F.when(F.col("given"), merge(F.col("old"), F.col("new"))).otherwise(F.col("old"))
    return out.select("run_id", "key", F.when(F.col("late"), F.col("value")).otherwise(early).alias("value"))


def state_merge(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Shallow upsert: values of ``delta`` replace those of ``state`` whole."""
    new = delta.select(*keys, F.col("value").alias("new"), F.lit(True).alias("given"))
    return state.join(new, keys, "full_outer").select(*keys, F.when(F.col("given"), F.col("new")).otherwise(F.col("value")).alias("value"))


def write_conflicts(writes: DataFrame, reach: DataFrame) -> DataFrame:
    """Writes of a key whose earlier producer is not upstream of the writer, however far.

    writes (run_id, pos, stage, key); reach (src, dst): closure of the stages' graph. What a
    run began with (<init>) may not be written again, what a fork put in (<fork>) may be."""
    by = Window.partitionBy("run_id", "key").orderBy("pos")
    rows = writes.withColumn("producer", F.lag("stage").over(by)).where(F.col("producer").isNotNull() & (F.col("producer") != F.col("stage")))
    rows = rows.where(~F.col("stage").isin("<init>", "<fork>") & (F.col("producer") != "<fork>"))
    allowed = reach.select(F.col("src").alias("producer"), F.col("dst").alias("stage"))
    return rows.join(allowed, ["producer", "stage"], "left_anti").select("run_id", "key", "pos", "stage", "producer")


def ancestry(forks: DataFrame) -> DataFrame:
    """(run_id, source, bound) of each run and the runs whose rows its state begins with.

    forks (run_id, parent_id, kept): a fork keeps the first ``kept`` positions of its parent,
    whose own rows stand after those that the parent keeps in turn; so of an ancestor's rows a
    run sees those before the smallest cut on the way. Pointers double: each round joins the
    pointers found last to all that start where they end, so a chain takes log rounds."""
    far = durable(forks.select("run_id", F.col("parent_id").alias("source"), F.col("kept").alias("bound")))
    hop = far  # pointers over exactly 2^k forks
    while not hop.isEmpty():
        on = hop.select(F.col("run_id").alias("via"), F.col("source").alias("to"), F.col("bound").alias("at"))
        step = lambda x: x.join(on, F.col("source") == F.col("via")).select("run_id", F.col("to").alias("source"), F.least("bound", "at").alias("bound"))
        far, hop = durable(far.union(step(far))), durable(step(hop))
    return far


def chained_state(log: DataFrame, forks: DataFrame, overrides: DataFrame) -> DataFrame:
    """(run_id, key, value, producer) of runs and forks of forks.

    log (run_id, n, stage, key, value) holds each run's own rows, n from 0; a fork's stand at
    kept + n. Overrides (run_id, key, value) come in at the fork's cut, before its own rows and
    after the kept ones, and are not handed down. One shuffle by run for the ancestors' rows,
    then one hash aggregate."""
    own = log.join(forks.select("run_id", "kept"), "run_id", "left").withColumn("pos", F.coalesce("kept", F.lit(0)) + F.col("n"))
    row = lambda rank: F.struct("pos", F.lit(rank).alias("rank")).alias("at")
    rows = own.select("run_id", "key", "value", "stage", row(1))
    kept = own.withColumnRenamed("run_id", "source").join(ancestry(forks), "source").where(F.col("pos") < F.col("bound")).select("run_id", "key", "value", "stage", row(1))
    put = overrides.join(forks.select("run_id", "kept"), "run_id").select("run_id", "key", "value", F.lit("<fork>").alias("stage"), F.struct(F.col("kept").cast(own.schema["pos"].dataType).alias("pos"), F.lit(0).alias("rank")).alias("at"))
    every = rows.union(kept).union(put)
    return every.groupBy("run_id", "key").agg(F.max_by("value", "at").alias("value"), F.max_by("stage", "at").alias("producer"))


def override_layers(layers: DataFrame) -> DataFrame:
    """Later layers win key by key; layers (run_id, key, value, priority), null values skipped."""
    return layers.where("value is not null").groupBy("run_id", "key").agg(F.max_by("value", "priority").alias("value"))


def override_apply(base: Column, patch: Column) -> Column:
    """Maps merged key by key: siblings stay, patched keys take the patch."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)
