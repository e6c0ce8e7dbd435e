"""Starts and ends of stages paired in a stream, with deadlines.

Events may come shuffled within the watermark's delay. A key (run, stage) holds back what the
watermark has not passed, then takes it in order of time: an end closes the latest open start,
unless that start's deadline was over; a start whose deadline passes unclosed is expired. Keys
are held and taken one by one, but come in groups by hash, a call for each group. State
is what is younger than delay and deadline, whatever the stream's length; a restart goes on
from the checkpoint. ``settled`` is the same question of a table, as one batch query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Keys share this many groups by hash: a call from Spark costs milliseconds, whatever it brings.
BUCKETS = 1024
OUT = "run_id long, stage string, start_seq long, end_seq long, status string"


def _advance(pending: list, open_: list, passed: int, deadline: int) -> tuple[list, list, list]:
    """Take the events up to ``passed`` (microseconds): what stays pending, what stays open, and
    (start, end or None, status) of what is settled. Events are (ts, seq, 1 for a start)."""
    out = []
    due = sorted(e for e in pending if e[0] <= passed)
    for ts, seq, start in due:
        if start:
            open_.append([ts, seq])
        elif open_:
            at, first = open_.pop()
            out.append((first, seq, "paired") if ts <= at + deadline else (first, None, "expired"))
    out += [(seq, None, "expired") for ts, seq in open_ if ts + deadline <= passed]
    return [e for e in pending if e[0] > passed], [s for s in open_ if s[0] + deadline > passed], out


def paired(events: DataFrame, delay: str, deadline_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """Streaming (run_id, stage, start_seq, end_seq, status) of events (run_id long, stage,
    seq, ts, is_start); status paired or expired. A row comes out once, when it is settled.
    ``buckets`` stays as it is for a checkpoint, as the number of state partitions does."""
    deadline = deadline_seconds * 1_000_000

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[list, list]] = {(r, s): (p, o) for r, s, p, o in json.loads(state.get[0])} if state.exists else {}
        for f in frames:
            for r, stage, t, s, b in zip(*(f[c].tolist() for c in ("run_id", "stage", "us", "seq", "is_start"))):
                held.setdefault((r, stage), ([], []))[0].append([t, s, b])
        out, stay, due = [], [], []
        for (r, stage), (pending, open_) in held.items():
            pending, open_, done = _advance(pending, open_, state.getCurrentWatermarkMs() * 1000, deadline)
            out += [(None if r is None else int(r), stage, *x) for x in done]
            if pending or open_:
                stay.append((r, stage, pending, open_))
                due.append(min([e[0] for e in pending] + [s[0] + deadline for s in open_]))
        if stay:
            state.update((json.dumps(stay, separators=(",", ":")),))
            # timers before the watermark fire, so this one fires as soon as the watermark is there
            state.setTimeoutTimestamp(max(-(-min(due) // 1000) - 1, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["run_id", "stage", "start_seq", "end_seq", "status"]).astype({"run_id": "Int64", "end_seq": "Int64"})

    # run_id as text, for pandas has no null among whole numbers
    rows = events.withWatermark("ts", delay).select(F.pmod(F.xxhash64("run_id", "stage"), F.lit(buckets)).alias("bucket"), F.col("run_id").cast("string").alias("run_id"), "stage", "seq", "ts", F.unix_micros("ts").alias("us"), F.col("is_start").cast("int").alias("is_start"))
    return rows.groupBy("bucket").applyInPandasWithState(run, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that the source holds now, appended to Parquet at ``path``; a later call with the
    same checkpoint goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(OUT).parquet(path)


def settled(events: DataFrame, delay_seconds: int, deadline_seconds: int) -> DataFrame:
    """What ``paired`` has put out when a stream of exactly these events has ended.

    Starts count up and ends down; a start's end is the next event of its (run, stage) at the
    same level, if that is an end. Only what the last watermark has passed is settled."""
    passed = events.agg(((F.floor(F.max(F.unix_micros("ts")) / 1000) - delay_seconds * 1000) * 1000).alias("passed"))
    rows = events.withColumn("us", F.unix_micros("ts")).crossJoin(F.broadcast(passed)).where("us <= passed")  # one row
    by = Window.partitionBy("run_id", "stage").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("depth", F.sum(F.when(F.col("is_start"), 1).otherwise(-1)).over(by)).withColumn("level", F.when(F.col("is_start"), F.col("depth")).otherwise(F.col("depth") + 1))
    at = Window.partitionBy("run_id", "stage", "level").orderBy("us", "seq")
    rows = rows.withColumns({k: F.lead(c).over(at) for k, c in (("next_start", "is_start"), ("next_seq", "seq"), ("next_us", "us"))}).where("is_start")
    limit = F.col("us") + deadline_seconds * 1_000_000
    ends = ~F.coalesce("next_start", F.lit(True)) & (F.col("next_us") <= limit)
    rows = rows.where(ends | (limit <= F.col("passed")) | (~F.coalesce("next_start", F.lit(True))))
    return rows.select("run_id", "stage", F.col("seq").alias("start_seq"), F.when(ends, F.col("next_seq")).alias("end_seq"), F.when(ends, "paired").otherwise("expired").alias("status"))
