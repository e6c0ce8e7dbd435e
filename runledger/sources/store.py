"""The run ledger on any file system that Spark can write: one JSON file per committed row, in
a folder per task and run. The folders are partition columns, so a filter on task or run is a
partition filter: Spark's planner lists and reads the files of those runs only, in a batch and
in a stream (whose offsets are the file source's own log)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, saved_at double, body string, task_id string, run_id string"


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def check_task_id(task_id: str) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]{1,128}", task_id) or set(task_id) == {"."}:
            raise ValueError(f"bad task id {task_id!r}")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def append(self, task_id: str, run_id: str, seq: int, body: dict) -> None:
        """Commit a row: written beside, then renamed, so a reader never sees half of it."""
        import time

        row = json.dumps({"seq": seq, "saved_at": time.time(), "body": json.dumps(body, sort_keys=True)})
        folder = f"{self.root}/ledger/task_id={task_id}/run_id={run_id}"
        fs, to = self._fs(f"{folder}/{seq:06d}.json")
        _, tmp = self._fs(f"{folder}/.{seq:06d}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(row.encode()))
        out.close()
        if not fs.rename(tmp, to):
            raise OSError(f"could not commit {to}")

    def rows(self, task_id: str | None = None) -> DataFrame:
        """The ledger as a DataFrame; a damaged row is an error, not a missing one."""
        rows = self.spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(f"{self.root}/ledger")
        return rows if task_id is None else rows.where(F.col("task_id") == task_id)

    def stream(self) -> DataFrame:
        """The rows as a stream: those that are there, then every later commit once."""
        return self.spark.readStream.schema(SCHEMA).option("mode", "FAILFAST").json(f"{self.root}/ledger")

    def visits(self, task_id: str | None = None) -> DataFrame:
        """(task_id, run_id, pos, stage, route, ts, delta_json): the finished visits of runs."""
        body = F.parse_json("body")
        rows = self.rows(task_id).where("seq > 0").select("task_id", "run_id", F.col("seq").alias("pos"), "saved_at", body.alias("b"))
        field = lambda name, kind: F.variant_get("b", f"$.{name}", kind)
        return rows.select("task_id", "run_id", "pos", field("stage", "string").alias("stage"), field("to", "string").alias("route"), field("ts", "double").alias("ts"), F.to_json(F.variant_get("b", "$.delta", "variant")).alias("delta_json"))

    def log(self, task_id: str | None = None) -> DataFrame:
        """The runs as the folds want them: (run_id, pos, stage, key, value), value as JSON text.
        What a run began with stands at pos 0, written by <init>, or <fork> for a fork."""
        body = F.parse_json("body")
        heads = self.rows(task_id).where("seq = 0").select("run_id", F.lit(0).cast("long").alias("pos"), F.coalesce(F.variant_get(body, "$.head.producers", "string"), F.lit("<init>")).alias("stage"), F.to_json(F.variant_get(body, "$.head.initial", "variant")).alias("delta_json"))
        rows = heads.unionByName(self.visits(task_id).select("run_id", "pos", "stage", "delta_json")).withColumnRenamed("pos", "at")
        return rows.lateralJoin(self.spark.tvf.variant_explode(F.parse_json(F.col("delta_json").outer()))).select("run_id", F.col("at").alias("pos"), "stage", "key", F.to_json("value").alias("value"))

    def saves(self, task_id: str | None = None) -> DataFrame:
        """(task_id, run_id, save_seq, ts) of every committed row, for retention and latest runs."""
        return self.rows(task_id).select("task_id", "run_id", F.col("seq").alias("save_seq"), F.timestamp_micros((F.col("saved_at") * 1000000).cast("long")).alias("ts"))

    def runs(self) -> DataFrame:
        """(task_id, run_id) of all runs."""
        return self.rows().select("task_id", "run_id").distinct()

    def references(self, task_id: str | None = None) -> DataFrame:
        """(run_id, path): the tables that each run's rows name, its own and those it forked with."""
        named = F.regexp_extract_all("body", F.lit(r'"__parquet__": "((?:[^"\\]|\\.)*)"'))
        return self.rows(task_id).select("run_id", F.explode(named).alias("path")).distinct()

    def prune(self, task_id: str, keep: int, dry_run: bool = False) -> list[str]:
        """Remove all but the newest ``keep`` runs of a task, never the latest; the run ids. Of
        their tables only those go that no run that stays names, of this task or another."""
        from ..operators.analytics import prune_plan, sweep_plan

        saves = self.saves(task_id).withColumn("save_seq", F.unix_micros("ts"))
        drop = prune_plan(saves, keep).where("drop").select("run_id")
        gone = sorted(r["run_id"] for r in drop.toLocalIterator())
        if dry_run or not gone:
            return gone
        for path in [r["path"] for r in sweep_plan(self.references(), drop).toLocalIterator()]:
            fs, data = self._fs(path)
            fs.delete(data, True)
        for run_id in gone:
            fs, rows = self._fs(f"{self.root}/ledger/task_id={task_id}/run_id={run_id}")
            fs.delete(rows, True)
        return gone

    def latest(self, task_id: str) -> tuple[dict, list[dict]] | None:
        """Head and rows of the run saved last; None if the task has none."""
        fs, p = self._fs(f"{self.root}/ledger/task_id={task_id}")
        if not fs.exists(p):
            return None
        rows = self.rows(task_id)
        last = rows.selectExpr("max_by(run_id, saved_at) as r").first()["r"]
        if last is None:
            return None
        own = [json.loads(r["body"]) for r in rows.where(rows["run_id"] == last).orderBy("seq").collect()]
        return own[0]["head"], own[1:]
