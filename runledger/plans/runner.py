"""Runs flows: retries, routing, loops, durable steps, resume, fork.

Each finished stage appends one JSON row to the run's ledger, after its DataFrames are
written as Parquet and read back; a row is the commit, so a run that died between the two
repeats the stage. Everything on the driver is scalars; data stays in Spark.
"""

from __future__ import annotations

import copy
import json
import random
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import Ledger
from .flow import Flow, RetryableError, StageError, StateConflictError


@dataclass(frozen=True)
class Policy:
    max_steps: int | None = None
    backoff_max: float = 30.0

    def __post_init__(self):
        if self.max_steps is not None and self.max_steps < 1 or self.backoff_max < 0:
            raise ValueError("limits must be positive")


@dataclass
class Context:
    spark: SparkSession
    state: dict[str, Any]
    stage: str
    attempt: int


@dataclass
class RunResult:
    status: str
    run_id: str
    state: dict[str, Any]
    error: str = ""
    error_category: str = ""
    failed_stage: str = ""
    events: list[tuple[str, dict]] = field(default_factory=list)


class Runner:
    def __init__(self, spark: SparkSession, root: str, policy: Policy = Policy(), sleep=time.sleep):
        self.spark, self.ledger, self.policy, self.sleep = spark, Ledger(spark, root), policy, sleep

    def _open(self, value: Any) -> Any:
        return self.spark.read.parquet(value["__parquet__"]) if isinstance(value, dict) and "__parquet__" in value else value

    def _store(self, run_id: str, stage: str, delta: dict) -> dict:
        out = {}
        for k, v in delta.items():
            if isinstance(v, DataFrame):
                path = f"{self.ledger.root}/data/{run_id}/{stage}/{k}-{uuid.uuid4().hex}"
                v.write.parquet(path)
                v = {"__parquet__": path}
            json.dumps(v, allow_nan=False)
            out[k] = v
        return out

    def run(self, flow: Flow, task_id: str, initial: dict | None = None, resume: bool = False) -> RunResult:
        flow.validate()
        self.ledger.check_task_id(task_id)
        last = self.ledger.latest(task_id) if resume else None
        if resume and last is None:
            raise ValueError(f"task {task_id} has no run")
        if last:
            head, rows = last
            if head["structure"] != flow.structure_hash():
                raise ValueError("the flow's structure has changed since that run")
            if {*head.get("kept", []), *(r["stage"] for r in rows)} >= {*flow.order()} and not (rows and rows[-1].get("to")):
                raise ValueError(f"the last run of {task_id} is done")
        else:
            head = {"task_id": task_id, "run_id": uuid.uuid4().hex, "structure": flow.structure_hash(), "initial": initial or {}, "overrides": {}, "cut": None}
            rows = []
            self.ledger.append(task_id, head["run_id"], 0, {"head": head})
        return self._drive(flow, head, rows)

    def fork(self, flow: Flow, task_id: str, stage: str, overrides: dict | None = None) -> RunResult:
        """A new run that keeps what the latest one did before ``stage``, with overrides there."""
        head, rows = self.ledger.latest(task_id) or ({}, [])
        if not head or stage not in [r["stage"] for r in rows]:
            raise ValueError(f"{stage} has not run in task {task_id}")
        flow.validate()
        if head["structure"] != flow.structure_hash():
            raise ValueError("the flow's structure has changed since that run")
        kept = rows[: [r["stage"] for r in rows].index(stage)]
        state, _ = self._fold(head, kept)
        new = head | {"run_id": uuid.uuid4().hex, "parent": head["run_id"], "initial": deep_merge(state, overrides or {}), "kept": [*head.get("kept", []), *(r["stage"] for r in kept)], "producers": "<fork>", "stage": stage}
        new["routes"] = [*head.get("routes", []), *([r["stage"], r["to"]] for r in kept if r.get("to"))]
        self.ledger.append(task_id, new["run_id"], 0, {"head": new})
        return self._drive(flow, new, [])

    def _fold(self, head: dict, rows: list[dict]) -> tuple[dict, dict]:
        state = dict(head["initial"])
        made = {k: head.get("producers", "<init>") for k in state}
        for r in rows:
            state |= r["delta"]
            made |= dict.fromkeys(r["delta"], r["stage"])
        return state, made

    def _drive(self, flow: Flow, head: dict, rows: list[dict]) -> RunResult:
        task, run_id, events = head["task_id"], head["run_id"], []
        state, made = self._fold(head, rows)
        order, only = flow.order(), flow.route_only()
        done = {*head.get("kept", []), *(r["stage"] for r in rows)}
        visits: dict[str, int] = {}
        for name in head.get("kept", []):  # visits before a fork count towards max_visits
            visits[name] = visits.get(name, 0) + 1
        for r in rows:
            visits[r["stage"]] = visits.get(r["stage"], 0) + 1
            if r.get("to"):  # a route re-arms its target and what follows it
                done -= {r["to"], *flow.reach(r["to"], False)}
        routes = [*map(tuple, head.get("routes", [])), *((r["stage"], r["to"]) for r in rows if r.get("to"))]
        routed = {to for _, to in routes}
        current = rows[-1]["to"] if rows and rows[-1].get("to") else None
        if not rows:
            current = head.get("stage")  # a fork begins with the stage it was asked for
        steps = 0

        def following() -> str | None:
            for n in order:
                gates = {g for g in only if n in flow.reach(g, False)} - routed
                if n not in done and n not in only and not gates and all(d in done for d in flow.stages[n].depends_on):
                    return n
            return None

        def failed(stage: str, error: Exception, category: str = "") -> RunResult:
            return RunResult("failed", run_id, state, f"{type(error).__name__}: {error}"[:500], category, stage, events)

        current = current or following()
        while current:
            stage, router = flow.stages[current], flow.routers.get(current)
            if router and router.max_visits is not None and visits.get(current, 0) >= router.max_visits:
                return failed(current, StageError(f"more than {router.max_visits} visits"))
            for attempt in range(1, stage.retries + 2):
                if self.policy.max_steps is not None and steps >= self.policy.max_steps:
                    return failed(current, StageError("max_steps reached"))
                steps += 1
                events.append(("stage_start", {"stage": current, "attempt": attempt}))
                try:
                    delta = stage.fn(Context(self.spark, {k: self._open(copy.deepcopy(v)) for k, v in state.items()}, current, attempt))
                    if delta is not None and not isinstance(delta, dict):
                        raise StageError("a stage returns a dict or None")
                    for k in delta or {}:
                        owner = made.get(k)
                        if owner and owner not in (current, "<fork>") and (owner == "<init>" or current not in flow.reach(owner)):
                            raise StateConflictError(f"{k} belongs to {owner}")
                    stored = self._store(run_id, current, delta or {})
                    break
                except (RetryableError, TimeoutError) as e:
                    events.append(("stage_end", {"stage": current, "status": "retry"}))
                    if attempt > stage.retries:
                        return failed(current, e)
                    self.sleep(random.uniform(0, min(2.0 ** (attempt - 1), self.policy.backoff_max)))
                except Exception as e:
                    events.append(("stage_end", {"stage": current, "status": "failed"}))
                    return failed(current, e, getattr(e, "category", ""))
            state |= stored
            made |= dict.fromkeys(stored, current)
            to = None
            if router:
                key = router.route(copy.deepcopy(state))
                if key not in router.mapping:
                    return failed(current, StageError(f"route {key!r} is not mapped"))
                to = router.mapping[key]
            visits[current] = visits.get(current, 0) + 1
            rows.append({"stage": current, "delta": stored, "to": to, "ts": time.time()})
            self.ledger.append(task, run_id, len(rows), rows[-1])
            events.append(("stage_end", {"stage": current, "status": "done", "visit": visits[current]}))
            done.add(current)
            if to:
                done -= {to, *flow.reach(to, False)}
                routed.add(to)
                routes.append((current, to))
            current = to or following()
        declared = {t for r, _ in routes for t in flow.routers[r].mapping.values()}
        missed = [n for n in order if n not in done and not any(n == t or n in flow.reach(t) for t in declared)]
        if missed:
            return failed(missed[0], StageError(f"no route led to {missed}"))
        return RunResult("done", run_id, state, events=events)


def deep_merge(base: dict, patch: dict) -> dict:
    """Patch laid into base: dicts key by key, anything else replaced; base is not changed."""
    out = dict(base)
    for k, v in patch.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
