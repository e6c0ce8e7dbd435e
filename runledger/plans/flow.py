"""Stages and edges of a pipeline: DataFrame transformations in a validated graph."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field


class FlowError(Exception):
    """A graph that cannot run."""


class StageError(Exception):
    """A stage failed for good; ``category`` says why."""

    def __init__(self, message: str, category: str = ""):
        super().__init__(message)
        self.category = category


class RetryableError(Exception):
    """A stage failed and may be tried again."""


class StateConflictError(Exception):
    """A stage wrote a key that a stage not upstream of it produced."""


@dataclass(frozen=True)
class Stage:
    name: str
    fn: Callable
    depends_on: tuple[str, ...] = ()
    retries: int = 0


@dataclass(frozen=True)
class Router:
    stage: str
    route: Callable[[dict], str]
    mapping: dict[str, str]
    max_visits: int | None = None


@dataclass
class Flow:
    """``fn(ctx)`` of a stage returns a dict: DataFrames become Parquet, the rest is JSON."""

    name: str
    stages: dict[str, Stage] = field(default_factory=dict)
    routers: dict[str, Router] = field(default_factory=dict)

    def stage(self, depends_on: tuple[str, ...] | list[str] = (), retries: int = 0):
        def add(fn: Callable) -> Callable:
            if fn.__name__ in self.stages:
                raise FlowError(f"stage {fn.__name__} is declared twice")
            self.stages[fn.__name__] = Stage(fn.__name__, fn, tuple(depends_on), retries)
            return fn

        return add

    def route(self, stage: str, fn: Callable[[dict], str], mapping: dict[str, str], max_visits: int | None = None) -> None:
        if stage in self.routers:
            raise FlowError(f"{stage} routes twice")
        if max_visits is not None and max_visits < 1:
            raise FlowError("max_visits must be positive")
        self.routers[stage] = Router(stage, fn, dict(mapping), max_visits)

    def edges(self, conditional: bool = True) -> list[tuple[str, str]]:
        out = [(d, s.name) for s in self.stages.values() for d in s.depends_on]
        return out + [(r.stage, x) for r in self.routers.values() for x in r.mapping.values()] * conditional

    def reach(self, start: str, conditional: bool = True) -> set[str]:
        """Stages that ``start`` leads to."""
        out, todo, edges = set(), [start], self.edges(conditional)
        while todo:
            node = todo.pop()
            new = {b for a, b in edges if a == node} - out
            out |= new
            todo += new
        return out

    def order(self) -> list[str]:
        """Topological order, ties as declared."""
        left, out = dict(self.stages), []
        while left:
            ready = next((n for n, s in left.items() if all(d in out for d in s.depends_on)), None)
            if ready is None:
                raise FlowError(f"cycle among {sorted(left)}")
            out.append(ready)
            del left[ready]
        return out

    def validate(self) -> None:
        for a, b in self.edges():
            for x in (a, b):
                if x not in self.stages:
                    raise FlowError(f"unknown stage {x}")
        self.order()
        for r in self.routers.values():
            for s in self.stages.values():
                if r.stage in s.depends_on and s.name not in r.mapping.values():
                    raise FlowError(f"{s.name} depends on router {r.stage} but is no target of it")
            for x in r.mapping.values():
                for d in self.stages[x].depends_on:
                    if d in self.routers:
                        raise FlowError(f"{x} is a target and must not depend on router {d}")
            if r.max_visits is None and r.stage in self.reach(r.stage):
                raise FlowError(f"router {r.stage} closes a loop and needs max_visits")

    def route_only(self) -> set[str]:
        """Targets that run only when routed to: those ahead of their router; on a loop, those
        without a static parent if a parent from outside enters the loop. Of the other such,
        loops of routers alone, the first declared starts."""
        reach = {n: self.reach(n) for n in self.stages}
        ring = {n: {n, *(m for m in reach[n] if n in reach[m])} for n in self.stages}
        out, pure = set(), set()
        for r in self.routers.values():
            for x in r.mapping.values():
                if r.stage not in reach[x]:
                    out.add(x)
                elif not self.stages[x].depends_on:
                    entered = any(d not in ring[x] for m in ring[x] for d in self.stages[m].depends_on)
                    (out if entered else pure).add(x)
        first = next((n for n in self.stages if n in pure), None)
        return (out | pure) - {first}

    def structure_hash(self) -> str:
        rows = [f"flow={self.name}", *(f"{n}<{','.join(sorted(self.stages[n].depends_on))} retries={self.stages[n].retries}" for n in self.order())]
        rows += sorted(f"{r.stage}?{sorted(r.mapping.items())} max_visits={r.max_visits} by {source_id(r.route)}" for r in self.routers.values())
        return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def source_id(fn: Callable) -> str:
    """A hash of a function's source, of its bytecode where there is none, or else its type."""
    try:
        text = inspect.getsource(fn)
    except (OSError, TypeError):
        code = getattr(fn, "__code__", None)
        text = repr((code.co_code, code.co_consts)) if code else type(fn).__name__
    return hashlib.sha256(text.encode()).hexdigest()[:16]
