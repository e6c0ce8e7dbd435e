import pytest

from runledger.plans.flow import Flow, FlowError, RetryableError, StageError
from runledger.plans.runner import Policy, Runner, deep_merge


def linear(fail=None):
    f = Flow("linear")

    @f.stage()
    def a(ctx):
        return {"a": ctx.state.get("a_in", 1), "rows": ctx.spark.range(3)}

    @f.stage(["a"])
    def b(ctx):
        if fail and fail.pop():
            raise StageError("boom", "SEARCH")
        return {"b": ctx.state["a"] * 7, "n": ctx.state["rows"].count()}

    return f


def test_run_resume_fork(spark, tmp_path):
    r = Runner(spark, str(tmp_path))
    fail = [False, True]
    first = r.run(linear(fail), "t1")
    assert (first.status, first.failed_stage, first.error_category) == ("failed", "b", "SEARCH")
    again = r.run(linear(fail), "t1", resume=True)
    assert again.status == "done" and again.run_id == first.run_id and (again.state["b"], again.state["n"]) == (7, 3)
    assert [e[1]["stage"] for e in again.events if e[0] == "stage_start"] == ["b"]
    fork = r.fork(linear(), "t1", "b", {"a": 2})
    assert fork.state["b"] == 14 and fork.run_id != first.run_id
    assert r.ledger.rows("t1").select("run_id").distinct().count() == 2


def test_loop_retry_and_fuses(spark, tmp_path):
    f, tries, sleeps = Flow("loop"), [], []

    @f.stage()
    def work(ctx):
        return {"n": ctx.state.get("n", 0) + 1}

    @f.stage(["work"], retries=2)
    def check(ctx):
        tries.append(1)
        if len(tries) == 1:
            raise RetryableError("later")
        return {"last": ctx.state["n"]}

    @f.stage()
    def end(ctx):
        return {"rounds": ctx.state["n"]}

    f.route("check", lambda s: "more" if s["n"] < 3 else "stop", {"more": "work", "stop": "end"}, max_visits=5)
    got = Runner(spark, str(tmp_path), Policy(backoff_max=0.5), sleeps.append).run(f, "t")
    assert (got.status, got.state["rounds"], got.state["last"]) == ("done", 3, 3) and all(s <= 0.5 for s in sleeps)
    assert Runner(spark, str(tmp_path), Policy(max_steps=1)).run(f, "u").status == "failed"


def test_conflict_and_validation(spark, tmp_path):
    f = Flow("diamond")
    f.stage()(lambda_named("a", {}))
    f.stage(["a"])(lambda_named("b", {"k": "B"}))
    f.stage(["a"])(lambda_named("c", {"k": "C"}))
    got = Runner(spark, str(tmp_path)).run(f, "t")
    assert got.status == "failed" and "StateConflictError" in got.error
    g = Flow("cycle")
    g.stage(["y"])(lambda_named("x", {}))
    g.stage(["x"])(lambda_named("y", {}))
    with pytest.raises(FlowError):
        g.validate()
    with pytest.raises(ValueError):
        Runner(spark, str(tmp_path)).run(f, "..")


def lambda_named(name, delta):
    def fn(ctx):
        return delta

    fn.__name__ = name
    return fn


def test_deep_merge():
    assert deep_merge({"a": {"x": 1, "y": 2}, "l": [1]}, {"a": {"y": 3}, "l": [2]}) == {"a": {"x": 1, "y": 3}, "l": [2]}


def test_ledger_answers_queries(spark, tmp_path):
    """State, provenance, diff and retention of runs that the runner wrote."""
    import json

    from runledger.operators import analytics, fold

    f = Flow("story")

    @f.stage()
    def plan(ctx):
        ctx.state["cfg"]["x"] = 99  # a stage's own copy
        return {"topic": "a\"b", "k": None, "n": 1}

    @f.stage(["plan"])
    def write(ctx):
        return {"n": ctx.state["n"] + ctx.state["cfg"]["x"], "list": [1, {"a": 2}]}

    r = Runner(spark, str(tmp_path))
    first = r.run(f, "t1", {"cfg": {"x": 1, "y": 2}})
    assert first.status == "done" and first.state["cfg"] == {"x": 1, "y": 2}
    fork = r.fork(f, "t1", "write", {"cfg": {"x": 5}})
    assert fork.state["n"] == 6 and fork.state["cfg"] == {"x": 5, "y": 2}
    log = r.ledger.log("t1")
    for run in (first, fork):
        rows = fold.producers(log.where(log.run_id == run.run_id)).collect()
        assert {x.key: json.loads(x.value) for x in rows} == run.state
        assert {x.key: x.producer for x in rows}["cfg"] == ("<init>" if run is first else "<fork>")
    pairs = {(x.before, x.after) for x in analytics.diff(*(fold.state_fold(log.where(log.run_id == x.run_id)) for x in (first, fork)), ["key"]).collect()}
    assert ("2", "6") in pairs and len(pairs) == 2
    assert {(x.stage, x.pos) for x in r.ledger.visits("t1").where(f"run_id = '{first.run_id}'").collect()} == {("plan", 1), ("write", 2)}
    assert r.ledger.runs().count() == 2
    assert r.ledger.prune("t1", 1, dry_run=True) == [first.run_id] == r.ledger.prune("t1", 1) and r.ledger.runs().count() == 1


def test_guards(spark, tmp_path):
    r = Runner(spark, str(tmp_path))
    r.run(linear(), "t1")
    with pytest.raises(ValueError, match="done"):
        r.run(linear(), "t1", resume=True)
    other = linear()
    other.name = "other"
    with pytest.raises(ValueError, match="structure"):
        r.fork(other, "t1", "b")

    def routed(route, most):
        f = Flow("routed")
        for name in ("head", "left", "right"):
            f.stage()(_named(name))
        f.route("head", route, {"l": "left", "r": "right"}, most)
        return f

    left, right = (lambda s: "l"), (lambda s: "r")
    hashes = {routed(left, None).structure_hash(), routed(right, None).structure_hash(), routed(left, 2).structure_hash()}
    assert len(hashes) >= 2 and routed(left, None).route_only() == {"left", "right"}
    bad = routed(left, None)
    bad.stage(["head"])(_named("late"))
    with pytest.raises(FlowError):
        bad.validate()


def _named(name):
    def fn(ctx):
        return None

    fn.__name__ = name
    return fn


def test_closure_of_a_long_chain(spark):
    from runledger.operators import graph

    edges = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}", "static") for i in range(120)] + [("n0120", "n0000", "conditional")], "src string, dst string, kind string")
    assert graph.closure(edges.where("kind = 'static'")).count() == 121 * 120 // 2
    assert graph.cycle_nodes(edges).count() == 121


def branching():
    f = Flow("branching")

    @f.stage()
    def r(ctx):
        return {"r": 1}

    @f.stage()
    def x(ctx):
        return {"x": ctx.spark.range(5)}

    @f.stage(["x"])
    def y(ctx):
        return {"y": ctx.state["x"].count() + ctx.state.get("more", 0)}

    @f.stage()
    def z(ctx):
        return {"z": 1}

    f.route("r", lambda s: "x", {"x": "x", "z": "z"})
    return f


@pytest.mark.parametrize("stage,ran", [("x", ["x", "y"]), ("y", ["y"]), ("r", ["r", "x", "y"])])
def test_fork_runs_its_stage_behind_a_route(spark, tmp_path, stage, ran):
    r = Runner(spark, str(tmp_path))
    assert r.run(branching(), "t").status == "done"
    fork = r.fork(branching(), "t", stage, {"more": 2})
    assert fork.status == "done" and fork.state["y"] == 7
    assert [e[1]["stage"] for e in fork.events if e[0] == "stage_start"] == ran


def test_prune_keeps_what_forks_read(spark, tmp_path):
    r = Runner(spark, str(tmp_path))
    first = r.run(branching(), "t")
    fork = r.fork(branching(), "t", "y")
    assert r.ledger.prune("t", 1, dry_run=True) == [first.run_id]
    assert r.ledger.prune("t", 1) == [first.run_id]
    assert spark.read.parquet(fork.state["x"]["__parquet__"]).count() == 5
    assert {x["run_id"] for x in r.ledger.rows("t").select("run_id").distinct().collect()} == {fork.run_id}
    other = r.run(branching(), "t")
    assert r.ledger.prune("t", 1) == [fork.run_id]
    import glob

    assert len(glob.glob(f"{tmp_path}/data/*/*/*")) == 1 and spark.read.parquet(other.state["x"]["__parquet__"]).count() == 5


def test_ledger_reads_the_files_of_a_run_only(spark, tmp_path):
    r = Runner(spark, str(tmp_path))
    runs = [r.run(linear(), f"t{i % 2}").run_id for i in range(4)]
    own = r.ledger.rows().where(f"run_id = '{runs[2]}'")
    assert own.count() == 3 and len(r.ledger.rows().inputFiles()) == 12
    plan = own._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    own.collect()
    assert scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters()).apply(0).files().size() == 3
    assert r.ledger.rows("t1").count() == 6
    # a stream sees the same rows, and later commits once
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def streamed():
        q = r.ledger.stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("task_id", "run_id", "seq", "body").collect()))

    table = lambda: sorted(map(tuple, r.ledger.rows().select("task_id", "run_id", "seq", "body").collect()))
    assert streamed() == table()
    r.run(linear(), "t1")
    assert len(table()) == 15 and streamed() == table()
