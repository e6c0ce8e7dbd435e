"""Nested states, digests and streams against plain Python, on awkward rows."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from runledger.operators import analytics, content, fold, graph, nested
from runledger.streaming import pairing

LONG, MANY = "x" * 201, list(range(51))
VALUES = [1, 1.0, True, 0, None, "1", "a", "", LONG, MANY, [], [1, {"b": 2}], {}, {"p": 1}, {"p": {"q": None}}, {"p": {"q": {"r": [1]}}, "s": 2}, 2**53 + 1, 2**53, -0.5]


def shown(v):
    if isinstance(v, str) and len(v) > 200:
        v = v[:200] + f"...(truncated, total {len(v)} chars)"
    if isinstance(v, list) and len(v) > 50:
        v = [*v[:50], "...(truncated)"]
    return v


def plain_diff(a, b, path=""):
    out = {}
    for k in {*a, *b}:
        at, x, y = f"{path}.{k}" if path else k, a.get(k), b.get(k)
        if isinstance(x, dict) and isinstance(y, dict):
            out |= plain_diff(x, y, at)
        elif x != y:
            out[at] = (shown(x), shown(y))
    return out


def test_leaf_diff(spark):
    rng = random.Random(1)
    make = lambda: {k: copy.deepcopy(rng.choice(VALUES)) for k in rng.sample(["a", "b", "c", "d e"], rng.randint(0, 4))}
    pairs = [({"v": x}, {"v": y}) for x in VALUES for y in VALUES] + [({"v": {"w": {"z": x}}}, {"v": {"w": {"z": y}}}) for x in VALUES[:8] for y in VALUES] + [(make(), make()) for _ in range(100)]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(-1, None, '{"a":1}'), (-2, "not json", None), (-3, "[1]", "3")]
    got = {}
    for r in nested.leaf_diff(spark.createDataFrame(rows, "id long, x string, y string"), ["id"], "x", "y").collect():
        got.setdefault(r.id, {})[r.path] = tuple(None if v is None else json.loads(v) for v in (r.before, r.after))
    for i, (a, b) in enumerate(pairs):
        assert got.get(i, {}) == plain_diff(a, b), (a, b)
    assert got[-1] == {"a": (None, 1)} and -2 not in got and -3 not in got
    assert nested.leaf_diff(spark.createDataFrame([], "id long, x string, y string"), ["id"], "x", "y").count() == 0


def plain_override(layers):
    """Each patch in turn: dot paths are set, objects merged, anything else replaced."""
    state = {}

    def merge(into, patch):
        for k, v in patch.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                merge(into[k], v)
            else:
                into[k] = copy.deepcopy(v)

    for patch in layers:
        for k, v in patch.items():
            *way, last = k.split(".")
            if not way:
                merge(state, {k: v})
                continue
            at = state
            for p in way:
                if not isinstance(at.get(p), dict):
                    at[p] = {}
                at = at[p]
            at[last] = copy.deepcopy(v)
    out = {}

    def leaves(d, path):
        for k, v in d.items():
            if isinstance(v, dict) and v:
                leaves(v, [*path, k])
            else:
                out[".".join([*path, k])] = v

    leaves(state, [])
    return out


def test_deep_override(spark):
    rng = random.Random(2)
    values = [1, "s", None, [1, 2], {}, {"x": 1}, {"x": {"y": 2}, "z": {}}, {"y": {"x": {"z": 3}}}]
    runs = {r: [{rng.choice(["x", "y", "x.y", "y.x", "x.y.z", "z"]): copy.deepcopy(rng.choice(values))} for _ in range(rng.randint(1, 7))] for r in range(300)}
    rows = [(r, i, json.dumps(p)) for r, layers in runs.items() for i, p in enumerate(layers)]
    got = {}
    for row in nested.deep_override(spark.createDataFrame(rows, "run long, ord int, doc string").repartition(3), ["run"], "ord", "doc").collect():
        assert row.path not in got.setdefault(row.run, {})
        got[row.run][row.path] = json.loads(row.value)
    for r, layers in runs.items():
        assert got.get(r, {}) == plain_override(layers), layers


def test_chain_of_forks(spark):
    """A fork of a fork of a fork, cut inside what an earlier one kept."""
    log = [("g", i, f"g{i}", k, v) for i, (k, v) in enumerate([("a", 1.0), ("b", 2.0), ("c", 3.0), ("a", 4.0)])]
    log += [("p", 0, "p0", "c", 5.0), ("p", 1, "p1", "d", 6.0), ("r", 0, "r0", "e", 7.0), ("s", 0, "s0", "a", 8.0)]
    forks = spark.createDataFrame([("p", "g", 3), ("r", "p", 4), ("s", "r", 1)], "run_id string, parent_id string, kept long")
    got = {(r.run_id, r.source): r.bound for r in fold.ancestry(forks).collect()}
    assert got == {("p", "g"): 3, ("r", "p"): 4, ("r", "g"): 3, ("s", "r"): 1, ("s", "p"): 1, ("s", "g"): 1}
    put = spark.createDataFrame([("p", "b", -1.0), ("r", "e", -2.0), ("r", "z", -3.0)], "run_id string, key string, value double")
    rows = fold.chained_state(spark.createDataFrame(log, "run_id string, n long, stage string, key string, value double"), forks, put).collect()
    state = {}
    for r in rows:
        state.setdefault(r.run_id, {})[r.key] = (r.value, r.producer)
    assert state["p"] == {"a": (1.0, "g0"), "b": (-1.0, "<fork>"), "c": (5.0, "p0"), "d": (6.0, "p1")}
    assert state["r"] == {"a": (1.0, "g0"), "b": (2.0, "g1"), "c": (5.0, "p0"), "e": (7.0, "r0"), "z": (-3.0, "<fork>")}
    assert state["s"] == {"a": (8.0, "s0")}
    deep = spark.createDataFrame([(i, i - 1, 100 - i) for i in range(1, 21)], "run_id long, parent_id long, kept long")
    far = {(r.run_id, r.source): r.bound for r in fold.ancestry(deep).collect()}
    assert len(far) == 210 and far[20, 0] == 80 and far[7, 3] == 93


def test_digest_and_range_diff(spark):
    a = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"), F.when(F.col("id") % 3 > 0, F.lit("")).alias("w"))
    one = content.content_digest(a, ["k", "v", "w"]).first()
    assert content.content_digest(a.repartition(7, "v").orderBy(F.desc("k")), ["k", "v", "w"]).first() == one
    assert content.content_digest(a.withColumn("w", F.lit("")), ["k", "v", "w"]).first() != one
    assert content.content_digest(a.union(a.limit(1)), ["k", "v", "w"]).first() != one
    b = a.where("k <> 77").withColumn("v", F.when(F.col("k") == 15_003, "new").otherwise(F.col("v")))
    trees = [content.tree(x, "k", ["k", "v", "w"], 64) for x in (a, b)]
    nodes = content.differing(*trees)
    leaves = nodes.where("level = 0")
    assert sorted(r.node for r in leaves.collect()) == [77 // 64, 15_003 // 64]
    read = content.in_ranges(a, "k", leaves, 64)
    assert read.count() == 128  # of 20,000
    got = sorted(map(tuple, content.range_diff(a, b, "k", ["k", "v"], leaves, 64).collect()))
    assert got == [(77, "0", 1, 0), (15_003, "2", 1, 0), (15_003, "new", 0, 1)]
    assert content.differing(trees[0], trees[0]).isEmpty()
    assert content.range_diff(a, a, "k", ["k"], leaves.where("false"), 64).count() == 0


def test_seconds_match_plain_formatting(spark):
    from runledger.functions.scalars import fmt_secs

    rng = random.Random(3)
    t = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 0.95, 0.9999999, 1.0, 1.5, 2.5, 3.4999999, 1e-9, 12345678.5, 0.3, 0.7] + [rng.random() * 2 for _ in range(5000)] + [i / 1000 for i in range(2000)]
    got = [r.s for r in spark.createDataFrame([(x,) for x in t], "t double").select(fmt_secs(F.col("t")).alias("s")).collect()]
    assert got == [f"{x:.1f}" if x < 1 else f"{x:.0f}" for x in t]


def test_ends_close_the_latest_start(spark):
    events = [(1, "s", i, e) for i, e in enumerate("eesseeesse")]
    rows = spark.createDataFrame([(r, s, i, {"s": "start", "e": "end"}[e]) for r, s, i, e in events] + [(1, "t", 0, "start"), (1, "t", 1, "start"), (1, "t", 2, "end")], "run_id long, stage string, seq int, event string")
    assert sorted(map(tuple, analytics.unpaired(rows, "start", "end").collect())) == [(1, "s", 3, 7), (1, "t", 1, 0)]


def test_skip_needs_all_ancestors(spark):
    static = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("x", "e")], "src string, dst string")
    now = spark.createDataFrame([(1, s, h) for s, h in (("a", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("e", "1"))] + [(2, s, "1") for s in "abcd"], "run_id long, stage string, input_hash string")
    old = spark.createDataFrame([(r, s, "1") for r in (1, 2) for s in "abcde"], "run_id long, stage string, input_hash string")
    got = {(r.run_id, r.stage): r.skipped for r in analytics.skippable(now, old, static).collect()}
    assert got == {(1, "a"): True, (1, "b"): False, (1, "c"): False, (1, "d"): True, (1, "e"): False, (2, "a"): True, (2, "b"): True, (2, "c"): True, (2, "d"): True}


def test_stale_and_orphan(spark):
    """The router led to b; c is beyond b, d is not, e hangs on the branch not taken."""
    edges = spark.createDataFrame([("r", "b"), ("r", "d"), ("b", "c"), ("d", "e"), ("q", "z")], "src string, dst string")
    mapping = spark.createDataFrame([("r", "k1", "b"), ("r", "k2", "d"), ("q", "k1", "z")], "router string, route string, target string")
    visits = spark.createDataFrame([(1, 0, "r"), (1, 1, "b"), (1, 2, "c"), (2, 0, "r"), (2, 1, "d"), (2, 2, "b")], "run_id long, pos long, stage string")
    made = spark.createDataFrame([(1, "r", "k1", 0), (2, "r", "k2", 0)], "run_id long, router string, route string, seq long")
    decided, reach = analytics.last_decisions(made, mapping), graph.closure(edges)
    assert [tuple(r) for r in analytics.stale_routes(decided, visits, reach).collect()] == [(2, "r", "d", 0, "b", 2)]
    stages = spark.createDataFrame([(s,) for s in "rbcdeqz"], "stage string")
    got = sorted(map(tuple, analytics.orphan_stages(stages, decided, visits, mapping, reach).collect()))
    assert got == [(1, "q"), (1, "z"), (2, "c"), (2, "e"), (2, "q"), (2, "z")]


@pytest.fixture
def timed(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 4), rng.choice("ab"), i, 1_700_000_000 + i * 30 + rng.randint(0, 29), rng.random() < 0.5) for i in range(600)]
    frame = spark.createDataFrame(rows, "run_id long, stage string, seq long, t long, is_start boolean")
    return frame.select("run_id", "stage", "seq", F.timestamp_seconds("t").alias("ts"), "is_start"), rows


def test_stream_pairing(spark, timed, tmp_path):
    """Shuffled files, a restart in the middle, and rows too late for the watermark."""
    frame, rows = timed
    want = sorted(map(tuple, pairing.settled(frame, 600, 900).collect()), key=repr)
    assert {r[4] for r in want} == {"paired", "expired"}
    source, rng = tmp_path / "in", random.Random(5)
    order = sorted(rows, key=lambda r: r[3] + rng.randint(0, 500))  # late by less than the delay
    source.mkdir()
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    made = pairing.paired(stream, "600 seconds", 900)
    for part in range(4):
        some = spark.createDataFrame(order[150 * part : 150 * part + 150], "run_id long, stage string, seq long, t long, is_start boolean")
        some.select("run_id", "stage", "seq", F.timestamp_seconds("t").alias("ts"), "is_start").coalesce(1).write.mode("append").parquet(str(source))
        if part % 2:  # the query ends after the second file and starts again for the rest
            got = pairing.run_to_end(made, str(tmp_path / "out"), str(tmp_path / "at"))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    late = spark.createDataFrame([(1, "a", 10_000, 1_700_000_000, True)], "run_id long, stage string, seq long, t long, is_start boolean")
    late.select("run_id", "stage", "seq", F.timestamp_seconds("t").alias("ts"), "is_start").coalesce(1).write.mode("append").parquet(str(source))
    got = pairing.run_to_end(made, str(tmp_path / "out"), str(tmp_path / "at"))
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_first_offence(spark):
    docs = ["{}", None, "[]", '{"b":{"c":"nan"},"a":{"__class__":1}}', '{"a.b.c.d.e":1}', '{"a.b.c.d.e.f":1}', '{"a":{"x y":{"q.":"inf"}}}', '{"":1}', '{"a":null}', '{"a":["nan"]}', '{"ü1":1}']
    got = {r.id: (r.path, r.reason) for r in nested.first_offence(spark.createDataFrame(list(enumerate(docs)), "id long, doc string"), ["id"], "doc").collect()}
    assert got == {3: ("a.__class__", "barred"), 5: ("a.b.c.d.e.f", "deep"), 6: ("a.x y.q.", "number"), 7: ("", "name")}
