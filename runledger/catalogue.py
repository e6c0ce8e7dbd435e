"""The query catalogue: every ledger operator applied to the test tables, with its SQL.

``events`` is a delta log (run = user, position = event id, stage = key = event type),
``conversations`` a list of visits, ``documents`` a table of state values, ``orders`` a list
of runs with a status; the graph is that of the transitions that ``events`` shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as sc
from .operators import analytics as an
from .operators import content, fold, graph, nested
from .sources.shared import new_path
from .streaming import pairing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A stage is an event type and a third of the event ids; a run is a user.
_X = "x AS (SELECT user_id AS run_id, event_id AS pos, event_type || '_' || (event_id % 3) AS stage, value FROM events)"
_SQL_EDGES = _X + """,
tr AS (SELECT stage AS src, lead(stage) OVER (PARTITION BY run_id ORDER BY pos) AS dst FROM x),
cn AS (SELECT src, dst, count(*) AS c FROM tr WHERE src <> dst GROUP BY 1, 2),
e AS (SELECT src, dst, 'static' AS kind, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS INTEGER) AS max_visits FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS r FROM cn WHERE src < dst) WHERE r <= 2
UNION ALL SELECT src, dst, 'conditional', 'k' || r, CASE WHEN dst < src THEN 3 END FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS r FROM cn WHERE right(src, 2) = '_0') WHERE r <= 2)"""
_REACH = "r AS (SELECT src, dst FROM e WHERE {c} UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src WHERE {c})"
_BARRED = ", ".join(map(repr, sc.BARRED))
LOG = "log AS (SELECT user_id AS run_id, event_id AS pos, event_type AS stage, event_type AS key, value FROM events)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("stage"), F.col("event_type").alias("key"), "value")


def events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.concat("event_type", F.lit("_"), (F.col("event_id") % 3).cast("string")).alias("stage"), "value")


def edges(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = graph.observed(steps(spark, d), F.col("src").endswith("_0"))
    return e.where(F.col("kind") == kind) if kind else e


def saves(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select((F.col("user_id") % 10).alias("task_id"), F.col("user_id").alias("run_id"), F.col("event_id").alias("save_seq"), "ts")


def order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("view", 0), ("click", 1), ("purchase", 2), ("signup", 3), ("ship", 4)], "stage string, idx int")


# --- folds ---------------------------------------------------------------------------------
@query(f"WITH {LOG} SELECT run_id, key, arg_max(value, pos) AS value FROM log GROUP BY 1, 2")
def state_fold(spark, d):
    return fold.state_fold(log(spark, d))


@query(f"WITH {LOG} SELECT run_id, key, arg_max(value, pos) AS value, arg_max(stage, pos) AS producer, max(pos) AS pos FROM log GROUP BY 1, 2")
def producers(spark, d):
    return fold.producers(log(spark, d))


@query(f"WITH {LOG}, s AS (SELECT run_id, min(pos) AS stop FROM log WHERE stage = 'purchase' GROUP BY 1) SELECT run_id, key, arg_max(value, pos) AS value FROM log LEFT JOIN s USING (run_id) WHERE stop IS NULL OR pos < stop GROUP BY 1, 2")
def state_before(spark, d):
    return fold.state_before(log(spark, d), "purchase")


@query("SELECT user_id AS run_id, event_type AS stage, max(event_id) AS pos, arg_max(props, event_id) AS delta_json FROM events GROUP BY 1, 2")
def last_delta(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("pos"), F.col("props").alias("delta_json"))
    return fold.last_per(rows, ["run_id", "stage"], "pos")


@query("SELECT conv_id AS run_id, turn, role AS stage, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS visit FROM conversations")
def visit_numbers(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), "turn", F.col("role").alias("stage"))
    return fold.numbered(rows, ["run_id", "stage"], "turn")


@query(f"WITH {LOG} SELECT run_id, stage, count(*) AS visits FROM log GROUP BY 1, 2")
def visit_counts(spark, d):
    return log(spark, d).groupBy("run_id", "stage").agg(F.count("*").alias("visits"))


def _aligned(spark, d):
    rows = log(spark, d).select("run_id", "stage", "pos", "value")
    deltas = fold.numbered(rows, ["run_id", "stage"], "pos").select("run_id", "stage", (F.col("visit") - 1).alias("visit_idx"), "value")
    done = fold.numbered(rows, ["run_id", "stage"], F.desc("pos"), "back").where("back <= 3").select("run_id", "pos", "stage")
    keep = rows.where("run_id % 2 = 0 and stage = 'view'").select("run_id", "stage").distinct().withColumn("kc", F.lit(1))
    return done, deltas, keep


@query(
    f"""WITH {LOG}, deltas AS (SELECT run_id, stage, row_number() OVER (PARTITION BY run_id, stage ORDER BY pos) - 1 AS visit_idx, value FROM log),
done AS (SELECT run_id, stage, pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY pos DESC) AS b FROM log) WHERE b <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY pos) - 1 AS occ, count(*) OVER (PARTITION BY run_id, stage) AS total FROM done),
n AS (SELECT run_id, stage, count(*) AS n FROM deltas GROUP BY 1, 2),
forks AS (SELECT DISTINCT run_id FROM log WHERE run_id % 2 = 0 AND stage = 'view'),
x AS (SELECT o.run_id, o.stage, o.pos, o.occ, CASE WHEN f.run_id IS NOT NULL AND o.stage = 'view' AND o.occ < 1 THEN o.occ ELSE n - total + occ END AS visit_idx,
  f.run_id IS NOT NULL AND NOT (o.stage = 'view' AND o.occ < 1) AS after_cut FROM o JOIN n USING (run_id, stage) LEFT JOIN forks f ON f.run_id = o.run_id)
SELECT x.run_id, x.stage, x.pos, CAST(x.occ AS INTEGER) AS occ, x.visit_idx, x.after_cut, d.value FROM x JOIN deltas d ON d.run_id = x.run_id AND d.stage = x.stage AND d.visit_idx = x.visit_idx"""
)
def visit_alignment(spark, d):
    return fold.align_visits(*_aligned(spark, d))


@query(
    f"""WITH {LOG}, c AS (SELECT run_id, min(pos) AS boundary FROM log WHERE stage = 'click' GROUP BY 1),
e AS (SELECT run_id, key, arg_max(value, pos) AS v FROM log LEFT JOIN c USING (run_id) WHERE boundary IS NULL OR pos < boundary GROUP BY 1, 2),
o AS (SELECT DISTINCT run_id, 'view' AS key, -1.0 AS v FROM c), l AS (SELECT run_id, key, arg_max(value, pos) AS v FROM log JOIN c USING (run_id) WHERE pos >= boundary GROUP BY 1, 2),
k AS (SELECT run_id, key FROM e UNION SELECT run_id, key FROM o UNION SELECT run_id, key FROM l)
SELECT k.run_id, k.key, CAST(coalesce(l.v, o.v, e.v) AS DOUBLE) AS value FROM k LEFT JOIN e USING (run_id, key) LEFT JOIN o USING (run_id, key) LEFT JOIN l USING (run_id, key)"""
)
def fork_state(spark, d):
    rows = log(spark, d)
    cut = rows.where("stage = 'click'").groupBy("run_id").agg(F.min("pos").alias("boundary"))
    return fold.fork_state(rows, cut, cut.select("run_id", F.lit("view").alias("key"), F.lit(-1.0).alias("value")))


@query(
    f"""WITH {LOG}, m AS (SELECT avg(pos) AS m FROM log), a AS (SELECT run_id, key, arg_max(value, pos) AS v FROM log, m WHERE pos < m GROUP BY 1, 2),
b AS (SELECT run_id, key, arg_max(value, pos) AS v FROM log, m WHERE pos >= m GROUP BY 1, 2)
SELECT run_id, key, coalesce(b.v, a.v) AS value FROM a FULL JOIN b USING (run_id, key)"""
)
def state_merge(spark, d):
    rows = log(spark, d)
    m = rows.agg(F.avg("pos").alias("m"))
    cut = rows.crossJoin(F.broadcast(m))  # one row
    return fold.state_merge(fold.state_fold(cut.where("pos < m")), fold.state_fold(cut.where("pos >= m")), ["run_id", "key"])


@query(
    f"""WITH RECURSIVE {_SQL_EDGES}, {_REACH.format(c='true')}, w AS (SELECT run_id, pos, stage, CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR) AS key FROM x
UNION ALL SELECT DISTINCT run_id, CAST(-1 AS BIGINT), CASE run_id % 3 WHEN 0 THEN '<init>' ELSE '<fork>' END, '0' FROM x WHERE run_id % 3 < 2),
p AS (SELECT *, lag(stage) OVER (PARTITION BY run_id, key ORDER BY pos) AS producer FROM w)
SELECT run_id, key, pos, stage, producer FROM p WHERE producer IS NOT NULL AND producer <> stage AND producer <> '<fork>' AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = p.producer AND r.dst = p.stage)"""
)
def write_conflicts(spark, d):
    writes = steps(spark, d).select("run_id", "pos", "stage", (F.floor("value") % 4).cast("string").alias("key"))
    given = writes.where("run_id % 3 < 2").select("run_id", F.lit(-1).cast("long").alias("pos"), F.when(F.col("run_id") % 3 == 0, "<init>").otherwise("<fork>").alias("stage"), F.lit("0").alias("key")).distinct()
    return fold.write_conflicts(writes.union(given), graph.closure(edges(spark, d)))


_FORKS = """f AS (SELECT c.run_id, p.run_id AS parent_id, c.run_id * 7 % 23 AS kept FROM (SELECT DISTINCT user_id AS run_id FROM events) c JOIN (SELECT DISTINCT user_id AS run_id FROM events) p ON p.run_id = c.run_id - 10 WHERE c.run_id // 10 % 21 <> 0),
a AS (SELECT run_id, parent_id AS source, kept AS bound FROM f UNION ALL SELECT a.run_id, f.parent_id, least(a.bound, f.kept) FROM a JOIN f ON f.run_id = a.source)"""


def forks(spark, d):
    """Each run forks from the run ten before it, in chains of 21 runs at most."""
    runs = t(spark, d, "events").select(F.col("user_id").alias("run_id")).distinct()
    parents = runs.select(F.col("run_id").alias("parent_id"), (F.col("run_id") + 10).alias("run_id"))
    return runs.where(F.floor(F.col("run_id") / 10) % 21 != 0).join(parents, "run_id").select("run_id", "parent_id", (F.col("run_id") * 7 % 23).alias("kept"))


@query(f"WITH RECURSIVE {_FORKS} SELECT run_id, source, bound FROM a")
def fork_ancestry(spark, d):
    return fold.ancestry(forks(spark, d))


@query(
    f"""WITH RECURSIVE {_FORKS}, o AS (SELECT user_id AS run_id, event_type AS key, event_type || '_' || (event_id % 3) AS stage, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
q AS (SELECT o.*, coalesce(kept, 0) + n AS pos FROM o LEFT JOIN f USING (run_id)),
z AS (SELECT run_id, key, value, stage, pos * 2 + 1 AS place FROM q
UNION ALL SELECT a.run_id, q.key, q.value, q.stage, q.pos * 2 + 1 FROM a JOIN q ON q.run_id = a.source WHERE q.pos < a.bound
UNION ALL SELECT run_id, 'view', CAST(-run_id AS DOUBLE), '<fork>', kept * 2 FROM f WHERE run_id % 2 = 0)
SELECT run_id, key, arg_max(value, place) AS value, arg_max(stage, place) AS producer FROM z GROUP BY 1, 2"""
)
def chained_fork_state(spark, d):
    rows = fold.numbered(t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("key"), F.concat("event_type", F.lit("_"), (F.col("event_id") % 3).cast("string")).alias("stage"), "value"), ["run_id"], "pos", "n")
    made = forks(spark, d)
    put = made.where("run_id % 2 = 0").select("run_id", F.lit("view").alias("key"), (-F.col("run_id")).cast("double").alias("value"))
    return fold.chained_state(rows.withColumn("n", F.col("n") - 1), made, put)


@query(
    """WITH l AS (SELECT user_id AS run_id, event_type AS key, value, event_id % 3 AS layer, event_id FROM events), p AS (SELECT run_id, key, arg_max(value, layer * 1000000000 + event_id) AS value FROM l GROUP BY 1, 2) SELECT * FROM p"""
)
def override_layers(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), "value", (F.col("event_id") % 3 * 1000000000 + F.col("event_id")).alias("priority"))
    return fold.override_layers(rows)


@query(
    """SELECT event_id AS pos, key, value FROM (SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE event_id % 2 = 1
UNION ALL SELECT event_id, 'k', 99.0 FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'tag', value FROM events WHERE event_id % 2 = 0)"""
)
def override_apply(spark, d):
    base = F.from_json("props", "map<string,double>")
    patch = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit(99.0), F.lit("tag"), F.col("value"))).otherwise(F.create_map().cast("map<string,double>"))
    rows = t(spark, d, "events").select(F.col("event_id").alias("pos"), base.alias("base"), patch.alias("patch"))
    return rows.select("pos", F.explode(fold.override_apply(F.col("base"), F.col("patch"))).alias("key", "value"))


# --- diffs, retention, sizes ---------------------------------------------------------------
_PAIRS = "p AS (SELECT run_id, before FROM (SELECT run_id, lag(run_id) OVER (PARTITION BY run_id % 10 ORDER BY seq) AS before FROM (SELECT user_id AS run_id, max(event_id) AS seq FROM events GROUP BY 1)) WHERE before IS NOT NULL)"


@query(f"""WITH {LOG}, {_PAIRS}, s AS (SELECT run_id, key, arg_max(value, pos) AS v FROM log GROUP BY 1, 2),
a AS (SELECT p.run_id, s.key, s.v FROM p JOIN s ON s.run_id = p.before), b AS (SELECT s.* FROM p JOIN s USING (run_id))
SELECT run_id, key, a.v AS before, b.v AS after FROM a FULL JOIN b USING (run_id, key) WHERE a.v IS DISTINCT FROM b.v""")
def state_diff(spark, d):
    return an.diff_with_previous(fold.state_fold(log(spark, d)), saves(spark, d), ["key"])


@query(f"""WITH {LOG}, {_PAIRS}, s AS (SELECT run_id, stage, substr(sha256(CAST(max(pos) AS VARCHAR)), 1, 16) AS h, CAST(count(*) AS INTEGER) AS v FROM log GROUP BY 1, 2),
a AS (SELECT p.run_id, s.stage, s.h, s.v FROM p JOIN s ON s.run_id = p.before), b AS (SELECT s.* FROM p JOIN s USING (run_id))
SELECT run_id, stage, CASE WHEN a.h IS NOT NULL THEN 'done' END AS status_a, CASE WHEN b.h IS NOT NULL THEN 'done' END AS status_b, a.h <> b.h AS input_changed, coalesce(a.v, 0) AS visits_a, coalesce(b.v, 0) AS visits_b
FROM a FULL JOIN b USING (run_id, stage)""")
def diff_stages(spark, d):
    rows = log(spark, d).groupBy("run_id", "stage").agg(F.lit("done").alias("status"), sc.digest(F.max("pos").cast("string")).alias("input_hash"), F.count("*").cast("int").alias("visits"))
    return an.diff_stages(rows, saves(spark, d))


@query(f"""WITH {LOG}, {_PAIRS}, s AS (SELECT run_id, stage, count(*) AS v FROM log GROUP BY 1, 2),
a AS (SELECT p.run_id, s.stage, s.v FROM p JOIN s ON s.run_id = p.before), b AS (SELECT s.* FROM p JOIN s USING (run_id))
SELECT run_id, stage, a.v AS before, b.v AS after FROM a FULL JOIN b USING (run_id, stage) WHERE a.v IS DISTINCT FROM b.v""")
def diff_visits(spark, d):
    return an.diff_with_previous(log(spark, d).groupBy("run_id", "stage").agg(F.count("*").alias("value")), saves(spark, d), ["stage"])


_K = "CAST(CAST(floor(value) AS BIGINT) AS {v})"
_DOC = """CASE event_id % 5 WHEN 0 THEN '{{"cfg":{{"model":"' || event_type || '","opts":{{"k":' || {k} || ',"v":null}}}},"n":' || {k} || ',"tags":[1,' || {k} || ']}}'
WHEN 1 THEN '{{"cfg":{{"model":"' || event_type || '","opts":{{"k":' || {k} || '}}}},"n":' || {k} || '.0,"tags":[1,' || {k} || ']}}'
WHEN 2 THEN '{{"cfg":"' || event_type || '","n":' || {k} || '}}'
WHEN 3 THEN '{{"cfg":{{"model":"' || event_type || '","opts":[' || {k} || ']}},"long":"' || repeat(event_type, 60) || '","n":null,"tags":[1,2]}}'
ELSE '{{"cfg":{{"opts":{{"k":' || {k} || ',"v":{{"deep":"' || event_type || '"}}}}}},"list":[' || repeat('1,', 59) || {k} || ']}}' END"""
_PATCH = """CASE event_id % 11 WHEN 0 THEN '{{"cfg":' || {k} || '}}' WHEN 1 THEN '{{"cfg.opts.k":' || {k} || '}}' WHEN 2 THEN '{{"cfg.opts":{{"z":' || {k} || ',"y":{{}}}}}}'
WHEN 3 THEN '{{"n":null,"tags":[' || {k} || ',1]}}' WHEN 4 THEN '{{"cfg":{{"opts":{{}}}}}}' WHEN 5 THEN '{{"n":{{"m":' || {k} || '}}}}' WHEN 6 THEN '{{"cfg.opts.z":{{"w":"' || event_type || '"}}}}' WHEN 7 THEN '{{"tags.first":' || {k} || '}}'
ELSE '{{"cfg":{{"model":"' || event_type || '","opts":{{"k":' || {k} || '}}}}}}' END"""
_SQL_K, _SPARK_K = _K.format(v="VARCHAR"), _K.format(v="STRING")


@query(
    f"""WITH RECURSIVE docs AS (SELECT event_id, run_id, CAST(b AS JSON) AS a, CAST(doc AS JSON) AS b FROM (SELECT event_id, user_id AS run_id, doc, lag(doc) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM (SELECT *, {_DOC.format(k=_SQL_K)} AS doc FROM events)) WHERE b IS NOT NULL),
w AS (SELECT event_id, '' AS path, a, b FROM docs
UNION ALL SELECT event_id, path || '.' || k, json_extract(a, '$."' || k || '"'), json_extract(b, '$."' || k || '"') FROM (SELECT *, unnest(list_distinct(list_concat(json_keys(a), json_keys(b)))) AS k FROM w WHERE json_type(a) = 'OBJECT' AND json_type(b) = 'OBJECT')),
v AS (SELECT event_id, substr(path, 2) AS path, nullif(CAST(a AS VARCHAR), 'null') AS a, nullif(CAST(b AS VARCHAR), 'null') AS b FROM w WHERE path <> '' AND NOT (coalesce(json_type(a), '-') = 'OBJECT' AND coalesce(json_type(b), '-') = 'OBJECT')),
n AS (SELECT event_id, path, regexp_replace(a, '[.]0$', '') AS a, regexp_replace(b, '[.]0$', '') AS b, a AS ra, b AS rb FROM v),
s AS (SELECT event_id, path, CASE WHEN path = 'long' AND ra IS NOT NULL THEN substr(ra, 1, 201) || '...(truncated, total ' || (length(ra) - 2) || ' chars)"' WHEN path = 'list' AND ra IS NOT NULL THEN '[' || repeat('1,', 50) || '"...(truncated)"]' ELSE a END AS before,
 CASE WHEN path = 'long' AND rb IS NOT NULL THEN substr(rb, 1, 201) || '...(truncated, total ' || (length(rb) - 2) || ' chars)"' WHEN path = 'list' AND rb IS NOT NULL THEN '[' || repeat('1,', 50) || '"...(truncated)"]' ELSE b END AS after FROM n WHERE a IS DISTINCT FROM b)
SELECT * FROM s"""
)
def leaf_diff(spark, d):
    doc = F.expr(_DOC.format(k=_SPARK_K))
    rows = t(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), doc.alias("after"))
    before = F.lag("after").over(Window.partitionBy("run_id").orderBy("event_id"))
    return nested.leaf_diff(rows.withColumn("before", before).where("before is not null"), ["event_id"], "before", "after")


@query(
    f"""WITH RECURSIVE l AS (SELECT user_id AS run_id, event_id AS ord, CAST({_PATCH.format(k=_SQL_K)} AS JSON) AS doc FROM events),
w AS (SELECT run_id, ord, k AS path, json_extract(doc, '$."' || k || '"') AS v, contains(k, '.') AS whole FROM (SELECT *, unnest(json_keys(doc)) AS k FROM l)
UNION ALL SELECT run_id, ord, path || '.' || k, json_extract(v, '$."' || k || '"'), false FROM (SELECT *, unnest(json_keys(v)) AS k FROM w WHERE json_type(v) = 'OBJECT')),
q AS (SELECT run_id, ord, path, CAST(v AS VARCHAR) AS v, json_type(v) <> 'OBJECT' OR CAST(v AS VARCHAR) = '{{}}' AS leaf, json_type(v) <> 'OBJECT' OR whole AS cuts FROM w),
alive AS (SELECT * FROM q WHERE leaf AND NOT EXISTS (SELECT 1 FROM q z WHERE z.run_id = q.run_id AND z.ord > q.ord AND ((z.cuts AND starts_with(q.path || '.', z.path || '.')) OR (z.leaf AND z.path = q.path) OR starts_with(z.path, q.path || '.'))))
SELECT run_id, path, v AS value FROM alive WHERE v <> '{{}}' OR NOT EXISTS (SELECT 1 FROM alive z WHERE z.run_id = alive.run_id AND starts_with(z.path, alive.path || '.'))"""
)
def deep_override(spark, d):
    layers = t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), F.expr(_PATCH.format(k=_SPARK_K)).alias("doc"))
    return nested.deep_override(layers, ["run_id"], "ord", "doc")


@query(f"WITH {LOG}, {_PAIRS}, s AS (SELECT run_id, key, arg_max(value, pos) AS v FROM log GROUP BY 1, 2), m AS (SELECT user_id % 10 AS task_id, arg_max(user_id, event_id) AS latest FROM events GROUP BY 1), a AS (SELECT u.run_id, s.key, s.v FROM (SELECT DISTINCT run_id FROM log) u JOIN m ON m.task_id = u.run_id % 10 JOIN s ON s.run_id = m.latest)\nSELECT run_id, key, a.v AS before, s.v AS after FROM a FULL JOIN s USING (run_id, key) WHERE a.v IS DISTINCT FROM s.v")
def compare_with(spark, d):
    saved = saves(spark, d)
    pairs = saved.select("task_id", "run_id").distinct().join(an.latest_run(saved).withColumnRenamed("run_id", "before"), "task_id").select("run_id", "before")
    return an.diff_pairs(fold.state_fold(log(spark, d)), pairs, ["key"])


@query(f"WITH {LOG}, s AS (SELECT run_id, min(pos) AS stop FROM log WHERE stage = 'purchase' GROUP BY 1), b AS (SELECT run_id, key, arg_max(value, pos) AS v FROM log LEFT JOIN s USING (run_id) WHERE stop IS NULL OR pos < stop GROUP BY 1, 2) SELECT run_id, '{{' || string_agg('\"' || key || '\":' || v, ',' ORDER BY key) || '}}' AS state FROM b GROUP BY 1")
def export_input(spark, d):
    return fold.as_document(fold.state_before(log(spark, d), "purchase"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text FROM documents")
def diff_truncate(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.diff_truncate(F.col("text")).alias("text"))


@query("SELECT doc_id, substr(text, 1, 2048) AS summary, substr(text, 1, 500) AS error FROM documents")
def summary_cut(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.cut(F.col("text"), 2048).alias("summary"), sc.cut(F.col("text"), 500).alias("error"))


_PRUNE = """WITH r AS (SELECT user_id % 10 AS task_id, user_id AS run_id, max(ts) AS ts, max(event_id) AS seq FROM events GROUP BY 1, 2),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, run_id DESC) AS INTEGER) AS rank, max(seq) OVER (PARTITION BY task_id) AS newest FROM r)"""


@query(_PRUNE + ' SELECT task_id, run_id, rank, rank > 3 AND seq <> newest AS "drop" FROM p')
def prune_plan(spark, d):
    return an.prune_plan(saves(spark, d), 3)


@query(_PRUNE + ", b AS (SELECT user_id AS run_id, sum(length(props)) AS n FROM events GROUP BY 1) SELECT task_id, CAST(sum(n) AS BIGINT) AS bytes FROM p JOIN b USING (run_id) WHERE rank > 3 AND seq <> newest GROUP BY 1")
def prune_bytes(spark, d):
    size = t(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.sum(F.length("props")).alias("n"))
    return an.prune_plan(saves(spark, d), 3).where("drop").join(size, "run_id").groupBy("task_id").agg(F.sum("n").alias("bytes"))


@query(f"""WITH RECURSIVE {_FORKS}, r AS (SELECT user_id % 10 AS task_id, user_id AS run_id, max(ts) AS ts, max(event_id) AS seq FROM events GROUP BY 1, 2),
k AS (SELECT run_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, run_id DESC) AS rank, max(seq) OVER (PARTITION BY task_id) AS newest FROM r) WHERE rank <= 3 OR seq = newest),
n AS (SELECT run_id, run_id AS source FROM r UNION SELECT run_id, source FROM a WHERE bound > 0)
SELECT 'data/' || source AS path FROM n GROUP BY source HAVING count(*) FILTER (WHERE run_id IN (SELECT run_id FROM k)) = 0""")
def sweep_plan(spark, d):
    """Each run reads its own data and that of the runs it forked from, up to the cut."""
    own = saves(spark, d).select("run_id", F.col("run_id").alias("source")).distinct()
    read = own.union(fold.ancestry(forks(spark, d)).where("bound > 0").select("run_id", "source"))
    return an.sweep_plan(read.select("run_id", F.concat(F.lit("data/"), F.col("source").cast("string")).alias("path")), an.prune_plan(saves(spark, d), 3).where("drop"))


@query("SELECT user_id % 10 AS task_id, arg_max(user_id, event_id) AS run_id FROM events GROUP BY 1")
def latest_run(spark, d):
    return an.latest_run(saves(spark, d))


@query("SELECT DISTINCT user_id % 10 AS task_id, user_id AS run_id FROM events")
def listsaves(spark, d):
    return saves(spark, d).select("task_id", "run_id").distinct()


@query("SELECT DISTINCT user_id % 10 AS task_id FROM events")
def list_tasks(spark, d):
    return saves(spark, d).select("task_id").distinct()


def _values(spark, d):
    return t(spark, d, "documents").select(F.col("lang").alias("run_id"), F.col("doc_id").alias("key"), F.col("text").alias("value"))


@query("SELECT lang AS run_id, count(*) AS n_keys, CAST(sum(length(text)) AS BIGINT) AS total_chars, max(CAST(length(text) AS INTEGER)) AS max_chars FROM documents GROUP BY 1")
def state_stats(spark, d):
    return an.state_stats(_values(spark, d))


@query("SELECT * FROM (SELECT lang AS run_id, doc_id AS key, CAST(length(text) AS INTEGER) AS chars, CAST(row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 10")
def top_keys(spark, d):
    return an.top_keys(_values(spark, d), 10)


# --- runs, attempts, failures --------------------------------------------------------------
def _attempts(spark, d):
    status = F.when(F.col("value") > 90, "failed").otherwise("done")
    return t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), (F.col("event_id") % 3 + 1).alias("attempt"), status.alias("status"), F.col("value").alias("duration"))


@query("SELECT event_type AS stage, count(*) AS attempts, count(*) FILTER (WHERE value > 90) AS failed, count(DISTINCT user_id) AS runs, max(event_id % 3 + 1) AS most FROM events GROUP BY 1")
def attempt_audit(spark, d):
    return an.attempt_audit(_attempts(spark, d))


@query("SELECT user_id AS run_id, event_type AS stage, round(sum(value), 3) AS seconds FROM events GROUP BY 1, 2")
def stage_timings(spark, d):
    return an.stage_timings(_attempts(spark, d))


@query("SELECT o_orderstatus AS status, count(*) AS runs, round(sum(o_totalprice), 2) AS cost, max(substr(o_orderpriority, 1, 2048)) AS sample FROM orders GROUP BY 1")
def failure_triage(spark, d):
    return an.failure_triage(t(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("summary")))


@query("WITH r AS (SELECT user_id AS run_id, user_id % 10 AS task_id, max(event_id) AS seq, count(*) AS n FROM events GROUP BY 1, 2) SELECT task_id, count(*) AS total_runs, arg_max(run_id, seq) AS latest, CAST(sum(n) AS BIGINT) AS attempts FROM r GROUP BY 1")
def trace_summary(spark, d):
    runs = saves(spark, d).groupBy("task_id", "run_id").agg(F.max("save_seq").alias("save_seq"))
    return an.trace_summary(runs, _attempts(spark, d))


_STATUS = "CASE WHEN value > 90 THEN 'failed' WHEN event_id % 7 = 0 THEN 'skipped' ELSE 'done' END"


@query(
    f"""WITH m AS (SELECT user_id % 10 AS task_id, arg_max(user_id, event_id) AS run_id, count(DISTINCT user_id) AS total_runs FROM events GROUP BY 1),
l AS (SELECT user_id AS run_id, event_type AS stage, arg_max({_STATUS}, event_id) AS status, count(*) FILTER (WHERE {_STATUS} <> 'skipped') AS n FROM events GROUP BY 1, 2),
p AS (SELECT run_id, '{{' || string_agg('"' || stage || '":"' || CASE status WHEN 'skipped' THEN 'done' ELSE status END || '"', ',' ORDER BY stage) || '}}' AS statuses, coalesce(string_agg(CASE WHEN status = 'skipped' THEN stage END, ',' ORDER BY stage), '') AS skipped, CAST(sum(n) AS BIGINT) AS attempts FROM l GROUP BY 1)
SELECT task_id, run_id, total_runs, statuses, skipped, attempts FROM m JOIN p USING (run_id)"""
)
def trace(spark, d):
    visits = t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("pos"), F.expr(_STATUS).alias("status"), F.lit(1).alias("attempt"))
    return an.trace(saves(spark, d), visits)


# --- hashes --------------------------------------------------------------------------------
@query("SELECT doc_id, substr(sha256('stage|' || text), 1, 16) AS input_hash FROM documents")
def input_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.digest(F.lit("stage"), F.col("text")).alias("input_hash"))


@query(f"WITH {_SQL_EDGES} SELECT substr(sha256(string_agg(src || '>' || dst || ':' || kind || ':' || coalesce(key, ''), '|' ORDER BY src, dst, kind)), 1, 16) AS structure_hash FROM e")
def structure_hash(spark, d):
    row = F.concat(F.col("src"), F.lit(">"), F.col("dst"), F.lit(":"), F.col("kind"), F.lit(":"), F.coalesce("key", F.lit("")))
    rows = edges(spark, d).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "kind", row.alias("row")))).alias("rows"))
    return rows.select(sc.digest(F.array_join(F.transform("rows", lambda r: r["row"]), "|")).alias("structure_hash"))


@query("SELECT run_id, pos, stage, input_hash FROM (SELECT user_id AS run_id, event_id AS pos, event_type AS stage, sha256(props) AS input_hash, lag(sha256(props)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS b FROM events) WHERE input_hash = b")
def skip_candidates(spark, d):
    return an.skip_candidates(t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("stage"), F.sha2("props", 256).alias("input_hash")))


@query("SELECT event_type AS stage, count(DISTINCT substr(sha256(props), 1, 16)) AS versions FROM events GROUP BY 1 HAVING count(DISTINCT substr(sha256(props), 1, 16)) > 1")
def source_drift(spark, d):
    rows = t(spark, d, "events").select(F.col("event_type").alias("stage"), sc.digest(F.col("props")).alias("h"))
    return rows.groupBy("stage").agg(F.countDistinct("h").alias("versions")).where("versions > 1")


_HASH = """md5(concat_ws('|', coalesce(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey, '-'), coalesce(length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey, '-'), coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-'), coalesce(length(CAST(cents AS VARCHAR)) || ':' || cents, '-')))"""
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_VERSIONS = f"""a AS (SELECT o_orderkey, o_custkey, o_orderstatus, {_CENTS} AS cents FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 997 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, cents FROM a WHERE o_orderkey % 1009 <> 5)"""
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "cents"]


def _versions(spark, d):
    """Two versions of orders: some rows changed, some gone."""
    a = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.expr(_CENTS).alias("cents"))
    status = F.when(F.col("o_orderkey") % 997 == 3, "X").otherwise(F.col("o_orderstatus"))
    return a, a.where("o_orderkey % 1009 <> 5").withColumn("o_orderstatus", status)


@query(f"WITH {_VERSIONS}, h AS (SELECT o_orderstatus, {_HASH} AS h FROM a) SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS d1, CAST(sum(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS d2 FROM h GROUP BY 1")
def content_digest(spark, d):
    a, _ = _versions(spark, d)
    return content.content_digest(a, _COLUMNS, [F.col("o_orderstatus").alias("status")])


_WIDTH = 64


def _changed(spark, d):
    a, b = _versions(spark, d)
    return a, b, content.differing(*(content.tree(x, "o_orderkey", _COLUMNS, _WIDTH) for x in (a, b)))


@query(f"WITH {_VERSIONS}, u AS (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) SELECT o_orderkey, o_custkey, o_orderstatus, cents, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b FROM u GROUP BY 1, 2, 3, 4 HAVING sum(x) <> sum(y)")
def range_diff(spark, d):
    a, b, nodes = _changed(spark, d)
    return content.range_diff(a, b, "o_orderkey", _COLUMNS, nodes.where("level = 0"), _WIDTH)


@query(f"""WITH {_VERSIONS}, u AS (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b), g AS (SELECT o_orderkey, sum(x) AS x, sum(y) AS y FROM u GROUP BY o_orderkey, o_custkey, o_orderstatus, cents),
l(level, width) AS (VALUES (0, {_WIDTH}), (1, {_WIDTH * 16}), (2, {_WIDTH * 256}), (3, {_WIDTH * 4096})), z AS (SELECT level, o_orderkey // width AS node, max(CASE WHEN x <> y THEN 1 ELSE 0 END) AS differs, sum(x + y) AS n FROM g, l GROUP BY 1, 2)
SELECT level, count(*) AS ranges, CAST(sum(n) AS BIGINT) AS rows_read FROM z WHERE differs = 1 GROUP BY 1""")
def range_diff_cost(spark, d):
    """Ranges that differ at each level, and the rows that are read if one stops there."""
    a, b, nodes = _changed(spark, d)
    trees = [content.tree(x, "o_orderkey", _COLUMNS, _WIDTH) for x in (a, b)]
    both = trees[0].union(trees[1]).join(nodes, ["level", "node"])
    return both.groupBy("level").agg(F.countDistinct("node").alias("ranges"), F.sum("n").alias("rows_read"))


# --- scalar functions ----------------------------------------------------------------------
@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, d):
    return t(spark, d, "events").select("event_id", sc.json_path(F.col("props"), "k").alias("k"))


@query("SELECT event_id FROM events WHERE event_id % 7 = 0 OR value IS NULL")
def invalid_values(spark, d):
    x = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    return t(spark, d, "events").where(~sc.finite(x) | x.isNull()).select("event_id")


_ODD = """CASE event_id % 9 WHEN 0 THEN '{{"a":{{"__class__":' || {k} || '}},"b":1}}' WHEN 1 THEN '{{"a":{{"b":{{"c":"nan"}}}},"z":"inf"}}' WHEN 2 THEN '{{"a.b.c.d.e.f":' || {k} || '}}' WHEN 3 THEN '{{"a..b":1,"x y":2}}'
WHEN 4 THEN '{{"a.__dict__":1}}' WHEN 5 THEN '{{"m":null,"n":{{"a.b":' || {k} || '}}}}' WHEN 6 THEN '{{"m":{{"__init__x":1}},"q":["nan"]}}' WHEN 7 THEN '{{"q":{{"r":{{"s":{{"__mro__":{{"t":"-inf"}}}}}}}}}}' ELSE props END"""


@query(
    f"""WITH RECURSIVE l AS (SELECT event_id, CAST({_ODD.format(k=_SQL_K)} AS JSON) AS doc FROM events),
w AS (SELECT event_id, k AS path, k, json_extract(doc, '$."' || k || '"') AS v, true AS top FROM (SELECT *, unnest(json_keys(doc)) AS k FROM l)
UNION ALL SELECT event_id, path || '.' || k2, k2, json_extract(v, '$."' || k2 || '"'), false FROM (SELECT *, unnest(json_keys(v)) AS k2 FROM w WHERE json_type(v) = 'OBJECT')),
o AS (SELECT event_id, path, CASE WHEN top AND list_has_any(string_split(k, '.'), [{_BARRED}]) OR k IN ({_BARRED}) THEN 'barred' WHEN top AND len(string_split(k, '.')) > 5 THEN 'deep' WHEN top AND NOT regexp_matches(k, '^[\\p{{L}}\\p{{N}}_]+([.][\\p{{L}}\\p{{N}}_]+)*$') THEN 'name'
 WHEN CAST(v AS VARCHAR) IN ('"nan"', '"inf"', '"-inf"') THEN 'number' END AS reason FROM w)
SELECT event_id, min(path) AS path, arg_min(reason, path) AS reason FROM o WHERE reason IS NOT NULL GROUP BY 1"""
)
def first_offence(spark, d):
    docs = t(spark, d, "events").select("event_id", F.expr(_ODD.format(k=_SPARK_K)).alias("doc"))
    return nested.first_offence(docs, ["event_id"], "doc")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE CAST(value AS VARCHAR) END AS value FROM events")
def json_safe(spark, d):
    k = F.col("event_id") % 5
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return t(spark, d, "events").select("event_id", sc.json_safe(x).alias("value"))


@query("SELECT event_id FROM events WHERE event_id % 4 = 0")
def corrupt_records(spark, d):
    torn = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x"), F.col("props"))).otherwise(F.col("props"))
    read = F.from_json(torn, "struct<k:int,_corrupt_record:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return t(spark, d, "events").select("event_id", read.alias("r")).where("r._corrupt_record is not null").select("event_id")


_RAW = "CASE doc_id % 13 WHEN 0 THEN ' ' || doc_id || ' ' WHEN 1 THEN '1_000' WHEN 2 THEN '-0.7' WHEN 3 THEN 'True' WHEN 4 THEN 'null' WHEN 5 THEN '[1, 2]' WHEN 6 THEN '1e3' WHEN 7 THEN 'NULL' WHEN 8 THEN '[abc' WHEN 9 THEN 'nan' WHEN 10 THEN 'true' WHEN 11 THEN 'None' ELSE text END"


@query(
    rf"""WITH x AS (SELECT doc_id, trim({_RAW}) AS t FROM documents) SELECT doc_id, CASE WHEN t IN ('null', 'None') THEN 'null' WHEN t IN ('true', 'false') THEN 'bool'
WHEN regexp_matches(t, '\A[+-]?[0-9]+(_[0-9]+)*\z') THEN 'int'
WHEN regexp_matches(t, '\A[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?\z') OR lower(ltrim(t, '+-')) IN ('nan', 'inf', 'infinity') THEN 'float'
WHEN length(t) <= 500 AND t[1] IN ('[', '{{') AND json_valid(t) THEN 'json' ELSE 'str' END AS type FROM x"""
)
def infer_type(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.infer_type(F.expr(_RAW)).alias("type"))


_NUMBER = r"\A[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?\z"


@query(
    rf"""WITH x AS (SELECT doc_id, {_RAW} AS raw, trim({_RAW}) AS t FROM documents) SELECT doc_id, CASE WHEN t IN ('null', 'None') THEN 'null' WHEN t IN ('true', 'false') THEN t
WHEN regexp_matches(t, '\A[+-]?[0-9]+(_[0-9]+)*\z') THEN CAST(CAST(replace(t, '_', '') AS HUGEINT) AS VARCHAR)
WHEN lower(ltrim(t, '+-')) IN ('nan', 'inf', 'infinity') THEN NULL WHEN regexp_matches(t, '{_NUMBER}') THEN CAST(CAST(replace(t, '_', '') AS DOUBLE) AS VARCHAR)
WHEN length(t) <= 500 AND t[1] IN ('[', '{{') AND json_valid(t) THEN replace(t, ', ', ',') ELSE CAST(to_json(CASE WHEN t = '' THEN t ELSE raw END) AS VARCHAR) END AS value FROM x"""
)
def infer_value(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.infer_value(F.expr(_RAW)).alias("value"))


@query("WITH x AS (SELECT doc_id, source || '=' || lang || '=x' AS s FROM documents) SELECT doc_id, substr(s, 1, instr(s, '=') - 1) AS key, substr(s, instr(s, '=') + 1) AS value FROM x")
def parse_set(spark, d):
    key, value = sc.parse_set(F.concat(F.col("source"), F.lit("="), F.col("lang"), F.lit("=x")))
    return t(spark, d, "documents").select("doc_id", key.alias("key"), value.alias("value"))


_PATH = "CASE doc_id % 6 WHEN 0 THEN source || '.' || lang WHEN 1 THEN 'a.b.c.d.e.f' WHEN 2 THEN '__' || source WHEN 3 THEN source || '..x' WHEN 4 THEN 'a.__class__' ELSE substr(text, 1, 8) END"


@query(rf"WITH x AS (SELECT doc_id, {_PATH} AS p FROM documents) SELECT doc_id, regexp_matches(p, '\A[\p{{L}}\p{{N}}_]+(\.[\p{{L}}\p{{N}}_]+){{0,4}}\z') AND NOT list_has_any(string_split(p, '.'), [{_BARRED}]) AS ok FROM x")
def path_validate(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.path_valid(F.expr(_PATH)).alias("ok"))


@query(r"SELECT doc_id, regexp_matches(substr(text, 1, 8), '\A[A-Za-z0-9_.-]{1,128}\z') AND NOT regexp_matches(substr(text, 1, 8), '\A\.+\z') AS ok FROM documents")
def task_id_valid(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.task_id_valid(F.substring("text", 1, 8)).alias("ok"))


@query("SELECT event_id, CASE WHEN value / 50 < 1 THEN printf('%.1f', value / 50) ELSE printf('%.0f', value / 50) END AS shown FROM events")
def fmt_secs(spark, d):
    return t(spark, d, "events").select("event_id", sc.fmt_secs(F.col("value") / 50).alias("shown"))


_NAME = "CASE doc_id % 5 WHEN 0 THEN 'end' WHEN 1 THEN 'stage_' || doc_id WHEN 2 THEN doc_id || '-load' WHEN 3 THEN 'load-data' ELSE substr(text, 1, 40) END"
_WORDS = ", ".join(map(repr, sc.RESERVED))


@query(
    rf"""WITH x AS (SELECT doc_id, {_NAME} AS n, regexp_replace({_NAME}, '[^A-Za-z0-9]', '_', 'g') AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(n, '\A[A-Za-z_][A-Za-z0-9_]*\z') AND n NOT IN ({_WORDS}) THEN n WHEN NOT regexp_matches(s, '\A[A-Za-z_]') OR s IN ({_WORDS}) THEN 'n_' || s ELSE s END AS id FROM x"""
)
def safe_id(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.safe_id(F.expr(_NAME)).alias("id"))


@query(r"""SELECT doc_id, replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '"', '#quot;') AS label FROM documents""")
def mermaid_text(spark, d):
    return t(spark, d, "documents").select("doc_id", sc.mermaid_text(F.col("text"), True).alias("label"))


# --- graphs --------------------------------------------------------------------------------
@query(f"WITH RECURSIVE {_SQL_EDGES}, {_REACH.format(c='true')} SELECT src, dst FROM r")
def execution_reach(spark, d):
    return graph.closure(edges(spark, d))


@query(f"WITH RECURSIVE {_SQL_EDGES}, {_REACH.format(c='true')} SELECT dst FROM r WHERE src = 'click_0'")
def reachability(spark, d):
    return graph.closure(edges(spark, d)).where("src = 'click_0'").select("dst")


_STATIC = _REACH.format(c="e.kind = 'static'").replace("FROM e WHERE e.kind", "FROM e WHERE kind")


@query(f"WITH RECURSIVE {_SQL_EDGES}, {_STATIC} SELECT src, dst FROM r")
def static_closure(spark, d):
    return graph.closure(edges(spark, d, "static"))


@query(f"WITH RECURSIVE {_SQL_EDGES}, {_REACH.format(c='true')} SELECT src AS node FROM r WHERE src = dst")
def cycle_nodes(spark, d):
    return graph.cycle_nodes(edges(spark, d))


@query(f"WITH RECURSIVE {_SQL_EDGES}, {_REACH.format(c='true')}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT n.node, least(n.node, coalesce(min(a.dst), n.node)) AS scc FROM n LEFT JOIN r a ON a.src = n.node AND EXISTS (SELECT 1 FROM r b WHERE b.src = a.dst AND b.dst = a.src) GROUP BY n.node")
def scc_members(spark, d):
    return graph.scc_members(edges(spark, d))


@query(f"WITH RECURSIVE {_SQL_EDGES}, s AS (SELECT src, dst FROM e WHERE kind = 'static'), p AS (SELECT src AS node, 0 AS level FROM s UNION SELECT dst, 0 FROM s UNION SELECT s.dst, p.level + 1 FROM p JOIN s ON s.src = p.node) SELECT node, max(level) AS level FROM p GROUP BY 1")
def topo_levels(spark, d):
    return graph.topo_levels(edges(spark, d, "static"))


_ONLY = f"""{_REACH.format(c='true')}, nd AS (SELECT node, row_number() OVER (ORDER BY node) AS idx FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)),
c AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'conditional'), bk AS (SELECT c.src, c.dst FROM c JOIN r ON r.src = c.dst AND r.dst = c.src),
inn AS (SELECT DISTINCT dst AS node FROM bk WHERE dst NOT IN (SELECT dst FROM e WHERE kind = 'static')),
mem AS (SELECT node AS t, node AS m FROM nd UNION SELECT a.src, a.dst FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src),
ent AS (SELECT DISTINCT mem.t FROM mem JOIN e ON e.dst = mem.m AND e.kind = 'static' WHERE NOT EXISTS (SELECT 1 FROM mem k WHERE k.t = mem.t AND k.m = e.src)),
fst AS (SELECT node FROM inn JOIN nd USING (node) WHERE node NOT IN (SELECT t FROM ent) ORDER BY idx LIMIT 1),
ro AS (SELECT node FROM (SELECT dst AS node FROM c WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.src = c.src AND bk.dst = c.dst) UNION SELECT node FROM inn) WHERE node NOT IN (SELECT node FROM fst))"""


def _declared(e):
    """Stages in order of declaration: that of their names."""
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return nodes.withColumn("idx", F.row_number().over(Window.orderBy("node")))


@query(f"WITH RECURSIVE {_SQL_EDGES}, {_ONLY} SELECT DISTINCT node FROM ro")
def route_only(spark, d):
    e = edges(spark, d)
    return graph.route_only(e, _declared(e))


@query(f"WITH RECURSIVE {_SQL_EDGES}, {_ONLY}, {_STATIC.replace('r AS', 's AS').replace('FROM r JOIN', 'FROM s r JOIN')} SELECT s.dst AS node, s.src AS gate FROM s WHERE s.src IN (SELECT node FROM ro)")
def gate_sets(spark, d):
    e = edges(spark, d)
    return graph.gate_sets(e, _declared(e))


@query(f"WITH {_SQL_EDGES} SELECT DISTINCT dst AS stage FROM e WHERE dst NOT IN (SELECT stage FROM x GROUP BY 1 HAVING count(*) * (SELECT count(DISTINCT stage) FROM x) >= (SELECT count(*) FROM x))")
def unknown_deps(spark, d):
    """Dependencies on stages that run less often than the mean are not declared."""
    counts = steps(spark, d).groupBy("stage").agg(F.count("*").alias("c"))
    named = counts.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("every"), F.count("*").alias("stages")))).where("c * stages >= every")  # one row
    return graph.unknown_deps(edges(spark, d).select(F.col("dst").alias("src")), named.select("stage"))


@query(f"WITH {_SQL_EDGES} SELECT src, dst FROM e a WHERE kind = 'static' AND src IN (SELECT src FROM e WHERE kind = 'conditional') AND (NOT EXISTS (SELECT 1 FROM e b WHERE b.kind = 'conditional' AND b.src = a.src AND b.dst = a.dst) OR dst IN (SELECT dst FROM e WHERE kind = 'conditional'))")
def router_rule_violations(spark, d):
    return graph.router_rule_violations(edges(spark, d))


@query(f"WITH {_X}, h AS (SELECT run_id, max(pos) AS seq, substr(sha256(string_agg(DISTINCT stage, '|' ORDER BY stage)), 1, 16) AS h FROM x GROUP BY 1), m AS (SELECT run_id % 10 AS task_id, arg_max(h, seq) AS newest FROM h GROUP BY 1) SELECT run_id, h AS workflow_hash, newest FROM h JOIN m ON m.task_id = run_id % 10 WHERE h <> newest")
def incompatible_runs(spark, d):
    """Runs whose set of stages is not that of the task's latest run."""
    shape = sc.digest(F.array_join(F.array_sort(F.collect_set("stage")), "|"))
    return an.incompatible(steps(spark, d).groupBy((F.col("run_id") % 10).alias("task_id"), "run_id").agg(F.max("pos").alias("save_seq"), shape.alias("workflow_hash")))


@query(f"WITH {_SQL_EDGES} SELECT src, dst, src || CASE WHEN kind = 'static' THEN ' --> ' ELSE ' -. ' || key || ' .-> ' END || dst AS line FROM e")
def mermaid_edges(spark, d):
    arrow = F.when(F.col("kind") == "static", " --> ").otherwise(F.concat(F.lit(" -. "), F.coalesce("key", F.lit("")), F.lit(" .-> ")))
    return edges(spark, d).select("src", "dst", F.concat("src", arrow, "dst").alias("line"))


@query(f"WITH {_SQL_EDGES} SELECT '{{\"src\":\"' || src || '\",\"dst\":\"' || dst || '\",\"kind\":\"' || kind || '\"}}' AS edge FROM e")
def graph_edges(spark, d):
    return edges(spark, d).select(F.to_json(F.struct("src", "dst", "kind")).alias("edge"))


# --- routing and fuses ---------------------------------------------------------------------
_ROUTES = [("view", "0", "click"), ("view", "1", "purchase"), ("click", "0", "purchase")]


def _routers(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), (F.col("event_id") % 2).cast("string").alias("route"))
    return rows, spark.createDataFrame(_ROUTES, "stage string, route string, target string")


_MAP = "m(stage, route, target) AS (VALUES ('view', '0', 'click'), ('view', '1', 'purchase'), ('click', '0', 'purchase')), x AS (SELECT user_id AS run_id, event_id AS seq, event_type AS stage, CAST(event_id % 2 AS VARCHAR) AS route FROM events)"


@query(f"WITH {_MAP} SELECT stage, route, run_id, seq, target FROM x JOIN m USING (stage, route)")
def route_decisions(spark, d):
    return an.route_decisions(*_routers(spark, d))


@query(f"WITH {_MAP} SELECT stage, route, run_id, seq FROM x ANTI JOIN m USING (stage, route)")
def unmapped_routes(spark, d):
    return an.unmapped_routes(*_routers(spark, d))


_ORD = "o(stage, idx) AS (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('signup', 3), ('ship', 4)), dn AS (SELECT DISTINCT user_id AS run_id, event_type AS stage FROM events WHERE event_id % 3 = 0), todo AS (SELECT r.run_id, o.* FROM (SELECT DISTINCT run_id FROM dn) r CROSS JOIN o ANTI JOIN dn ON dn.run_id = r.run_id AND dn.stage = o.stage)"


@query(f"WITH {_ORD} SELECT run_id, arg_min(stage, idx) AS next FROM todo GROUP BY 1")
def next_stage(spark, d):
    return an.next_stage(order(spark), log(spark, d).where("pos % 3 = 0"))


_DECIDED = f"""{_SQL_EDGES}, {_REACH.format(c='true')}, y AS (SELECT * FROM x WHERE value > 60), dc AS (SELECT run_id, stage AS router, max(pos) AS seq, 'k' || (1 + max(pos) % 2) AS route FROM y WHERE right(stage, 2) = '_0' GROUP BY 1, 2),
ld AS (SELECT dc.run_id, dc.router, e.dst AS target, dc.seq FROM dc JOIN e ON e.kind = 'conditional' AND e.src = dc.router AND e.key = dc.route),
st AS (SELECT ld.run_id, ld.router, ld.target, ld.seq, v.stage AS stray, max(v.pos) AS last FROM ld JOIN y v ON v.run_id = ld.run_id AND v.pos > ld.seq WHERE v.stage <> ld.target AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = ld.target AND r.dst = v.stage) GROUP BY 1, 2, 3, 4, 5)"""


def _decided(spark, d):
    """Graph, closure, visits, mapping and last decisions; a router's decision goes by the id of its event."""
    e = edges(spark, d)
    visits = steps(spark, d).where("value > 60")
    mapping = e.where("kind = 'conditional'").select(F.col("src").alias("router"), F.col("key").alias("route"), F.col("dst").alias("target"))
    made = visits.where(F.col("stage").endswith("_0")).select("run_id", F.col("stage").alias("router"), F.col("pos").alias("seq"), F.concat(F.lit("k"), (1 + F.col("pos") % 2).cast("string")).alias("route"))
    return e, graph.closure(e), visits, mapping, an.last_decisions(made, mapping)


@query(
    f"""WITH RECURSIVE {_DECIDED}, fresh AS (SELECT run_id, router FROM ld WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.run_id = ld.run_id AND st.router = ld.router)),
tg AS (SELECT run_id, e.dst AS stage FROM fresh JOIN e ON e.src = fresh.router AND e.kind = 'conditional'), cov AS (SELECT * FROM tg UNION SELECT tg.run_id, r.dst FROM tg JOIN r ON r.src = tg.stage),
nd AS (SELECT src AS stage FROM e UNION SELECT dst FROM e) SELECT u.run_id, nd.stage FROM (SELECT DISTINCT run_id FROM y) u CROSS JOIN nd WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.run_id = u.run_id AND y.stage = nd.stage) AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.run_id = u.run_id AND cov.stage = nd.stage)"""
)
def orphan_stages(spark, d):
    e, reach, visits, mapping, decided = _decided(spark, d)
    return an.orphan_stages(_declared(e).select(F.col("node").alias("stage")), decided, visits, mapping, reach)


@query(f"WITH RECURSIVE {_DECIDED} SELECT * FROM st")
def stale_routes(spark, d):
    _, reach, visits, _, decided = _decided(spark, d)
    return an.stale_routes(decided, visits, reach)


@query(
    f"""WITH RECURSIVE {_SQL_EDGES}, {_STATIC}, {_PAIRS}, h AS (SELECT run_id, stage, CAST(floor(arg_max(value, pos)) AS BIGINT) % 4 = 0 AS h FROM x GROUP BY 1, 2),
sm AS (SELECT p.run_id, a.stage, coalesce(a.h = b.h, false) AS same FROM p JOIN h a ON a.run_id = p.run_id LEFT JOIN h b ON b.run_id = p.before AND b.stage = a.stage)
SELECT run_id, stage, same, same AND NOT EXISTS (SELECT 1 FROM r WHERE r.dst = sm.stage AND NOT EXISTS (SELECT 1 FROM sm k WHERE k.run_id = sm.run_id AND k.stage = r.src AND k.same)) AS skipped FROM sm"""
)
def skip_propagation(spark, d):
    hashes = steps(spark, d).groupBy("run_id", "stage").agg(sc.digest((F.floor(F.max_by("value", "pos")) % 4 == 0).cast("string")).alias("input_hash"))
    pairs = an.previous_runs(saves(spark, d))
    history = hashes.withColumnRenamed("run_id", "before").join(pairs, "before").select("run_id", "stage", "input_hash")
    return an.skippable(hashes.join(pairs, "run_id", "left_semi"), history, edges(spark, d, "static"))


@query("SELECT run_id, stage, pos FROM (SELECT user_id AS run_id, event_type AS stage, event_id AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS v FROM events) WHERE v = 6")
def visit_fuse(spark, d):
    return an.visit_fuse(log(spark, d), 5)


@query("SELECT *, used >= 100 AS stopped FROM (SELECT user_id AS run_id, event_id AS pos, event_id % 3 + 1 AS attempts, CAST(coalesce(sum(event_id % 3 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM events)")
def step_fuse(spark, d):
    return an.step_fuse(log(spark, d).select("run_id", "pos", (F.col("pos") % 3 + 1).alias("attempts")), 100)


@query("SELECT conv_id, turn, least(pow(2.0, turn - 1), 5.0) AS cap FROM conversations")
def backoff_caps(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", an.backoff_cap(F.col("turn"), 5.0).alias("cap"))


# --- events --------------------------------------------------------------------------------
_OPEN = """e AS (SELECT user_id AS run_id, CAST(event_id % 3 AS VARCHAR) AS stage, event_id AS seq, event_type AS event FROM events),
n AS (SELECT *, CAST(count(*) FILTER (WHERE event = 'view') OVER w AS INTEGER) AS visit, count(*) FILTER (WHERE event = 'view') OVER w - count(*) FILTER (WHERE event = 'purchase') OVER w AS depth
  FROM e WHERE event IN ('view', 'purchase') WINDOW w AS (PARTITION BY run_id, stage ORDER BY seq)),
u AS (SELECT run_id, stage, visit, seq FROM n WHERE event = 'view' AND NOT EXISTS (SELECT 1 FROM n b WHERE b.run_id = n.run_id AND b.stage = n.stage AND b.seq > n.seq AND b.depth < n.depth))"""


def _staged(spark, d):
    return events(spark, d).withColumn("stage", (F.col("seq") % 3).cast("string"))


@query(f"WITH {_OPEN} SELECT run_id, stage, visit, seq FROM u")
def unpaired_events(spark, d):
    return an.unpaired(_staged(spark, d), "view", "purchase")


@query(f"WITH {_OPEN} SELECT run_id, count(*) AS open FROM u GROUP BY 1")
def in_flight(spark, d):
    return an.in_flight(_staged(spark, d), "view", "purchase")


_DELAY, _DEADLINE = 3600, 72 * 3600


def _timed(e):
    shown = F.col("event_type").isin("view", "purchase")
    return e.where(shown).select(F.col("user_id").alias("run_id"), (F.col("event_id") % 3).cast("string").alias("stage"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "view").alias("is_start"))


_SETTLED = f"""WITH e AS (SELECT user_id AS run_id, CAST(event_id % 3 AS VARCHAR) AS stage, event_id AS seq, epoch_us(ts) AS us, event_type = 'view' AS s FROM events WHERE event_type IN ('view', 'purchase')),
p AS (SELECT (max(us) // 1000 - {_DELAY * 1000}) * 1000 AS passed FROM e),
d AS (SELECT e.*, passed, sum(CASE WHEN s THEN 1 ELSE -1 END) OVER w AS depth, row_number() OVER w AS i FROM e, p WHERE us <= passed WINDOW w AS (PARTITION BY run_id, stage ORDER BY us, seq)),
m AS (SELECT a.run_id, a.stage, a.seq, a.us + {_DEADLINE * 1000000} AS due, a.passed, min(b.i) AS bi FROM d a LEFT JOIN d b ON b.run_id = a.run_id AND b.stage = a.stage AND b.i > a.i AND b.depth < a.depth WHERE a.s GROUP BY 1, 2, 3, 4, 5)
SELECT m.run_id, m.stage, m.seq AS start_seq, CASE WHEN b.us <= due THEN b.seq ELSE -1 END AS end_seq, CASE WHEN b.us <= due THEN 'paired' ELSE 'expired' END AS status
FROM m LEFT JOIN d b ON b.run_id = m.run_id AND b.stage = m.stage AND b.i = m.bi WHERE b.us IS NOT NULL OR due <= m.passed"""


@query(_SETTLED)
def stream_pairing(spark, d):
    """The events as a stream, read to their end with event-time timers."""
    schema = t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern: the source may be one file
    made = pairing.paired(_timed(stream), f"{_DELAY} seconds", _DEADLINE)
    return pairing.run_to_end(made, new_path(spark, "paired"), new_path(spark, "pairing")).fillna(-1, ["end_seq"])


@query(_SETTLED)
def settled_pairs(spark, d):
    return pairing.settled(_timed(t(spark, d, "events")), _DELAY, _DEADLINE).fillna(-1, ["end_seq"])


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, d):
    return events(spark, d).groupBy("event").agg(F.count("*").alias("n"))


@query("SELECT run_id, seq, event FROM (SELECT user_id AS run_id, event_id AS seq, event_type AS event, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE event IS DISTINCT FROM b")
def progress_debounce(spark, d):
    return an.debounced(events(spark, d), "event")


@query("SELECT event_id, value AS duration, CAST(floor(value / 10.0) AS BIGINT) AS beats FROM events")
def heartbeat_counts(spark, d):
    return an.heartbeats(t(spark, d, "events").select("event_id", F.col("value").alias("duration")), 10.0)


@query(
    f"""WITH {LOG}, s AS (SELECT run_id, min(pos) AS stop FROM log WHERE stage = 'purchase' GROUP BY 1), b AS (SELECT run_id, key, arg_max(value, pos) AS v FROM log LEFT JOIN s USING (run_id) WHERE stop IS NULL OR pos < stop GROUP BY 1, 2)
SELECT run_id, key, v AS before, CASE WHEN key = 'view' THEN 0.0 ELSE v END AS after, 'purchase,signup,ship' AS reruns FROM b WHERE key = 'view' AND v <> 0.0"""
)
def fork_preview(spark, d):
    state = fold.state_before(log(spark, d), "purchase")
    patch = state.where("key = 'view'").select("run_id", "key", F.lit(0.0).alias("value"))
    return an.fork_preview(state, fold.state_merge(state, patch, ["run_id", "key"]), order(spark), "purchase")


_VALUE = "CASE event_id % 5 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('infinity' AS DOUBLE) ELSE value END"


@query("""SELECT event_id AS seq, '{"event":"' || event_type || '","data":{"fraction":' || CASE event_id % 5 WHEN 0 THEN '"nan"' WHEN 1 THEN '"inf"' ELSE CAST(value AS VARCHAR) END || ',"run":' || CAST(CAST(user_id AS DOUBLE) AS VARCHAR) || '}}' AS line FROM events""")
def event_sink(spark, d):
    data = F.create_map(F.lit("run"), F.col("user_id").cast("double"), F.lit("fraction"), F.expr(_VALUE))
    return an.sink_lines(t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), data.alias("data")))


@query("SELECT substr('cannot write ' || event_type || ' of ' || repeat('x', 300), 1, 200) AS reason, min(event_id) AS first, count(*) AS n FROM events WHERE event_id % 6 = 5 GROUP BY 1")
def sink_errors(spark, d):
    error = F.when(F.col("event_id") % 6 == 5, F.concat(F.lit("cannot write "), F.col("event_type"), F.lit(" of "), F.repeat(F.lit("x"), 300)))
    return an.sink_errors(t(spark, d, "events").select(F.col("event_id").alias("seq"), error.alias("error")))


@query(f"WITH {LOG} SELECT run_id, arg_max(value, pos) AS value FROM log WHERE key = 'purchase' GROUP BY 1")
def state_key_lookup(spark, d):
    return fold.state_fold(log(spark, d).where("key = 'purchase'")).select("run_id", "value")
