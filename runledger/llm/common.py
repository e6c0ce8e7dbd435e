"""Helpers shared by the operators: durable cuts, sources, connected components."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of the two word definitions the operators use.
NON_SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our
    own in local mode, as in tests; on a cluster an error, for a local folder is not shared."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="runledger-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the query that wrote them ends. Else they stay until the driver happens
#: to collect its garbage, and the steps of an operator add up on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Write; only here are shuffle files removed, for an iterator may read its own after its query ended."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later stages start
    from files that survive a lost executor, and nothing above is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    for made in getattr(_open, "cuts", [])[-1:]:
        made.append(path)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is removed at the end, also when it fails: nothing lazy may read it on."""
    levels = _open.__dict__.setdefault("cuts", [])
    levels.append([])
    try:
        yield
    finally:
        for path in levels.pop():
            drop_path(spark, path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is cut, after which the cuts made on the way are removed, as
    they are when it fails."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        spark = next(a for a in (*args, *kwargs.values()) if isinstance(a, DataFrame)).sparkSession
        outer = getattr(_open, "cuts", [])[-1:]
        with scratch(spark):
            path = new_path(spark, f.__name__)
            for made in outer:
                made.append(path)
            result = f(*args, **kwargs)
            _write(result, path)
        return spark.read.schema(result.schema).parquet(path)

    return run


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that may be broadcast to filter rows: a hash table of some 32 MB.
MOST_IDS = 1 << 20


def without(rows: DataFrame, key: Column, gone: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """The rows whose ``key`` is not in the one column of ``gone`` (longs, not null, distinct).
    Up to ``most`` of them, counted, are broadcast, so whole texts are not shuffled to lose a
    few; beyond that both sides are joined by shuffle."""
    gone = gone.select(F.col(gone.columns[0]).alias(fresh("gone", rows.columns)))
    few = gone.count() <= most
    return rows.join(F.broadcast(gone) if few else gone, key == gone[gone.columns[0]], "left_anti")


def fresh(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of ``columns`` has, upper or lower case."""
    low = {c.lower() for c in columns}
    while name in low:
        name += "_"
    return name


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, _UPPER, _UPPER.lower())


def slots(df: DataFrame) -> int:
    """Range partitions for the rows of ``df``: as many as it is read in, so their number grows
    with the input, and no fewer than shuffles and cores."""
    spark = df.sparkSession
    return max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@tidy
def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Distributed union-find by alternating large-star and small-star rounds.

    ``edges`` has two comparable id columns. Returns (node, root): root is the smallest id
    of the component. Each round is one min-aggregation (with map-side combine) and one
    join on the node id, cut to a durable table; rounds needed grow with the logarithm of
    the component size. The result is cut, the rounds' tables are removed. Nodes without an edge are not listed. Self-loops and repeated
    edges are allowed.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = cut(e, "edges"), None
    for _ in range(max_rounds):
        # large star: larger neighbours of u hang on the smallest of u's neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, hang on the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = cut(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
