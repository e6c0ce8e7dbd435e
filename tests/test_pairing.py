"""Stream pairing: calls do not grow with the keys, nulls, events just on the watermark."""

from pyspark.sql import functions as F

from runledger.streaming import pairing

SCHEMA = "run_id long, stage string, seq long, us long, is_start boolean"
BASE = 1_700_000_000_000_000


def both(spark, tmp_path, rows):
    """The stream's rows, those of the batch query, and the most state rows it had."""
    frame = spark.createDataFrame(rows, SCHEMA).select("run_id", "stage", "seq", F.timestamp_micros("us").alias("ts"), "is_start")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = pairing.paired(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "10 seconds", 20)
    out = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    out.awaitTermination()
    most = max(o["numRowsTotal"] for p in out.recentProgress for o in p["stateOperators"])
    got = spark.read.schema(pairing.OUT).parquet(str(tmp_path / "out"))
    return [sorted(map(tuple, x.collect()), key=repr) for x in (got, pairing.settled(frame, 10, 20))], most


def test_calls_do_not_grow_with_keys(spark, tmp_path):
    rows = [(i, "a", 2 * i + k, BASE + 1_000_000 * k, k == 0) for i in range(1500) for k in (0, 1)] + [(0, "z", 9999, BASE + 60_000_000, True)]
    (got, want), most = both(spark, tmp_path, rows)
    assert got == want and len(got) == 1500
    assert most <= 1024


def test_nulls_and_the_watermark_itself(spark, tmp_path):
    """The last watermark is the very time of an end and of a deadline: both count."""
    rows = [
        (None, "a", 1, BASE, True), (None, "a", 2, BASE + 5_000_000, False), (2**60 + 1, None, 3, BASE, True), (2**60 + 1, None, 4, BASE + 50_000_000, False),
        (5, "b", 5, BASE + 45_000_000, True), (5, "b", 6, BASE + 50_000_000, False), (6, "b", 7, BASE + 30_000_000, True), (7, "c", 8, BASE + 60_000_000, True),
    ]
    (got, want), _ = both(spark, tmp_path, rows)
    assert got == want == sorted([(None, "a", 1, 2, "paired"), (2**60 + 1, None, 3, None, "expired"), (5, "b", 5, 6, "paired"), (6, "b", 7, None, "expired")], key=repr)
