"""Seconds of every catalogue query at BENCH_SF_DIR, one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from runledger import catalogue

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
cpus = os.environ.get("BENCH_CPUS", "8")
spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
took = {}
for name, f in catalogue.QUERIES.items():
    runs = []
    for _ in range(3):
        began = time.time()
        f(spark, SF).write.format("noop").mode("overwrite").save()
        runs.append(time.time() - began)
    took[name] = round(min(runs), 3)
print(json.dumps({"metric": "total seconds of the ledger queries, best of 3", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": SF}))
