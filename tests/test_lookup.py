"""Lookup by name where many rows share one."""

import time

from motionlake.operators import tables
from pyspark.sql import functions as F


def test_lookup_of_a_name_that_many_rows_share(spark):
    # every key beside every row would be 1.6 billion pairs
    keys = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, "Bolt").otherwise("BOLT").alias("name")).union(spark.createDataFrame([(-1, "nut"), (-2, None)], "id long, name string"))
    meta = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "bolt").otherwise("BOLT").alias("name"), F.col("id").alias("ord"))
    began = time.monotonic()
    got = {r.id: (r.meta_name, r.meta_ord) for r in tables.lookup_ci(keys, meta, "name", "ord").collect()}
    assert time.monotonic() - began < 60
    assert len(got) == 40_002 and got[-1] == got[-2] == (None, None)
    assert all(got[i] == (("bolt", 0) if i % 2 == 0 else ("BOLT", 1)) for i in range(40_000))
