"""Running numbers and ranks against plain loops, also when one group holds nearly all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import ranges


@pytest.mark.parametrize("hot", [False, True])
def test_running_equals_a_plain_loop(spark, hot):
    rng = random.Random(hot)
    rows = [(("a" if hot and rng.random() < 0.9 else rng.choice(["a", "b", None, "c"])), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    rng.shuffle(rows)
    found = ranges.running(spark.createDataFrame(rows, "g string, i long, v int"), ["g"], ["i"], {"before": F.col("v")}, partitions=7).collect()
    seen, expected = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        n, total = seen.get(g, (0, 0))
        expected[i] = (g, v, n + 1, total)
        seen[g] = (n + 1, total + (v or 0))
    assert {r.i: (r.g, r.v, r.nth, r.before) for r in found} == expected


def test_a_hot_group_is_split_over_ranges(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("g"), "id", F.lit(1).alias("v"))
    dealt = rows.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 5_000
    found = ranges.running(rows, ["g"], ["id"], {"before": F.col("v")}, partitions=8)
    assert found.where("nth = id + 1 and before = id").count() == 20_000


def test_two_keys_and_no_sums(spark):
    rows = [("x", None, 3), ("x", None, 1), ("x", "y", 2), (None, "y", 9)]
    found = ranges.running(spark.createDataFrame(rows, "a string, b string, i int"), ["a", "b"], ["i"], partitions=3).collect()
    assert sorted((str(r.a), str(r.b), r.i, r.nth) for r in found) == [("None", "y", 9, 1), ("x", "None", 1, 1), ("x", "None", 3, 2), ("x", "y", 2, 1)]
    assert ranges.running(spark.createDataFrame([], "a string, i int"), ["a"], ["i"]).count() == 0


def test_nearest_ranks(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, rng.random(), 0.5, 7.0])) for g in ("a", "b", None) for _ in range(rng.randint(1, 80))] + [("none", None)]
    found = {r.g: r for r in ranges.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        expected = [values[max(math.ceil(p * len(values)), 1) - 1] if values else 0.0 for p in (0.0, 0.5, 0.95, 1.0)]
        assert [found[g].p0, found[g].p50, found[g].p95, found[g].p100] == expected
