"""Running numbers, running sums and ranks over groups of any size, in two passes over ranges."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.storage import stored


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """rows with nth (1, 2, ... within its group in the given order) and, for each of sums, the sum over the rows before it in its group.

    Rows are dealt out by group and order over ranges and stored; so a group that holds most rows fills many ranges, and a range may hold many small groups. Each range
    counts and sums its part of each group, which gives at most one row for each group and range; what lies in earlier ranges of the group is added to the numbers that
    each range finds for itself. No task gets more than a range, or the counted ranges of one group. Null keys are a group of their own, null amounts count as 0, rows
    that are equal in order take any places among themselves.
    """
    sums = sums or {}
    names = {f"_v{i}": name for i, name in enumerate(sums)}
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = rows.select("*", *(F.coalesce(c, F.lit(0)).alias(k) for k, c in zip(names, sums.values(), strict=True)))
    dealt = stored(given.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(k).alias(k) for k in names))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_ahead{c}") for c in ("_n", *names)))
    here = Window.partitionBy("_range", *by).orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_k", F.row_number().over(here)).select("*", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_own{k}") for k in names))
    same = reduce(and_, (own[c].eqNullSafe(ahead[f"_by_{i}"]) for i, c in enumerate(by)), own["_range"] == ahead["_r"])
    joined = own.join(ahead, same)
    return joined.select(*(own[c] for c in rows.columns), (F.col("_k") + F.col("_ahead_n")).cast("long").alias("nth"), *((F.col(f"_own{k}") + F.col(f"_ahead{k}")).alias(name) for k, name in names.items()))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): the least value that at least that share of a group's values does not exceed; 0 for a group without values.

    Equal values are counted before anything moves; the counts run on over ranges, and each share picks the value in whose count its rank falls. Nulls are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ordered = running(counts, by, [value], {"_before": F.col("_n")})
    groups = rows.groupBy(*by).agg(F.count(value).alias("_all"))
    same = reduce(and_, (groups[c].eqNullSafe(ordered[c]) for c in by))
    met = groups.join(ordered, same, "left").select(*(groups[c] for c in by), "_all", value, "_n", "_before")
    picked = []
    for name, share in shares.items():
        rank = F.greatest(F.ceil(F.col("_all") * F.lit(float(share))), F.lit(1))
        inside = (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_n"))
        picked.append(F.coalesce(F.max(F.when(inside, F.col(value))).cast("double"), F.lit(0.0)).alias(name))
    return met.groupBy(*by).agg(*picked)
