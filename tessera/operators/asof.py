"""As-of join: to each row the last row of another table that is not later, by key.

Both tables are put together, range-sorted by key and time, and the last match is carried forward. A key that fills many
tasks is carried across them by a table of what each task ends with, so that no key has to fit in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import scratch


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: list[str]) -> DataFrame:
    """left with `match`, a struct of the row of `right` with equal keys and the greatest time up to the left row's own.

    `order` names columns of right that decide between rows of one time: the greatest is the match. Rows without a match,
    and those with a null key or time, have a null one. Right rows with a null time match nothing.
    """
    spark, l_cols, r_cols = left.sparkSession, left.columns, right.columns
    l_one, r_one = F.struct(*l_cols), F.struct(*r_cols)
    names = [f"_k{i}" for i in range(len(keys))]
    tie = [f"_o{i}" for i in range(len(order))]
    kept = right.where(F.col(right_time).isNotNull())
    a = kept.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *(F.col(o).alias(n) for o, n in zip(order, tie, strict=True)), r_one.alias("_r"))
    b = left.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), l_one.alias("_l"))
    sort = [*names, "_t", "_side", *tie]
    ranged = a.unionByName(b, allowMissingColumns=True).repartitionByRange(*sort).sortWithinPartitions(*sort)
    path = scratch(spark, "asof")
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    both = spark.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))
    here = F.last("_r", ignorenulls=True).over(Window.partitionBy("_task", *names).orderBy("_at"))
    # One row for each task that holds some of a key.
    ends = both.groupBy("_task", *names).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_at"))).alias("_end"))
    before = Window.partitionBy(*names).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select(F.col("_task").alias("_to"), *(F.col(n).alias(f"{n}_") for n in names), F.last("_end", ignorenulls=True).over(before).alias("_brought"))
    same = [F.col("_task") == F.col("_to"), *(F.equal_null(F.col(n), F.col(f"{n}_")) for n in names)]
    found = both.withColumn("_here", here).where("_side = 1").join(brought, same, "left")
    whole = F.col("_t").isNotNull()
    for n in names:
        whole = whole & F.col(n).isNotNull()
    return found.select(*(F.col("_l")[c].alias(c) for c in l_cols), F.when(whole, F.coalesce("_here", "_brought")).alias("match"))
