"""Running sums over a total order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import Scratch, spread


def running_sum(df: DataFrame, scratch: Scratch, groups: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group that come before in order.

    Rows are range-partitioned by group and order and written with their partition's number, so
    a group that holds a third of all rows lies in many partitions. Sums run within partitions;
    a table of one row for each group and partition carries them across. df is read twice
    (once to sample the ranges): give it as a kept table. Rows alike in group and order fall in
    some fixed order.
    """
    keys = [*groups, *order]
    ranged = df.repartitionByRange(spread(scratch.spark), *keys).withColumn("__part", F.spark_partition_id())
    kept = scratch.keep(ranged)
    parts = kept.groupBy("__part", *groups).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col("__part").alias("__of"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"))
    same = F.col("__part") == F.col("__of")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = kept.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(carried, same).withColumn(out, F.col("__carried") + F.col("__local")).select(*df.columns, out)
