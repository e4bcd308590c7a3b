"""Row numbers and running sums within keys, without ever gathering one key in one task.

A window function sends all rows of a key to one task. Here rows are range-partitioned by
(key, order), so a hot key spreads over as many tasks as its rows need; each task numbers its own
rows, and only one row per (partition, key) is gathered to compute where each part starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.plans.runtime import cut, shuffle_width

_ROW_BITS = 33  # monotonically_increasing_id: partition in the upper bits, row in the lower 33


def number_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rank: str = "rank",
    value: str | None = None,
    running: str = "running",
) -> DataFrame:
    """df with `rank` (from 0, by `order`, within `keys`) and, if `value` is named, `running`: its sum up to and with the row.

    `order` must be total within a key for a repeatable result. NULL keys form one key. The sorted
    rows are written once (see cut()), so that both passes see the same partitions.
    """
    spark = df.sparkSession
    cols = [F.col(c) for c in keys + order]
    spread = df.repartitionByRange(shuffle_width(spark), *cols).sortWithinPartitions(*cols)
    spread = cut(spread.withColumn("_at", F.monotonically_increasing_id()))
    spread = spread.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")]
    if value:
        aggs.append(F.sum(value).alias("_sum"))
    parts = spread.groupBy(*keys, "_part").agg(*aggs)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if value:
        parts = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    same: Column = F.lit(True)
    right = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", "_skip", *(["_base"] if value else []))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = spread.join(right, same & (F.col("_part") == F.col("_p")))
    out = out.withColumn(rank, F.col("_at") - F.col("_first") + F.col("_skip"))
    drop = ["_at", "_part", "_p", "_first", "_skip", *[f"_k{i}" for i in range(len(keys))]]
    if value:
        # one (partition, key) part is at most a range partition, so this window stays bounded
        inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(running, F.col("_base") + F.sum(value).over(inside))
        drop.append("_base")
    return out.drop(*drop)
