"""The rate-limited request queue as windows.

One call at a time: a call is dispatched when it has arrived and the gap that
the call before it left is over. With G the sum of the gaps before a call,
its dispatch is G plus the greatest of (arrival - G) so far, so a running sum
and a running maximum replace the simulation. Both are taken in chunks of
time, and the chunks' own totals are carried over, so no task orders a whole
queue. Queues with different keys don't wait for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dispatch(requests: DataFrame, gap_ms: Column, keys: list[str] | None = None, chunk_ms: int = 6 * 3_600_000) -> DataFrame:
    """requests (t: arrival in ms, id: order of equal arrivals, other columns) with dispatched and waited, in ms.

    gap_ms: what each call leaves before the next one.
    """
    keys = keys or []
    rows = requests.withColumn("_gap", gap_ms.cast("bigint")).withColumn("_chunk", F.floor(F.col("t") / chunk_ms))
    own = Window.partitionBy(*keys, "_chunk").orderBy("t", "id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")

    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_gap").alias("_sum"))
    sums = sums.withColumn("_sum_before", F.coalesce(F.sum("_sum").over(chunks), zero)).drop("_sum")
    rows = rows.withColumn("_g", F.coalesce(F.sum("_gap").over(before), zero)).join(sums, [*keys, "_chunk"]).withColumn("_g", F.col("_g") + F.col("_sum_before"))
    rows = rows.withColumn("_lead", F.col("t") - F.col("_g"))
    tops = rows.groupBy(*keys, "_chunk").agg(F.max("_lead").alias("_top"))
    tops = tops.withColumn("_top_before", F.max("_top").over(chunks)).drop("_top")
    running = F.max("_lead").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_running", running).join(tops, [*keys, "_chunk"]).withColumn("dispatched", F.col("_g") + F.greatest("_running", "_top_before"))
    return rows.withColumn("waited", F.col("dispatched") - F.col("t")).drop("_gap", "_chunk", "_g", "_sum_before", "_lead", "_running", "_top_before")


def gaps(throttled: Column, delay_ms: int, cooldown: Column) -> Column:
    """The fixed delay; behind a throttled call the cooldown, if that is longer."""
    return F.when(throttled, F.greatest(F.lit(delay_ms).cast("bigint"), cooldown.cast("bigint"))).otherwise(F.lit(delay_ms).cast("bigint"))
