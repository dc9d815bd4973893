"""Dense 1-based row numbers in key order, without a one-partition window.

1. Range-partition on (key, tiebreak); the tiebreak spreads repeated keys.
2. Sort within partitions and ``checkpoint()`` to the shared checkpoint
   folder: the partition a row landed in is now fixed data (range bounds are
   sampled anew by every job, so without this the numbering can break). The
   files go with the frame (``spark.cleaner.referenceTracking.cleanCheckpoints``
   in our sessions).
3. Rows per partition (one small aggregate), running offsets over those few
   rows, and a broadcast join back (its size is the partition count).
4. Position inside a partition comes from ``monotonically_increasing_id``,
   whose low 33 bits count rows within the partition in stored order.
The only shuffle of the data is the range partitioning itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.session import checkpoint_root

POSITION_BITS = 33


def row_index(df: DataFrame, order_col: str = "pair_id", name: str = "row", start: int = 1,
              num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_root(spark)
    cols = df.columns
    # Without a number the planner sizes the partitions from the data at run time.
    parts = (num_partitions,) if num_partitions else ()
    tiebreak = F.xxhash64(*[F.col(c) for c in cols])
    laid = (df.withColumn("_tb", tiebreak)
              .repartitionByRange(*parts, F.col(order_col), F.col("_tb"))
              .sortWithinPartitions(order_col, "_tb")
              .checkpoint(eager=True))
    placed = laid.select(
        *cols,
        F.spark_partition_id().alias("_pid"),
        (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << POSITION_BITS) - 1))).alias("_pos"),
    )
    sizes = laid.groupBy(F.spark_partition_id().alias("_pid")).count()
    # A window without partitioning over (partition count) rows: small by construction.
    offsets = sizes.select(
        "_pid",
        (F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_offset"))
    offsets = offsets.fillna(0, subset=["_offset"])
    numbered = placed.join(F.broadcast(offsets), "_pid")
    return numbered.select(
        (F.col("_offset") + F.col("_pos") + F.lit(start)).cast("bigint").alias(name), *cols)
