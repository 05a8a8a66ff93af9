"""Row numbers over huge, few-key groups without funnelling them into one task.

``row_number() OVER (PARTITION BY k ORDER BY o)`` sorts each key in a single
task; with a key holding a third of all rows that task holds a third of the
data.  ``row_index`` computes the same number in three distributed steps, the
same at every size:

1. range-partition the rows by (key, order) and name each range after its
   partition; the ranges are kept in a reliable checkpoint, so that all later
   steps see the same ones, also after an executor is lost;
2. count rows per (key, range) -- a small table -- and turn the counts into a
   per-key running offset;
3. number the rows inside each (key, range) and add the offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.staging import materialize
from kiln.session import ensure_checkpoint_dir


def range_buckets(df: DataFrame, cols: list[str], out_col: str = "_bucket", ranges: int | None = None) -> DataFrame:
    """Add the number of the row's range along ``cols`` (any orderable types, nulls first)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(ranges, *[F.col(c) for c in cols])
            .withColumn(out_col, F.spark_partition_id()).checkpoint())


def row_index(df: DataFrame, order_col: str, partition_cols: tuple[str, ...] = (),
              name: str = "row_index", ranges: int | None = None, in_place: bool = False) -> DataFrame:
    """0-based ``row_number() - 1`` over ``partition_cols`` ordered by ``order_col``.

    ``order_col`` must be unique within each partition key (ties would be
    numbered arbitrarily, as with a plain window).  Null keys form a group,
    null orders come first.  ``ranges`` defaults to the session's shuffle
    partitions.  ``in_place`` (few keys): the rows are sorted as they are dealt
    out and numbered where they lie, so that they are shuffled once, not twice.
    """
    part = list(partition_cols)
    if in_place:
        return _index_in_place(df, order_col, part, name, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = range_buckets(df, [*part, order_col], "_bucket", ranges)
    keys = [*part, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in keys],
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys).orderBy(order_col)
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in keys]
    return (df.withColumn("_rn", F.row_number().over(local))
            .join(offsets, same, "inner")
            .withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("bigint"))
            .drop("_rn", "_offset", "_bucket", *[f"_o_{c}" for c in keys]))


def _index_in_place(df: DataFrame, order_col: str, part: list[str], name: str, ranges: int) -> DataFrame:
    order = [F.col(c) for c in (*part, order_col)]
    df = materialize(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # a key's rows of a range lie one after the other: the id counts them, its upper bits are the range
    counts = df.groupBy(*part, F.shiftright("_at", 33).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    w = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in part], F.col("_bucket").alias("_o_bucket"),
                            (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_from")).alias("_offset"))
    same = [F.shiftright("_at", 33) == F.col("_o_bucket"), *[F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in part]]
    # a row per key and range
    return (df.join(F.broadcast(offsets), same, "inner").withColumn(name, (F.col("_offset") + F.col("_at")).cast("bigint"))
            .drop("_at", "_offset", "_o_bucket", *[f"_o_{c}" for c in part]))
