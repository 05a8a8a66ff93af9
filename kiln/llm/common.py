"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.session import ensure_checkpoint_dir

# the six ASCII white space characters that end a word, as a regex class body
SPACE_CLASS = r"\x20\x09-\x0D"
# a key is "hot" when it holds more than one in HOT_SHARE rows: at most HOT_SHARE such keys exist
HOT_SHARE = 1000
# so few narrow rows (some 10 MB) can be broadcast, and never make a slow task
FEW_ROWS = 200_000


def words(text: Column) -> Column:
    """Maximal runs of non-space characters, in order; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A plain reference inside a lambda may be inlined by the optimizer and then
    runs once per array element; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_struct(df: DataFrame) -> Column:
    """All columns of ``df`` as one column ``_row``, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and read it back.

    Cuts the lineage: later jobs read the columns they need from files that
    every executor sees, also after an executor is lost.  With ``rows`` known
    to be few, they go to few files.
    """
    spark = df.sparkSession
    if rows is not None and rows <= FEW_ROWS:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def join_unique(big: DataFrame, small: DataFrame, key: str, counts: DataFrame | None = None,
                rows: int | None = None, narrow: bool = True) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key, or few) that survives hot keys.

    Keys that hold more than 1/1000 of the rows of ``big`` are at most 1000, so
    their rows of ``small`` are broadcast (a proven bound) and the rows of
    ``big`` under them never meet in one task; all other keys take a plain
    shuffle join.  When ``big`` has few rows it is broadcast itself, unless its
    rows are not ``narrow``.  ``counts`` (key, n) and ``rows`` may be passed when
    they are known already.  ``big`` should be materialised, as it is read again.
    """
    if (big.count() if rows is None else rows) <= FEW_ROWS:
        return (F.broadcast(big) if narrow else big).join(small, key)
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most * HOT_SHARE <= total or most <= FEW_ROWS:
        return big.join(small, key)
    hot = [r[0] for r in counts.filter((F.col("n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key).collect()]
    is_hot = F.col(key).isin(hot)
    return big.filter(~is_hot).join(small.filter(~is_hot), key).unionByName(
        big.filter(is_hot).join(F.broadcast(small.filter(is_hot)), key))


def running_total(df: DataFrame, groups: list[str], order: list[str], bucket: str, value: str,
                  out: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one in its group (0 for the first).

    ``bucket`` is an integer column that never decreases along ``order``; the
    sum is taken per (group, bucket), so a hot group is spread over its
    buckets, and the totals of earlier buckets come from one small row per
    bucket.  The group columns must hold no null.
    """
    part = [*groups, bucket]
    before = (df.groupBy(*part).agg(F.sum(value).alias("_sum"))
              .withColumn("_before", F.coalesce(F.sum("_sum").over(
                  Window.partitionBy(*groups).orderBy(bucket)
                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select(*part, "_before"))
    own = F.sum(value).over(Window.partitionBy(*part).orderBy(*order)
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    return (df.withColumn("_own", own).join(before, part)
            .withColumn(out, (F.col("_own") + F.col("_before")).cast("long"))
            .drop("_own", "_before"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")
