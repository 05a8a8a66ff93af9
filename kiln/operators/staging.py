"""Intermediate results as files of the session's shared folder.

``materialize`` writes a DataFrame once and reads it back.  Several branches can
read it, a lost executor loses nothing, and later plans start from a plain scan:
a persisted DataFrame would carry its whole lineage into every plan above it,
which adaptive execution then describes anew after each of their stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from kiln.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
