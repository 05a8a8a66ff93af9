"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written and reread as the next one's
``docs``.  All but the last return the columns of ``documents``:

* quality_rules drops the documents that the quality operator rejects;
* near_dedup keeps one document of each group of near-duplicates;
* decontamination drops documents that leak a benchmark item;
* mixing repeats or leaves out whole documents, so that sources meet their targets;
* sharding adds the column ``shard``.

Null texts, empty tables and repeated rows behave as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kiln.llm.common import materialize, read_documents, read_table
from kiln.llm.decontaminate import drop_leaks
from kiln.llm.mixing import mixed_rows
from kiln.llm.neardup import keep_first
from kiln.llm.quality import keep_clean
from kiln.llm.sharding import with_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# the graph search, the template windows and the capacity search are not one SQL statement
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
