"""A corpus pipeline: quality rules, near copies, benchmark passages, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row that the stage before
it kept. All but the last return the columns of ``documents``; the last adds ``slot`` and
``shard``. Documents that the mix takes more than once are rows that occur that often.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pigmenta.llm.decontaminate import drop_contaminated
from pigmenta.llm.mixing import resample
from pigmenta.llm.ngram_join import keep_one
from pigmenta.llm.quality import keep_good
from pigmenta.scratch import materialize
from pigmenta.llm.sharding import place
from pigmenta.session import small_batches


def _stage(work: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of this script, which owns its session: texts are long, so batches are small."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return work(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules do not reject."""
    return keep_good(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return keep_one(docs, k=5, percent=80)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to weights 1, 2, 3 of their sources takes them."""
    return resample(docs)


@_stage
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return place(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("mixing", mixing), ("sharding", sharding)]

#: The mix is random (by hash) and the quality bands need a tokeniser: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
