"""The corpus pipeline: language identification, near-dedup, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's docs. All but the last return the columns of docs, whatever other
columns there are. Empty tables pass through every stage. Repeated rows: one of a group stays in near-dedup, so that later
stages see none; before, all stay or all go. Null and empty texts hold no language and go in the first stage; given to a later one, they are one group
in near-dedup, hold no benchmark item, have no words in the mix and are rows like others in shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import decontaminate, langid, mixing, sharding, simhash
from quernstone.llm.common import materialize, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, fitted on this corpus, does not reject."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compacted shards in the shared folder; a row for each row of docs says where it lies."""
    return sharding.shard_report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: Gradient descent, SimHash, balanced sampling and file layout have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
