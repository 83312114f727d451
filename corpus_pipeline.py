"""From raw documents to training shards: rejects low quality, keeps one of each group of near
copies, drops benchmark leaks, mixes sources to their weights and deals the rest into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.llm import decontam, minhash, quality, queries, sharding
from chromloom.llm.common import read_table, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle of the near-copy stage; operator 1 alone is bound to two.
NEAR_COPY_WORDS = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees accept."""
    judged = quality.classify(docs, read_table(spark, sf_dir, "labels"))
    return judged.filter("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; rows that repeat a doc_id
    are judged by their own text."""
    return minhash.one_of_each(docs, n_words=NEAR_COPY_WORDS).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each epoch that reaches them."""
    mixed = queries.mix_query(docs).filter("copies > 0")
    return mixed.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot in it."""
    return sharding.assign_shards(docs, queries.N_SHARDS).select(*COLUMNS, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [
    ("quality", keep_quality), ("near copies", drop_near_copies), ("benchmark leaks", drop_leaks),
    ("mix", mix_sources), ("shards", into_shards),
]

#: The trees of the first stage can't be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
