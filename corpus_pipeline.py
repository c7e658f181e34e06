"""From raw documents to token shards: language, near-duplicates, benchmark leaks, source mixing, token ids.

Each stage is `(spark, docs, sf_dir) -> DataFrame`; what it returns is written as Parquet to the shared folder and read again as the next
stage's documents. All stages but the last return the columns of `documents`, whatever further columns those have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm import decontaminate, language, mixing, neardup, tokens
from vouchline.llm.common import part_of, table, written

ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose two best languages are all but equal, go."""
    dictionaries = language.learn_dictionaries(docs.where(~part_of("doc_id", 4, 2)))
    judged = language.classify(docs.select(F.struct(*docs.columns).alias("doc"), "text"), dictionaries)
    return judged.where("not rejected").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id: shingles of five words, similarity 0.8 or more."""
    groups = written(neardup.near_duplicates(docs), "pipeline-groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("known"), F.col("row").alias("row_")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("known")) & (F.xxhash64("text") == F.col("row_")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: one row for each repetition, none for those it leaves out or that have no word."""
    _, plan = mixing.mix_plan(docs)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", mixing.word_count().alias("size"), mixing.order_hash().alias("h"))
    taken = mixing.take(rows, plan).where("taken > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select("doc.*")


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents in shard files; one row for each, as read back by key."""
    return tokens.token_positions(docs, tokens.default_vocabulary())


STAGES = [("language", languages), ("near_dedup", near_duplicates), ("decontamination", leaks), ("mixing", mix), ("token_shards", token_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
