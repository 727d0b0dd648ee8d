"""The corpus pipeline: documents in, sharded training documents out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the last adds
its shard. Between stages docs are written as Parquet to the shared folder and read again, so a lost executor redoes one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontam, jaccard, mixing, rules, sharding
from wayfold.llm.queries import MIX, SHARDS, table
from wayfold.llm.storage import materialize, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and their language's perplexity band keep."""
    return rules.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight says, in a global shuffle."""
    return mixing.replicate(docs, "doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))) + 1, MIX).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that their doc_id is hashed to."""
    return sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: The perplexity bands have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table, and what the stage wrote on the way, goes when the next stage's is written; the last stage reads the one that stays."""
    return STAGES[-1][1](spark, _after(spark, sf_dir, len(STAGES) - 1), sf_dir)


def _after(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The documents after the first n stages."""
    if not n:
        return table(spark, sf_dir, "documents")
    name, stage = STAGES[n - 1]
    with temporary(spark):
        return materialize(stage(spark, _after(spark, sf_dir, n - 1), sf_dir), name, keep=True)
