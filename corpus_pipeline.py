"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go; repeated lines go, and with them documents that lose every line; of each group of near
copies one document stays (five-word shingles, similarity of 0.8 or more); sources are mixed by temperature,
every source read at least once and none more than twice; the last stage encodes what is left and returns
its digests. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosswork.llm import byte_bpe, line_dedup, mixing, near_dedup, toxicity
from glosswork.llm.common import stored, table_of


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table_of(spark, sf_dir, "labels").select("doc_id", "toxic"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(docs)


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("mixing", _mixing), ("byte_bpe", _encoding)]
#: Training a classifier is nothing that SQL expresses; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
