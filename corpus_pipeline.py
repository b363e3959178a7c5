"""The corpus pipeline: documents to token shards, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtab.llm.common import written
from voxtab.llm.decontaminate import decontaminated_stage
from voxtab.llm.language_id import language_stage
from voxtab.llm.mixing import mixed_stage
from voxtab.llm.simhash import dedup_stage
from voxtab.llm.token_shards import shard_stage

STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminated_stage),
    ("mixing sources to target weights", mixed_stage),
    ("token-ID / binary output", shard_stage),
]

#: Neural scores, XXH64 and a tokenizer are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "".join(c if c.isalnum() else "-" for c in name))
    return docs
