"""Helpers that the text operators share: the shared folder, lineage cuts and word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxtab.operators.graph import shared_dir

#: White space of the word rule: space and U+0009 to U+000D. Everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder, as a URI or path that Spark can write."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
