"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Without one a session on this machine alone (local master) gets a temporary folder; on a cluster that is an error, as other machines
    do not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    pairs = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return pairs.union(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root for every node of an edge table (a, b); root is the smallest node that can be reached.

    Each round is a large-star and a small-star step (both are one aggregation and one join on the node) behind a
    reliable checkpoint; the number of rounds grows with the logarithm of the number of nodes. Edges of a node to
    itself and repeated edges do no harm; edges with a null end are left out.
    """
    shared_dir(edges.sparkSession)
    loops = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    now = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    mark = None
    for _ in range(rounds):
        now = _small_star(_large_star(now)).checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components are not known after {rounds} rounds")
    return loops.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
