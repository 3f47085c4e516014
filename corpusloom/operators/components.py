"""Connected components by large-star and small-star steps on tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir, which all executors share.

    Where that is unset a local session takes a temporary folder, and a cluster is an error, as its machines share none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='corpusloom-')}/table-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """The table written to a shared folder and read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(df: DataFrame) -> None:
    """Deletes a kept table that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def connected(edges: DataFrame) -> DataFrame:
    """node and component (the least node it is connected with) of every node of the edges (a, b)."""
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
        before, edges = edges, keep(large.join(least, "u").select(pairs.alias("x")).select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).where("u <> v").distinct())
        forget(before)
        forget(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
        seen = now
