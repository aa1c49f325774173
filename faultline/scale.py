"""Lineage cuts, stored tables and positions shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session may make its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` durably, so later steps neither replan nor recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored_table(df: DataFrame) -> DataFrame:
    """`df` written by column in the shared checkpoint folder, so that readers take what they need."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that may be sent to every task.
SMALL = 100_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """`df`, materialised and counted; sent to every task if it has at most SMALL rows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                name: str) -> DataFrame:
    """Adds the 1-based position of each row within its key, however large the key is.

    Rows are range-partitioned by key and order, so a large key spreads over many
    partitions; each numbers its own rows and adds the sizes of the ones before.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *cols))
    placed = placed.withColumn("_part", F.spark_partition_id())
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_part",
                         F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*cols))
    return (placed.withColumn(name, inside).join(sizes, [*keys, "_part"])
            .withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before"))


class Appended:
    """A table in the shared checkpoint folder that rounds add rows to, each row written once."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_path(spark, name)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def read(self, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:  # nothing was appended
            return self.spark.createDataFrame([], schema)
