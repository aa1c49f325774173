"""Baseline snapshot: feature statistics and a repeatable sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import model as M


def feature_profile(df: DataFrame, features: Sequence[str],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, min and max per feature in one pass over wide rows."""
    aggs = []
    for i, f in enumerate(features):
        v = F.col(f).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs.append(F.struct(F.lit(f).alias("feature"), F.count(v).alias("n"),
                             F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                             F.min(v).alias("min"), F.max(v).alias("max")).alias(f"_{i}"))
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*[f"_{i}" for i in range(len(features))])))


def baseline_sample(values: DataFrame, id_col: str, k: int = M.BASELINE_SAMPLE,
                    seed: int = 42) -> DataFrame:
    """The k values of each feature whose seeded id hash is smallest: exact and repeatable.

    `values(feature, v, id_col)`.  A count per hash prefix finds where the k-th
    value falls, so only the prefixes up to it are ranked, however many rows a
    feature has.
    """
    hashed = values.withColumn(
        "h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    hashed = hashed.withColumn("p", F.substring("h", 1, 4))
    run = W.partitionBy("feature").orderBy("p")
    cut = (hashed.groupBy("feature", "p").count()
           .withColumn("upto", F.sum("count").over(run))
           .where(F.col("upto") - F.col("count") < k)
           .groupBy("feature").agg(F.max("p").alias("last")))
    near = hashed.join(cut, "feature").where(F.col("p") <= F.col("last"))
    rank = F.row_number().over(W.partitionBy("feature").orderBy("h", id_col))
    return near.withColumn("r", rank).where(F.col("r") <= k).select("feature", id_col, "v")
