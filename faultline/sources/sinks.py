"""Result tables to storage and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | Sequence[str] | None = None,
                mode: str = "overwrite", sort_by: Sequence[str] = ()) -> None:
    """Impact, fragility, sweep, verification, ranking or write-back rows as json or parquet.

    Rows are dealt out by partition value and sorted inside, so a value is written by few tasks and
    a reader of one value or range opens little.  An overwrite replaces the partitions it brings
    and leaves the others.
    """
    by = [partition_by] if isinstance(partition_by, str) else list(partition_by or ())
    by = [c for c in by if c in df.columns]
    if by:
        # a large partition value is spread over tasks by the sort columns
        df = df.repartitionByRange(*[F.col(c) for c in (*by, *sort_by)])
    if by or sort_by:
        df = df.sortWithinPartitions(*by, *sort_by)
    w = df.write.mode(mode).format(fmt)
    if by:
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def nested_impact(summary: DataFrame) -> DataFrame:
    """Impact rows in the nested report shape: change, counts, risk and coverage structs."""
    return summary.select(
        "catalog", "change_id", "change", "target_urn",
        F.struct("breaks", "degrades", "safe", "unknown", "ambiguous", "queries_total",
                 "analysed", "runs_impacted", "teams").alias("counts"),
        F.struct("score", "level", "review_required", "coverage", "level_qualifier").alias("risk"),
        "teams_impacted")


def write_baseline(profile: DataFrame, sample: DataFrame, schema: DataFrame, path: str) -> None:
    """A baseline snapshot as three tables under one folder, the sample a folder per feature."""
    write_table(profile, f"{path}/features")
    write_table(sample, f"{path}/sample", partition_by="feature")
    write_table(schema, f"{path}/schema")


def read_baseline_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables of `write_baseline`."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("features", "sample", "schema")}


class Snapshot:
    """Counts of baseline values, bucketed by (feature, h), h a hash of the value.

    Whoever joins current values to it on these shuffles those to the buckets; the snapshot itself
    is not shuffled again.  (Spark does not use buckets of floating-point columns, hence the hash;
    whoever joins on it compares the values too.)  `open` makes a snapshot that another session
    wrote known to this one.
    """

    COLUMNS = "feature STRING, v DOUBLE, nb BIGINT, h BIGINT"

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def write(self, values: DataFrame) -> "Snapshot":
        """values(feature, v); nulls and NaN do not count."""
        counts = values.where("v IS NOT NULL AND NOT isnan(v)").groupBy("feature", "v").agg(
            F.count("*").alias("nb")).withColumn("h", F.xxhash64("v"))
        counts = counts.repartition(self.buckets, "feature", "h")
        (counts.write.mode("overwrite").bucketBy(self.buckets, "feature", "h").sortBy("feature", "h")
         .option("path", self.path).saveAsTable(self.name))
        return self

    def open(self) -> "Snapshot":
        place = self.path.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
                       f"CLUSTERED BY (feature, h) SORTED BY (feature, h) INTO {self.buckets} BUCKETS "
                       f"LOCATION '{place}'")
        return self

    def counts(self) -> DataFrame:
        return self.spark.table(self.name)
