"""Readers that turn metadata files into the tables of `model`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import model as M
from ..functions import expr as X
from ..operators import infer
from ..operators.impact import Catalog

LOG_OFFSET = 1 << 40  # keeps log rows behind the inline ones


def _folder(path: Column | str) -> Column:
    return F.regexp_extract(X.col(path), r"^(.*)/[^/]*$", 1)


def _query_columns(q: str) -> list[Column]:
    return [F.col(f"{q}query_id").alias("query_id"), F.col(f"{q}sql").alias("sql"),
            F.coalesce(f"{q}platform", F.lit("unknown")).alias("platform"),
            F.col(f"{q}team").alias("team"), F.col(f"{q}actor").alias("actor"),
            F.coalesce(F.col(f"{q}runs").cast("int"), F.lit(1)).alias("runs"),
            F.col(f"{q}last_run").alias("last_run")]


def read_catalogs(spark: SparkSession, paths: str | Sequence[str],
                  logs: str | Sequence[str] = (), log_lines: bool = False) -> Catalog:
    """Catalog JSON files plus query logs; a log belongs to the catalog in its folder.

    Inline queries come before the log's, nothing is de-duplicated, and missing
    fields take their defaults.  `log_lines` reads logs as one object per line,
    which splits large files over tasks.
    """
    raw = (spark.read.schema(M.CATALOG_JSON).option("multiLine", True).json(paths)
           .withColumn("folder", _folder("_metadata.file_path")))
    raw = raw.withColumn("catalog", F.coalesce("name", F.element_at(F.split("folder", "/"), -1)))
    catalogs = raw.select(
        "catalog", F.coalesce("sql_dialect", F.lit("snowflake")).alias("sql_dialect"),
        F.coalesce("require_review", F.lit(False)).alias("require_review"),
        F.coalesce("compliance_note", F.lit("")).alias("compliance_note"))
    ds = raw.select("catalog", F.posexplode("datasets").alias("ds_pos", "d"))
    name = F.coalesce("d.name", "d.urn")
    datasets = ds.select(
        "catalog", "ds_pos", F.col("d.urn").alias("urn"), name.alias("name"),
        F.coalesce(F.col("d.sql_name"), name).alias("sql_name"),
        F.coalesce("d.platform", F.lit("unknown")).alias("platform"),
        F.coalesce("d.owners", F.array().cast("array<string>")).alias("owners"))
    columns = ds.select("catalog", F.col("d.urn").alias("urn"),
                        F.posexplode("d.schema").alias("col_pos", "column", "native_type"))
    assets = raw.select("catalog", F.posexplode("assets").alias("a_pos", "a")).select(
        "catalog", F.col("a_pos").cast("bigint").alias("a_pos"), F.col("a.urn").alias("urn"),
        F.coalesce("a.name", "a.urn").alias("name"),
        F.coalesce("a.type", F.lit("asset")).alias("type"),
        F.coalesce("a.platform", F.lit("unknown")).alias("platform"),
        F.coalesce("a.owners", F.array().cast("array<string>")).alias("owners"),
        F.col("a.defining_query_id").alias("defining_query_id"),
        F.col("a.dbt_path").alias("model_path"))
    queries = raw.select("catalog", F.posexplode("queries").alias("q_pos", "q")).select(
        "catalog", F.col("q_pos").cast("bigint").alias("q_pos"), *_query_columns("q."))
    if logs:
        log = (spark.read.schema(M.QUERY_JSON).option("multiLine", not log_lines).json(logs)
               .withColumn("folder", _folder("_metadata.file_path"))
               .withColumn("q_pos", F.monotonically_increasing_id() + LOG_OFFSET)
               .join(raw.select("folder", "catalog"), "folder"))
        queries = queries.unionByName(log.select("catalog", "q_pos", *_query_columns("")))
    return Catalog(datasets, columns, queries, assets, catalogs)


def read_evidence(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    raw = spark.read.schema(M.EVIDENCE).option("multiLine", True).json(paths)
    return raw.withColumns({
        **{c: F.coalesce(c, none) for c in
           ("schema_fields", "lineage_sources", "query_tokens", "sibling_terms")},
        **{c: F.coalesce(c, F.lit(0)) for c in ("downstream_count", "query_count")},
    }).withColumn("pos", F.monotonically_increasing_id())


def read_baseline(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, DataFrame]:
    """A training snapshot as `schema`, `features` and `sample` tables."""
    raw = spark.read.schema(M.BASELINE_JSON).option("multiLine", True).json(paths)
    raw = raw.withColumn("model_urn", F.coalesce("model_urn", F.lit("unknown")))
    feats = raw.select("model_urn", F.explode("features").alias("feature", "f"))
    return {
        "schema": raw.select("model_urn", F.explode("schema").alias("column", "type")),
        "features": feats.select("model_urn", "feature", F.col("f.count").alias("n"),
                                 F.col("f.mean").alias("mean"), F.col("f.std").alias("std"),
                                 F.col("f.min").alias("min"), F.col("f.max").alias("max")),
        "sample": feats.select("model_urn", "feature", F.explode("f.sample").alias("v")),
    }


def read_serving(spark: SparkSession, path: str) -> DataFrame:
    """A serving CSV with types that hold all of its rows (`infer.column_types`).

    The rows are read once to fold the types, and again by whoever uses them; no value is lost to
    a guess from the first ones.
    """
    raw = spark.read.option("header", True).csv(path)
    found = infer.column_types(infer.text_values(raw)).select("column", "type").collect()
    return infer.typed(raw, {r["column"]: r["type"] for r in found})  # one row a column


def schema_table(df: DataFrame, entity: str, side: str) -> DataFrame:
    """Column names and types of a DataFrame as rows of a schema table."""
    return df.sparkSession.createDataFrame(
        [(entity, side, c, t) for c, t in df.dtypes],
        "entity STRING, side STRING, column STRING, type STRING")


def feature_values(df: DataFrame, feature: str, limit: int | None = None) -> DataFrame:
    """Non-null values of one feature; all of them unless the caller asks for the first ones."""
    out = df.select(F.col(feature).cast("double").alias("v")).where(F.col("v").isNotNull())
    return out.limit(limit) if limit else out


def read_changes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Change lists: an array of runs, or an object with a `runs` array."""
    run = "name STRING, catalog STRING, change STRING, require_review BOOLEAN, new_name STRING"
    struct = ", ".join(f.replace(" ", ": ", 1) for f in run.split(", "))
    raw = spark.read.schema(f"{run}, runs ARRAY<STRUCT<{struct}>>").option(
        "multiLine", True).json(paths)
    fields = [f.split(" ")[0] for f in run.split(", ")]
    flat = raw.where(F.col("runs").isNull()).select(*fields)
    nested = raw.select(F.inline("runs")).select(*fields)
    return flat.unionByName(nested)


def read_models(spark: SparkSession, root: str, catalog: str,
                pattern: str = "*.sql") -> DataFrame:
    """Model files as (catalog, path below root, whole text)."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
           .text(root, wholetext=True))
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    below = F.replace(path, F.lit(root.rstrip("/") + "/"), F.lit(""))
    return raw.select(F.lit(catalog).alias("catalog"), below.alias("path"), F.col("value").alias("sql"))
