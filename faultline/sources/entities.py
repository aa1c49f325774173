"""Nested metadata payloads to catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X
from ..scale import cut_lineage

ENTITY = ("urn STRING, properties STRUCT<name: STRING, qualifiedName: STRING>, "
          "viewProperties STRUCT<logic: STRING, viewLogic: STRING>")


_FIELDS = ("urn: STRING, properties: STRUCT<name: STRING, qualifiedName: STRING>, "
           "viewProperties: STRUCT<logic: STRING, viewLogic: STRING>")


def parse_entities(payloads: DataFrame, json: str = "json") -> DataFrame:
    """JSON text per entity to an `e` struct, other columns kept; entities without urn drop."""
    return payloads.withColumn("e", F.from_json(json, ENTITY)).where(
        F.length(F.coalesce("e.urn", F.lit(""))) > 0)


def normalise_results(payloads: DataFrame, json: str = "json") -> DataFrame:
    """One row per result, whichever of three list names the payload uses and whether the
    entity is nested or flat."""
    item = f"STRUCT<{_FIELDS}, entity: STRUCT<{_FIELDS}>>"
    shape = f"searchResults ARRAY<{item}>, results ARRAY<{item}>, entities ARRAY<{item}>"
    body = F.from_json(json, shape)
    rows = payloads.withColumn("r", F.explode(F.coalesce(
        body["searchResults"], body["results"], body["entities"])))
    urn = F.coalesce(F.when(F.col("r.entity").isNotNull(), F.col("r.entity.urn"))
                     .otherwise(F.col("r.urn")), F.lit(""))
    props = F.coalesce("r.entity.properties", "r.properties")
    name = F.coalesce(F.nullif(props["name"], F.lit("")),
                      F.nullif(props["qualifiedName"], F.lit("")), F.lit(""))
    keep = [c for c in payloads.columns if c != json]
    return rows.select(*keep, urn.alias("urn"), name.alias("name"))


def _logic() -> Column:
    text = F.coalesce(F.nullif("e.viewProperties.logic", F.lit("")),
                      F.nullif("e.viewProperties.viewLogic", F.lit("")))
    return F.when(F.lower(text).contains("select"), text)


def flatten_entities(entities: DataFrame, pos: str = "pos", prefix: str = "view") -> DataFrame:
    """Downstream entities (`e` struct, position) to consumers.

    An entity with a SELECT in its view logic becomes a query and the asset it
    defines; any other becomes an asset without a definition, never a gap.
    """
    platform = X.urn_platform("e.urn")
    tail = F.substring_index(F.substring_index(F.substring_index("e.urn", ",", -2), ",", 1),
                             ".", -1)
    name = F.coalesce(F.nullif("e.properties.name", F.lit("")), tail)
    sql = _logic()
    qid = F.when(sql.isNotNull(), X.generated_query_id(name, pos, prefix))
    return entities.select(
        F.col(pos), F.col("e.urn").alias("urn"), name.alias("name"),
        X.platform_asset_type(platform).alias("type"), platform.alias("platform"),
        qid.alias("defining_query_id"), sql.alias("sql"),
        F.when(sql.isNotNull(), "view_logic").otherwise("no_sql_definition").alias("source"),
        F.length(sql).alias("sql_chars"))


def dataset_names(entities: DataFrame) -> DataFrame:
    """Target entities to name and sql_name, at most three dotted segments."""
    qualified = F.nullif("e.properties.qualifiedName", F.lit(""))
    sql_name = X.last_segments(F.coalesce(qualified, X.urn_sql_name("e.urn")), 3)
    return entities.select(
        F.col("e.urn").alias("urn"),
        F.coalesce(F.nullif("e.properties.name", F.lit("")),
                   F.substring_index(sql_name, ".", -1)).alias("name"),
        sql_name.alias("sql_name"), X.urn_platform("e.urn").alias("platform"))


def provenance_counts(consumers: DataFrame) -> DataFrame:
    return consumers.groupBy("platform", "source").agg(F.count("*").alias("n"))


def find_sql(payloads: DataFrame, json: str = "json") -> DataFrame:
    """Every string field that looks like SQL anywhere in a JSON text, with its path.

    Containers are opened one nesting level per round until none is left.
    """
    keep = [c for c in payloads.columns if c != json]
    level = payloads.select(*keep, F.lit("").alias("path"), F.parse_json(json).alias("v"))
    tvf = payloads.sparkSession.tvf
    found = []
    while True:
        opened = level.withColumnsRenamed({k: f"_k_{k}" for k in keep}).lateralJoin(
            tvf.variant_explode(F.col("v").outer()))
        opened = cut_lineage(opened.select(
            *[F.col(f"_k_{k}").alias(k) for k in keep],
            F.concat("path", F.when(F.col("key").isNotNull(),
                                           F.concat(F.lit("."), F.col("key"))).otherwise(
                F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"),
            F.col("key").isNotNull().alias("named"), F.col("value").alias("v"),
            F.schema_of_variant("value").alias("kind")))
        text = F.try_variant_get("v", "$", "string")
        low = F.lower(text)
        found.append(opened.where((F.col("kind") == "STRING") & F.col("named")
                                  & (F.length(text) > 30) & low.contains("select")
                                  & low.contains("from")).select(*keep, "path",
                                                                 text.alias("sql")))
        level = opened.where(F.col("kind").startswith("OBJECT")
                             | F.col("kind").startswith("ARRAY")).select(*keep, "path", "v")
        if level.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def distinct_sql(found: DataFrame, order: str) -> DataFrame:
    """One hit per text, the earliest by `order` and path; `prefix` shows its first 80 characters."""
    return found.groupBy(F.sha2("sql", 256).alias("digest")).agg(
        F.min_by(F.struct("path", "sql"), F.struct(order, "path")).alias("x")).select(
        F.substring("x.sql", 1, 80).alias("prefix"), "x.path", "x.sql")
