"""Catalog, log, evidence and payload tables derived from the given tables.

The tables hold no metadata of their own, so the registered queries build it
from their rows: every event is a logged statement, every supplier an asset.
The same rules are mirrored in `oracles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .operators.impact import Catalog

# Statement of an event by template number; {id} becomes the event id.
TEMPLATES = (
    "SELECT orderstatus, SUM(totalprice) AS total FROM sales.orders WHERE orderkey > {id}"
    " GROUP BY orderstatus",
    "SELECT o.orderkey, c.name FROM sales.orders o JOIN sales.customer c"
    " ON o.custkey = c.custkey WHERE c.acctbal > {id}",
    "SELECT custkey FROM sales.orders o JOIN sales.customer c ON o.custkey = c.custkey"
    " WHERE o.orderdate > DATE '2001-01-01' AND o.orderkey <> {id}",
    "SELECT * FROM sales.lineitem WHERE quantity > {id}",
    "SELECT l.*, o.orderpriority FROM sales.orders o, sales.lineitem l"
    " WHERE o.orderkey = l.orderkey AND l.linenumber = {id}",
    "SELECT shipdate, COUNT(*) AS n FROM sales.lineitem GROUP BY shipdate"
    " HAVING MAX(tax) > {id} ORDER BY SUM(discount)",
    "SELECT orderkey FROM {{ ref('orders') }} WHERE orderkey = {id}",
    "SELECT name FROM sales.customer WHERE custkey IN"
    " (SELECT custkey FROM sales.orders WHERE totalprice > {id})",
    "WITH big AS (SELECT custkey, SUM(totalprice) AS spend FROM sales.orders GROUP BY custkey)"
    " SELECT spend FROM big WHERE spend > {id}",
    "SELECT mktsegment, ROW_NUMBER() OVER (PARTITION BY nationkey ORDER BY acctbal) AS rn"
    " FROM sales.customer QUALIFY ROW_NUMBER() OVER (ORDER BY name) < {id}",
    "SELECT x FROM other.metrics WHERE y = {id}",
    "SELECT partkey FROM sales.lineitem JOIN other.notes ON note_id = {id}",
    "SELECT orderkey FROM WHERE totalprice > {id} (",
    "SELECT returnflag, linestatus FROM (SELECT returnflag, linestatus, suppkey"
    " FROM sales.lineitem WHERE extendedprice < {id}) t ORDER BY returnflag",
)
# Text of a supplier's model by supplier key modulo 3.
MODELS = (
    "SELECT\n    s.suppkey,\n    s.name\nFROM sales.supplier s\n",
    "-- nation of each supplier\nSELECT nationkey, suppkey AS id FROM sales.supplier\n"
    "WHERE nationkey >= 0\n",
    "SELECT\n    orderkey,\n    custkey\nFROM sales.orders\n",
)
# Statements that write, by event id modulo 5; {id} becomes the event id.
WRITES = (
    "INSERT INTO sales.orders (orderkey, custkey) SELECT l.orderkey, {id} FROM sales.lineitem l",
    "INSERT OVERWRITE TABLE sales.customer SELECT * FROM sales.supplier WHERE suppkey > {id}",
    "CREATE OR REPLACE VIEW mart.daily AS SELECT o.orderdate, SUM(l.tax) AS tax FROM sales.orders o"
    " JOIN sales.lineitem l ON o.orderkey = l.orderkey WHERE o.custkey <> {id} GROUP BY o.orderdate",
    "CREATE TABLE mart.big AS WITH b AS (SELECT o.custkey FROM sales.orders o WHERE o.totalprice >"
    " {id}) SELECT c.name FROM b JOIN sales.customer c ON b.custkey = c.custkey",
    "INSERT INTO sales.supplier VALUES ({id})",
)
TABLES = ("orders", "customer", "lineitem", "supplier")
CATALOGS = ("east", "west")
CHANGES = (
    ("c1", "west", "sales.orders", "orderkey", "drop", None),
    ("c2", "west", "customer", "name", "rename", "full_name"),
    ("c3", "west", "sales.lineitem", "tax", "drop", None),
    ("c4", "west", "sales.supplier", "nationkey", "drop", None),
    ("c5", "east", "orders", "custkey", "drop", None),
    ("c6", "east", "sales.nowhere", "x", "drop", None),
    ("c7", "west", "sales.supplier", "suppkey", "rename", "supplier_key"),
    ("c8", "east", "urn:sales:supplier", "acctbal", "drop", None),
    ("c9", "west", "sales.supplier", "name", "drop", None),
)
CHANGE_DDL = ("change_id STRING, catalog STRING, dataset STRING, column STRING, op STRING, "
              "new_name STRING")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(texts: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in texts]), n.cast("int"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    t = F.col("user_id") % 7 + F.when(F.col("event_type").isin("purchase", "error"), 7).otherwise(0)
    west = F.col("event_id") % 2 == 1
    t = F.when(west & t.isin(6, 12), 10).otherwise(t)
    ident = F.col("event_id").cast("string")
    events = e.select(
        F.when(west, "west").otherwise("east").alias("catalog"), F.col("event_id").alias("q_pos"),
        F.concat(F.lit("q"), ident).alias("query_id"),
        F.replace(_pick(TEMPLATES, t), F.lit("{id}"), ident).alias("sql"),
        F.lit("warehouse").alias("platform"),
        F.when(F.col("user_id") % 5 < 4, F.concat(F.lit("team"), (F.col("user_id") % 5).cast(
            "string"))).alias("team"),
        F.lit(None).cast("string").alias("actor"),
        (1 + F.col("event_id") % 3).cast("int").alias("runs"),
        F.lit(None).cast("string").alias("last_run"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    models = s.select(
        F.lit("west").alias("catalog"), (F.col("k") + (1 << 40)).alias("q_pos"),
        F.concat(F.lit("mq"), F.col("k").cast("string")).alias("query_id"),
        _pick(MODELS, F.col("k") % 3).alias("sql"), F.lit("dbt").alias("platform"),
        F.lit("models").alias("team"), F.lit(None).cast("string").alias("actor"),
        F.lit(2).alias("runs"), F.lit(None).cast("string").alias("last_run"))
    return events.unionByName(models)


def writes(spark: SparkSession, sf: str) -> DataFrame:
    """The log's events as statements that write."""
    i = F.col("q_pos")
    log_ = log(spark, sf).where(F.col("team").isNull() | (F.col("team") != "models"))
    return log_.withColumn("sql", F.replace(_pick(WRITES, i % 5), F.lit("{id}"), i.cast("string")))


def assets(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    key = F.col("k").cast("string")
    none = F.lit(None).cast("string")
    owners = F.array().cast("array<string>").alias("owners")
    kind = _pick(("looker_dashboard", "warehouse_view", "dbt_model"), F.col("k") % 3)
    defined = (F.when(F.col("k") % 4 == 0, none)
               .when(F.col("k") % 4 == 1, F.concat(F.lit("missing"), key))
               .otherwise(F.concat(F.lit("q"), (F.col("k") * 2).cast("string"))))
    east = s.select(F.lit("east").alias("catalog"), F.col("k").alias("a_pos"),
                    F.concat(F.lit("urn:asset:"), key).alias("urn"),
                    F.concat(F.lit("a"), key).alias("name"), kind.alias("type"),
                    F.lit("bi").alias("platform"), owners, defined.alias("defining_query_id"),
                    none.alias("model_path"))
    west = s.select(F.lit("west").alias("catalog"), F.col("k").alias("a_pos"),
                    F.concat(F.lit("urn:model:"), key).alias("urn"),
                    F.concat(F.lit("m"), key).alias("name"), F.lit("dbt_model").alias("type"),
                    F.lit("dbt").alias("platform"), owners,
                    F.concat(F.lit("mq"), key).alias("defining_query_id"),
                    F.concat(F.lit("models/m"), key, F.lit(".sql")).alias("model_path"))
    return east.unionByName(west)


def models(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.lit("west").alias("catalog"),
        F.concat(F.lit("models/m"), k.cast("string"), F.lit(".sql")).alias("path"),
        _pick(MODELS, k % 3).alias("sql"))


def catalog(spark: SparkSession, sf: str) -> Catalog:
    """Two catalogs with the real column lists of four tables, prefixes cut."""
    datasets, columns = [], []
    for c in CATALOGS:
        for i, t in enumerate(TABLES):
            urn = f"urn:sales:{t}"
            datasets.append((c, i, urn, t, f"sales.{t}", "warehouse", []))
            for j, (name, kind) in enumerate(table(spark, sf, t).dtypes):
                columns.append((c, urn, j, name.split("_", 1)[1], kind))
    ds = spark.createDataFrame(datasets, "catalog STRING, ds_pos INT, urn STRING, name STRING, "
                               "sql_name STRING, platform STRING, owners ARRAY<STRING>")
    cols = spark.createDataFrame(
        columns, "catalog STRING, urn STRING, col_pos INT, column STRING, native_type STRING")
    cats = spark.createDataFrame([("east", "snowflake", True, ""), ("west", "snowflake", False, "")],
                                 "catalog STRING, sql_dialect STRING, require_review BOOLEAN, "
                                 "compliance_note STRING")
    return Catalog(ds, cols, log(spark, sf), assets(spark, sf), cats)


def changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHANGES), CHANGE_DDL)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One asset per part: lineage is where its suppliers sit, use is how often it sold."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                              "s_nationkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"),
                                               F.lower("n_name").alias("nation"))
    used = lines.groupBy("l_partkey").agg(F.count("*").cast("int").alias("query_count"),
                                          F.count_distinct("l_orderkey").cast("int")
                                          .alias("downstream_count"))
    src = (lines.groupBy("l_partkey", "l_suppkey").agg(F.lit(1).alias("one"))
           .join(sup, "l_suppkey").join(nation, "s_nationkey")
           .groupBy("l_partkey").agg(F.array_sort(F.collect_set("nation")).alias("src")))
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    d = (part.join(used, part.p_partkey == used.l_partkey, "left").drop("l_partkey")
         .join(src, part.p_partkey == src.l_partkey, "left").drop("l_partkey"))
    quiet = k % 3 == 0   # nobody uses these
    text = F.concat(
        F.lit("The "), F.col("p_name"), F.lit(" table, loaded from "),
        _pick(("france", "oracle", "germany", "peru and kafka"), k % 4),
        F.when(k % 7 == 0, F.concat(F.lit(" keyed by `"), F.col("p_type"), F.lit("`")))
        .otherwise(""), F.when(k % 11 == 0, " (deprecated test)").otherwise(""))
    return d.select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("urn:part:"), k.cast("string")).alias("urn"),
        F.col("p_name").alias("name"),
        F.when(k % 5 != 0, text).alias("current_description"),
        F.lit(None).cast("string").alias("owner"),
        F.when(k % 6 == 0, none).otherwise(F.array(F.lower("p_brand"), F.lit("economy"))).alias(
            "schema_fields"),
        F.when(k % 8 == 0, none).otherwise(F.coalesce("src", none)).alias("lineage_sources"),
        F.when(quiet, 0).otherwise(F.coalesce("downstream_count", F.lit(0))).alias(
            "downstream_count"),
        F.when(quiet, F.col("p_size") % 30).otherwise(F.coalesce("query_count", F.lit(0))).alias(
            "query_count"),
        none.alias("query_tokens"),
        F.when(k % 9 == 0, F.array(F.col("p_brand"))).otherwise(none).alias("sibling_terms"))


EVIDENCE_KEYWORDS = ("france", "germany", "kafka", "oracle", "peru")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """part -> supplier -> nation -> region."""
    def node(prefix: str, c: str) -> Column:
        return F.concat(F.lit(prefix), F.col(c).cast("string"))

    line = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.lit(1).alias("one")).select(node("part:", "l_partkey").alias("up"),
                                      node("supplier:", "l_suppkey").alias("down"))
    sup = table(spark, sf, "supplier").select(node("supplier:", "s_suppkey").alias("up"),
                                              node("nation:", "s_nationkey").alias("down"))
    nat = table(spark, sf, "nation").select(node("nation:", "n_nationkey").alias("up"),
                                            node("region:", "n_regionkey").alias("down"))
    return line.unionByName(sup).unionByName(nat)


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One nested entity per event as JSON text; every third has view logic."""
    e = table(spark, sf, "events").select("event_id", "event_type", "props")
    i = F.col("event_id").cast("string")
    platform = _pick(("dbt", "tableau", "looker", "mode", "snowflake"), F.col("event_id") % 5)
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), platform,
                   F.lit(",ws.db.sch.T "), i, F.lit(",PROD)"))
    logic = F.concat(F.lit("select k, n from log_"), F.col("event_type"), F.lit(" where k = "), i)
    entity = F.struct(
        urn.alias("urn"),
        F.when(F.col("event_id") % 2 == 0, F.struct(F.concat(F.lit("Item "), i).alias("name")))
        .alias("properties"),
        F.when(F.col("event_id") % 3 == 0, F.struct(logic.alias("logic"))).alias(
            "viewProperties"))
    extra = F.concat(F.lit(',"more":['), F.col("props"),
                     F.lit(',{"note":"select one thing only","deep":{"q":"'),
                     F.when(F.col("event_id") % 10 == 0,
                            F.concat(F.lit("SELECT a FROM events_archive WHERE id = "), i))
                     .otherwise("no statement in this field, just words"), F.lit('"}}]}'))
    text = F.to_json(entity)
    return e.select(F.col("event_id").alias("pos"), text.alias("t"), extra.alias("x")).select(
        "pos", F.concat(F.expr("left(t, length(t) - 1)"), F.col("x")).alias("json"))
