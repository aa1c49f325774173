"""Table schemas (Spark DDL) and the fixed values the rules are stated in."""

from __future__ import annotations

# ---------------------------------------------------------------- schemas
DATASETS = ("catalog STRING, ds_pos INT, urn STRING, name STRING, sql_name STRING, "
            "platform STRING, owners ARRAY<STRING>")
COLUMNS = "catalog STRING, urn STRING, col_pos INT, column STRING, native_type STRING"
QUERIES = ("catalog STRING, q_pos BIGINT, query_id STRING, sql STRING, platform STRING, "
           "team STRING, actor STRING, runs INT, last_run STRING")
ASSETS = ("catalog STRING, a_pos BIGINT, urn STRING, name STRING, type STRING, platform STRING, "
          "owners ARRAY<STRING>, defining_query_id STRING, model_path STRING")
CATALOGS = "catalog STRING, sql_dialect STRING, require_review BOOLEAN, compliance_note STRING"
CHANGES = ("change_id STRING, catalog STRING, dataset STRING, column STRING, op STRING, "
           "new_name STRING")
MODELS = "catalog STRING, path STRING, sql STRING"

CATALOG_JSON = (
    "name STRING, sql_dialect STRING, require_review BOOLEAN, compliance_note STRING, "
    "datasets ARRAY<STRUCT<urn: STRING, name: STRING, sql_name: STRING, platform: STRING, "
    "schema: MAP<STRING, STRING>, owners: ARRAY<STRING>>>, "
    "assets ARRAY<STRUCT<urn: STRING, name: STRING, type: STRING, platform: STRING, "
    "owners: ARRAY<STRING>, defining_query_id: STRING, dbt_path: STRING>>, "
    "queries ARRAY<STRUCT<query_id: STRING, sql: STRING, platform: STRING, team: STRING, "
    "actor: STRING, runs: STRING, last_run: STRING>>"
)
QUERY_JSON = ("query_id STRING, sql STRING, platform STRING, team STRING, actor STRING, "
              "runs STRING, last_run STRING")
EVIDENCE = (
    "urn STRING, name STRING, current_description STRING, owner STRING, "
    "schema_fields ARRAY<STRING>, lineage_sources ARRAY<STRING>, downstream_count INT, "
    "query_count INT, query_tokens ARRAY<STRING>, sibling_terms ARRAY<STRING>"
)
BASELINE_JSON = (
    "model_urn STRING, created_at STRING, training_data STRING, schema MAP<STRING, STRING>, "
    "features MAP<STRING, STRUCT<count: BIGINT, mean: DOUBLE, std: DOUBLE, min: DOUBLE, "
    "max: DOUBLE, sample: ARRAY<DOUBLE>>>"
)

# ---------------------------------------------------------------- fixed values
# Verdicts, worst first.
VERDICTS = ("BREAKS", "DEGRADES", "UNKNOWN", "SAFE")
VERDICT_COLORS = {"BREAKS": "red", "DEGRADES": "amber", "SAFE": "green", "UNKNOWN": "grey"}

# Sweep buckets, worst first.
BUCKETS = ("landmine", "unassessed", "needs_review", "verified_safe", "error")

# Risk weights and level floors.
RISK_BREAK, RISK_DEGRADE, RISK_RUN, RISK_RUN_CAP, RISK_TEAM = 20, 8, 0.5, 60, 5
RISK_LEVELS = (("CRITICAL", 60), ("HIGH", 30), ("MODERATE", 10))

# PSI class limits and the floor put under a bin's share.
PSI_STABLE, PSI_MODERATE, PSI_FLOOR = 0.10, 0.25, 1e-6

# Drift score penalties and the at-risk limit.
SCHEMA_PENALTY = {"high": 0.30, "low": 0.05}
STALE_PENALTY = {"high": 0.30, "moderate": 0.15}
AT_RISK = 0.25

# Values kept per feature in a baseline snapshot.
BASELINE_SAMPLE = 5000

# Data platforms a description may claim as a source.
PLATFORM_KEYWORDS = (
    "bigquery", "databricks", "dynamodb", "erp", "hadoop", "hive", "kafka", "mongo", "mongodb",
    "mysql", "oracle", "postgres", "postgresql", "redshift", "s3", "salesforce", "sap",
    "snowflake", "sqlserver", "teradata",
)
# Words that call an asset unimportant.
DEPRECATION_WORDS = (
    "deprecated", "do not use", "legacy", "obsolete", "sandbox", "scratch", "temp", "temporary",
    "test", "throwaway", "unused",
)
HEAVY_USE_QUERIES = 25

# Health buckets, worst first.
HEALTH = ("CRITICAL", "NEEDS_REVIEW", "FORGOTTEN", "HEALTHY")

# Substrings that mark an asset type as a BI consumer.
BI_TYPES = ("dashboard", "report", "chart", "workbook", "looker", "powerbi", "tableau", "bi",
            "explore")

# Platform of an entity -> asset type; anything else is '<platform>_asset'.
PLATFORM_TYPES = {
    "dbt": "dbt_model",
    "tableau": "tableau_workbook",
    "powerbi": "powerbi_report",
    "looker": "looker_dashboard",
    "snowflake": "snowflake_table",
}

HUMAN = "⟨human to decide⟩"
FOOTER_MARK = "⚠️"
