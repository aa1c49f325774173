"""Small catalogs written as rows."""

from faultline import model as M
from faultline.operators.impact import Catalog


def make_catalog(spark, tables, queries, assets=(), catalogs=()):
    """tables {(catalog, sql_name): {column: type}}, queries [(catalog, id, sql, team, runs)],
    assets [(catalog, urn, name, type, query_id, model_path)]."""
    ds, cols, pos = [], [], {}
    for (c, sql_name), schema in tables.items():
        i = pos[c] = pos.get(c, -1) + 1
        urn = f"urn:{c}:{sql_name}"
        ds.append((c, i, urn, sql_name.split(".")[-1], sql_name, "warehouse", []))
        cols += [(c, urn, j, n, t) for j, (n, t) in enumerate(schema.items())]
    q = [(c, i, n, s, "warehouse", t, None, r, None) for i, (c, n, s, t, r) in enumerate(queries)]
    a = [(c, i, u, n, t, "p", [], d, m) for i, (c, u, n, t, d, m) in enumerate(assets)]
    return Catalog(
        spark.createDataFrame(ds, M.DATASETS), spark.createDataFrame(cols, M.COLUMNS),
        spark.createDataFrame(q, M.QUERIES), spark.createDataFrame(a, M.ASSETS),
        spark.createDataFrame([(c, "snowflake", r, "") for c, r in catalogs], M.CATALOGS))


def changes(spark, rows):
    return spark.createDataFrame(rows, M.CHANGES)


def by(df, key):
    return {r[key]: r for r in df.collect()}
