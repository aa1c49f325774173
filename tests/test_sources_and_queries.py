import json
import os

import pytest

from pyspark.sql import functions as F

from faultline.functions import expr as X
from faultline.operators import impact as I, infer
from faultline.sources import catalog as C, sinks
from helpers import by

SF = "/root/testdata/sf0.001"


def test_catalog_files(spark, tmp_path):
    d = tmp_path / "one"
    d.mkdir()
    (d / "catalog.json").write_text(json.dumps({
        "datasets": [{"urn": "u1", "sql_name": "a.t", "schema": {"z": "INT", "b": "TEXT"}},
                     {"urn": "u2"}],
        "assets": [{"urn": "x", "defining_query_id": "q1"}],
        "queries": [{"query_id": "q0", "sql": "SELECT b FROM a.t", "runs": "3"}]}))
    (d / "query_log.json").write_text(json.dumps(
        [{"query_id": "q1", "sql": "SELECT z FROM t"}, {"query_id": "q1", "sql": "SELECT 1"}]))
    cat = C.read_catalogs(spark, str(d / "catalog.json"), str(d / "query_log.json"))
    assert [r.column for r in cat.columns.orderBy("col_pos").collect()] == ["z", "b"]
    ds = by(cat.datasets, "urn")
    assert ds["u2"].sql_name == "u2" and ds["u1"].platform == "unknown"
    q = cat.queries.orderBy("q_pos").collect()
    assert [(r.query_id, r.runs) for r in q] == [("q0", 3), ("q1", 1), ("q1", 1)]
    assert q[0].catalog == "one" and cat.assets.first().type == "asset"
    assert cat.catalogs.first().sql_dialect == "snowflake"


def test_models_serving_baseline_and_sinks(spark, tmp_path):
    (tmp_path / "m" / "x").mkdir(parents=True)
    (tmp_path / "m" / "x" / "a.sql").write_text("SELECT\n 1\n")
    m = C.read_models(spark, str(tmp_path / "m"), "c").collect()
    assert [(r.path, r.sql) for r in m] == [("x/a.sql", "SELECT\n 1\n")]
    (tmp_path / "s.csv").write_text("a,b\n1,x\n,y\n3,z\n")
    s = C.read_serving(spark, str(tmp_path / "s.csv"))
    assert dict(s.dtypes) == {"a": "int", "b": "string"}
    assert sorted(r.v for r in C.feature_values(s, "a").collect()) == [1.0, 3.0]
    (tmp_path / "late.csv").write_text("a\n" + "1\n" * 1500 + "0.5\n" * 500)
    late = C.feature_values(C.read_serving(spark, str(tmp_path / "late.csv")), "a").collect()
    assert len(late) == 2000 and sum(r.v for r in late) == 1750.0
    (tmp_path / "b.json").write_text(json.dumps({
        "model_urn": "m", "schema": {"a": "int"},
        "features": {"a": {"count": 2, "mean": 1.5, "std": 0.5, "min": 1, "max": 2,
                           "sample": [1, 2]}}}))
    b = C.read_baseline(spark, str(tmp_path / "b.json"))
    assert b["sample"].count() == 2 and b["features"].first().n == 2
    sinks.write_table(s, str(tmp_path / "out"), "json", partition_by="b")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_types_hold_every_row(spark):
    cols = {"int": ["1", "-7", "+3", ""], "bigint": ["1", "3000000000", None], "double": ["1", ".5", "1e9", "99999999999999999999"],
            "timestamp_ntz": ["2024-02-29", "2024-01-01T10:00", "2024-01-01 10:00:00.123+02:00"],
            "string": ["1"] * 50 + ["x"], "void": ["", None, "  "]}
    more = {"a": ["2024-02-30"], "b": ["2024-01-01", "1"], "c": ["1.", "-", "e5"], "d": ["2024-01-01 25:00"]}
    rows = [(c, t) for c, ts in (cols | more).items() for t in ts]
    got = by(infer.column_types(spark.createDataFrame(rows, "column string, text string")), "column")
    assert {c: got[c].type for c in cols} == {c: c for c in cols}
    assert {c: got[c].type for c in more} == dict.fromkeys(more, "string")
    assert (got["string"].misfits, got["string"].n_int, got["b"].misfits, got["double"].misfits) == (1, 50, 1, 0)
    assert (got["void"].missing, got["void"].rows, got["int"].missing) == (3, 3, 1)
    parts = [infer.column_types(spark.createDataFrame(rows[i::3], "column string, text string")) for i in range(3)]
    added = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("column").agg(F.sum("n_text").alias("n"))
    assert {r["column"]: r.n for r in added.collect()} == {c: r.n_text for c, r in got.items()}
    assert infer.column_types(spark.createDataFrame([], "column string, text string")).isEmpty()


def test_serving_rows_keep_their_values(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a.b,when,n\n1,2024-01-02T03:04:05Z,7\n,,\n2.5, 2024-01-03 ,x\n")
    s = C.read_serving(spark, str(tmp_path / "s.csv"))
    assert dict(s.dtypes) == {"a.b": "double", "when": "timestamp_ntz", "n": "string"}
    assert [[str(v) for v in r] for r in s.collect()] == [
        ["1.0", "2024-01-02 03:04:05", "7"], ["None", "None", "None"], ["2.5", "2024-01-03 00:00:00", "x"]]


def test_evidence_and_change_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"urn": "u1", "name": "n", "query_count": 3}, {"urn": "u2", "schema_fields": ["a"]}]))
    e = by(C.read_evidence(spark, str(tmp_path / "e.json")), "urn")
    assert (e["u1"].query_count, e["u1"].downstream_count, e["u1"].schema_fields) == (3, 0, [])
    assert e["u2"].schema_fields == ["a"] and e["u1"].pos < e["u2"].pos
    run = {"name": "r", "catalog": "c", "change": "drop a.b", "require_review": True}
    (tmp_path / "list.json").write_text(json.dumps([run, {**run, "name": "s", "new_name": "x"}]))
    (tmp_path / "runs.json").write_text(json.dumps({"runs": [{**run, "name": "t"}]}))
    got = by(C.read_changes(spark, [str(tmp_path / f) for f in ("list.json", "runs.json")]), "name")
    assert set(got) == {"r", "s", "t"} and got["s"].new_name == "x" and got["t"].require_review
    kinds = spark.createDataFrame([("number(10,2)",), ("VARCHAR",), ("bigint",), ("Double",)], "t string")
    assert [r[0] for r in kinds.select(X.native_is_number("t")).collect()] == [True, False, False, True]


def test_models_below_a_folder_with_a_quote(spark, tmp_path):
    (tmp_path / "it's" / "x").mkdir(parents=True)
    (tmp_path / "it's" / "x" / "a.sql").write_text("SELECT 1")
    assert [r.path for r in C.read_models(spark, str(tmp_path / "it's"), "c").collect()] == ["x/a.sql"]


def test_parse_changes(spark):
    rows = ["drop a.b.c", "rename x.y new", "rename x.y", "add x.y", "drop nodot", ""]
    d = I.parse_changes(spark.createDataFrame([(r,) for r in rows], "change string"))
    got = {r.change: r for r in d.collect()}
    assert (got["drop a.b.c"].dataset, got["drop a.b.c"].column) == ("a.b", "c")
    assert got["rename x.y new"].error is None and got["rename x.y"].error
    assert all(got[t].error for t in ("add x.y", "drop nodot", ""))


QUICK = ("feature_profile", "freshness", "schema_drift", "asset_health", "impact_summary",
         "fragility", "model_fixes", "downstream_rank", "entity_flatten", "json_sql_search",
         "approval_decision", "aspect_merge", "verify_status", "change_loop")


def _norm(v):
    if hasattr(v, "as_tuple") or (isinstance(v, (int, float)) and not isinstance(v, bool)):
        return round(float(v), 6)
    return v


def _names():
    import __spark_entry__ as E
    return list(E.queries()) if os.environ.get("ALL_QUERIES") else list(QUICK)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as E
    if name not in E.oracle_sql():
        assert E.queries()[name](spark, SF).collect()
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.sql(E.oracle_sql()[name])
    at = [res.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert len(res.columns) == len(cols) and got == want


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_plan_holds_every_change_and_consumer(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as E
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    found = con.sql(f"SELECT change_id, query_id, asset_urn, verdict, confidence FROM "
                    f"({E.oracle_sql()['impact_verdicts']})").fetchall()
    want = {(c, a or q) for c, q, a, v, sure in found if v == "UNKNOWN" or sure != "low"}
    steps = E.queries()["plan_steps"](spark, SF).collect()
    assert len(steps) == len(want) and {(r.change_id, r.key) for r in steps} == want
    assert any(v == "UNKNOWN" and a is None for _, _, a, v, _ in found)
    for change in {c for c, _ in want}:
        mine = sorted(r.step for r in steps if r.change_id == change)
        assert mine == list(range(1, len(mine) + 1))
