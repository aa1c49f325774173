import pytest
from pyspark.sql import functions as F

from faultline.operators import impact as I
from faultline.plans import sweep as S
from helpers import by, changes, make_catalog

TABLES = {
    ("shop", "mart.sales"): {"sale_id": "NUMBER", "buyer_id": "NUMBER", "sold_on": "DATE",
                             "total": "FLOAT", "postcode": "VARCHAR", "state": "VARCHAR",
                             "phase": "VARCHAR"},
    ("shop", "mart.buyers"): {"buyer_id": "NUMBER", "full_name": "VARCHAR", "mail": "VARCHAR",
                              "postcode": "VARCHAR", "tier": "VARCHAR", "joined": "DATE"},
}
QUERIES = [
    ("shop", "by_code", "SELECT postcode, SUM(total) AS t FROM mart.sales GROUP BY postcode",
     "growth", 12),
    ("shop", "model", "SELECT s.sale_id, s.postcode, s.total FROM mart.sales s"
     " WHERE s.phase = 'done'", "core", 6),
    ("shop", "map", "SELECT postcode, COUNT(*) AS n FROM mart.sales GROUP BY postcode",
     "media", 5),
    ("shop", "export", "SELECT buyer_id, postcode, total FROM mart.sales"
     " WHERE sold_on >= '2020-01-01'", "growth", 4),
    ("shop", "by_state", "SELECT state, SUM(total) AS t FROM mart.sales"
     " WHERE postcode IS NOT NULL GROUP BY state", "media", 9),
    ("shop", "on_code", "SELECT b.tier, SUM(s.total) AS t FROM mart.sales s JOIN mart.buyers b"
     " ON s.postcode = b.postcode GROUP BY b.tier", "core", 5),
    ("shop", "daily", "SELECT sold_on, SUM(total) AS t FROM mart.sales GROUP BY sold_on",
     "board", 15),
    ("shop", "phases", "SELECT phase, COUNT(*) AS n FROM mart.sales GROUP BY phase", "board", 7),
    ("shop", "value", "SELECT buyer_id, SUM(total) AS v FROM mart.sales GROUP BY buyer_id",
     "growth", 8),
    ("shop", "vague", "SELECT postcode FROM mart.sales s JOIN mart.buyers b"
     " ON s.buyer_id = b.buyer_id", "growth", 2),
    ("blind", "ok", "SELECT a FROM m.t", "x", 1),
    ("blind", "jinja", "SELECT a FROM {{ ref('t') }}", "x", 9),
]
TABLES[("blind", "m.t")] = {"a": "NUMBER", "b": "NUMBER"}
TABLES[("blind", "other.t")] = {"c": "NUMBER"}
ASSETS = [
    ("shop", "urn:d1", "Codes", "looker_dashboard", "by_code", None),
    ("shop", "urn:m1", "rpt", "dbt_model", "model", "models/rpt.sql"),
    ("shop", "urn:m2", "rpt again", "dbt_model", "model", "models/rpt2.sql"),
    ("blind", "urn:z", "Measure", "powerbi_report", None, None),
    ("blind", "urn:y", "Gone", "tableau_workbook", "nowhere", None),
]


@pytest.fixture(scope="module")
def cat(spark):
    return make_catalog(spark, TABLES, QUERIES, ASSETS, [("shop", False), ("blind", True)])


@pytest.fixture(scope="module")
def index(cat):
    return I.build_index(cat)


@pytest.fixture(scope="module")
def ch(spark):
    return changes(spark, [
        ("drop", "shop", "mart.sales", "postcode", "drop", None),
        ("ren", "shop", "SALES", "PostCode", "rename", "zip"),
        ("none", "shop", "mart.nothing", "x", "drop", None),
        ("nocol", "shop", "mart.sales", "ghost", "drop", None),
        ("blind", "blind", "m.t", "a", "drop", None)])


def test_summary(ch, cat, index):
    s = by(I.impact_summary(ch, cat, index), "change_id")
    d = s["drop"]
    assert (d.breaks, d.degrades, d.safe, d.ambiguous, d.unknown) == (6, 0, 3, 1, 0)
    assert d.runs_impacted == 41 and d.teams_impacted == ["core", "growth", "media"]
    assert d.level == "CRITICAL" and d.score == 100
    assert d.level_qualifier == "CRITICAL with 1 unresolved reference(s)"
    assert d.coverage == "10 of 10 analysed" and d.review_required
    assert s["ren"].breaks == 6 and s["ren"].target_urn == d.target_urn
    assert s["none"].target_urn is None and s["none"].queries_total == 0
    assert "not found" in s["none"].note
    assert s["nocol"].breaks == 0 and "not in the current schema" in s["nocol"].note
    b = s["blind"]
    assert (b.breaks, b.unknown, b.safe, b.queries_total) == (1, 3, 0, 4)
    assert b.level_qualifier.endswith("among assessed")


def test_verdict_rows(ch, cat, index):
    v = I.impact_verdicts(ch, cat, index, include_safe=True)
    rows = v.where("change_id = 'drop'").collect()
    assert len(rows) == 10 and sum(r.verdict == "SAFE" for r in rows) == 3
    model = [r for r in rows if r.query_id == "model"][0]
    assert model.asset_urn == "urn:m1"  # the first asset that names the query
    ren = [r for r in v.where("change_id = 'ren'").collect() if r.query_id == "model"][0]
    assert "must be rewritten to `zip`" in ren.reason
    blind = {r.query_id: r for r in v.where("change_id = 'blind'").collect()}
    assert blind["no_definition:urn:z"].verdict == "UNKNOWN"
    assert blind["nowhere"].runs == 0 and blind["jinja"].usage == "parse_error"
    order = I.impacted(v.where("change_id = 'drop'")).orderBy(*I.impacted_order())
    assert [r.runs for r in order.collect()] == [12, 9, 6, 5, 5, 4]


def test_summary_counts_equal_verdict_rows(ch, cat, index):
    s = by(I.impact_summary(ch, cat, index), "change_id")
    v = I.impact_verdicts(ch, cat, index, include_safe=True).groupBy("change_id").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("verdict") == "BREAKS") & (F.col("confidence") != "low")).alias("b"),
        F.count_if(F.col("verdict") == "SAFE").alias("safe"),
        F.count_if(F.col("verdict") == "UNKNOWN").alias("u"))
    for r in v.collect():
        x = s[r.change_id]
        assert (r.n, r.b, r.safe, r.u) == (x.queries_total, x.breaks, x.safe, x.unknown)


def test_fragility(cat, index):
    rows = I.fragility(cat, index).where("catalog = 'shop'").orderBy("position").collect()
    assert len(rows) == 13 and rows[0].column == "total" and rows[0].breaks == 7
    assert rows[-1].score == 0 and [r.position for r in rows] == list(range(1, 14))


def test_sweep_buckets(spark, cat, index):
    models = spark.createDataFrame(
        [("shop", "models/rpt.sql", "SELECT\n    s.sale_id,\n    s.postcode,\n    s.total\n"
          "FROM mart.sales s\nWHERE s.phase = 'done'\n")],
        "catalog string, path string, sql string")
    ledger = S.sweep(cat, index, models).collect()
    b = {(r.catalog, r.dataset_name, r.column): r for r in ledger}
    assert b["shop", "sales", "sale_id"].bucket == "verified_safe"
    assert b["shop", "sales", "sale_id"].basis == "verified_patch"
    assert b["shop", "buyers", "mail"].basis == "no_references"
    assert b["shop", "sales", "postcode"].bucket == "landmine"
    assert {r.bucket for r in ledger if r.catalog == "blind"} == {"unassessed"}
    assert len(ledger) == 16
    top = S.sweep(cat, index, None, ops=("drop", "rename"), limit=4).collect()
    assert len(top) == 8 and all(not r.patch_generated for r in top)
