"""The log is read for what the index needs; later steps look shapes up."""

import pytest

from faultline.operators import impact as I, qlog as Q, verify as V
from helpers import changes, make_catalog

LOG = [("k", "q1", "SELECT a FROM s.t WHERE b > 1", "x", 1), ("k", "q2", "SELECT a FROM s.t WHERE b > 22", "y", 2),
       ("k", "q3", "SELECT * FROM s.t", "x", 1), ("k", "q4", 'SELECT "a" FROM s.t -- 5', None, 3),
       ("k", "q5", "SELECT FROM (", "x", 1), ("k", "q6", "SELECT c FROM s.u", "x", 1)]
ASSETS = [("k", "u1", "one", "dbt_model", "q2", "m.sql"), ("k", "u2", "two", "dbt_model", "q5", None),
          ("k", "u3", "three", "looker_dashboard", "gone", None), ("k", "u4", "four", "dbt_model", None, None)]


def catalog(spark, log):
    return make_catalog(spark, {("k", "s.t"): {"a": "int", "b": "int"}, ("k", "s.u"): {"c": "int"}},
                        log, ASSETS, [("k", False)])


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark, LOG)


@pytest.fixture(scope="module")
def index(cat):
    return I.build_index(cat)


@pytest.fixture(scope="module")
def ch(spark):
    return changes(spark, [("c1", "k", "s.t", "a", "drop", None), ("c2", "k", "s.u", "c", "drop", None)])


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_consumers_with_an_asset_are_not_cut_into_tokens_again(cat, index, ch):
    assert "regexp_extract_all" not in plan(V.asset_queries(cat, index))
    some = I.impact_verdicts(ch, cat, index, assets_only=True)
    assert "regexp_extract_all" not in plan(some)
    every = I.impact_verdicts(ch, cat, index).where("asset_urn IS NOT NULL")
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))


def test_the_log_is_read_once_for_verdicts(cat, index, ch):
    assert plan(I.impact_verdicts(ch, cat, index)).count("regexp_extract_all") == 1


def test_known_shapes_are_those_of_the_tokens(spark, cat, index):
    more = spark.createDataFrame([(t,) for t in ("SELECT  a\nFROM s.t", None, "", "SELECT 'it''s' || 5x FROM s.t1")],
                                 "sql STRING").union(cat.queries.select("sql"))
    known = {(r.sql, r.shape_id) for r in Q.with_known_shape(more, index.texts).collect()}
    assert known == {(r.sql, r.shape_id) for r in Q.with_shape(more).collect()}


def test_a_statement_the_index_has_not_seen_is_unknown(spark, index, ch):
    later = catalog(spark, [*LOG, ("k", "q7", "SELECT a, b FROM s.t", "x", 1)])
    rows = {(r.change_id, r.query_id): r.verdict for r in I.impact_verdicts(ch, later, index).collect()}
    assert rows["c1", "q1"] == rows["c1", "q4"] == "BREAKS" and rows["c1", "q3"] == "DEGRADES"
    assert {c for c, q in rows if q == "q7"} == {c for c, q in rows if q == "q5"} == {"c1", "c2"}
    assert rows["c1", "q7"] == rows["c1", "q5"] == "UNKNOWN" and ("c2", "q1") not in rows
