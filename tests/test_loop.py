"""Many change requests in one job."""

from faultline.operators import impact as I
from faultline.plans import loop as L
from helpers import by, make_catalog

RUNS = "name STRING, catalog STRING, change STRING, require_review BOOLEAN, new_name STRING"


def test_fixes_are_counted_without_repeating_the_scan(spark):
    sql = "SELECT\n    a,\n    b\nFROM s.t\n"
    cat = make_catalog(spark, {("k", "s.t"): {"a": "int", "b": "int"}},
                       [("k", "q1", sql, "x", 1), ("k", "q2", "SELECT b FROM s.t", "x", 1)],
                       [("k", "u1", "one", "dbt_model", "q1", "m1.sql"),
                        ("k", "u2", "two", "dbt_model", "q2", "m2.sql")], [("k", False)])
    models = spark.createDataFrame([("k", "m1.sql", sql), ("k", "m2.sql", "SELECT b FROM s.t")],
                                   "catalog STRING, path STRING, sql STRING")
    runs = spark.createDataFrame([("r1", "k", "drop s.t.a", None, None),
                                  ("r2", "k", "rename s.t.b c", True, None),
                                  ("r3", "k", "add s.t.b", None, None)], RUNS)
    out = L.run_loop(runs, cat, I.build_index(cat), models)
    # a filter over the edits would put the scan of the edited text into itself, several times over
    assert "regexp_extract_all" not in out._jdf.queryExecution().analyzed().toString()
    got = by(out, "change_id")
    assert {n: got[n].fixes for n in got} == {"r1": 1, "r2": 2, "r3": 0}
    assert got["r3"].error and not got["r1"].error
