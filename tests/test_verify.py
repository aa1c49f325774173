"""Each catalog below is one scenario; all are verified in a single job."""

import pytest

from faultline.operators import impact as I, verify as V
from helpers import by, changes, make_catalog

BASE = {"id": "NUMBER", "cust": "NUMBER", "zip": "VARCHAR", "amount": "FLOAT"}
A = "SELECT\n    id,\n    zip\nFROM w.orders\n"
A_OK = "SELECT\n    id\nFROM w.orders\n"
B = "SELECT\n    cust,\n    zip\nFROM w.orders\nWHERE amount > 1\n"
B_OK = "SELECT\n    cust\nFROM w.orders\nWHERE amount > 1\n"
# scenario: extra queries, patch {path: text}, expected status, a reason that must be present
CASES = {
    "all_fixed": ([], {"a.sql": A_OK, "b.sql": B_OK}, "PASS", "breaks_eliminated"),
    "empty": ([], {}, "FAIL", "no_patch_provided"),
    "unreadable": ([], {"a.sql": "SELECT FROM (", "b.sql": B_OK}, "FAIL",
                   "patched_sql_unparseable"),
    "partial": ([], {"a.sql": A_OK}, "REVIEW_REQUIRED", "breaks_remaining"),
    "no_progress": ([], {"a.sql": A + "-- note\n"}, "FAIL", "breaks_not_reduced"),
    "unknown": ([("j", "SELECT {{ x }} FROM w.orders")], {"a.sql": A_OK, "b.sql": B_OK},
                "REVIEW_REQUIRED", "unknown_consumers_present"),
    "manual": ([("adhoc", "SELECT zip FROM w.orders")], {"a.sql": A_OK, "b.sql": B_OK},
               "REVIEW_REQUIRED", "manual_work_remaining"),
    "regressed": ([], {"a.sql": A_OK, "b.sql": B_OK, "safe.sql": "SELECT zip FROM w.orders"},
                  "FAIL", "safe_consumer_regressed"),
    "ambiguous": ([("amb", "SELECT zip FROM w.orders o JOIN w.people p ON o.cust = p.cust")],
                  {"a.sql": A_OK, "b.sql": B_OK}, "REVIEW_REQUIRED",
                  "ambiguous_consumers_present"),
    "old_star": ([("st", "SELECT * FROM w.orders")], {"a.sql": A_OK, "b.sql": B_OK},
                 "REVIEW_REQUIRED", "degrades_remaining"),
    "new_star": ([], {"a.sql": A_OK, "b.sql": B_OK, "safe.sql": "SELECT * FROM w.orders"},
                 "FAIL", "new_degrades"),
    "unmapped": ([], {"a.sql": A_OK, "b.sql": B_OK, "orphan.sql": "SELECT 1"},
                 "REVIEW_REQUIRED", "patched_file_unmapped"),
    "scope": ([], {"a.sql": A_OK, "b.sql": B_OK, "outside.sql": "SELECT 1"}, "FAIL",
              "scope_violation"),
    "residual": ([], {"a.sql": A_OK + "-- zip was here\n", "b.sql": B_OK}, "REVIEW_REQUIRED",
                 "fix_incomplete_column_still_referenced"),
    "deleted": ([], {"a.sql": A_OK, "b.sql": B_OK}, "REVIEW_REQUIRED", "patched_file_deleted"),
    "renamed": ([], {"a.sql": A_OK, "b.sql": B_OK}, "REVIEW_REQUIRED", "patched_file_renamed"),
    "no_schema": ([], {"a.sql": A_OK, "b.sql": B_OK}, "REVIEW_REQUIRED", "schema_unknown"),
    "no_column": ([], {"a.sql": A_OK, "b.sql": B_OK}, "FAIL", "column_not_found"),
    "no_target": ([], {"a.sql": A_OK, "b.sql": B_OK}, "FAIL", "target_not_found"),
}


@pytest.fixture(scope="module")
def result(spark):
    tables, queries, assets, ch, written = {}, [], [], [], []
    for c, (extra, patch, _, _) in CASES.items():
        tables[c, "w.orders"] = {} if c == "no_schema" else BASE
        tables[c, "w.people"] = {"cust": "NUMBER", "zip": "VARCHAR"}
        queries += [(c, "qa", A, "t1", 3), (c, "qb", B, "t2", 4),
                    (c, "qs", "SELECT amount FROM w.orders", "t3", 5)]
        queries += [(c, n, s, "t4", 1) for n, s in extra]
        assets += [(c, "u:a", "A", "dbt_model", "qa", "a.sql"),
                   (c, "u:b", "B", "dbt_model", "qb", "b.sql"),
                   (c, "u:s", "S", "dbt_model", "qs", "safe.sql"),
                   (c, "u:o", "O", "dbt_model", None, "orphan.sql")][:4 if c == "unmapped" else 3]
        table = "w.ghost" if c == "no_target" else "w.orders"
        ch.append((c, c, table, "ghost" if c == "no_column" else "zip", "drop", None))
        written += [(c, p, t) for p, t in patch.items()]
    cat = make_catalog(spark, tables, queries, assets)
    patch = V.Patch(
        spark.createDataFrame(written, "change_id string, path string, new_sql string"),
        spark.createDataFrame([("deleted", "safe.sql")], "change_id string, path string"),
        spark.createDataFrame([("renamed", "safe.sql", "new/safe.sql", "SELECT amount FROM"
                                " w.orders")], "change_id string, old_path string,"
                              " new_path string, new_sql string"),
        spark.createDataFrame([("renamed", p) for p in ("a.sql", "b.sql", "safe.sql",
                                                        "new/safe.sql")],
                              "change_id string, path string"))
    target = I.resolve_changes(changes(spark, ch), cat)
    return by(V.verify(target, patch, cat, I.build_index(cat)), "change_id")


@pytest.mark.parametrize("case", CASES)
def test_status(result, case):
    r, (_, _, status, reason) = result[case], CASES[case]
    if case == "unmapped":  # an asset without a known query is itself unreadable
        assert "patched_file_unmapped" in r.reasons and r.status == "REVIEW_REQUIRED"
        return
    assert reason in r.reasons and r.status == status, (r.status, r.reasons)


def test_counts(result):
    r = result["all_fixed"]
    assert r.before["breaks"] == 2 and r.after["breaks"] == 0 and r.after["safe"] == 3
    assert r.coverage_after == "3 of 3 analysed" and r.improved == 2 and r.auto_applicable
    assert result["partial"].after["runs_impacted"] == 4
    assert result["partial"].after["teams"] == 1
    assert result["empty"].after == result["empty"].before
