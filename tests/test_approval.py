"""The approve path on small tables: binding, first by time, single use, reruns, records."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import writeback as WB
from faultline.plans import approval as AP
from helpers import by

SUMMARY = "change_id string, catalog string, change string, target_urn string"
CHECK = "change_id string, status string, reasons array<string>"
WRITES = ("change_id string, mutation_id string, tool string, target_urn string, queue_reason string, "
          "auto boolean, payload map<string,string>")
CHANGES = [("c1", "cat", "drop a.b", "urn:a"), ("c2", "cat", "drop a.c", "urn:a"), ("c3", "cat", "drop z.z", None)]
REASON = "verification_review_required"


def writes(footer="x" * 200, seventh="7", clock="1"):
    props = {f"impact_k{i}": str(i) for i in range(1, 7)} | {"impact_k7": seventh, "impact_assessed_at": clock}
    rows = [("add_structured_properties", "urn:a", props), ("add_tags", "urn:a", {"tags": "pending"}),
            ("update_description", "urn:a", {"footer": footer})]
    return [(c, f"{t}:{u}", t, u, REASON, False, p) for c in ("c1", "c2") for t, u, p in rows]


class Run:
    def __init__(self, spark, status="REVIEW_REQUIRED", **payload):
        self.spark = spark
        self.summary = spark.createDataFrame(CHANGES, SUMMARY)
        self.check = spark.createDataFrame([(c[0], status, ["a", "b"]) for c in CHANGES], CHECK)
        self.muts = spark.createDataFrame(writes(**payload), WRITES)
        self.queue = WB.approval_queue(self.muts)

    def manifests(self, at="2024-01-01T00:00:00Z"):
        return WB.manifests(WB.fingerprints(self.summary, self.check, self.queue), self.queue, at).cache()

    def approve(self, mans, asked, listed=None, ledger=None, **more):
        """asked [(change_id, approver, requested_at)]"""
        who = self.spark.createDataFrame(asked, "change_id string, approver string, requested_at string")
        none = self.spark.createDataFrame([], "manifest_id string")
        return AP.approve(mans.join(who, "change_id"), AP.manifest_queue(mans, self.queue) if listed is None else listed,
                          self.summary, self.check, self.muts, none if ledger is None else ledger,
                          "2024-01-02T00:00:00Z", **more)


def codes(done):
    return {(r.change_id, r.approver): r.refusal_code for r in done.decisions.collect()}


def test_first_by_time_applies_all_and_is_recorded(spark):
    run = Run(spark)
    mans = run.manifests()
    assert {r.change_id for r in mans.collect()} == {"c1", "c2"}
    bad = spark.createDataFrame([("c1", "add_tags:urn:a")], "change_id string, mutation_id string")
    done = run.approve(mans, [("c1", "zoe", "09:00"), ("c1", "ann", "10:00"), ("c1", "bob", "09:00"),
                              ("c2", "  ", "01:00")], failed=bad)
    assert codes(done) == {("c1", "zoe"): "already_consumed", ("c1", "ann"): "already_consumed",
                           ("c1", "bob"): None, ("c2", "  "): "no_approver"}
    assert {(r.mutation_id.split(":")[0], r.outcome) for r in done.outcomes.collect()} == {
        ("add_structured_properties", "written_human_approved"), ("add_tags", "failed"),
        ("update_description", "written_human_approved")}
    count = done.counts.first()
    assert (count.total, count.written, count.failed, count.reconciles, count.applied_by) == (3, 2, 1, True, "human-approved")
    props = done.audit.first().props
    ident = mans.where("change_id = 'c1'").first().manifest_id
    assert props == {"impact_approved_by": "bob", "impact_approved_at": "2024-01-02T00:00:00Z",
                     "impact_manifest_id": ident, "impact_verification_status_at_approval": "REVIEW_REQUIRED",
                     "impact_approved_writes": "2", "impact_approved_failures": "1"}
    assert [tuple(r) for r in done.consumed.collect()] == [(ident, "bob", "2024-01-02T00:00:00Z")]


@pytest.mark.parametrize("payload", [{"footer": "x" * 160 + "y"}, {"seventh": "changed"}])
def test_a_change_past_what_the_summary_shows_is_stale(spark, payload):
    before, now = Run(spark), Run(spark, **payload)
    shown = [sorted(r.payload_summary for r in x.queue.collect()) for x in (before, now)]
    assert shown[0] == shown[1]
    assert set(codes(now.approve(before.manifests(), [("c1", "ann", "1")])).values()) == {"stale"}


def test_clock_values_do_not_bind(spark):
    before, now = Run(spark), Run(spark, clock="2")
    assert set(codes(now.approve(before.manifests(), [("c1", "ann", "1")])).values()) == {None}


def test_edited_manifest_and_other_verdicts(spark):
    run = Run(spark)
    mans = run.manifests()
    listed = AP.manifest_queue(mans, run.queue).where("tool <> 'add_tags'")
    assert set(codes(run.approve(mans, [("c1", "ann", "1")], listed)).values()) == {"stale"}
    for status, code in (("FAIL", "fail_not_approvable"), ("PASS", "stale")):
        later = Run(spark, status)
        assert later.manifests().isEmpty()
        done = later.approve(mans, [("c1", "ann", "1"), ("c2", "", "1")])
        assert codes(done)["c1", "ann"] == code
        assert done.outcomes.isEmpty() and done.audit.isEmpty() and done.consumed.isEmpty()


def test_ledger_holds_a_manifest_once_over_reruns(spark, tmp_path):
    ledger = AP.Ledger(spark, str(tmp_path / "ledger"))
    run = Run(spark)
    mans = run.manifests()
    assert ledger.rows().isEmpty()
    dry = run.approve(mans, [("c1", "ann", "2")], ledger=ledger.rows(), dry_run=True)
    assert {r.outcome for r in dry.outcomes.collect()} == {"planned"}
    assert ledger.add(dry.consumed).isEmpty() and ledger.rows().isEmpty()
    first = run.approve(mans, [("c1", "ann", "2"), ("c1", "bob", "3")], ledger=ledger.rows())
    # the same outcome presented twice, as after a run that broke off, adds one row
    assert ledger.add(first.consumed.unionByName(first.consumed)).count() == 1
    assert ledger.add(first.consumed).isEmpty()
    again = run.approve(mans, [("c1", "bob", "3"), ("c2", "cy", "4")], ledger=ledger.rows())
    assert codes(again) == {("c1", "bob"): "already_consumed", ("c2", "cy"): None}
    ledger.add(again.consumed)
    rows = by(ledger.rows(), "manifest_id")
    assert sorted(r.approver for r in rows.values()) == ["ann", "cy"] and len(rows) == 2
    # the same queue at another moment is another approval
    other = run.manifests("2024-01-05T00:00:00Z")
    assert codes(run.approve(other, [("c1", "dee", "1")], ledger=ledger.rows())) == {("c1", "dee"): None}


def test_no_requests(spark):
    run = Run(spark)
    done = run.approve(run.manifests(), [("c9", "ann", "1")])
    assert all(df.isEmpty() for df in (done.decisions, done.outcomes, done.counts, done.audit, done.consumed))
    assert WB.property_rows(done.audit).columns == ["urn", "key", "value"]
