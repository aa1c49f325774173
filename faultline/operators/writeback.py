"""Planned catalog writes, their approval, and the merge into catalog aspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import model as M
from ..functions import expr as X


def assessment_properties(summary: DataFrame, verification: DataFrame | None = None,
                          prefix: str = "impact_", assessed_at: Column | None = None) -> DataFrame:
    """(change_id, target_urn, props MAP) describing an assessment."""
    pairs = {
        "status": F.lit("pending-change"), "risk": F.col("level"), "score": F.col("score"),
        "breaks": F.col("breaks"), "degrades": F.col("degrades"), "teams": F.col("teams"),
        "unassessed": F.col("unknown"), "ambiguous": F.col("ambiguous"),
        "coverage": F.col("coverage"), "review_required": F.col("review_required"),
    }
    d = summary
    if assessed_at is not None:
        pairs["assessed_at"] = assessed_at
    flat = [x for k, v in pairs.items() for x in (F.lit(prefix + k), v.cast("string"))]
    props = F.create_map(*flat)
    if verification is not None:
        v = verification.select(
            "change_id", F.col("status").alias("v_status"), "before", "after",
            F.col("unmapped").alias("v_unmapped"), F.col("coverage_after").alias("v_cov"))
        d = d.join(v, "change_id", "left")
        vp = {
            "verification_status": F.col("v_status"),
            "verification_breaks_before": F.col("before")["breaks"],
            "verification_breaks_after": F.col("after")["breaks"],
            "verification_degrades_after": F.col("after")["degrades"],
            "verification_ambiguous_after": F.col("after")["ambiguous"],
            "verification_unmapped_files": F.col("v_unmapped"),
            "verification_coverage": F.col("v_cov"),
            "verification_method": F.lit("static"),
        }
        flat = [x for k, c in vp.items() for x in (F.lit(prefix + k), c.cast("string"))]
        empty = F.create_map().cast("map<string,string>")
        props = F.map_concat(props, F.when(F.col("v_status").isNotNull(),
                                           F.create_map(*flat)).otherwise(empty))
    return d.select("change_id", "target_urn", props.alias("props"))


def property_rows(props: DataFrame) -> DataFrame:
    return props.select(F.col("target_urn").alias("urn"), F.explode("props").alias("key",
                                                                                  "value"))


def summary_sentence() -> Column:
    caveat = F.when(F.col("review_required"), F.lit(" Review required.")).otherwise("")
    risk = F.concat(F.col("level_qualifier"), F.lit(" ("), F.col("score").cast("string"),
                    F.lit("/100)."))
    return F.concat(
        F.col("change"), F.lit(" breaks "), F.col("breaks").cast("string"),
        F.lit(" and degrades "), F.col("degrades").cast("string"),
        F.lit(" downstream consumer(s), spanning "), F.col("runs_impacted").cast("string"),
        F.lit(" query runs in history. Change risk: "),
        F.when(F.col("analysed") == 0, "unable to assess.").otherwise(risk), caveat)


def plan_mutations(summary: DataFrame, verdicts: DataFrame, verification: DataFrame | None,
                   review: DataFrame, prefix: str = "impact_",
                   document_root: str = "assessments") -> DataFrame:
    """The writes a change would make: four on its dataset, one tag per impacted asset.

    `review(change_id, require_review)`.  A change whose dataset is unknown plans
    nothing.  A write applies itself only behind a PASS with nothing unresolved.
    """
    d = summary.where(F.col("target_urn").isNotNull()).join(review, "change_id", "left")
    if verification is None:
        d = d.withColumn("v_status", F.lit(None).cast("string"))
    else:
        d = d.join(verification.select("change_id", F.col("status").alias("v_status")),
                   "change_id", "left")
    d = d.join(assessment_properties(summary, verification, prefix).select("change_id", "props"),
               "change_id")
    reason = X.queue_reason("v_status", F.coalesce("require_review", F.lit(False)),
                            F.col("review_required"))
    d = d.withColumn("queue_reason", reason)
    url = F.concat(F.lit(document_root + "/"), X.slug("change", "assessment"), F.lit(".md"))
    title = F.concat(F.lit("Change assessment: "), F.col("change"))

    def write(tool: str, urn: Column, payload: Column, n: int) -> Column:
        return F.struct(F.lit(n).alias("pos"), F.lit(tool).alias("tool"),
                        urn.alias("target_urn"), payload.alias("payload"))

    urn = F.col("target_urn")
    own = d.select("change_id", "queue_reason", F.inline(F.array(
        write("add_structured_properties", urn, F.col("props"), 0),
        write("add_tags", urn, F.create_map(F.lit("tags"), F.lit("pending-schema-change")), 1),
        write("save_document", urn, F.create_map(
            F.lit("url"), url, F.lit("description"), title), 2),
        write("update_description", urn, F.create_map(
            F.lit("footer"), F.concat(F.lit(M.FOOTER_MARK + " "), summary_sentence())), 3))))
    hit = verdicts.where(F.col("verdict").isin("BREAKS", "DEGRADES") & ~X.is_ambiguous()
                         & F.col("asset_urn").isNotNull())
    tags = hit.join(d.select("change_id", "queue_reason"), "change_id").select(
        "change_id", "queue_reason", F.lit(4).alias("pos"), F.lit("add_tags").alias("tool"),
        F.col("asset_urn").alias("target_urn"),
        F.create_map(F.lit("tags"), F.concat(F.lit("impacted-by-upstream-change, impact-"),
                                             F.lower("verdict"))).alias("payload"))
    return own.unionByName(tags).withColumn("auto", F.col("queue_reason") == "").withColumn(
        "mutation_id", F.concat_ws(":", "tool", "target_urn"))


def outcomes(mutations: DataFrame, dry_run: bool, failed: DataFrame | None = None) -> DataFrame:
    """What became of each write; `failed(change_id, mutation_id)` lists attempts that raised."""
    d = mutations
    if failed is None:
        d = d.withColumn("bad", F.lit(False))
    else:
        d = d.join(failed.select("change_id", "mutation_id").distinct().withColumn(
            "bad", F.lit(True)), ["change_id", "mutation_id"], "left").na.fill(False, ["bad"])
    out = (F.when(~F.col("auto"), "queued_for_review").when(F.lit(dry_run), "planned")
           .when(F.col("bad"), "failed").otherwise("written_auto"))
    return d.withColumn("outcome", out).drop("bad")


def approved_outcomes(queue: DataFrame, dry_run: bool,
                      failed: DataFrame | None = None) -> DataFrame:
    """Outcomes of a queue a human approved."""
    d = outcomes(queue.withColumn("auto", F.lit(True)), dry_run, failed)
    return d.withColumn("outcome", F.when(F.col("outcome") == "written_auto",
                                          "written_human_approved").otherwise(F.col("outcome")))


OUTCOMES = ("written_auto", "written_human_approved", "queued_for_review", "failed", "planned",
            "skipped")


def outcome_counts(rows: DataFrame, key: str = "change_id") -> DataFrame:
    got = rows.groupBy(key).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        F.array_sort(F.collect_set(F.nullif("queue_reason", F.lit("")))).alias("queue_reasons"))
    parts = F.col(OUTCOMES[0])
    for o in OUTCOMES[1:]:
        parts = parts + F.col(o)
    auto, human = F.col("written_auto") > 0, F.col("written_human_approved") > 0
    return got.withColumns({
        "written": F.col("written_auto") + F.col("written_human_approved"),
        "reconciles": parts == F.col("total"),
        "applied_by": F.when(auto & human, "mixed").when(human, "human-approved")
        .when(auto, "auto").otherwise("none")})


# ---------------------------------------------------------------- approval
def approval_queue(mutations: DataFrame, prefix: str = "impact_") -> DataFrame:
    """Writes a human is asked for: a line to read, and a digest of the whole payload to bind to."""
    return mutations.where(~F.col("auto")).select(
        "change_id", "mutation_id", "tool", "target_urn",
        X.payload_summary(prefix=prefix).alias("payload_summary"),
        X.payload_digest(prefix=prefix).alias("payload_digest"))


def queue_digest(queue: DataFrame) -> DataFrame:
    """(change_id, entries): a digest of the `id::payload digest` texts of a queue.

    Order does not matter, content does.  At every size the texts are hashed in
    4,096 buckets of equal hash prefix and the bucket digests are joined, so no
    task holds a whole large queue.
    """
    text = F.concat_ws("::", "mutation_id", "payload_digest")
    e = queue.select("change_id", text.alias("t"))
    part = e.groupBy("change_id", F.substring(F.sha2("t", 256), 1, 3).alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("t")), "|"), 256).alias("t"))
    return part.groupBy("change_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("b", "t"))), lambda x: x["t"]), "|")
        .alias("entries"))


def fingerprints(summary: DataFrame, verification: DataFrame, queue: DataFrame) -> DataFrame:
    """sha256 over the change, catalog, target, verdict, reasons and queue, each ended by NUL."""
    d = (summary.select("change_id", "catalog", "change", "target_urn")
         .join(verification.select("change_id", "status", "reasons"), "change_id", "left")
         .join(queue_digest(queue), "change_id", "left"))
    parts = [F.col("change"), F.col("catalog"), F.coalesce("target_urn", F.lit("None")),
             F.coalesce("status", F.lit("NONE")),
             F.coalesce(F.array_join(F.array_sort("reasons"), "|"), F.lit("")),
             F.coalesce("entries", F.lit(""))]
    end = F.char(F.lit(0))
    text = F.concat(*[x for p in parts for x in (p, end)])
    return d.select("change_id", "catalog", "change", "status", "reasons",
                    F.sha2(text, 256).alias("fingerprint"))


def manifests(prints: DataFrame, queue: DataFrame, created_at: str) -> DataFrame:
    """An approval manifest for every REVIEW_REQUIRED change with a queue.

    `created_at` is the moment in ISO form; equal queues of two moments are two manifests.
    """
    some = queue.select("change_id").distinct()
    return prints.where(F.col("status") == "REVIEW_REQUIRED").join(
        some, "change_id", "left_semi").select(
        F.substring(F.sha2(F.concat("fingerprint", F.lit(created_at)), 256), 1, 16).alias("manifest_id"),
        F.lit(created_at).alias("created_at"), "change_id", "change", "catalog",
        F.col("status").alias("verification_status"),
        F.col("reasons").alias("verification_reasons"), "fingerprint")


def approval_decisions(requests: DataFrame, current: DataFrame, ledger: DataFrame,
                       body: DataFrame) -> DataFrame:
    """Adds `refusal_code` (null = may apply) to approval requests; first refusal wins.

    requests  manifest columns plus approver
    current   `fingerprints` of this run
    ledger    manifest_id, approver, consumed_at
    body      manifest_id, fingerprint recomputed from the manifest's own queue
    """
    used = ledger.select("manifest_id", F.lit(True).alias("used")).distinct()
    now = current.select("change_id", F.col("change").alias("now_change"),
                         F.col("status").alias("now_status"),
                         F.col("fingerprint").alias("now_print"))
    own = body.select("manifest_id", F.col("fingerprint").alias("own_print"))
    d = (requests.join(now, "change_id", "left").join(used, "manifest_id", "left")
         .join(own, "manifest_id", "left"))
    blank = F.length(F.trim(F.coalesce("approver", F.lit("")))) == 0
    code = (
        F.when(F.col("now_status") == "FAIL", "fail_not_approvable")
        .when(blank, "no_approver")
        .when(F.col("used"), "already_consumed")
        .when(~F.col("change").eqNullSafe(F.col("now_change"))
              | ~F.col("verification_status").eqNullSafe(F.col("now_status")), "stale")
        .when(F.col("now_status") != "REVIEW_REQUIRED", "not_review_required")
        .when(~F.col("fingerprint").eqNullSafe(F.col("now_print")), "stale")
        .when(~F.col("fingerprint").eqNullSafe(F.col("own_print")), "stale"))
    return d.select(*requests.columns, code.alias("refusal_code"))


def consume(decisions: DataFrame, ledger: DataFrame, at: Column) -> DataFrame:
    """New ledger rows: every accepted manifest once, for whoever presented it first.

    Where decisions carry `requested_at` the earliest wins, equal moments by name.
    """
    moment = F.col("requested_at") if "requested_at" in decisions.columns else F.lit(None).cast("string")
    first = F.min(F.struct(moment.alias("requested_at"), "approver"))
    ok = decisions.where(F.col("refusal_code").isNull()).groupBy("manifest_id").agg(
        first["approver"].alias("approver")).withColumn("consumed_at", at)
    return ok.join(ledger.select("manifest_id"), "manifest_id", "left_anti")


def approval_audit(counts: DataFrame, approvals: DataFrame, prefix: str = "impact_") -> DataFrame:
    """Who approved what and how it went, as properties; nothing without an approver.

    counts      outcomes per manifest_id
    approvals   change_id, target_urn, manifest_id, approver, approved_at STRING, status
    """
    d = approvals.where(F.length(F.trim(F.coalesce("approver", F.lit("")))) > 0).join(
        counts.select("manifest_id", "written_human_approved", "failed"), "manifest_id", "left")
    pairs = {"approved_by": F.col("approver"), "approved_at": F.col("approved_at"),
             "manifest_id": F.col("manifest_id"),
             "verification_status_at_approval": F.col("status"),
             "approved_writes": F.coalesce("written_human_approved", F.lit(0)),
             "approved_failures": F.coalesce("failed", F.lit(0))}
    flat = [x for k, v in pairs.items() for x in (F.lit(prefix + k), v.cast("string"))]
    return d.select("change_id", "target_urn", F.create_map(*flat).alias("props"))


# ---------------------------------------------------------------- aspects
def merge_tags(current: DataFrame, updates: DataFrame) -> DataFrame:
    """(urn, tags ARRAY) full-joined with (urn, tag): existing order kept, new tags appended."""
    new = updates.groupBy("urn").agg(F.array_sort(F.collect_set("tag")).alias("new"))
    none = F.array().cast("array<string>")
    return current.join(new, "urn", "full").select("urn", F.array_union(
        F.coalesce("tags", none), F.coalesce("new", none)).alias("tags"))


def merge_descriptions(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace an earlier footer by the new one; the latest update of an asset wins.

    updates(urn, footer, at)
    """
    last = updates.groupBy("urn").agg(F.max_by("footer", "at").alias("footer"))
    base = F.substring_index(F.coalesce("description", F.lit("")), "\n\n" + M.FOOTER_MARK, 1)
    return current.join(last, "urn", "full").select("urn", F.when(
        F.col("footer").isNotNull(), F.concat(base, F.lit("\n\n"), F.col("footer"))).otherwise(
        F.col("description")).alias("description"))


def merge_links(current: DataFrame, updates: DataFrame) -> DataFrame:
    """(urn, url, title, at): an update replaces the link with the same url."""
    both = current.select("urn", "url", "title", "at", F.lit(0).alias("new")).unionByName(
        updates.select("urn", "url", "title", "at", F.lit(1).alias("new")))
    return both.groupBy("urn", "url").agg(
        F.max_by(F.struct("title", "at"), F.struct("new", "at")).alias("x")).select(
        "urn", "url", "x.title", "x.at")


def replace_properties(current: DataFrame, updates: DataFrame) -> DataFrame:
    """(urn, props MAP): an update replaces the whole set."""
    return current.join(updates.select("urn", F.col("props").alias("new")), "urn", "full").select(
        "urn", F.coalesce("new", "props").alias("props"))


def merge_properties(current: DataFrame, updates: DataFrame) -> DataFrame:
    """(urn, props MAP): an update replaces the keys it names."""
    j = current.join(updates.select("urn", F.col("props").alias("new")), "urn", "full")
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce("new", empty)
    kept = F.map_filter(F.coalesce("props", empty),
                        lambda k, v: ~F.map_contains_key(new, k))
    return j.select("urn", F.map_concat(kept, new).alias("props"))


def flag_at_risk(diagnosis: DataFrame, checked_at: Column, prefix: str = "skew_") -> DataFrame:
    """Two tags and four properties for every model with drift, as rows."""
    d = diagnosis.where("has_drift")
    tags = d.select("entity", F.lit("tag").alias("aspect"), F.explode(F.array(
        F.lit("at-risk"), F.lit("skew-detected"))).alias("key"), F.lit("").alias("value"))
    pairs = F.array(*[F.struct(F.lit(prefix + k).alias("key"), v.alias("value")) for k, v in (
        ("status", F.lit("at-risk")),
        ("drift_score", F.format_string("%.3f", F.col("drift_score"))),
        ("offending_upstream", F.col("offending_upstream")),
        ("checked_at", checked_at.cast("string")))])
    return tags.unionByName(d.select("entity", F.lit("property").alias("aspect"),
                                     F.inline(pairs)))
