"""The approve path: what a human approved is applied once, exactly, and put on record.

Manifests bind an approval to a change, its verdict and the whole payloads of its queue.  A batch
of requests is decided in one pass; of several valid requests for a manifest the first by time
wins.  The ledger is a table that rows are only added to, a manifest at most once, so a rerun of a
batch finds its own rows and adds nothing.  It is written after the outcomes, so an approval is not
spent by a run that broke off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import writeback as WB
from ..scale import cut_lineage

LEDGER = "manifest_id STRING, approver STRING, consumed_at STRING"


class Ledger:
    """Consumed manifests, kept as Parquet at `path`; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:  # nothing consumed yet
            return self.spark.createDataFrame([], LEDGER)

    def add(self, consumed: DataFrame) -> DataFrame:
        """Adds the manifests that are not in the ledger yet, and returns those rows."""
        once = consumed.groupBy("manifest_id").agg(F.min(F.struct("consumed_at", "approver")).alias("x"))
        new = cut_lineage(once.select("manifest_id", "x.approver", "x.consumed_at").join(
            self.rows(), "manifest_id", "left_anti"))
        if not new.isEmpty():
            new.write.mode("append").parquet(self.path)
        return new


def manifest_queue(manifests: DataFrame, queue: DataFrame) -> DataFrame:
    """The writes listed in each manifest."""
    return manifests.select("manifest_id", "change_id").join(queue, "change_id")


@dataclass
class Approved:
    decisions: DataFrame  # requests with refusal_code; null for the one request that counts
    outcomes: DataFrame   # every write of an approved manifest and what became of it
    counts: DataFrame     # outcomes per manifest
    audit: DataFrame      # (change_id, target_urn, props)
    consumed: DataFrame   # ledger rows to add; none on a dry run


def approve(requests: DataFrame, listed: DataFrame, summary: DataFrame, verification: DataFrame,
            mutations: DataFrame, ledger: DataFrame, at: str, failed: DataFrame | None = None,
            dry_run: bool = False, prefix: str = "impact_") -> Approved:
    """Decides a batch of requests and applies what was approved.

    requests  manifest columns, approver, requested_at
    listed    (manifest_id, mutation_id, payload_digest): the writes a manifest names
    ledger    manifests consumed before; `at` is the moment of this run
    failed    (change_id, mutation_id) of writes that raised when attempted
    """
    queue = WB.approval_queue(mutations, prefix)
    current = cut_lineage(WB.fingerprints(summary, verification, queue))
    # what each manifest's own list amounts to against this run
    ids = requests.select("manifest_id", "change_id").distinct()

    def by_manifest(df: DataFrame) -> DataFrame:
        return ids.join(df, "change_id").drop("change_id").withColumnRenamed("manifest_id", "change_id")

    body = WB.fingerprints(by_manifest(summary), by_manifest(verification),
                           listed.select(F.col("manifest_id").alias("change_id"), "mutation_id", "payload_digest"))
    decided = cut_lineage(WB.approval_decisions(requests, current, ledger, body.select(
        F.col("change_id").alias("manifest_id"), "fingerprint")))
    consumed = cut_lineage(WB.consume(decided, ledger, F.lit(at)))
    first = decided.where("refusal_code IS NULL").groupBy("manifest_id").agg(
        F.min(F.struct("requested_at", "approver")).alias("first"))
    later = F.col("refusal_code").isNull() & (F.struct("requested_at", "approver") != F.col("first"))
    decisions = decided.join(first, "manifest_id", "left").withColumn(
        "refusal_code", F.when(later, "already_consumed").otherwise(F.col("refusal_code"))).drop("first")
    won = consumed.join(requests.select("manifest_id", "change_id", "verification_status").distinct(),
                        "manifest_id")
    writes = listed.select("manifest_id", "mutation_id").join(won, "manifest_id").join(
        mutations.select("change_id", "mutation_id", "tool", "queue_reason", F.lit(True).alias("there")),
        ["change_id", "mutation_id"], "left")
    done = WB.approved_outcomes(writes, dry_run, failed)
    done = cut_lineage(done.withColumn("outcome", F.when(F.col("there"), F.col("outcome")).otherwise("skipped"))
                       .select("manifest_id", "change_id", "mutation_id", "tool", "queue_reason", "outcome"))
    counts = WB.outcome_counts(done, "manifest_id")
    signed = won.join(summary.select("change_id", "target_urn"), "change_id").select(
        "change_id", "target_urn", "manifest_id", "approver", F.col("consumed_at").alias("approved_at"),
        F.col("verification_status").alias("status"))
    audit = WB.approval_audit(counts, signed, prefix)
    return Approved(decisions, done, counts, audit, consumed.limit(0) if dry_run else consumed)
