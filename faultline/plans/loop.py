"""Many change requests over many catalogs in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import impact as I, writeback as WB
from ..scale import cut_lineage
from . import sweep as S


def parse_runs(runs: DataFrame) -> DataFrame:
    """(name, catalog, change, require_review, new_name) to change columns or an error."""
    given = runs.withColumnRenamed("new_name", "given_name")
    out = I.parse_changes(given.withColumn("change_id", F.col("name")))
    new = F.coalesce("new_name", "given_name")
    fixed = (F.col("error") == "rename requires a new name") & new.isNotNull()
    return out.withColumn("new_name", new).withColumn(
        "error", F.when(~F.coalesce(fixed, F.lit(False)), F.col("error"))).drop("given_name")


def run_loop(runs: DataFrame, catalog: I.Catalog, index: I.Index,
             models: DataFrame | None = None, dry_run: bool = True) -> DataFrame:
    """One row per run: counts, risk, fixes and write buckets.

    Nothing is verified here, so every planned write is queued.
    """
    parsed = parse_runs(runs)
    changes = parsed.where(F.col("error").isNull()).select(
        "change_id", "catalog", "dataset", "column", "op", "new_name", "require_review")
    summary = cut_lineage(I.impact_summary(changes.drop("require_review"), catalog, index))
    verdicts = I.impact_verdicts(changes.drop("require_review"), catalog, index, assets_only=True)
    review = changes.select("change_id", "catalog", "require_review")
    if catalog.catalogs is not None:
        own = catalog.catalogs.select("catalog", F.col("require_review").alias("default"))
        review = review.join(own, "catalog", "left").withColumn(
            "require_review", F.coalesce("require_review", "default", F.lit(False)))
    review = review.select("change_id", F.coalesce("require_review", F.lit(False)).alias(
        "require_review"))
    muts = WB.plan_mutations(summary, verdicts, None, review)
    counts = WB.outcome_counts(cut_lineage(WB.outcomes(muts, dry_run)))
    out = (parsed.select("change_id", "error").join(
        summary.drop("note"), "change_id", "left").join(review, "change_id", "left")
        .join(counts, "change_id", "left"))
    if models is None:
        out = out.withColumn("fixes", F.lit(0).cast("bigint"))
    else:
        target = cut_lineage(I.resolve_changes(changes.drop("require_review"), catalog))
        hit = cut_lineage(S.impacted_assets(target, catalog, index))
        # cut before filtering: a pushed-down filter would repeat the edit and its scan inside itself
        fix = cut_lineage(S.fixes_for(target, hit, models, catalog).select("change_id", "changed"))
        n = fix.where("changed").groupBy("change_id").agg(F.count("*").alias("fixes"))
        out = out.join(n, "change_id", "left")
    zero = ["fixes", "total", "written", *WB.OUTCOMES]
    return out.na.fill(0, zero)
