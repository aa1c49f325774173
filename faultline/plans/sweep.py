"""Every column of every catalog as a candidate change, sorted into five buckets.

One pass over the log serves the ranking, the fixes and the verification of all
candidates; its cost does not grow with the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import model as M
from ..functions import expr as X
from ..operators import fixes as FX, impact as I, verify as V
from ..scale import cut_lineage


def candidates(catalog: I.Catalog, index: I.Index, ops: Sequence[str] = ("drop",),
               limit: int | None = None) -> DataFrame:
    """Fragility rows x operations in ranking order; `limit` keeps the first per catalog."""
    ranked = I.fragility(catalog, index)
    ops_col = F.posexplode(F.array(*[F.lit(o) for o in ops])).alias("op_pos", "op")
    out = ranked.select("*", ops_col).withColumn(
        "place", (F.col("position") - 1) * len(ops) + F.col("op_pos") + 1)
    if limit is not None:
        out = out.where(F.col("place") <= limit)
    return out.withColumn("change_id", F.concat_ws("|", "id", "op")).withColumn(
        "new_name", F.when(F.col("op") == "rename",
                           F.concat(F.col("column"), F.lit("_renamed"))))


def impacted_assets(target: DataFrame, catalog: I.Catalog, index: I.Index) -> DataFrame:
    """Asset-defined consumers each change breaks or degrades."""
    rows = V.asset_queries(catalog, index)
    hits = I.shape_verdicts(target, index.usage, index.stars)
    return (rows.where("assessable")
            .join(hits.select("change_id", "catalog", "shape_id", "usage", "confidence"),
                  ["catalog", "shape_id"])
            .where(F.col("confidence") != "low")
            .withColumn("verdict", X.verdict_of("usage"))
            .select("change_id", "catalog", "query_id", "team", "runs", "verdict", "asset_urn",
                    "asset_name", "asset_type", "model_path"))


def fixes_for(target: DataFrame, hit: DataFrame, models: DataFrame,
              catalog: I.Catalog) -> DataFrame:
    """A fix for every asset with a model path that some change impacts."""
    paths = (catalog.assets.where(F.col("model_path").isNotNull())
             .select("catalog", F.col("urn").alias("asset_urn"), F.col("name").alias("asset_name"),
                     F.col("model_path").alias("path")))
    work = (hit.select("change_id", "catalog", "asset_urn").distinct()
            .join(paths, ["catalog", "asset_urn"])
            .join(target.select("change_id", F.col("target_urn").alias("ds_urn"), "column", "op",
                                "new_name"), "change_id"))
    return FX.model_fixes(work, models, catalog)


def sweep(catalog: I.Catalog, index: I.Index, models: DataFrame | None = None,
          ops: Sequence[str] = ("drop",), limit: int | None = None) -> DataFrame:
    """The ledger: one row per candidate with bucket, basis and reasons.

    Without `models` no patch exists and buckets follow from the impact alone.
    """
    cand = cut_lineage(candidates(catalog, index, ops, limit))
    target = I.resolve_changes(cand.select("change_id", "catalog", "dataset", "column", "op",
                                           "new_name"), catalog)
    target = cut_lineage(target)
    hit = cut_lineage(impacted_assets(target, catalog, index))
    asset_breaks = hit.groupBy("change_id").agg(
        F.count_if(F.col("verdict") == "BREAKS").alias("asset_breaks"))
    if models is None:
        unfixed = hit
        verdicts = patched = None
    else:
        fix = cut_lineage(fixes_for(target, hit, models, catalog))
        good = fix.where("changed")
        unfixed = hit.join(good.select("change_id", "asset_urn"), ["change_id", "asset_urn"],
                           "left_anti")
        written = good.groupBy("change_id", "path").agg(F.first("new_sql").alias("new_sql"))
        patch = V.Patch(written, allowed=written.select("change_id", "path"))
        patched = good.groupBy("change_id").agg(
            F.count("*").alias("fixes"), F.min("method").alias("fix_method"))
        errors = fix.where(F.col("error").isNotNull()).groupBy("change_id").agg(
            F.min("error").alias("error"))
        checked = target.join(patched.select("change_id"), "change_id", "left_semi")
        verdicts = V.verify(checked, patch, catalog, index).select(
            "change_id", F.col("status").alias("verdict"), "reasons",
            F.col("before")["breaks"].alias("breaks_before"),
            F.col("after")["breaks"].alias("breaks_after"))
    blocked = unfixed.groupBy("change_id").agg(F.count("*").alias("blocked_assets"))
    parts = [asset_breaks, blocked]
    if models is not None:
        parts += [patched, errors, verdicts]
    rows = cand.join(V.gather(parts), "change_id", "left")
    if models is None:
        rows = rows.withColumns({
            "fixes": F.lit(0), "fix_method": F.lit(None).cast("string"),
            "error": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"),
            "reasons": F.array().cast("array<string>"),
            "breaks_before": F.lit(None).cast("bigint"),
            "breaks_after": F.lit(None).cast("bigint")})
    rows = rows.na.fill(0, ["asset_breaks", "blocked_assets", "fixes"])
    rows = rows.withColumn("blocking", F.col("blocked_assets") + F.col("breaks")
                           - F.col("asset_breaks"))
    return classify(rows)


def classify(rows: DataFrame) -> DataFrame:
    """Bucket precedence, most serious lack of knowledge first."""
    c = F.col
    patch = c("fixes") > 0
    passed = F.coalesce(c("verdict") == "PASS", F.lit(False))
    failed = F.coalesce(c("verdict") == "FAIL", F.lit(False))
    hit = (c("breaks") > 0) | (c("degrades") > 0)
    error = c("error").isNotNull()
    status = F.coalesce(c("verdict"), F.lit("not run"))
    bucket = (F.when(error, "error").when(c("unknown") > 0, "unassessed")
              .when(failed, "landmine")
              .when(hit & (c("blocking") > 0), "landmine")
              .when(hit & passed, "verified_safe").when(hit, "needs_review")
              .when(c("ambiguous") > 0, "needs_review")
              .when(patch & passed, "verified_safe").when(patch, "needs_review")
              .otherwise("verified_safe"))
    note = (F.when(error, F.lit(None).cast("string"))
            .when(c("unknown") > 0, F.concat(c("unknown").cast("string"),
                                             F.lit(" consumer(s) could not be assessed")))
            .when(failed, "static verification returned FAIL")
            .when(hit & (c("blocking") > 0),
                  F.concat(c("blocking").cast("string"),
                           F.lit(" breaking consumer(s) no mechanical fix reaches")))
            .when(hit & ~passed, F.concat(F.lit("verification "), status,
                                          F.lit("; a human must confirm")))
            .when(~hit & (c("ambiguous") > 0), "an unattributable column reference remains")
            .when(~hit & ~patch, "no consumer that parses references this column"))
    rows = rows.withColumn("bucket", bucket)
    basis = F.when(c("bucket") != "verified_safe", "").when(patch, "verified_patch").otherwise(
        "no_references")
    return rows.select(
        "change_id", "catalog", "place", "dataset_name", "dataset_urn", "column", "op",
        X.describe_change().alias("change"), "breaks", "degrades", "safe", "unknown", "ambiguous",
        "coverage", (c("unknown") == 0).alias("coverage_complete"),
        F.col("level").alias("risk_level"), F.col("score").alias("risk_score"), "runs_impacted",
        "teams", patch.alias("patch_generated"), "fixes", "fix_method", "blocking",
        F.when(error, None).otherwise(c("verdict")).alias("verdict"),
        F.concat(F.coalesce("reasons", F.array().cast("array<string>")),
                 F.array_compact(F.array(note))).alias("reasons"),
        "breaks_before", "breaks_after", "bucket", basis.alias("basis"), "error")


def bucket_totals(ledger: DataFrame) -> DataFrame:
    """Every bucket of every catalog, zero when empty."""
    grid = ledger.select("catalog").distinct().select(
        "catalog", F.explode(F.array(*[F.lit(b) for b in M.BUCKETS])).alias("bucket"))
    n = ledger.groupBy("catalog", "bucket").agg(F.count("*").alias("n"))
    return grid.join(n, ["catalog", "bucket"], "left").na.fill(0, ["n"])


def sweep_totals(ledger: DataFrame) -> DataFrame:
    """Header numbers per catalog with a total row (null catalog)."""
    aggs = [F.count("*").alias("columns_assessed"),
            F.count_distinct("dataset_urn").alias("datasets_scanned"),
            F.count_if(F.col("coverage_complete") & (F.col("bucket") != "error"))
            .alias("fully_assessed")]
    aggs += [F.count_if(F.col("bucket") == b).alias(b) for b in M.BUCKETS]
    aggs += [F.count_if(F.col("basis") == b).alias(b) for b in ("verified_patch",
                                                               "no_references")]
    out = ledger.rollup("catalog").agg(*aggs)
    parts = F.col(M.BUCKETS[0])
    for b in M.BUCKETS[1:]:
        parts = parts + F.col(b)
    return out.withColumn("reconciles", parts == F.col("columns_assessed")).withColumn(
        "coverage_line", F.concat(F.col("fully_assessed").cast("string"), F.lit(" of "),
                                  F.col("columns_assessed").cast("string"),
                                  F.lit(" candidate(s) fully assessed")))
