"""Static verification of edited definitions, for many changes at once.

Only the consumers whose definition was edited are scanned again; every count
after the edit is the count before it plus the difference those consumers make.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X
from ..scale import cut_lineage, number_rows
from . import fixes as FX, impact as I, qlog


@dataclass(frozen=True)
class Patch:
    """What was edited, per change: written texts, deleted paths, moved paths."""

    written: DataFrame               # change_id, path, new_sql
    deleted: DataFrame | None = None  # change_id, path
    renamed: DataFrame | None = None  # change_id, old_path, new_path, new_sql
    allowed: DataFrame | None = None  # change_id, path; absent changes use the model paths


def diff_definitions(before: DataFrame, after: DataFrame) -> Patch:
    """Two snapshots `(change_id, path, sql)` to written / deleted / renamed paths.

    A path that vanished and one that appeared with the same text are one rename.
    Each path of the edit lands in exactly one outcome.
    """
    b = before.select("change_id", "path", F.sha2("sql", 256).alias("hb"))
    a = after.select("change_id", "path", F.sha2("sql", 256).alias("ha"), "sql")
    both = b.join(a, ["change_id", "path"], "full")
    gone = both.where(F.col("ha").isNull()).select("change_id", "path", F.col("hb").alias("h"))
    new = both.where(F.col("hb").isNull()).select("change_id", "path", F.col("ha").alias("h"),
                                                  "sql")
    # One partner each: equal texts are paired in path order.
    pairs = number_rows(gone, ["change_id", "h"], ["path"], "n").withColumnRenamed(
        "path", "old_path").join(
        number_rows(new, ["change_id", "h"], ["path"], "n").withColumnRenamed(
            "path", "new_path"),
        ["change_id", "h", "n"]).select("change_id", "old_path", "new_path",
                                        F.col("sql").alias("new_sql"))
    moved_old = pairs.select("change_id", F.col("old_path").alias("path"))
    moved_new = pairs.select("change_id", F.col("new_path").alias("path"))
    written = both.where(F.col("ha").isNotNull() & ~F.col("hb").eqNullSafe(F.col("ha"))).join(
        moved_new, ["change_id", "path"], "left_anti")
    return Patch(written.select("change_id", "path", F.col("sql").alias("new_sql")),
                 gone.join(moved_old, ["change_id", "path"], "left_anti").select(
                     "change_id", "path"), pairs)


def _slash(c: str):
    return F.replace(F.col(c), F.lit("\\"), F.lit("/"))


def path_queries(catalog: I.Catalog, index: I.Index) -> DataFrame:
    """Model path to the query of the log it defines; the last asset of a path wins."""
    known = index.defined.select("catalog", "query_id").distinct()
    by_path = (catalog.assets.where(F.col("model_path").isNotNull()
                                    & F.col("defining_query_id").isNotNull())
               .groupBy("catalog", _slash("model_path").alias("key"))
               .agg(F.max_by("defining_query_id", "a_pos").alias("query_id")))
    return by_path.join(known, ["catalog", "query_id"])


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Verdict moves between two verdict tables; a consumer on one side only is ABSENT.

    `order.transitions` puts regressions first.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("change_id", "query_id", F.col("verdict").alias(p),
                         F.col("asset_name").alias(f"{p}_name"),
                         F.col("asset_type").alias(f"{p}_type"))

    j = side(before, "b").join(side(after, "a"), ["change_id", "query_id"], "full")
    rb, ra = X.verdict_rank("b"), X.verdict_rank("a")
    out = j.where(~F.col("b").eqNullSafe(F.col("a")))
    return out.select(
        "change_id", "query_id",
        F.coalesce("a_name", "b_name", "query_id").alias("consumer"),
        F.coalesce("b", F.lit("ABSENT")).alias("before"),
        F.coalesce("a", F.lit("ABSENT")).alias("after"),
        F.coalesce(ra < rb, F.lit(False)).alias("regressed"),
        F.coalesce(ra > rb, F.lit(False)).alias("improved"),
        F.coalesce("a_type", "b_type").alias("asset_type"))


def manual_consumers(impacted: DataFrame, catalog: I.Catalog) -> DataFrame:
    """(change_id, asset_name): impacted consumers whose asset no file defines, so no fix reaches."""
    reach = catalog.assets.where(F.col("model_path").isNotNull()).select(
        "catalog", F.col("urn").alias("asset_urn")).distinct()
    return impacted.join(reach, ["catalog", "asset_urn"], "left_anti").select(
        "change_id", "asset_name").distinct()


def count_deltas(before: DataFrame, after: DataFrame, key: str = "change_id") -> DataFrame:
    """after - before per (key, name) of two long count tables, names of both sides kept."""
    j = before.withColumnRenamed("value", "b").join(
        after.withColumnRenamed("value", "a"), [key, "name"], "full").na.fill(0, ["a", "b"])
    return j.select(key, "name", (F.col("a") - F.col("b")).alias("delta"))


def asset_queries(catalog: I.Catalog, index: I.Index) -> DataFrame:
    """Log rows that some asset names, with their shape and first asset."""
    log = index.defined.join(I.first_assets(catalog.assets), ["catalog", "query_id"])
    return log.join(
        index.shapes, ["catalog", "shape_id"], "left").na.fill(False, ["assessable"])


def _classified(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows with (change_id, catalog, shape_id, assessable) to usage, confidence, verdict."""
    j = rows.join(hits.select("change_id", "catalog", "shape_id", "usage", "confidence"),
                  ["change_id", "catalog", "shape_id"], "left")
    usage = (F.when(~F.col("assessable"), "parse_error")
             .otherwise(F.coalesce("usage", F.lit("none"))))
    conf = (F.when(~F.col("assessable"), "low")
            .otherwise(F.coalesce("confidence", F.lit("high"))))
    return j.withColumn("usage", usage).withColumn("confidence", conf).withColumn(
        "verdict", X.verdict_of("usage"))


def edited_consumers(target: DataFrame, patch: Patch, catalog: I.Catalog,
                     index: I.Index) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths with their query, verdicts before, verdicts after) of the edited consumers."""
    ids = target.select("change_id", "catalog")
    paths = patch.written.select("change_id", "path", "new_sql", F.lit(True).alias("written"))
    if patch.renamed is not None:
        moved = patch.renamed.select("change_id", F.col("new_path").alias("path"), "new_sql",
                                     F.lit(False).alias("written"))
        paths = paths.unionByName(moved.join(paths, ["change_id", "path"], "left_anti"))
    paths = paths.where(F.lower("path").endswith(".sql")).join(ids, "change_id")
    paths = paths.withColumn("key", _slash("path")).join(
        path_queries(catalog, index), ["catalog", "key"], "left").drop("key")
    texts = paths.where(F.col("query_id").isNotNull()).groupBy(
        "change_id", "catalog", "query_id").agg(F.max_by("new_sql", "path").alias("new_sql"))
    log = index.defined.select("catalog", "query_id", F.col("shape_id").alias("old_shape"), "team",
                               "runs", "q_pos").join(
        I.first_assets(catalog.assets), ["catalog", "query_id"], "left")
    rows = texts.join(log, ["catalog", "query_id"])
    rows = cut_lineage(qlog.with_shape(rows, "new_sql").drop("new_sql"))
    old = rows.drop("tokens", "shape_id").withColumnRenamed("old_shape", "shape_id").join(
        index.shapes, ["catalog", "shape_id"], "left").na.fill(False, ["assessable"])
    new = rows.drop("old_shape")
    scanned = cut_lineage(qlog.scan(qlog.distinct_shapes(new)).drop(
        "tokens", "projections", "outputs"))
    usage, stars = I.usage_rows(I.attribute(scanned, catalog))
    new = new.drop("tokens").join(scanned.select("catalog", "shape_id", "assessable"),
                                  ["catalog", "shape_id"])
    return (paths, _classified(old, I.shape_verdicts(target, index.usage, index.stars)),
            _classified(new, I.shape_verdicts(target, usage, stars)))


def _signed_cells(rows: DataFrame, sign: int) -> DataFrame:
    amb = X.is_ambiguous()
    one = F.lit(sign).cast("bigint")

    def n(verdict: str, what) -> Column:
        return F.sum(F.when((F.col("verdict") == verdict) & ~amb, what).otherwise(0))

    return rows.groupBy(F.col("change_id").alias("id"), "team").agg(
        n("BREAKS", one).alias("breaks"), n("BREAKS", F.col("runs") * sign).alias("break_runs"),
        F.sum(F.when(amb, one).otherwise(0)).alias("ambiguous"),
        n("DEGRADES", one).alias("degrades"),
        n("DEGRADES", F.col("runs") * sign).alias("degrade_runs"),
        F.sum(F.when(F.col("verdict") == "UNKNOWN", one).otherwise(0)).alias("unknown"),
        F.sum(F.when(F.col("verdict").isin("BREAKS", "DEGRADES") & ~amb
                     & F.col("fixable"), one).otherwise(0)).alias("fixable"))


def verify(target: DataFrame, patch: Patch, catalog: I.Catalog, index: I.Index) -> DataFrame:
    """One row per resolved change: status, reasons, counts before and after.

    `target` comes from `impact.resolve_changes`.
    """
    paths, old, new = edited_consumers(target, patch, catalog, index)
    # consumers a mechanical fix can reach: their first asset has a model path somewhere
    reach = catalog.assets.where(F.col("model_path").isNotNull()).select(
        "catalog", F.col("urn").alias("asset_urn")).distinct().withColumn("fixable", F.lit(True))

    def flag(rows: DataFrame) -> DataFrame:
        return rows.join(reach, ["catalog", "asset_urn"], "left").na.fill(False, ["fixable"])

    old, new = cut_lineage(flag(old)), cut_lineage(flag(new))
    resolved = target.where(F.col("target_urn").isNotNull())
    wanted = resolved.select(F.col("change_id").alias("id"), "catalog",
                             F.col("target_urn").alias("ds_urn"), "column",
                             (F.col("has_column") | ~F.col("schema_known")).alias("carries"))
    names = ["breaks", "break_runs", "ambiguous", "degrades", "degrade_runs"]
    zero = F.lit(0).cast("bigint")
    base = I.team_cells(wanted, index).withColumn("unknown", zero).withColumn("fixable", zero)
    asset_hit = flag_hits(flag(asset_queries(catalog, index)),
                          I.shape_verdicts(target, index.usage, index.stars))
    fix_before = asset_hit.groupBy("change_id").agg(F.count_if("fixable").alias("fixable_b"))
    delta = _signed_cells(old, -1).unionByName(_signed_cells(new, 1))
    after = base.unionByName(delta).groupBy("id", "team").agg(
        *[F.sum(c).alias(c) for c in (*names, "unknown", "fixable")])
    more = after.groupBy("id").agg(F.sum("unknown").alias("unknown_d"),
                                   F.sum("fixable").alias("fixable_d"))

    def prefixed(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("id").alias("change_id"), *[
            F.col(c).alias(f"{c}{p}") for c in ("breaks", "degrades", "ambiguous",
                                                "runs_impacted", "teams")])

    moves = transitions(old, new).groupBy("change_id").agg(
        F.count_if("regressed").alias("regressed"), F.count_if("improved").alias("improved"),
        F.count_if(F.col("regressed") & (F.col("before") == "SAFE")).alias("safe_regressed"),
        F.count_if((F.col("after") == "DEGRADES")
                   & ~F.col("before").isin("DEGRADES", "BREAKS")).alias("new_degrades"))
    parsed = qlog.readable(patch.written.where(F.lower("path").endswith(".sql")),
                           qlog.shape_tokens(F.coalesce("new_sql", F.lit(""))), "assessable")
    parsed = parsed.groupBy("change_id").agg(
        F.count_if(~F.col("assessable")).alias("unreadable"))
    unmapped = paths.where(F.col("written")).groupBy("change_id").agg(
        F.count_if(F.col("query_id").isNull()).alias("unmapped"))
    residual = FX.residual_lines(patch.written.join(
        target.select("change_id", "column", "op"), "change_id")).groupBy("change_id").agg(
        F.count("*").alias("residual"))
    touched = patch.written.select("change_id", "path")
    patched = touched
    gone = moved = None
    if patch.deleted is not None:
        touched = touched.unionByName(patch.deleted.select("change_id", "path"))
        gone = patch.deleted.where(F.lower("path").endswith(".sql")).groupBy("change_id").agg(
            F.count("*").alias("deleted"))
    if patch.renamed is not None:
        touched = touched.unionByName(patch.renamed.select(
            "change_id", F.explode(F.array("old_path", "new_path")).alias("path")))
        moved = unresolved_renames(patch, paths, target, catalog).groupBy("change_id").agg(
            F.count("*").alias("lost_renames"))
    scope = scope_violations(touched, patch.allowed, target, catalog).groupBy("change_id").agg(
        F.count("*").alias("out_of_scope"))
    edits = touched.groupBy("change_id").agg(F.count("*").alias("edits"))
    totals = I.catalog_totals(catalog, index)
    rows = target.join(totals, "catalog", "left").withColumn(
        "queries_total", F.when(F.col("target_urn").isNull(), 0).otherwise(
            F.coalesce("queries_total", F.lit(0)))).withColumn(
        "unknown_b", F.when(F.col("target_urn").isNull(), 0).otherwise(
            F.coalesce("unknown", F.lit(0)))).drop("unknown")
    parts = [prefixed(I.fold_cells(base), "_b"), prefixed(I.fold_cells(after), "_a"),
             more.withColumnRenamed("id", "change_id"), fix_before, moves, parsed, unmapped,
             residual, scope, edits] + [p for p in (gone, moved) if p is not None]
    got = gather(parts)
    rows = rows.join(got, "change_id", "left")
    for c in ("deleted", "lost_renames"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0).cast("bigint"))
    rows = rows.na.fill(0, got.columns[1:] + ["deleted", "lost_renames"])
    rows = rows.withColumn("unknown_a", F.col("unknown_b") + F.when(
        F.col("target_urn").isNotNull(), F.col("unknown_d")).otherwise(0))
    rows = rows.withColumn(
        "manual_work", F.col("breaks_a") + F.col("degrades_a") - F.col("fixable_b")
        - F.col("fixable_d"))
    return decide(rows)


def gather(parts: list[DataFrame], key: str = "change_id") -> DataFrame:
    """Partial rows per key to one row per key in one shuffle; counts add up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    types = dict(out.dtypes)
    return out.groupBy(key).agg(*[
        (F.max(c) if types[c] in ("string", "array<string>") else F.sum(c)).alias(c)
        for c in out.columns if c != key])


def flag_hits(asset_rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Asset-defined consumers a change breaks or degrades with confidence: a statement meets the
    changes that touch its shape, not all changes of its catalog."""
    return asset_rows.where("assessable").join(
        hits.select("change_id", "catalog", "shape_id", "usage", "confidence"),
        ["catalog", "shape_id"]).withColumn(
        "verdict", X.verdict_of("usage")).where(F.col("confidence") != "low")


def scope_violations(touched: DataFrame, allowed: DataFrame | None, target: DataFrame,
                     catalog: I.Catalog) -> DataFrame:
    """Touched paths outside the allowed ones; without a declared scope the catalog's model
    paths are the scope, and a catalog without any is not checked."""
    t = touched.join(target.select("change_id", "catalog"), "change_id").withColumn(
        "key", _slash("path"))
    model = catalog.assets.where(F.col("model_path").isNotNull()).select(
        "catalog", _slash("model_path").alias("key")).distinct()
    if allowed is None:
        declared, free = None, t
    else:
        named = allowed.select("change_id").distinct()
        declared, free = t.join(named, "change_id", "left_semi"), t.join(named, "change_id",
                                                                         "left_anti")
    out = free.join(model.select("catalog").distinct(), "catalog", "left_semi").join(
        model, ["catalog", "key"], "left_anti").select("change_id", "path")
    if declared is not None:
        ok = allowed.select("change_id", _slash("path").alias("key"))
        out = out.unionByName(declared.join(ok, ["change_id", "key"], "left_anti").select(
            "change_id", "path"))
    return out


def unresolved_renames(patch: Patch, paths: DataFrame, target: DataFrame,
                       catalog: I.Catalog) -> DataFrame:
    """Renames whose new path was not analysed or whose old path the catalog still names."""
    r = patch.renamed.where(F.lower("old_path").endswith(".sql")
                            | F.lower("new_path").endswith(".sql")).join(
        target.select("change_id", "catalog"), "change_id").withColumn("key", _slash("old_path"))
    mapped = paths.where(F.col("query_id").isNotNull()).select(
        "change_id", F.col("path").alias("new_path"), F.lit(True).alias("is_mapped"))
    held = catalog.assets.where(F.col("model_path").isNotNull()).select(
        "catalog", _slash("model_path").alias("key"), F.lit(True).alias("held")).distinct()
    return (r.join(mapped, ["change_id", "new_path"], "left").join(held, ["catalog", "key"],
                                                                   "left")
            .where(F.col("is_mapped").isNull() | F.col("held").isNotNull())
            .select("change_id", "old_path", "new_path"))


def decide(rows: DataFrame) -> DataFrame:
    """Counts to a status and its reasons; the only place a status is made."""
    c = F.col
    found = c("target_urn").isNotNull()
    code = (F.when(~found, "target_not_found").when(~c("schema_known"), "schema_unknown")
            .when(~c("has_column"), "column_not_found"))
    resolved = found & (~c("schema_known") | c("has_column"))
    no_patch = c("edits") == 0
    more = c("breaks_a") > c("breaks_b")
    same = (c("breaks_a") == c("breaks_b")) & (c("breaks_b") > 0)
    degr, newd = c("degrades_a") > 0, c("new_degrades") > 0
    unknown, amb = c("unknown_a") > 0, c("ambiguous_a") > 0
    observed = F.array(
        code,
        F.when(c("unreadable") > 0, "patched_sql_unparseable"),
        F.when(c("out_of_scope") > 0, "scope_violation"),
        F.when(c("safe_regressed") > 0, "safe_consumer_regressed"),
        F.when(((c("regressed") > 0) & (c("safe_regressed") == 0)) | more, "breaks_increased"),
        F.when(same, "breaks_not_reduced"),
        F.when(newd, "new_degrades"),
        F.when(c("breaks_a") == 0, "breaks_eliminated").otherwise("breaks_remaining"),
        F.when(degr & ~newd, "degrades_remaining"),
        F.when(unknown, "unknown_consumers_present"),
        F.when(amb, "ambiguous_consumers_present"),
        F.when(unknown, "coverage_incomplete"),
        F.when(c("unmapped") > 0, "patched_file_unmapped"),
        F.when(c("deleted") > 0, "patched_file_deleted"),
        F.when(c("lost_renames") > 0, "patched_file_renamed"),
        F.when(c("manual_work") > 0, "manual_work_remaining"),
        F.when(c("residual") > 0, "fix_incomplete_column_still_referenced"))
    fail = (no_patch | ~resolved | (c("unreadable") > 0) | (c("out_of_scope") > 0)
            | (c("regressed") > 0) | newd | more | same)
    clean = F.forall(F.array(*[c(n) == 0 for n in (
        "unmapped", "deleted", "lost_renames", "breaks_a", "degrades_a", "unknown_a",
        "ambiguous_a", "regressed", "manual_work", "residual")]), lambda ok: ok)
    status = (F.when(fail, "FAIL").when(c("schema_known") & clean, "PASS")
              .otherwise("REVIEW_REQUIRED"))
    reasons = F.when(no_patch, F.array_compact(F.array(F.lit("no_patch_provided"), code))
                     ).otherwise(F.array_compact(observed))

    def tally(s: str):
        safe = (c("queries_total") - c(f"unknown{s}") - c(f"breaks{s}") - c(f"degrades{s}")
                - c(f"ambiguous{s}"))
        pairs = {"breaks": c(f"breaks{s}"), "degrades": c(f"degrades{s}"), "safe": safe,
                 "unknown": c(f"unknown{s}"), "ambiguous": c(f"ambiguous{s}"),
                 "runs_impacted": c(f"runs_impacted{s}"), "teams": c(f"teams{s}"),
                 "queries_total": c("queries_total"),
                 "analysed": c("queries_total") - c(f"unknown{s}")}
        out = []
        for k, v in pairs.items():
            out += [F.lit(k), v.cast("bigint")]
        return F.create_map(*out)

    after_line = X.coverage_line(c("queries_total") - c("unknown_a"), c("queries_total"))
    return rows.select(
        "change_id", "catalog", X.describe_change().alias("change"), "target_urn",
        status.alias("status"), reasons.alias("reasons"), (status == "PASS").alias(
            "auto_applicable"), tally("_b").alias("before"), tally("_a").alias("after"),
        after_line.alias("coverage_after"), "regressed", "improved", "new_degrades", "unmapped",
        "deleted", "lost_renames", "manual_work", "residual", "out_of_scope", "unreadable",
        resolved.alias("target_resolved"), "schema_known")
