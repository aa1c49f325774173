"""The registered queries: name -> f(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import workload as WL
from .functions import expr as X
from .operators import (drift as D, evidence as E, fixes as FX, graph as G, impact as I,
                        infer as IN, order as O, profile as P, qlog as Q, verify as V, writeback as WB)
from .plans import approval as AP, loop as L, migration as MG, sweep as S
from .scale import cut_lineage, shared_path
from .sources import catalog as C, entities as EN, sinks as SK

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _text(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


# ---------------------------------------------------------------- drift
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _before(ts: str, day: str) -> Column:
    return F.when(F.col(ts) < F.lit(day).cast("timestamp_ntz"), "baseline").otherwise("current")


def _line_values(spark: SparkSession, sf: str) -> DataFrame:
    return D.long_features(WL.table(spark, sf, "lineitem"), LINE_FEATURES,
                           _before("l_shipdate", "1998-01-01"))


def _segment_values(spark: SparkSession, sf: str) -> DataFrame:
    o = D.long_features(
        WL.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "segment"),
        ["o_totalprice"], _before("o_orderdate", "1998-01-01"), ["segment"])
    e = D.long_features(
        WL.table(spark, sf, "events").withColumnRenamed("event_type", "segment"),
        ["value"], _before("ts", "2024-01-15"), ["segment"])
    return o.unionByName(e)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"psi": F.round("psi", 6), "ks": F.round("ks", 6)}).drop("error")


@query
def drift_psi_ks(spark, sf):
    return _rounded(D.distribution_drift(_line_values(spark, sf)))


@query
def drift_by_segment(spark, sf):
    return _rounded(D.distribution_drift(_segment_values(spark, sf), ["segment", "feature"]))


@query
def drift_by_psi(spark, sf):
    """Features of each segment kind by falling PSI."""
    d = D.distribution_drift(_segment_values(spark, sf), ["segment", "feature"])
    return O.by_psi(_rounded(d), ["feature"], "segment").select("feature", "position", "segment", "psi")


@query
def drift_against_snapshot(spark, sf):
    """A stored baseline of four features against current rows that have three of them, and a new one."""
    values = _line_values(spark, sf)
    base = values.where("side = 'baseline'").select("feature", "v")
    path = shared_path(spark, "snapshot")
    snap = SK.Snapshot(spark, path.rsplit("/", 1)[-1].replace("-", "_"), path, 8).write(base)
    now = values.where("side = 'current' AND feature <> 'l_tax'").select("feature", "v")
    new = now.where("feature = 'l_quantity'").withColumn("feature", F.lit("l_new"))
    return _rounded(D.against_snapshot(snap.counts(), now.unionByName(new)))


@query
def baseline_tables(spark, sf):
    """A baseline snapshot written and one feature of its sample read back."""
    e = WL.table(spark, sf, "events").select(F.col("event_type").alias("feature"),
                                             F.col("value").alias("v"), "event_id")
    path = shared_path(spark, "baseline")
    line = WL.table(spark, sf, "lineitem").select(*LINE_FEATURES)
    SK.write_baseline(P.feature_profile(line, LINE_FEATURES), P.baseline_sample(e, "event_id", k=300),
                      C.schema_table(line, "m", "baseline"), path)
    back = SK.read_baseline_tables(spark, path)
    sample = back["sample"].where("feature = 'click'").groupBy("feature").agg(
        F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))
    return back["schema"].join(back["features"], F.col("column") == F.col("feature")).select(
        "feature", "n", F.round("mean", 4).alias("total")).unionByName(sample)


@query
def drift_bin_shares(spark, sf):
    rows = D.share_rows(D.bin_shares(_line_values(spark, sf)))
    return rows.select("feature", "bin", *[F.round(c, 6).alias(c) for c in
                                           ("low", "high", "expected", "actual")])


@query
def feature_profile(spark, sf):
    out = None
    for t, cols in (("lineitem", LINE_FEATURES), ("customer", ("c_acctbal",)),
                    ("supplier", ("s_acctbal",))):
        p = P.feature_profile(WL.table(spark, sf, t), cols)
        out = p if out is None else out.unionByName(p)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query
def baseline_sample(spark, sf):
    e = WL.table(spark, sf, "events").select(F.col("event_type").alias("feature"),
                                             F.col("value").alias("v"), "event_id")
    return P.baseline_sample(e, "event_id", k=300)


def _user_schemas(spark, sf) -> DataFrame:
    n = WL.table(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("entity"),
        F.concat_ws("_", "event_type", (F.col("event_id") % 8).cast("string")).alias("column"),
        _before("ts", "2024-01-15").alias("side")).count()
    odd = F.col("count") % 2 == 1
    kind = F.when(F.col("side") == "baseline", F.when(odd, "BIGINT").otherwise("Double"))
    kind = F.coalesce(kind, F.when(odd, " bigint ").otherwise("double"))
    return n.select("entity", "side", "column", kind.alias("type"))


@query
def schema_changes(spark, sf):
    return D.schema_changes(_user_schemas(spark, sf))


@query
def schema_drift(spark, sf):
    return D.schema_summary(_user_schemas(spark, sf))


@query
def column_types(spark, sf):
    """Types of event columns written as text, where late rows do not fit what came before."""
    e, i = WL.table(spark, sf, "events"), F.col("event_id")
    late = i % 997 == 500
    text = e.select(
        "event_type", i.cast("string").alias("id"),
        F.when(late, "1e300").otherwise(i.cast("string")).alias("scaled"),
        F.when(late, "n/a").otherwise((i * 3000000).cast("string")).alias("coded"),
        F.when(i % 9 == 0, " ").otherwise((i * 3000000).cast("string")).alias("wide"),
        F.concat(F.when(late, "2024-02-30").otherwise("2024-02-28"), F.lit(" 10:00:00")).alias("day"),
        F.when(i % 2 == 0, "2024-02-29T23:59:59.5Z").alias("moment"),
        F.when(i < 0, "x").alias("empty"), "props")
    return IN.column_types(IN.text_values(text, keys=["event_type"]), ["event_type"])


def _epoch(c: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def _user_freshness(spark, sf) -> DataFrame:
    e = WL.table(spark, sf, "events").groupBy("user_id").agg(F.max(_epoch("ts")).alias("us"))
    now = WL.table(spark, sf, "events").agg(F.max(_epoch("ts"))).scalar()
    secs = F.col("us") / F.lit(1e6)
    given = F.when(F.col("user_id") % 2 == 0, F.floor(secs).cast("double")).otherwise(
        F.floor(secs * 1000).cast("double"))
    e = e.withColumn("now_us", now)
    return D.freshness(e.select(
        F.col("user_id").cast("string").alias("entity"),
        X.epoch_to_timestamp(given).alias("last_modified"),
        F.timestamp_micros("now_us").alias("now"),
        F.get(F.array(F.lit(1.0), F.lit(6.0), F.lit(24.0)), (F.col("user_id") % 3).cast("int"))
        .alias("max_age_hours")), F.col("now"))


@query
def freshness(spark, sf):
    return _user_freshness(spark, sf).select(
        "entity", F.round("age_hours", 4).alias("age_hours"), "max_age_hours", "is_stale",
        "severity")


@query
def model_diagnosis(spark, sf):
    vals = D.long_features(
        WL.table(spark, sf, "events").withColumn("entity", F.col("user_id").cast("string")),
        ["value"], _before("ts", "2024-01-15"), ["entity"])
    feats = D.distribution_drift(vals, ["entity", "feature"])
    ups = WL.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity")).distinct().withColumn(
        "upstream", F.when(F.col("entity").cast("int") % 4 != 0,
                           F.concat(F.lit("up"), F.col("entity"))).otherwise(""))
    return D.diagnose(feats, D.schema_summary(_user_schemas(spark, sf)),
                      _user_freshness(spark, sf), ups)


@query
def drift_flags(spark, sf):
    flags = WB.flag_at_risk(model_diagnosis(spark, sf), F.lit("2024-02-01T00:00:00"))
    return flags.select("entity", "aspect", "key", "value")


@query
def events_in_order(spark, sf):
    """Kinds of event of each user in the order they first occur."""
    e = WL.table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return O.first_occurrences(e, ["user_id"], "event_type", "event_id").select(
        "user_id", "position", "event_type", "first", "times")


# ---------------------------------------------------------------- health
def _evidence(spark, sf) -> DataFrame:
    return WL.evidence(spark, sf)


@query
def asset_contradictions(spark, sf):
    return E.contradictions(_evidence(spark, sf), keywords=WL.EVIDENCE_KEYWORDS)


@query
def asset_investigation(spark, sf):
    d = E.investigate(_evidence(spark, sf), keywords=WL.EVIDENCE_KEYWORDS)
    return d.select("urn", "evidence_strength", "confidence", "action", "is_zombie",
                    "proposed_description", _text("rationale"))


@query
def asset_health(spark, sf):
    d = E.health(E.investigate(_evidence(spark, sf), keywords=WL.EVIDENCE_KEYWORDS))
    return d.select("urn", "status", _text("reasons"))


@query
def asset_leaderboard(spark, sf):
    d = E.health(E.investigate(_evidence(spark, sf), keywords=WL.EVIDENCE_KEYWORDS))
    return O.leaderboard(d.select("pos", "urn", "status")).select("position", "urn", "status")


@query
def health_coverage(spark, sf):
    return E.health_coverage(E.health(E.investigate(_evidence(spark, sf),
                                                    keywords=WL.EVIDENCE_KEYWORDS)))


@query
def health_write_gate(spark, sf):
    d = E.health(E.investigate(_evidence(spark, sf), keywords=WL.EVIDENCE_KEYWORDS))
    return E.write_gate(d).groupBy("knowledge_health", "action", "outcome").agg(
        F.count("*").alias("n"), F.count("new_description").alias("described"))


# ---------------------------------------------------------------- query log and impact
def _indexed(spark, sf):
    cat = WL.catalog(spark, sf)
    return cat, I.build_index(cat)


@query
def log_assessability(spark, sf):
    q = Q.scan(Q.distinct_shapes(Q.with_shape(WL.log(spark, sf)).groupBy(
        "catalog", "shape_id", "team").agg(F.first("tokens").alias("tokens"),
                                           F.count("*").alias("n"), F.sum("runs").alias("runs"))))
    log = Q.with_shape(WL.log(spark, sf)).groupBy("catalog", "shape_id").agg(
        F.count("*").alias("n"), F.sum("runs").alias("runs"))
    return log.join(q.select("catalog", "shape_id", "assessable"), ["catalog", "shape_id"]
                    ).groupBy("catalog", "assessable").agg(
        F.count("*").alias("shapes"), F.sum("n").alias("statements"),
        F.sum("runs").alias("runs"))


@query
def column_usage(spark, sf):
    cat, ix = _indexed(spark, sf)
    cols = cat.columns.select("catalog", F.col("urn").alias("ds_urn"), "column")
    use = ix.usage.join(cols, ["catalog", "ds_urn", "column"]).join(
        ix.cells, ["catalog", "shape_id"])
    return use.groupBy("catalog", "ds_urn", "column", "usage", "confidence",
                       F.array_join("clauses", "|").alias("clauses"), "star").agg(
        F.sum("n").alias("statements"), F.sum("runs").alias("runs"))


@query
def impact_summary(spark, sf):
    cat, ix = _indexed(spark, sf)
    d = I.impact_summary(WL.changes(spark), cat, ix)
    return d.select("change_id", "change", "target_urn", "has_column", "breaks", "degrades",
                    "safe", "unknown", "ambiguous", "queries_total", "analysed", "runs_impacted",
                    "teams", _text("teams_impacted"), "score", "level", "level_qualifier",
                    "coverage", "review_required")


@query
def impact_verdicts(spark, sf):
    cat, ix = _indexed(spark, sf)
    d = I.impact_verdicts(WL.changes(spark), cat, ix)
    return d.select("change_id", "query_id", "verdict", "usage", _text("clauses"), "confidence",
                    "team", "runs", "asset_urn", "reason")


@query
def impact_all_consumers(spark, sf):
    cat, ix = _indexed(spark, sf)
    return I.impact_verdicts(WL.changes(spark), cat, ix, include_safe=True).select(
        "change_id", "query_id", "verdict", "confidence", "runs")


@query
def no_definition_assets(spark, sf):
    return I.undefined_assets(WL.catalog(spark, sf)).select(
        "catalog", "urn", "type", F.coalesce(
            "defining_query_id", F.concat(F.lit("no_definition:"), "urn")).alias("query_id"),
        X.asset_tier("type").alias("tier"))


@query
def fragility(spark, sf):
    cat, ix = _indexed(spark, sf)
    return I.fragility(cat, ix).select("catalog", "position", "dataset_name", "column", "breaks",
                                       "degrades", "safe", "runs_impacted", "teams", "score",
                                       "level")


@query
def fragility_top(spark, sf):
    cat, ix = _indexed(spark, sf)
    return I.fragility(cat, ix, top=5).select("catalog", "position", "dataset_name", "column",
                                              "score")


@query
def impacted_in_order(spark, sf):
    cat, ix = _indexed(spark, sf)
    d = O.impacted(I.impact_verdicts(WL.changes(spark), cat, ix))
    return d.select("change_id", "position", "query_id", "verdict", "runs", X.verdict_color("verdict").alias("color"))


@query
def write_lineage(spark, sf):
    """What the statements of a log that writes read, as edges between datasets."""
    cat = WL.catalog(spark, sf)
    return I.write_edges(WL.writes(spark, sf), cat)


@query
def write_usage(spark, sf):
    cat = replace(WL.catalog(spark, sf), queries=WL.writes(spark, sf))
    ix = I.build_index(cat)
    return ix.usage.join(ix.cells, ["catalog", "shape_id"]).groupBy(
        "catalog", "ds_urn", "column", "usage", "confidence",
        F.array_join("clauses", "|").alias("clauses"), "star").agg(
        F.sum("n").alias("statements"), F.sum("runs").alias("runs"))


@query
def impact_report(spark, sf):
    """The nested report written as JSON, a folder per catalog, and one catalog read back."""
    cat, ix = _indexed(spark, sf)
    ch = WL.changes(spark)
    report = cut_lineage(SK.nested_impact(I.impact_summary(ch, cat, ix)))
    path = shared_path(spark, "report")
    SK.write_table(report, path, "json", "catalog", sort_by=["change_id"])
    # a second write of one catalog leaves the other in place
    SK.write_table(report.where("catalog = 'west'"), path, "json", "catalog", sort_by=["change_id"])
    back = spark.read.schema(report.schema).json(path).where("catalog = 'west'")
    return back.select("catalog", "change_id", "change", "target_urn", "counts.breaks", "counts.safe",
                       "counts.unknown", "risk.score", "risk.level", "risk.coverage", _text("teams_impacted"))


@query
def most_referenced_columns(spark, sf):
    return I.most_referenced_columns(WL.catalog(spark, sf))


@query
def projected_columns(spark, sf):
    rows = I.projected_columns(WL.log(spark, sf))
    return rows.groupBy("catalog", "pos", "output").agg(F.count("*").alias("statements"))


@query
def parsed_changes(spark, sf):
    e = WL.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    i = F.col("event_id").cast("string")
    ref = F.concat(F.lit("sales.t"), (F.col("user_id") % 9).cast("string"), F.lit(".c"), i)
    text = (F.when(F.col("event_type") == "click", F.concat(F.lit("drop "), ref))
            .when(F.col("event_type") == "view", F.concat(F.lit("rename "), ref, F.lit(" n"), i))
            .when(F.col("event_type") == "error", F.concat(F.lit("rename "), ref))
            .when(F.col("event_type") == "signup", F.concat(F.lit("add "), ref))
            .otherwise(F.concat(F.lit("DROP c"), i)))
    d = I.parse_changes(e.select("event_id", text.alias("change")))
    return d.select("event_id", "op", "dataset", "column", "new_name", "error",
                    F.when(F.col("error").isNull(), X.describe_change()).alias("described"))


# ---------------------------------------------------------------- fixes, verification, sweep
def _target_and_fixes(spark, sf, cat, ix):
    target = cut_lineage(I.resolve_changes(WL.changes(spark), cat))
    hit = cut_lineage(S.impacted_assets(target, cat, ix))
    return target, cut_lineage(S.fixes_for(target, hit, WL.models(spark, sf), cat))


@query
def model_fixes(spark, sf):
    cat, ix = _indexed(spark, sf)
    _, fix = _target_and_fixes(spark, sf, cat, ix)
    return fix.select("change_id", "path", "new_sql", "applicable", "changed",
                      F.size("needs_review").alias("reviews"), "method")


def _patch(fix: DataFrame) -> V.Patch:
    w = fix.where("changed").groupBy("change_id", "path").agg(F.first("new_sql").alias("new_sql"))
    return V.Patch(w)


@query
def residual_lines(spark, sf):
    cat, ix = _indexed(spark, sf)
    target, fix = _target_and_fixes(spark, sf, cat, ix)
    return FX.residual_lines(_patch(fix).written.join(
        target.select("change_id", "column", "op"), "change_id"))


@query
def verify_status(spark, sf):
    cat, ix = _indexed(spark, sf)
    target, fix = _target_and_fixes(spark, sf, cat, ix)
    d = V.verify(target, _patch(fix), cat, ix)
    return d.select("change_id", "status", _text("reasons"),
                    F.col("before")["breaks"].alias("breaks_before"),
                    F.col("after")["breaks"].alias("breaks_after"),
                    F.col("after")["safe"].alias("safe_after"),
                    F.col("after")["runs_impacted"].alias("runs_after"),
                    F.col("after")["teams"].alias("teams_after"), "coverage_after", "improved",
                    "regressed", "manual_work", "residual")


@query
def verify_deltas(spark, sf):
    """What the edits of each change do to its counts."""
    cat, ix = _indexed(spark, sf)
    target, fix = _target_and_fixes(spark, sf, cat, ix)
    d = cut_lineage(V.verify(target, _patch(fix), cat, ix))

    def side(c: str) -> DataFrame:
        pairs = [x for k in ("breaks", "degrades", "runs_impacted", "teams")
                 for x in (F.lit(k), F.col(c)[k].cast("long"))]
        return d.select("change_id", F.explode(F.create_map(*pairs)).alias("name", "value"))

    return V.count_deltas(side("before"), side("after"))


@query
def verify_transitions(spark, sf):
    cat, ix = _indexed(spark, sf)
    target, fix = _target_and_fixes(spark, sf, cat, ix)
    _, old, new = V.edited_consumers(target, _patch(fix), cat, ix)
    return V.transitions(old, new).select("change_id", "query_id", "consumer", "before", "after",
                                          "regressed", "improved")


@query
def transitions_in_order(spark, sf):
    cat, ix = _indexed(spark, sf)
    target, fix = _target_and_fixes(spark, sf, cat, ix)
    _, old, new = V.edited_consumers(target, _patch(fix), cat, ix)
    return O.transitions(V.transitions(old, new)).select("change_id", "position", "consumer", "before", "after")


@query
def definition_diff(spark, sf):
    m = WL.models(spark, sf).withColumn("k", F.regexp_extract("path", r"m(\d+)", 1).cast("int"))
    text = F.concat("sql", F.lit("-- "), F.col("k").cast("string"))
    before = m.select(F.lit("d").alias("change_id"), "path", text.alias("sql"), "k")
    after = before.where(F.col("k") % 5 != 0).select(
        "change_id", F.when(F.col("k") % 7 == 1, F.concat(F.lit("moved/"), "path")).otherwise(
            F.col("path")).alias("path"),
        F.when(F.col("k") % 4 == 2, F.concat("sql", F.lit(" edited"))).otherwise(
            F.col("sql")).alias("sql"))
    p = V.diff_definitions(before.drop("k"), after)
    w = p.written.select(F.lit("written").alias("outcome"), F.col("path"), F.lit("").alias("to"))
    x = p.deleted.select(F.lit("deleted").alias("outcome"), F.col("path"), F.lit("").alias("to"))
    r = p.renamed.select(F.lit("renamed").alias("outcome"), F.col("old_path").alias("path"),
                         F.col("new_path").alias("to"))
    return w.unionByName(x).unionByName(r)


def _ledger(spark, sf) -> DataFrame:
    cat, ix = _indexed(spark, sf)
    return S.sweep(cat, ix, WL.models(spark, sf))


@query
def sweep_ledger(spark, sf):
    d = _ledger(spark, sf)
    return d.select("catalog", "place", "dataset_name", "column", "change", "breaks", "degrades",
                    "unknown", "fixes", "blocking", "verdict", "breaks_after", "bucket", "basis")


@query
def sweep_in_order(spark, sf):
    return O.ledger(_ledger(spark, sf)).select("position", "bucket", "catalog", "change")


@query
def sweep_totals(spark, sf):
    return S.sweep_totals(cut_lineage(_ledger(spark, sf)))


@query
def sweep_bucket_totals(spark, sf):
    return S.bucket_totals(cut_lineage(_ledger(spark, sf)))


# ---------------------------------------------------------------- graph and plan
@query
def downstream_rank(spark, sf):
    e = WL.edges(spark, sf)
    nodes = e.select(F.explode(F.array("up", "down")).alias("node")).distinct().withColumn(
        "known", ~F.col("node").endswith("7"))
    return G.downstream_counts(nodes, e, max_hops=2).select("node", "downstream").orderBy(
        F.desc("downstream"), "node")


@query
def upstream_datasets(spark, sf):
    e = WL.edges(spark, sf)
    models = WL.table(spark, sf, "region").select(
        F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("model"))
    types = e.select(F.explode(F.array("up", "down")).alias("node")).distinct().withColumn(
        "type", F.when(F.col("node").startswith("nation"), "OTHER").otherwise("DATASET"))
    return G.upstream_datasets(models, e, types)


def _by_kind(keys: DataFrame, up: Column | None = None) -> DataFrame:
    """Both kinds of asset of supplier keys `k`: (up, down), or (key) without `up`."""
    kinds = F.explode(F.array(F.lit("urn:asset:"), F.lit("urn:model:"))).alias("kind")
    down = F.concat("kind", F.col("k").cast("string"))
    if up is None:
        return keys.select("*", kinds).withColumn("key", down)
    return keys.select("k", up.cast("bigint").cast("string").alias("u"), kinds).select(
        F.concat("kind", "u").alias("up"), down.alias("down"))


def _plan_edges(spark, sf) -> DataFrame:
    """Two ways down from ten suppliers to the next ten, and a cycle in every fifty."""
    s = WL.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")
    return (_by_kind(s, (k * 7) % 10 + F.floor(k / 10) * 10 - 10)
            .unionByName(_by_kind(s.where(k % 4 == 0), k - 10 - k % 3))
            .unionByName(_by_kind(s.where(k % 50 == 48), k + 1))
            .unionByName(_by_kind(s.where(k % 50 == 49), k - 1)))


def _plan_owners(spark, sf) -> DataFrame:
    k = F.col("k")
    s = WL.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).where(k % 3 == 0)
    first = F.concat(F.lit("own"), (k % 4).cast("string"))
    named = F.when(k % 6 == 0, F.array(first, F.lit(""), F.lit("desk"))).otherwise(F.array(first))
    i = F.col("event_id")
    readers = WL.table(spark, sf, "events").where(i % 50 == 0).select(
        F.concat(F.lit("q"), i.cast("string")).alias("key"),
        F.array(F.concat(F.lit("reader"), (i % 9).cast("string"))).alias("owners"))
    return _by_kind(s).select("key", named.alias("owners")).unionByName(readers)


@query
def plan_steps(spark, sf):
    """Steps of all changes, with fixes, owners and what verification saw of each consumer."""
    cat, ix = _indexed(spark, sf)
    target = cut_lineage(I.resolve_changes(WL.changes(spark), cat))
    hit = cut_lineage(S.impacted_assets(target, cat, ix))
    fix = cut_lineage(S.fixes_for(target, hit, WL.models(spark, sf), cat))
    _, old, new = V.edited_consumers(target, _patch(fix), cat, ix)
    return MG.plan_steps(
        I.impact_verdicts(WL.changes(spark), cat, ix), _plan_edges(spark, sf),
        fixes=fix.where("applicable AND changed"), owners=_plan_owners(spark, sf),
        transitions=V.transitions(old, new), manual=V.manual_consumers(hit, cat))


@query
def plan_teams(spark, sf):
    return MG.teams_to_involve(cut_lineage(plan_steps(spark, sf))).select("change_id", _text("teams"))


# ---------------------------------------------------------------- write-back
def _mutations(spark, sf):
    cat, ix = _indexed(spark, sf)
    ch = WL.changes(spark)
    summary = cut_lineage(I.impact_summary(ch, cat, ix))
    verdicts = I.impact_verdicts(ch, cat, ix, assets_only=True)  # writes go to assets alone
    target, fix = _target_and_fixes(spark, sf, cat, ix)
    check = cut_lineage(V.verify(target, _patch(fix), cat, ix))
    review = ch.join(cat.catalogs.select("catalog", "require_review"), "catalog").select(
        "change_id", "require_review")
    return summary, check, cut_lineage(WB.plan_mutations(summary, verdicts, check, review))


@query
def mutation_plan(spark, sf):
    _, _, muts = _mutations(spark, sf)
    return muts.select("change_id", "mutation_id", "auto", "queue_reason",
                       X.payload_summary().alias("payload_summary"))


@query
def writeback_counts(spark, sf):
    _, _, muts = _mutations(spark, sf)
    bad = muts.where(F.col("tool") == "save_document").select("change_id", "mutation_id")
    return WB.outcome_counts(WB.outcomes(muts, dry_run=False, failed=bad)).select(
        "change_id", "total", "written", "queued_for_review", "failed", "planned", "skipped",
        _text("queue_reasons"), "reconciles", "applied_by")


@query
def approval_fingerprint(spark, sf):
    summary, check, muts = _mutations(spark, sf)
    return WB.fingerprints(summary, check, WB.approval_queue(muts)).select(
        "change_id", "change", "status", "fingerprint")


@query
def approval_decision(spark, sf):
    """Every customer presents a manifest; most are stale, used, or unsigned."""
    cust = WL.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    status = F.get(F.array(*[F.lit(s) for s in ("REVIEW_REQUIRED", "FAIL", "PASS",
                                               "REVIEW_REQUIRED")]), (k % 4).cast("int"))
    ident = F.concat(F.lit("m"), k.cast("string"))
    now = cust.select(k.cast("string").alias("change_id"), F.concat(
        F.lit("drop a.c"), k.cast("string")).alias("change"), status.alias("status"),
        F.sha2("c_name", 256).alias("fingerprint"))
    req = cust.select(
        ident.alias("manifest_id"), k.cast("string").alias("change_id"),
        F.concat(F.lit("drop a.c"), F.when(k % 13 == 0, k + 1).otherwise(k).cast("string"))
        .alias("change"),
        F.when(k % 17 == 0, "REVIEW_REQUIRED").otherwise(status).alias("verification_status"),
        F.sha2(F.when(k % 11 == 0, F.lit("old")).otherwise(F.col("c_name")), 256).alias(
            "fingerprint"),
        F.when(k % 7 != 0, F.col("c_name")).alias("approver"))
    ledger = cust.where(k % 5 == 0).select(ident.alias("manifest_id"))
    body = cust.select(ident.alias("manifest_id"), F.sha2(
        F.when(k % 19 == 0, F.lit("edited")).otherwise(F.col("c_name")), 256).alias(
        "fingerprint"))
    d = WB.approval_decisions(req, now, ledger, body)
    return d.select("manifest_id", "refusal_code")


DECIDED = "2024-02-09T00:00:00Z"


def _approved(spark, sf) -> AP.Approved:
    """Every customer presents one of five manifests of a change, made day by day.

    They were made when all verdicts were REVIEW_REQUIRED; some have failed since.
    """
    summary, check, muts = _mutations(spark, sf)
    queue = cut_lineage(WB.approval_queue(muts))
    then = WB.fingerprints(summary, check, queue).withColumn("status", F.lit("REVIEW_REQUIRED"))
    mans = None
    for day in range(1, 6):
        made = WB.manifests(then, queue, f"2024-02-0{day}T00:00:00Z").withColumn("day", F.lit(day))
        mans = made if mans is None else mans.unionByName(made)
    mans = cut_lineage(mans)
    k = F.col("c_custkey")
    cust = WL.table(spark, sf, "customer").select(
        k, "c_name", (k % 5 + 1).cast("int").alias("day"),
        F.when(k % 4 == 0, F.concat(F.lit("c"), (k % 9 + 1).cast("string"))).otherwise("c1").alias("change_id"))
    asked = mans.join(cust, ["change_id", "day"]).select(
        *[c for c in mans.columns if c not in ("change", "fingerprint", "day")],
        F.concat("change", F.when(k % 13 == 0, " later").otherwise("")).alias("change"),
        F.when(k % 11 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(k % 7 != 0, F.col("c_name")).otherwise(" ").alias("approver"),
        F.format_string("2024-02-08T%05d", (k * 37) % 1000).alias("requested_at"))
    # those of day 4 were consumed before, and those of day 3 were edited
    ledger = mans.where("day = 4").select("manifest_id")
    listed = AP.manifest_queue(mans.where("day <> 3"), queue).unionByName(
        AP.manifest_queue(mans.where("day = 3"), queue.where("tool <> 'save_document'")))
    bad = muts.where("tool = 'save_document'").select("change_id", "mutation_id")
    return AP.approve(cut_lineage(asked), listed, summary, check, muts, ledger, DECIDED, failed=bad)


@query
def approval_requests(spark, sf):
    return _approved(spark, sf).decisions.select("manifest_id", "change_id", "approver",
                                                 "requested_at", "refusal_code")


@query
def approved_writes(spark, sf):
    return _approved(spark, sf).outcomes.select("manifest_id", "change_id", "mutation_id", "outcome")


@query
def approval_audit(spark, sf):
    done = _approved(spark, sf)
    facts = WB.property_rows(done.audit)
    spent = done.consumed.select("manifest_id", F.col("approver").alias("value"))
    return facts.unionByName(spent.select(F.col("manifest_id").alias("urn"),
                                          F.lit("ledger").alias("key"), "value"))


@query
def aspect_merge(spark, sf):
    """Tags, descriptions, links and properties of every customer asset after its events."""
    cust = WL.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("urn"),
                                                  "c_mktsegment", "c_name")
    ev = WL.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("urn"),
                                              "event_type", F.col("event_id").alias("at"))
    tags = WB.merge_tags(cust.select("urn", F.array(F.lower("c_mktsegment"), F.lit("view")).alias(
        "tags")), ev.select("urn", F.col("event_type").alias("tag")))
    desc = WB.merge_descriptions(
        cust.select("urn", F.concat("c_name", F.lit("\n\n⚠️ old note")).alias("description")),
        ev.select("urn", F.concat(F.lit("⚠️ last "), "event_type").alias("footer"), "at"))
    links = WB.merge_links(
        cust.select("urn", F.lit("doc/click").alias("url"), F.col("c_name").alias("title"),
                    F.lit(-1).cast("bigint").alias("at")),
        ev.select("urn", F.concat(F.lit("doc/"), "event_type").alias("url"),
                  F.concat(F.lit("e"), F.col("at").cast("string")).alias("title"), "at"))
    links = links.groupBy("urn").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(
        "=", "url", "title"))), "|").alias("links"))
    last = ev.groupBy("urn").agg(F.max("at").cast("string").alias("last"))
    props = WB.merge_properties(
        cust.select("urn", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("last"),
                                        F.lit("none")).alias("props")),
        last.select("urn", F.create_map(F.lit("last"), F.col("last")).alias("props")))
    return (tags.select("urn", _text("tags")).join(desc, "urn", "full").join(links, "urn", "full")
            .join(props.select("urn", F.col("props")["segment"].alias("segment"),
                               F.col("props")["last"].alias("last")), "urn", "full"))


# ---------------------------------------------------------------- payloads and loop
@query
def entity_flatten(spark, sf):
    ent = EN.parse_entities(WL.payloads(spark, sf))
    return EN.flatten_entities(ent).select("pos", "urn", "name", "type", "platform",
                                           "defining_query_id", "source", "sql_chars")


@query
def entity_provenance(spark, sf):
    return EN.provenance_counts(EN.flatten_entities(EN.parse_entities(WL.payloads(spark, sf))))


@query
def entity_names(spark, sf):
    ent = EN.parse_entities(WL.payloads(spark, sf))
    return EN.dataset_names(ent).select("urn", "name", "sql_name", "platform")


@query
def result_rows(spark, sf):
    p = WL.payloads(spark, sf)
    key = F.get(F.array(F.lit("searchResults"), F.lit("results"), F.lit("entities")),
                (F.col("pos") % 3).cast("int"))
    one = F.when(F.col("pos") % 2 == 0, F.concat(F.lit('{"entity":'), "json", F.lit("}"))
                 ).otherwise(F.col("json"))
    block = p.select("pos", F.concat(F.lit('{"'), key, F.lit('":['), one, F.lit("]}")).alias(
        "json"))
    return EN.normalise_results(block)


@query
def json_sql_search(spark, sf):
    return EN.find_sql(WL.payloads(spark, sf))


@query
def json_sql_distinct(spark, sf):
    return EN.distinct_sql(EN.find_sql(WL.payloads(spark, sf)), "pos")


@query
def change_loop(spark, sf):
    cat, ix = _indexed(spark, sf)
    runs = spark.createDataFrame(
        [("r1", "west", "drop sales.supplier.name", None, None),
         ("r2", "east", "rename sales.orders.custkey customer_key", None, None),
         ("r3", "west", "rename sales.lineitem.tax", True, "levy"),
         ("r4", "west", "rename sales.lineitem.tax", None, None),
         ("r5", "west", "drop sales.supplier.suppkey", True, None)],
        "name STRING, catalog STRING, change STRING, require_review BOOLEAN, new_name STRING")
    d = L.run_loop(runs, cat, ix, WL.models(spark, sf))
    return d.select("change_id", "error", "change", "breaks", "degrades", "safe", "ambiguous",
                    "score", "fixes", "require_review", "total", "queued_for_review", "planned",
                    _text("queue_reasons"))
