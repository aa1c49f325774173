"""Schema, distribution and freshness drift of model inputs.

The distribution test works on a long table `(keys..., side, v)` with side
`baseline` or `current`.  It is first reduced to one row per distinct value
with a count for each side, so a hot value or a hot feature costs one row per
map task in the shuffle.  The ordered distinct values are then cut into ranges
of bounded size, each a row with its running counts, its totals and the
extremes of its distance; a feature of any size is many such rows in many
tasks.  Quantile edges, bin shares and the KS statistic all come from that
table: totals of the ranges before one shift its counts, and only ranges that
hold a wanted rank or an edge are opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import model as M
from ..functions import expr as X
from ..scale import broadcast_if_small, cut_lineage, stored_table

VALUES_PER_RANGE = 1 << 13  # distinct values of a range


def long_features(df: DataFrame, features: Sequence[str], side: Column,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Wide rows to `(keys..., feature, side, v)`; nulls and NaN are dropped."""
    wide = df.select(*keys, side.alias("side"),
                     *[F.col(c).cast("double").alias(c) for c in features])
    return (wide.unpivot([*keys, "side"], list(features), "feature", "v")
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def value_counts(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    return values.groupBy(*keys, "v").agg(
        F.count_if(F.col("side") == "baseline").alias("nb"),
        F.count_if(F.col("side") == "current").alias("nc"))


RANGE = ("first double, n_b long, n_c long, t_b long, t_c long, high double, low double, "
         "v array<double>, upto_b array<long>, upto_c array<long>")


def ranges(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and range of its ordered values.

    `first` is the smallest value, `n_b` and `n_c` the counts of both sides, `t_b` and `t_c` those
    of the whole key; `upto_b` and `upto_c` count the values at or below each of `v` inside the
    range, and `high` and `low` are the extremes of `upto_b / t_b - upto_c / t_c`.
    """
    keys, size = list(keys), VALUES_PER_RANGE

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            turn = np.zeros(n, bool)
            turn[0] = True
            for k in keys:
                same = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                turn[1:] |= same[1:] != same[:-1]
            key_start = np.maximum.accumulate(np.where(turn, np.arange(n), 0))
            start = np.flatnonzero((np.arange(n) - key_start) % size == 0)
            edge = np.append(start, n)
            long = np.diff(edge)

            def inside(side: str) -> tuple[np.ndarray, np.ndarray]:
                one = batch.column(side).to_numpy()
                up = np.cumsum(one)
                up = up - np.repeat(up[start] - one[start], long)
                return up, up[edge[1:] - 1]

            (b, n_b), (c, n_c) = inside("nb"), inside("nc")
            t_b, t_c = batch.column("t_b").to_numpy(), batch.column("t_c").to_numpy()
            apart = b / np.maximum(t_b, 1) - c / np.maximum(t_c, 1)

            def lists(x):
                return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x))

            v, at = batch.column("v"), pa.array(start)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(at) for k in keys], v.take(at), pa.array(n_b), pa.array(n_c),
                 pa.array(t_b[start]), pa.array(t_c[start]), pa.array(np.maximum.reduceat(apart, start)),
                 pa.array(np.minimum.reduceat(apart, start)), lists(v), lists(b), lists(c)],
                [*keys, "first", "n_b", "n_c", "t_b", "t_c", "high", "low", "v", "upto_b", "upto_c"])

    totals = counts.groupBy(*keys).agg(F.sum("nb").alias("t_b"), F.sum("nc").alias("t_c"))
    dealt = counts.join(totals, keys).repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + RANGE
    return stored_table(dealt.mapInArrow(fold, schema))


def placed_ranges(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges without their lists, with the counts before them and the start of the next one."""
    order = W.partitionBy(*keys).orderBy("first")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return cut_lineage(table.select(
        *keys, "first", "n_b", "n_c", "t_b", "t_c", "high", "low",
        F.coalesce(F.sum("n_b").over(before), F.lit(0)).alias("o_b"),
        F.coalesce(F.sum("n_c").over(before), F.lit(0)).alias("o_c"),
        F.lead("first").over(order).alias("next")))


def edges_and_ks(table: DataFrame, placed: DataFrame, keys: Sequence[str],
                 buckets: int = 10) -> DataFrame:
    """One row per key: quantile edges of the baseline and the KS distance.

    Edge i interpolates between the baseline values at rank floor(p) and
    floor(p)+1 with p = i/buckets*(n-1).  A feature that lacks one side gets
    null edges and distance and the error text.
    """
    keys = list(keys)

    def rank(i: int, n: Column) -> tuple[Column, Column, Column]:
        p = F.lit(i / buckets) * (n - 1)
        low = F.floor(p)
        return p, low, F.least(low + 1, n - 1)

    total = F.col("t_b")
    ranks = [r for i in range(1, buckets) for r in rank(i, total)[1:]]
    ranks = F.array_distinct(F.array(F.lit(0).cast("long"), *ranks, total - 1))
    here = F.filter(ranks, lambda r: (r >= F.col("o_b")) & (r < F.col("o_b") + F.col("n_b")))
    wanted = placed.where("t_b > 0 AND t_c > 0").select(*keys, "first", "o_b", F.explode(here).alias("rank"))
    found = table.join(broadcast_if_small(wanted), [*keys, "first"]).select(*keys, F.struct(
        "rank", F.get("v", F.size(F.filter("upto_b", lambda n: n <= F.col("rank") - F.col("o_b"))))
        .alias("v")).alias("at"))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list("at")).alias("at"))
    apart = F.col("o_b") / F.greatest("t_b", F.lit(1)) - F.col("o_c") / F.greatest("t_c", F.lit(1))
    out = placed.groupBy(*keys).agg(
        F.max("t_b").alias("n_baseline"), F.max("t_c").alias("n_current"),
        F.max(F.greatest(F.abs(F.col("high") + apart), F.abs(F.col("low") + apart))).alias("ks"))
    out = out.join(found, keys, "left")

    def at(r: Column) -> Column:
        return F.try_element_at("at", r)

    n = F.col("n_baseline")
    inner = []
    for i in range(1, buckets):
        p, low, high = rank(i, n)
        inner.append(at(low) * (1 - (p - low)) + at(high) * (p - low))
    raw = F.array(at(F.lit(0).cast("long")), *inner, at(n - 1))
    rising = F.aggregate(
        raw, F.array().cast("array<double>"),
        lambda acc, e: F.when((F.size(acc) == 0) | (e > F.try_element_at(acc, F.lit(-1))),
                              F.concat(acc, F.array(e))).otherwise(acc))
    edges = F.when(F.size(rising) >= 2, rising).otherwise(
        F.array(F.get(raw, F.lit(0)), F.get(raw, F.lit(0)) + F.lit(1e-9)))
    both = (F.col("n_baseline") > 0) & (F.col("n_current") > 0)
    return cut_lineage(out.select(
        *keys, "n_baseline", "n_current", F.when(both, edges).alias("edges"),
        F.when(both, F.col("ks")).alias("ks"),
        F.when(F.col("n_baseline") == 0, "baseline values are empty")
        .when(F.col("n_current") == 0, "current values are empty").alias("error")))


def bin_index(v: Column | str, edges: Column | str) -> Column:
    """Bin of a value; the last bin is closed on the right, outliers go to the end bins."""
    reached = F.size(F.filter(X.col(edges), lambda e: e <= X.col(v)))
    return F.greatest(F.lit(0), F.least(reached - 1, F.size(X.col(edges)) - 2))


def binned(table: DataFrame, placed: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the share of each side per bin as the arrays `expected` and `actual`.

    Bin i holds the values from edge i up to edge i+1, so it is the difference of
    two counts of values below an edge; the end bins take the outliers.
    """
    keys = list(keys)
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    each = edges.where("error IS NULL").select(*keys, F.posexplode(inner).alias("i", "edge"))
    # an edge is looked up in the last range that starts below it
    here = (F.col("first") < F.col("edge")) & (F.col("next").isNull() | (F.col("edge") <= F.col("next")))
    wanted = placed.select(*keys, "first", "next", "o_b", "o_c").join(each, keys).where(here).drop("next")
    below = F.size(F.filter("v", lambda v: v < F.col("edge"))) - 1
    found = table.join(broadcast_if_small(wanted), [*keys, "first"]).select(*keys, F.struct(
        "i", F.struct((F.col("o_b") + F.get("upto_b", below)).alias("nb"),
                      (F.col("o_c") + F.get("upto_c", below)).alias("nc")).alias("n")).alias("at"))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list("at")).alias("below"))
    out = edges.join(found, keys, "left")

    def shares(side: str, total: str) -> Column:
        upto = F.concat(
            F.array(F.lit(0).cast("bigint")),
            F.transform(inner, lambda e, i: F.coalesce(
                F.try_element_at("below", i)[side], F.lit(0).cast("bigint"))),
            F.array(F.col(total)))
        return F.transform(
            F.sequence(F.lit(0), F.size("edges") - 2),
            lambda i: (F.get(upto, i + 1) - F.get(upto, i))
            / F.greatest(F.col(total), F.lit(1)))

    ok = F.col("error").isNull()
    return out.select(*edges.columns, F.when(ok, shares("nb", "n_baseline")).alias("expected"),
                      F.when(ok, shares("nc", "n_current")).alias("actual"))


def psi(expected: Column | str, actual: Column | str) -> Column:
    def term(e: Column, a: Column) -> Column:
        e, a = F.greatest(e, F.lit(M.PSI_FLOOR)), F.greatest(a, F.lit(M.PSI_FLOOR))
        return (a - e) * F.log(a / e)

    return F.aggregate(F.zip_with(X.col(expected), X.col(actual), term), F.lit(0.0),
                       lambda acc, x: acc + x)


def bin_shares(values: DataFrame, keys: Sequence[str] = ("feature",), buckets: int = 10) -> DataFrame:
    """One row per key with edges, shares per bin and KS."""
    keys = list(keys)
    table = ranges(cut_lineage(value_counts(values, keys)), keys)
    placed = placed_ranges(table, keys)
    return binned(table, placed, edges_and_ks(table, placed, keys, buckets), keys)


def against_snapshot(snapshot: DataFrame, current: DataFrame, buckets: int = 10) -> DataFrame:
    """PSI, KS and verdict of the features that a stored baseline and the current rows share.

    snapshot  (feature, v, nb, h) as `sinks.Snapshot` keeps it, bucketed by (feature, h)
    current   (feature, v); nulls and NaN do not count
    """
    both = cut_lineage(_meet_snapshot(snapshot, current))
    table = ranges(both, ["feature"])
    placed = placed_ranges(table, ["feature"])
    return drift_verdicts(binned(table, placed, edges_and_ks(table, placed, ["feature"], buckets), ["feature"]))


def _meet_snapshot(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, v, nb, nc) of the shared features; only the current side is shuffled."""
    now = current.where("v IS NOT NULL AND NOT isnan(v)").groupBy("feature", "v").agg(
        F.count("*").alias("nc")).withColumn("h", F.xxhash64("v"))
    old = shared_features(snapshot, now.select(F.col("feature").alias("column")))
    # a feature that is new has no baseline to differ from
    known = broadcast_if_small(snapshot.select("feature").distinct())
    a, b = old.alias("a"), now.join(known, "feature", "left_semi").alias("b")
    same = F.expr("a.feature = b.feature AND a.h = b.h AND a.v >= b.v AND a.v <= b.v")
    return a.join(b, same, "full").select(
        F.coalesce("a.feature", "b.feature").alias("feature"), F.coalesce("a.v", "b.v").alias("v"),
        F.coalesce("nb", F.lit(0)).alias("nb"), F.coalesce("nc", F.lit(0)).alias("nc"))


def share_rows(binned_rows: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """One row per bin."""
    return binned_rows.where(F.col("error").isNull()).select(
        *keys, "edges", F.posexplode(F.arrays_zip("expected", "actual")).alias("bin", "s"),
    ).select(*keys, "bin", F.get("edges", F.col("bin")).alias("low"),
             F.get("edges", F.col("bin") + 1).alias("high"),
             F.col("s.expected").alias("expected"), F.col("s.actual").alias("actual"))


def distribution_drift(values: DataFrame, keys: Sequence[str] = ("feature",),
                       buckets: int = 10) -> DataFrame:
    """PSI, KS and verdict per key."""
    return drift_verdicts(bin_shares(values, keys, buckets), keys)


def drift_verdicts(shares: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    out = shares.withColumn("psi", psi("expected", "actual"))
    return out.select(
        *keys, "n_baseline", "n_current", "psi", "ks",
        F.when(F.col("psi").isNotNull(), X.psi_class("psi")).alias("verdict"), "error",
    ).withColumn("has_drift", F.coalesce(F.col("verdict") != "stable", F.lit(False)))


def shared_features(baseline: DataFrame, current_columns: DataFrame) -> DataFrame:
    """Baseline features that the current schema still has."""
    names = broadcast_if_small(current_columns.select(F.col("column").alias("feature")).distinct())
    return baseline.join(names, "feature", "left_semi")


# ---------------------------------------------------------------- schema
def schema_changes(schemas: DataFrame) -> DataFrame:
    """`(entity, side, column, type)` to one row per added, removed or retyped column.

    Names compare as written; types compare trimmed and without case.
    """
    def side(name: str, out: str) -> DataFrame:
        return schemas.where(F.col("side") == name).select(
            "entity", "column", F.col("type").alias(out), F.lit(True).alias(f"has_{out}"))

    both = side("baseline", "old_type").join(side("current", "new_type"),
                                             ["entity", "column"], "full")
    change = (F.when(F.col("has_old_type").isNull(), "added")
              .when(F.col("has_new_type").isNull(), "removed")
              .when(X.type_norm("old_type") != X.type_norm("new_type"), "type_changed"))
    return (both.withColumn("change", change).where(F.col("change").isNotNull())
            .select("entity", "column", "change", "old_type", "new_type"))


def schema_summary(schemas: DataFrame) -> DataFrame:
    """One row per entity, entities without drift included."""
    changes = schema_changes(schemas)
    agg = changes.groupBy("entity").agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if(F.col("change") == "type_changed").alias("changed"))
    out = schemas.select("entity").distinct().join(agg, "entity", "left").na.fill(
        0, ["added", "removed", "changed"])
    return out.withColumn("severity", X.schema_severity()).withColumn(
        "has_drift", F.col("severity") != "none")


# ---------------------------------------------------------------- freshness
def freshness(inputs: DataFrame, now: Column) -> DataFrame:
    """`(entity, last_modified TIMESTAMP, max_age_hours)` to age, staleness and severity."""
    return (inputs.withColumn("age_hours", X.age_hours("last_modified", now))
            .withColumn("is_stale", F.col("age_hours") > F.col("max_age_hours"))
            .withColumn("severity", X.freshness_severity("age_hours", "max_age_hours")))


# ---------------------------------------------------------------- diagnosis
def diagnose(features: DataFrame, schema: DataFrame, fresh: DataFrame,
             upstreams: DataFrame) -> DataFrame:
    """One row per entity from the three signals.

    `upstreams(entity, upstream)` lists every entity to report, so one that has
    no signal at all still gets a row.
    """
    dist = features.groupBy("entity").agg(
        F.max("psi").alias("max_psi"),
        F.max(F.when(F.col("has_drift"), F.struct("psi", F.col("feature")))).alias("worst"))
    got = (upstreams.select("entity", "upstream")
           .join(dist, "entity", "left")
           .join(schema.select("entity", F.col("severity").alias("schema_severity")),
                 "entity", "left")
           .join(fresh.select("entity", F.col("severity").alias("stale_severity")),
                 "entity", "left"))
    schema_sev = F.coalesce("schema_severity", F.lit("none"))
    stale_sev = F.coalesce("stale_severity", F.lit("none"))
    score = F.round(
        F.coalesce("max_psi", F.lit(0.0))
        + F.coalesce(F.try_element_at(X.literal_map(M.SCHEMA_PENALTY), schema_sev), F.lit(0.0))
        + F.coalesce(F.try_element_at(X.literal_map(M.STALE_PENALTY), stale_sev), F.lit(0.0)), 3)
    named = F.nullif(F.col("upstream"), F.lit(""))
    offender = (
        F.when(F.col("worst").isNotNull(),
               F.concat(F.coalesce(named, F.lit("upstream")), F.lit("#"), F.col("worst.feature")))
        .when(stale_sev != "none", F.coalesce(named, F.lit("upstream (freshness)")))
        .when(schema_sev != "none", F.coalesce(named, F.lit("upstream (schema)")))
        .otherwise(F.lit("")))
    drifted = F.col("worst").isNotNull() | (stale_sev != "none") | (schema_sev != "none")
    return got.select(
        "entity", score.alias("drift_score"), drifted.alias("has_drift"),
        offender.alias("offending_upstream"),
        F.when((score >= M.AT_RISK) | drifted, "AT RISK").otherwise("healthy").alias("verdict"))
