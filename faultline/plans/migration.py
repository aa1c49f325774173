"""Ordered migration steps for every change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import model as M
from ..functions import expr as X
from ..operators import graph as G
from ..scale import stored_table


def plan_nodes(verdicts: DataFrame) -> DataFrame:
    """Confident breaks and degrades plus everything that could not be assessed."""
    keep = (F.col("verdict").isin("BREAKS", "DEGRADES") & ~X.is_ambiguous()) | (
        F.col("verdict") == "UNKNOWN")
    rows = verdicts.where(keep).withColumn("key", F.coalesce("asset_urn", "query_id"))
    # one step per consumer; its worst, most used verdict speaks for it
    worst = F.struct(X.verdict_rank("verdict").alias("r"), (-F.col("runs")).alias("w"), "q_pos",
                     "query_id", "verdict", "usage", "confidence", "team", "asset_urn",
                     "asset_name", "asset_type")
    one = rows.groupBy("change_id", "key").agg(F.min(worst).alias("v"))
    return one.select("change_id", "key", "v.query_id", "v.verdict", "v.usage", "v.confidence",
                      "v.team", "v.asset_urn", "v.asset_name", "v.asset_type",
                      X.asset_tier("v.asset_type").alias("tier"),
                      F.coalesce("v.asset_name", "v.query_id").alias("name"))


def plan_steps(verdicts: DataFrame, edges: DataFrame, fixes: DataFrame | None = None,
               owners: DataFrame | None = None, transitions: DataFrame | None = None,
               manual: DataFrame | None = None) -> DataFrame:
    """One row per step.

    fixes(change_id, asset_urn, path); owners(key, owners ARRAY); transitions
    from `verify.transitions`; manual(change_id, asset_name): consumers still
    impacted that no fix reaches.  Absent tables leave `not verified` and the
    placeholder for a human.
    """
    nodes = stored_table(plan_nodes(verdicts))  # the order and the steps read them
    order = G.with_step(G.plan_order(nodes.select("change_id", "key", "tier", "name"), edges))
    d = nodes.join(order.select("change_id", "key", "step"), ["change_id", "key"])
    if fixes is not None:
        f = fixes.groupBy("change_id", "asset_urn").agg(F.max("path").alias("fix_path"))
        d = d.join(f, ["change_id", "asset_urn"], "left")
    else:
        d = d.withColumn("fix_path", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    own = none
    if owners is not None:
        joined = owners.select("key", F.array_join(F.filter(
            "owners", lambda o: F.length(o) > 0), ", ").alias("named"))
        d = d.join(joined.select(F.col("key").alias("asset_urn"), F.col("named").alias("oa")),
                   "asset_urn", "left").join(
            joined.select(F.col("key").alias("query_id"), F.col("named").alias("oq")),
            "query_id", "left")
        own = F.coalesce(F.nullif("oa", F.lit("")), F.nullif("oq", F.lit("")))
    owner = F.coalesce(own, F.nullif("team", F.lit("")),
                       F.lit(f"{M.HUMAN} (unassigned owner)"))
    unknown = F.col("verdict") == "UNKNOWN"
    action = (F.when(unknown, F.concat(
        F.lit("manual review — could not be assessed automatically ("), F.col("usage"),
        F.lit("); determine impact by hand")))
        .when(F.col("fix_path").isNotNull(), F.concat(F.lit("apply generated fix: "),
                                                      F.col("fix_path")))
        .otherwise("manual review — no mechanical fix generated"))
    verified = F.lit("not verified")
    if transitions is not None:
        t = transitions.select("change_id", "query_id", "before", "after", "regressed",
                               "improved")
        d = d.join(t, ["change_id", "query_id"], "left")
        if manual is not None:
            m = manual.select("change_id", "asset_name").distinct().withColumn(
                "is_manual", F.lit(True))
            d = d.join(m, ["change_id", "asset_name"], "left")
        else:
            d = d.withColumn("is_manual", F.lit(None).cast("boolean"))
        move = F.concat(F.lit(" ("), F.col("before"), F.lit(" -> "), F.col("after"), F.lit(")"))
        verified = (
            F.when(unknown, "unassessed — verification cannot clear it")
            .when(F.col("is_manual"), "still impacted after fix — manual review")
            .when(F.col("regressed"), F.concat(F.lit("REGRESSED after fix"), move))
            .when(F.col("improved"), F.concat(F.lit("verified-clean after fix"), move))
            .otherwise("unchanged after fix — manual review"))
    return d.select("change_id", "step", "key", F.col("name").alias("asset_name"),
                    F.coalesce("asset_type", F.lit("query")).alias("asset_type"), "verdict",
                    owner.alias("owner"), action.alias("action"),
                    F.col("confidence").alias("parser_confidence"), verified.alias("verified"))


def teams_to_involve(steps: DataFrame) -> DataFrame:
    """Named owners of each change in the order of their first step."""
    named = steps.where(~F.col("owner").startswith(M.HUMAN)).select(
        "change_id", "step", F.posexplode(F.split("owner", ", ")).alias("i", "team"))
    first = named.where(F.length("team") > 0).groupBy("change_id", "team").agg(
        F.min(F.struct("step", "i")).alias("at"))
    return first.groupBy("change_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "team"))), lambda x: x["team"]).alias("teams"))
