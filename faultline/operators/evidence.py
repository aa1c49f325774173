"""Contradictions between a description and what is known about its asset.

Everything is decided inside the asset's own row from array columns, so the job
is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import model as M
from ..functions import expr as X


def _quoted_list(c: str) -> Column:
    return F.array_join(F.col(c), ", ")


def contradiction_array(keywords: Sequence[str] = M.PLATFORM_KEYWORDS,
                        deprecation: Sequence[str] = M.DEPRECATION_WORDS) -> Column:
    """array<struct<kind, word, detail>>, empty for an undocumented or consistent asset."""
    text = F.coalesce(F.col("current_description"), F.lit(""))
    desc = F.lower(text)
    lineage = F.lower(F.array_join("lineage_sources", " "))
    # Keywords are whole words, so one alternation finds each of them.
    cited = F.array_sort(F.array_distinct(F.regexp_extract_all(
        desc, F.lit(r"\b(" + "|".join(keywords) + r")\b"), F.lit(1))))
    missing = F.when(F.size("lineage_sources") > 0,
                     F.filter(cited, lambda k: ~lineage.contains(k)))
    mismatch = F.transform(missing, lambda k: F.struct(
        F.lit("source_mismatch").alias("kind"), k.alias("word"),
        F.concat(F.lit('description cites "'), k, F.lit('" but current lineage is ['),
                 _quoted_list("lineage_sources"), F.lit("]")).alias("detail")))
    word = F.array_min(F.filter(F.array(*[F.lit(w) for w in deprecation]),
                                lambda w: desc.contains(w)))
    false_dep = F.when(word.isNotNull() & X.heavily_used(), F.array(F.struct(
        F.lit("false_deprecation").alias("kind"), word.alias("word"),
        F.concat(F.lit('marked "'), word, F.lit('" but has '),
                 F.col("query_count").cast("string"), F.lit(" queries and "),
                 F.col("downstream_count").cast("string"),
                 F.lit(" downstream dependencies")).alias("detail"))))
    fields = F.transform("schema_fields", F.lower)
    named = F.regexp_extract_all(text, F.lit(r"`([a-zA-Z_]\w*)`"), F.lit(1))
    gone = F.when(F.size("schema_fields") > 0,
                  F.filter(named, lambda n: ~F.array_contains(fields, F.lower(n))))
    stale = F.transform(gone, lambda n: F.struct(
        F.lit("stale_column").alias("kind"), n.alias("word"),
        F.concat(F.lit("description references removed column `"), n, F.lit("`"))
        .alias("detail")))
    none = F.array().cast("array<struct<kind: string, word: string, detail: string>>")
    return F.concat(*[F.coalesce(a, none) for a in (mismatch, false_dep, stale)])


def with_contradictions(evidence: DataFrame, **words) -> DataFrame:
    return evidence.withColumn("contradictions", contradiction_array(**words))


def contradictions(evidence: DataFrame, **words) -> DataFrame:
    """One row per contradiction."""
    return with_contradictions(evidence, **words).select(
        "urn", F.inline("contradictions"))


def investigate(evidence: DataFrame, **words) -> DataFrame:
    """Adds strength, confidence, proposed description, rationale and action."""
    d = with_contradictions(evidence, **words)
    d = d.withColumn("evidence_types", X.evidence_types())
    d = d.withColumn("evidence_strength", F.size("evidence_types"))
    d = d.withColumn("confidence", X.evidence_confidence("evidence_strength"))
    d = d.withColumn("is_zombie", F.size("contradictions") > 0)
    q, n = F.col("query_count"), F.col("downstream_count")
    has_l, has_t = F.size("lineage_sources") > 0, F.size("sibling_terms") > 0
    bits = F.array_compact(F.array(
        F.when(has_l, F.concat(F.lit("derived from "), _quoted_list("lineage_sources"))),
        F.when(q != 0, F.concat(F.lit("actively queried ("), q.cast("string"),
                                F.lit(" queries observed)"))),
        F.when(n != 0, F.concat(F.lit("feeds "), n.cast("string"),
                                F.lit(" downstream asset(s)"))),
        F.when(has_t, F.concat(F.lit("related to "), _quoted_list("sibling_terms")))))
    proposed = F.when(F.size(bits) > 0, F.concat(
        F.col("name"), F.lit(": "), F.array_join(bits, "; "), F.lit("."))).otherwise(
        "insufficient evidence to reconstruct")
    thin = (F.col("evidence_strength") < 2) & ~X.documented()
    action = (F.when(thin, "abstain").when(F.col("is_zombie"), "review")
              .when(X.documented(), "none").when(F.col("evidence_strength") >= 3, "write")
              .otherwise("review"))
    d = d.withColumns({"proposed_description": proposed, "action": action})
    rationale = F.array_compact(F.array(
        F.when(has_l, F.concat(F.lit("lineage: "), F.size("lineage_sources").cast("string"),
                               F.lit(" upstream source(s)"))),
        F.when(q != 0, F.concat(F.lit("queries: "), q.cast("string"),
                                F.lit(" real queries reference it"))),
        F.when(n != 0, F.concat(F.lit("downstream: "), n.cast("string"),
                                F.lit(" dependent asset(s)"))),
        F.when(has_t, F.concat(F.lit("glossary: sibling terms "),
                               _quoted_list("sibling_terms"))),
        F.when(F.size("schema_fields") > 0,
               F.concat(F.lit("schema: "), F.size("schema_fields").cast("string"),
                        F.lit(" columns"))),
        F.when(F.col("action") == "abstain",
               "ABSTAIN: fewer than 2 independent evidence types")
        .when((F.col("action") == "review") & F.col("is_zombie"),
              "REVIEW: existing description contradicts current evidence")
        .when(F.col("action") == "write",
              "WRITE: >=3 corroborating evidence types, no prior description")))
    return d.withColumn("rationale", rationale)


def health(investigated: DataFrame) -> DataFrame:
    """Adds the health bucket and its reasons."""
    zombie, doc = F.col("is_zombie"), X.documented()
    critical = X.heavily_used() & (~doc | zombie)
    status = (F.when(critical, "CRITICAL").when(zombie, "NEEDS_REVIEW")
              .when(~doc, "FORGOTTEN").otherwise("HEALTHY"))
    use = F.concat(F.lit("load-bearing ("), F.col("query_count").cast("string"),
                   F.lit(" queries, "), F.col("downstream_count").cast("string"),
                   F.lit(" downstream)"))
    listed = F.array_join(F.transform("contradictions", lambda c: F.concat(
        F.lit("["), c["kind"], F.lit("] "), c["detail"])), "; ")
    reasons = (
        F.when(critical, F.array(use, F.when(~doc, "undocumented").otherwise(
            "documentation contradicts evidence")))
        .when(zombie, F.array(F.concat(F.lit("zombie: "), listed)))
        .when(~doc, F.array(F.when(F.col("action") != "abstain",
                                   "undocumented; reconstructable").otherwise(
            "undocumented; evidence too thin to reconstruct")))
        .otherwise(F.array(F.lit("documented and consistent with evidence"))))
    return investigated.withColumns({"status": status, "reasons": reasons})


def health_coverage(rows: DataFrame) -> DataFrame:
    healthy = F.count_if(F.col("status") == "HEALTHY")
    n = F.count("*")
    return rows.agg(
        n.alias("assets"),
        F.round(100 * healthy / F.greatest(n, F.lit(1)), 1).alias("healthy_pct"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in M.HEALTH])


def write_gate(rows: DataFrame) -> DataFrame:
    """Health is recorded for every asset, a description only when the evidence is strong."""
    outcome = (F.when(F.col("action") == "write", "written")
               .when(F.col("action") == "review", "queued").otherwise("skipped"))
    return rows.select(
        "urn", F.col("status").alias("knowledge_health"), "action", outcome.alias("outcome"),
        F.when(F.col("action") == "write", F.col("proposed_description")).alias(
            "new_description"))
