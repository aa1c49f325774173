"""Scalar rules as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .. import model as M


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def rank_in(c: Column | str, ordered: tuple[str, ...]) -> Column:
    """0-based position of a value in a fixed order."""
    return F.array_position(F.array(*[F.lit(v) for v in ordered]), col(c)).cast("int") - 1


# ---------------------------------------------------------------- names and text
def slug(c: Column | str, default: str = "candidate") -> Column:
    dashed = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    full = F.btrim(dashed, F.lit("-"))
    # two long texts with the same beginning stay apart
    cut = F.when(F.length(full) <= 80, full).otherwise(F.concat(
        F.substring(full, 1, 71), F.lit("-"), F.substring(F.sha2(col(c), 256), 1, 8)))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def bare_name(c: Column | str) -> Column:
    """Last dotted segment, lower case: the part table lookups match on."""
    return F.lower(F.substring_index(col(c), ".", -1))


def urn_platform(c: Column | str) -> Column:
    found = F.regexp_extract(col(c), r"dataPlatform:([^,]*)", 1)
    return F.when(col(c).contains("dataPlatform:"), found).otherwise(F.lit("unknown"))


def urn_sql_name(c: Column | str) -> Column:
    """Second comma part of a dataset urn, cut to its last three dotted segments."""
    path = F.get(F.split(col(c), ","), F.lit(1))
    return F.when(path.isNull(), col(c)).otherwise(last_segments(path, 3))


def last_segments(c: Column | str, n: int) -> Column:
    return F.substring_index(col(c), ".", -n)


def platform_asset_type(c: Column | str) -> Column:
    known = F.try_element_at(literal_map(M.PLATFORM_TYPES), col(c))
    return F.coalesce(known, F.concat(col(c), F.lit("_asset")))


def generated_query_id(name: Column | str, position: Column | str, prefix: str) -> Column:
    stem = F.btrim(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat_ws("_", F.lit(prefix), stem, col(position).cast("string"))


def native_is_number(c: Column | str) -> Column:
    return F.upper(col(c)).rlike("^(NUMBER|FLOAT|INT|DOUBLE)")


def type_norm(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit(""))))


def asset_tier(c: Column | str) -> Column:
    """Tables and models 0, views 1, BI consumers 2; the BI test comes first."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return (F.when(t.rlike("|".join(M.BI_TYPES)), 2).when(t.contains("view"), 1)
            .otherwise(0).cast("int"))


# ---------------------------------------------------------------- changes
def describe_change(op="op", dataset="dataset", column="column", new_name="new_name") -> Column:
    ref = F.concat_ws(".", col(dataset), col(column))
    return (F.when(col(op) == "rename",
                   F.concat(F.lit("rename "), ref, F.lit(" -> "), col(new_name)))
            .otherwise(F.concat(F.lit("drop "), ref)))


# ---------------------------------------------------------------- verdicts
def verdict_of(usage: Column | str) -> Column:
    u = col(usage)
    return (F.when(u.isin("parse_error", "no_definition"), "UNKNOWN")
            .when(u == "none", "SAFE")
            .when(u == "star", "DEGRADES")
            .when(u.isin("select", "filter"), "BREAKS")
            .otherwise("UNKNOWN"))


def verdict_rank(verdict: Column | str) -> Column:
    return rank_in(verdict, M.VERDICTS)


def verdict_color(verdict: Column | str) -> Column:
    return F.try_element_at(literal_map(M.VERDICT_COLORS), col(verdict))


def is_ambiguous(confidence="confidence", verdict="verdict") -> Column:
    return (col(confidence) == "low") & (col(verdict) != "UNKNOWN")


def verdict_reason(usage="usage", clauses="clauses", column="column", op="op",
                   new_name="new_name") -> Column:
    tick = F.concat(F.lit("`"), col(column), F.lit("`"))
    new = F.concat(F.lit("`"), col(new_name), F.lit("`"))
    where = F.when(F.size(col(clauses)) > 0, F.array_join(col(clauses), ", ")).otherwise("—")
    renamed = col(op) == "rename"
    unknown = F.concat(F.lit(" — impact on "), tick,
                       F.lit(" is UNKNOWN, not safe; needs manual review"))
    tail = (F.when(renamed, F.concat(F.lit(" → must be rewritten to "), new))
            .otherwise(F.lit(" → column removed")))
    star_tail = (F.when(renamed, F.concat(F.lit(" → still runs, output field becomes "), new))
                 .otherwise(F.concat(F.lit(" → still runs, output silently loses "), tick)))
    u = col(usage)
    return (F.when(u == "parse_error", F.concat(F.lit("SQL could not be parsed"), unknown))
            .when(u == "no_definition",
                  F.concat(F.lit("consumer exposes no SQL definition"), unknown))
            .when(u == "select", F.concat(F.lit("projects/derives "), tick, F.lit(" (in "), where,
                                          F.lit(")"), tail))
            .when(u == "filter", F.concat(F.lit("references "), tick, F.lit(" in "), where, tail))
            .when(u == "star", F.concat(F.lit("selects `*` over a scope that provides "), tick,
                                        F.lit(" (in "), where, F.lit(")"), star_tail))
            .otherwise(F.concat(F.lit("does not reference "), tick)))


def risk_score(breaks="breaks", degrades="degrades", runs="runs_impacted",
               teams="teams") -> Column:
    raw = (col(breaks) * M.RISK_BREAK + col(degrades) * M.RISK_DEGRADE
           + F.least(col(runs), F.lit(M.RISK_RUN_CAP)) * F.lit(M.RISK_RUN)
           + col(teams) * M.RISK_TEAM)
    return F.least(F.lit(100), F.bround(raw.cast("double"), 0)).cast("int")


def risk_level(score="score") -> Column:
    out = F.lit("LOW")
    for name, floor in reversed(M.RISK_LEVELS):
        out = F.when(col(score) >= floor, name).otherwise(out)
    return out


def level_qualifier(level="level", unassessed="unassessed", ambiguous="ambiguous") -> Column:
    return (F.when(col(unassessed) > 0, F.concat(col(level), F.lit(" among assessed")))
            .when(col(ambiguous) > 0,
                  F.concat(col(level), F.lit(" with "), col(ambiguous).cast("string"),
                           F.lit(" unresolved reference(s)")))
            .otherwise(col(level)))


def coverage_line(analysed="analysed", total="queries_total") -> Column:
    return F.concat(col(analysed).cast("string"), F.lit(" of "), col(total).cast("string"),
                    F.lit(" analysed"))


# ---------------------------------------------------------------- time and drift
def epoch_to_timestamp(c: Column | str) -> Column:
    """Epoch seconds, or milliseconds when the number is above 1e12."""
    x = col(c).cast("double")
    return F.when(x > 1e12, F.timestamp_millis(x.cast("bigint"))).otherwise(
        F.timestamp_micros(F.round(x * 1e6).cast("bigint")))


def age_hours(last: Column | str, now: Column | str) -> Column:
    return (F.unix_micros(col(now)) - F.unix_micros(col(last))) / F.lit(3.6e9)


def freshness_severity(age: Column | str, limit: Column | str) -> Column:
    return (F.when(~(col(age) > col(limit)), "none")
            .when(col(age) > 2 * col(limit), "high").otherwise("moderate"))


def psi_class(c: Column | str) -> Column:
    return (F.when(col(c) < M.PSI_STABLE, "stable").when(col(c) < M.PSI_MODERATE, "moderate")
            .otherwise("significant"))


def schema_severity(added="added", removed="removed", changed="changed") -> Column:
    return (F.when((col(removed) > 0) | (col(changed) > 0), "high")
            .when(col(added) > 0, "low").otherwise("none"))


# ---------------------------------------------------------------- evidence
def evidence_types() -> Column:
    def present(test: Column, name: str) -> Column:
        return F.when(test, F.lit(name))

    return F.array_compact(F.array(
        present(F.size("schema_fields") > 0, "schema"),
        present(F.size("lineage_sources") > 0, "lineage"),
        present(F.col("query_count") > 0, "queries"),
        present(F.col("downstream_count") > 0, "downstream"),
        present(F.size("sibling_terms") > 0, "glossary"),
    ))


def evidence_confidence(strength: Column | str) -> Column:
    s = col(strength)
    return (F.when(s <= 0, "none").when(s == 1, "weak").when(s == 2, "moderate")
            .otherwise("strong"))


def documented() -> Column:
    return F.length(F.coalesce(F.col("current_description"), F.lit(""))) > 0


def heavily_used() -> Column:
    return (F.col("downstream_count") > 0) | (F.col("query_count") >= M.HEAVY_USE_QUERIES)


# ---------------------------------------------------------------- write-back
def queue_reason(status: Column | str, require_review: Column | str,
                 unresolved: Column | str) -> Column:
    """Every gate that holds a write back, joined with '+'; '' means it may apply itself."""
    s = col(status)
    return F.concat_ws(
        "+",
        F.when(s.isNull(), F.lit("not_verified"))
        .when(s != "PASS", F.concat(F.lit("verification_"), F.lower(s))),
        F.when(col(require_review), F.lit("require_review")),
        F.when(col(unresolved), F.lit("unresolved_impact")),
    )


def payload_summary(tool="tool", payload="payload", prefix: str = "impact_") -> Column:
    """What a write would do, in one line, without clock values."""
    p = col(payload)
    kept = F.map_filter(p, lambda k, v: k.startswith(prefix) & ~k.endswith("_at"))
    keys = F.array_sort(F.map_keys(kept))
    shown = F.array_join(
        F.transform(F.slice(keys, 1, 6),
                    lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(kept, k),
                                                                 F.lit("")))), ", ")
    n = F.size(keys)
    return (
        F.when(col(tool) == "add_tags",
               F.concat(F.lit("tags: "), F.coalesce(F.try_element_at(p, F.lit("tags")),
                                                    F.lit(""))))
        .when(col(tool) == "update_description",
              F.concat(F.lit("append footer: "),
                       F.substring(F.coalesce(F.try_element_at(p, F.lit("footer")), F.lit("")),
                                   1, 160)))
        .when(col(tool) == "save_document",
              F.concat(F.lit("institutional-memory link -> "),
                       F.coalesce(F.try_element_at(p, F.lit("url")), F.lit(""))))
        .when(col(tool) == "add_structured_properties",
              F.concat(n.cast("string"), F.lit(" structured propert"),
                       F.when(n == 1, "y").otherwise("ies"), F.lit(": "), shown,
                       F.when(n > 6, " …").otherwise("")))
        .otherwise(F.concat(F.size(F.map_keys(p)).cast("string"), F.lit(" field(s)")))
    )


def payload_digest(payload="payload", prefix: str = "impact_") -> Column:
    """sha256 of everything a write would put down, clock values aside.

    Keys in order, each key and value ended by NUL, so no two payloads share a text.
    """
    end = F.char(F.lit(0))
    clock = lambda k: k.startswith(prefix) & k.endswith("_at")
    entries = F.array_sort(F.map_entries(F.map_filter(col(payload), lambda k, v: ~clock(k))))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(
        e["key"], end, F.coalesce(e["value"], F.lit("")), end)), ""), 256)
