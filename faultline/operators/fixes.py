"""Mechanical edits of model texts for a dropped or renamed column.

All work is done inside the row of one (change, model) pair.  A projection that
fills its own line is removed with its line; anything else is edited token by
token, with white space and comments kept.  A rename replaces whole words when
no other table of the statement provides the column, otherwise only the
references that resolve to the changed table.  Edited text that cannot be read
again is never offered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scale import cut_lineage
from . import qlog
from .impact import Catalog, attach_sources

# Does a reference (qualifier q, name n) of a statement with sources `src` mean table `ds_urn`?
# 0 high, 1 medium, 2 low; null when it does not.
_CONF = """
case when {q} <> '' then
  case when get(filter(src, s -> s.bare = {q} or s.alias = {q}), 0).ds_urn <=> ds_urn
       then 0 end
when exists(src, s -> array_contains(s.cols, {n})) then
  case when exists(src, s -> array_contains(s.cols, {n}) and s.ds_urn <=> ds_urn) then
    case when size(filter(src, s -> array_contains(s.cols, {n}))) > 1 then 2
         when exists(src, s -> not s.known) then 1 else 0 end end
when exists(src, s -> s.ds_urn <=> ds_urn)
 and exists(src, s -> not s.known and not (s.ds_urn <=> ds_urn)) then 1 end
"""
_NORM = (r"lower(trim(regexp_replace(regexp_replace(trim({}), ',+\\s*$', ''), '\\s+', ' ')))")


def scan_models(models: DataFrame, catalog: Catalog) -> DataFrame:
    """Models with their tokens, sources, references and projections."""
    scanned = cut_lineage(qlog.scan(qlog.with_shape(models)).drop("stars", "outputs"))
    keys = ("catalog", "path")
    src = attach_sources(scanned.where(F.size("sources") > 0), catalog, keys)
    return scanned.select("catalog", "path", "sql", "tokens", "assessable", "refs",
                          "projections").join(src.select(*keys, "src"), list(keys), "left")


def model_fixes(work: DataFrame, models: DataFrame, catalog: Catalog) -> DataFrame:
    """One row per (change, impacted model).

    `work(change_id, catalog, ds_urn, column, op, new_name, path, asset_urn, asset_name)`.
    """
    d = work.join(scan_models(models, catalog), ["catalog", "path"], "left")
    d = d.withColumn("col", F.lower("column")).withColumn(
        "src", F.coalesce("src", F.expr("slice(array(named_struct('ord', 0, 'bare', '', 'alias',"
                                        " '', 'ds_urn', '', 'known', true, 'cols',"
                                        " array(''))), 1, 0)")))
    low = "transform(tokens, t -> lower(t))"
    conf_p = _CONF.format(q="p.qualifier", n="p.name")
    conf_r = _CONF.format(q="r.qualifier", n="r.name")
    d = d.withColumn("hits", F.expr(
        f"filter(projections, p -> p.name = col and ({conf_p}) is not null)"))
    d = d.withColumn("named", F.expr(
        f"filter(refs, r -> r.name = col and ({conf_r}) is not null)"))
    d = d.withColumn("sure", F.expr(f"filter(named, r -> ({conf_r}) < 2)"))
    d = d.withColumn("filters", F.expr(
        "array_sort(array_distinct(transform(filter(named, r -> r.clause <> 'select'),"
        " r -> r.clause)))"))
    d = d.withColumn("emptied", F.expr("exists(hits, p -> p.sole)"))
    # line edit
    d = d.withColumn("lines", F.split("sql", "\n")).withColumn("wanted", F.expr(
        f"transform(hits, p -> array_join(slice({low}, p.pos + 1, p.len), ' '))"))
    d = d.withColumn("removed", F.expr(
        f"size(filter(lines, l -> array_contains(wanted, {_NORM.format('l')})))"))
    kept = F.expr(f"array_join(filter(lines, l -> not array_contains(wanted,"
                  f" {_NORM.format('l')})), '\n')")
    line_drop = F.regexp_replace(kept, r"(?i),[ \t]*((?:\n[ \t]*)+from\b)", "$1")
    # token edit: `at` maps a token position to its place among the raw tokens
    d = d.withColumn("raw", qlog.raw_tokens("sql")).withColumn("at", F.expr(
        "filter(sequence(0, size(raw) - 1), i -> not (raw[i] rlike '^\\\\s' or raw[i] like '--%'"
        " or (raw[i] like '/*%' and length(raw[i]) > 2)))"))
    d = d.withColumn("cut", F.expr(
        "transform(hits, p -> case when get(tokens, p.pos - 1) = ',' then"
        " named_struct('a', at[p.pos - 1], 'b', at[p.pos + p.len - 1])"
        " when get(tokens, p.pos + p.len) = ',' then"
        " named_struct('a', at[p.pos], 'b', coalesce(get(at, p.pos + p.len + 1) - 1,"
        " at[p.pos + p.len]))"
        " else named_struct('a', at[p.pos], 'b', at[p.pos + p.len - 1]) end)"))
    token_drop = F.expr("array_join(transform(raw, (t, i) -> case when exists(cut, c ->"
                        " i between c.a and c.b) then '' else t end), '')")
    d = d.withColumn("by_line", F.col("removed") == F.size("hits"))
    # rename
    word = F.concat(F.lit(r"\b"), F.regexp_replace("column", r"([^\w])", r"\\$1"), F.lit(r"\b"))
    d = d.withColumn("word", word)
    shared = F.expr("exists(src, s -> not (s.ds_urn <=> ds_urn) and"
                    " array_contains(s.cols, col))")
    d = d.withColumn("by_word", ~shared)
    word_rename = F.expr("regexp_replace(sql, word, new_name)")
    token_rename = F.expr(
        "array_join(transform(raw, (t, i) -> case when exists(sure, r -> at[r.pos] = i) then"
        " regexp_replace(t, concat('(?i)', word, '([\"`]?)$'), concat(new_name, '$1'))"
        " else t end), '')")
    rename = F.col("op") == "rename"
    d = d.withColumn("new_sql", F.when(
        rename, F.when(F.col("by_word"), word_rename).otherwise(token_rename)).otherwise(
        F.when(F.size("hits") == 0, F.col("sql")).when(F.col("by_line"), line_drop)
        .otherwise(token_drop)))
    keys = ["change_id", "catalog", "path", "asset_urn"]
    d = qlog.readable(
        d.drop("tokens", "refs", "projections", "src", "raw", "at", "cut", "lines", "wanted"),
        qlog.shape_tokens(F.coalesce("new_sql", F.lit(""))), "new_ok")
    drop = ~rename
    review = F.array_compact(F.array(
        F.when(drop & (F.size("filters") > 0),
               F.concat(F.lit("`"), F.col("column"), F.lit("` is used in "),
                        F.array_join("filters", ", "),
                        F.lit("; that logic needs manual review"))),
        F.when(drop & F.col("emptied"), F.lit("dropping the column would empty a SELECT list"))))
    found = F.col("sql").isNotNull()
    applicable = found & F.coalesce(F.col("assessable") & F.col("new_ok"), F.lit(False)) & ~(
        drop & F.coalesce(F.col("emptied"), F.lit(False)))
    minimal = F.when(rename, F.col("by_word")).otherwise(
        F.col("by_line") | (F.size("hits") == 0))
    return d.select(
        *keys, "asset_name", F.col("sql").alias("original_sql"),
        F.when(applicable, F.col("new_sql")).otherwise(F.col("sql")).alias("new_sql"),
        applicable.alias("applicable"),
        (applicable & (F.trim("new_sql") != F.trim("sql"))).alias("changed"),
        F.coalesce(review, F.array().cast("array<string>")).alias("needs_review"),
        F.when(~applicable, "manual").when(minimal, "minimal").otherwise("regenerated")
        .alias("method"),
        F.when(found & ~F.col("assessable"), "model text is not readable").alias("error"))


def residual_lines(patched: DataFrame) -> DataFrame:
    """Lines of patched texts that still name a dropped column.

    `patched(change_id, path, new_sql, column, op)`.
    """
    rows = patched.where((F.col("op") == "drop") & F.lower("path").endswith(".sql")).select(
        "change_id", "path", "column", F.posexplode(F.split("new_sql", "\n")).alias("i", "line"))
    word = F.concat(F.lit(r"(?i)\b"), F.regexp_replace("column", r"([^\w])", r"\\$1"),
                    F.lit(r"\b"))
    return rows.where(F.regexp_like("line", word)).select(
        "change_id", "path", (F.col("i") + 1).alias("line_no"),
        F.substring(F.trim("line"), 1, 80).alias("excerpt"))
