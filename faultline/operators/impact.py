"""Which consumers a column change touches, for many changes at once.

The log is read once: it is grouped to (catalog, shape, team) cells with run
counts, each shape is scanned once, and its references are turned into rows
keyed by (dataset, column).  Changes meet those rows in equi-joins.  Consumers
that stay safe are counted as the rest of the log, never enumerated, and what
could not be read is taken out of that rest first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import expr as X
from ..scale import broadcast_if_small, cut_lineage, number_rows
from . import qlog

CONFIDENCE = ("high", "medium", "low")


@dataclass(frozen=True)
class Catalog:
    """The tables that describe one or many catalogs (see `model`)."""

    datasets: DataFrame
    columns: DataFrame
    queries: DataFrame
    assets: DataFrame
    catalogs: DataFrame | None = None


# ---------------------------------------------------------------- lookups
def dataset_by_bare_name(datasets: DataFrame) -> DataFrame:
    """First dataset in catalog order for each last name segment."""
    return (datasets.groupBy("catalog", X.bare_name("sql_name").alias("bare"))
            .agg(F.min_by("urn", "ds_pos").alias("ds_urn")))


def dataset_columns(columns: DataFrame) -> DataFrame:
    return columns.groupBy("catalog", F.col("urn").alias("ds_urn")).agg(
        F.collect_set(F.lower("column")).alias("cols"))


def first_assets(assets: DataFrame) -> DataFrame:
    """The first asset that names each query."""
    return (assets.where(F.col("defining_query_id").isNotNull())
            .groupBy("catalog", F.col("defining_query_id").alias("query_id"))
            .agg(F.min_by(F.struct("urn", "name", "type", "model_path"), "a_pos").alias("a"))
            .select("catalog", "query_id", F.col("a.urn").alias("asset_urn"),
                    F.col("a.name").alias("asset_name"), F.col("a.type").alias("asset_type"),
                    F.col("a.model_path").alias("model_path")))


def undefined_assets(catalog: Catalog, index: Index | None = None) -> DataFrame:
    """Assets no query of the log defines: consumers nobody can read."""
    log = catalog.queries if index is None else index.defined
    known = log.select("catalog", F.col("query_id").alias("defining_query_id"))
    return catalog.assets.join(known.distinct(), ["catalog", "defining_query_id"], "left_anti")


def resolve_changes(changes: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds target_urn, sql_name, schema_known and has_column to every change."""
    ds = catalog.datasets
    exact = (ds.select("catalog", "ds_pos", "urn",
                       F.explode(F.array("urn", "name", "sql_name")).alias("dataset"))
             .groupBy("catalog", "dataset").agg(F.min_by("urn", "ds_pos").alias("exact_urn")))
    out = (changes.withColumn("bare", X.bare_name("dataset"))
           .join(exact, ["catalog", "dataset"], "left")
           .join(dataset_by_bare_name(ds), ["catalog", "bare"], "left")
           .withColumn("target_urn", F.coalesce("exact_urn", "ds_urn"))
           .drop("exact_urn", "ds_urn", "bare"))
    names = ds.groupBy("catalog", F.col("urn").alias("target_urn")).agg(
        F.min_by("sql_name", "ds_pos").alias("sql_name"))
    cols = dataset_columns(catalog.columns).withColumnRenamed("ds_urn", "target_urn")
    return (out.join(names, ["catalog", "target_urn"], "left")
            .join(cols, ["catalog", "target_urn"], "left")
            .withColumn("schema_known", F.coalesce(F.size("cols") > 0, F.lit(False)))
            .withColumn("has_column", F.coalesce(
                F.array_contains("cols", F.lower("column")), F.lit(False)))
            .drop("cols"))


def parse_changes(texts: DataFrame, text: str = "change") -> DataFrame:
    """`drop ds.col` / `rename ds.col new` to columns; a bad text gets an `error` instead."""
    word = F.split(F.trim(F.col(text)), r"\s+")
    ref = F.get(word, F.lit(1))
    out = (texts.withColumn("op", F.lower(F.get(word, F.lit(0))))
           .withColumn("dataset", F.regexp_extract(ref, r"^(.*)[.]([^.]*)$", 1))
           .withColumn("column", F.regexp_extract(ref, r"([^.]*)$", 1))
           .withColumn("new_name", F.get(word, F.lit(2))))
    return out.withColumn(
        "error",
        F.when(~F.coalesce(F.col("op").isin("drop", "rename"), F.lit(False)), "unknown operation")
        .when(ref.isNull() | (F.col("column") == "") | (F.col("dataset") == ""),
              "no dataset.column given")
        .when((F.col("op") == "rename") & F.col("new_name").isNull(),
              "rename requires a new name"))


# ---------------------------------------------------------------- the index
@dataclass(frozen=True)
class Index:
    """A scanned log.

    cells    (catalog, shape_id, team, n, runs)
    texts    (text_id, shape_id): shapes of the plain texts, so that rows need no tokens
    defined  rows of the log that some asset names, with shape_id in place of the text
    shapes   (catalog, shape_id, assessable)
    usage    (catalog, shape_id, ds_urn, column, usage, confidence, clauses, star)
    stars    (catalog, shape_id, ds_urn, confidence)
    """

    cells: DataFrame
    texts: DataFrame
    defined: DataFrame
    shapes: DataFrame
    usage: DataFrame
    stars: DataFrame


def attach_sources(scanned: DataFrame, catalog: Catalog, keys: tuple[str, ...]) -> DataFrame:
    """Adds `src`: the sources of a statement with their dataset and the columns it provides,
    cut to the names the statement uses."""
    names = F.array_distinct(F.transform("refs", lambda r: r["name"]))
    rows = scanned.select(*keys, names.alias("names"),
                          F.posexplode("sources").alias("ord", "s"))
    known = (dataset_by_bare_name(catalog.datasets)
             .join(dataset_columns(catalog.columns), ["catalog", "ds_urn"], "left"))
    rows = rows.select(*keys, "names", "ord", F.col("s.name").alias("bare"),
                       F.col("s.alias").alias("alias")).join(known, ["catalog", "bare"], "left")
    cols = F.coalesce("cols", F.array().cast("array<string>"))
    src = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "ord", "bare", "alias", "ds_urn", (F.size(cols) > 0).alias("known"),
        F.array_intersect(cols, F.col("names")).alias("cols")))).alias("src"))
    return scanned.join(src, list(keys))


# References of a statement attributed to datasets; fail-closed rules in order: a qualifier
# means the first source that answers to it; otherwise the sources that provide the column,
# ambiguous when several do; otherwise a guess when some source's schema is unknown.
_USES = """
flatten(transform(refs, r -> case
  when r.qualifier <> '' then transform(
    filter(slice(filter(src, s -> s.bare = r.qualifier or s.alias = r.qualifier), 1, 1),
           s -> s.ds_urn is not null),
    s -> named_struct('ds_urn', s.ds_urn, 'column', r.name, 'clause', r.clause, 'conf', 0))
  when exists(src, s -> array_contains(s.cols, r.name)) then transform(
    array_distinct(transform(filter(src, s -> array_contains(s.cols, r.name)), s -> s.ds_urn)),
    u -> named_struct('ds_urn', u, 'column', r.name, 'clause', r.clause, 'conf', case
      when size(filter(src, s -> array_contains(s.cols, r.name))) > 1 then 2
      when exists(src, s -> not s.known) then 1 else 0 end))
  else transform(
    filter(array_distinct(transform(filter(src, s -> s.ds_urn is not null), s -> s.ds_urn)),
           u -> exists(src, s -> not s.known and not (s.ds_urn <=> u))),
    u -> named_struct('ds_urn', u, 'column', r.name, 'clause', r.clause, 'conf', 1))
  end))
"""
# The first star that can carry a dataset's columns: any bare star, or its own `t.*`.
_STARS = """
filter(transform(
  array_distinct(transform(filter(src, s -> s.ds_urn is not null), s -> s.ds_urn)),
  u -> named_struct('ds_urn', u, 'star', get(filter(stars, t -> t.qualifier = '' or
    exists(src, s -> s.ds_urn <=> u and (s.bare = t.qualifier or s.alias = t.qualifier))), 0))),
  x -> x.star is not null)
"""


# What a write needs of its target: the columns it lists, else all of them.  A table that the
# statement makes has none to lose.
_WRITES = """
flatten(transform(filter(targets, t -> not t.made), t -> flatten(transform(
  filter(wrote, s -> s.ds_urn is not null), s -> transform(t.listed, c ->
    named_struct('ds_urn', s.ds_urn, 'column', c, 'clause', 'insert', 'conf', 0))))))
"""
_FILLS = """
flatten(transform(filter(targets, t -> not t.made and size(t.listed) = 0), t -> transform(
  filter(wrote, s -> s.ds_urn is not null), s -> named_struct('ds_urn', s.ds_urn, 'star',
    named_struct('depth', 0, 'pos', 0, 'qualifier', t.bare)))))
"""


def attribute(scanned: DataFrame, catalog: Catalog,
              keys: tuple[str, ...] = ("catalog", "shape_id")) -> DataFrame:
    """One row per readable statement with arrays `uses` and `star_of`."""
    target = F.transform("targets", lambda t: F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("pos"), t["bare"].alias("name"), F.lit("").alias("alias")))
    readable = scanned.where("assessable").select(
        *keys, F.concat("sources", target).alias("sources"), F.size("sources").alias("read"),
        F.concat("refs", "readings").alias("refs"), "stars", "targets").where(F.size("sources") > 0)
    src = attach_sources(readable, catalog, keys)
    src = src.withColumn("wrote", F.filter("src", lambda s: s["ord"] >= F.col("read"))).withColumn(
        "src", F.filter("src", lambda s: s["ord"] < F.col("read")))
    return src.select(*keys, F.expr(f"concat({_USES}, {_WRITES})").alias("uses"),
                      F.expr(f"concat({_STARS}, {_FILLS})").alias("star_of"))


def write_edges(log: DataFrame, catalog: Catalog) -> DataFrame:
    """(catalog, up, down, statements, runs): datasets that statements read to write others.

    A dataset of the catalog goes by its urn, a target outside it by its name as written.
    """
    shaped = cut_lineage(qlog.with_shape(log).groupBy("catalog", "shape_id").agg(
        F.first("tokens").alias("tokens"), F.count("*").alias("statements"), F.sum("runs").alias("runs")))
    found = qlog.scan(shaped).select("catalog", "shape_id", "statements", "runs", "sources",
                                     F.inline("targets"))
    urns = dataset_by_bare_name(catalog.datasets).select("catalog", "bare", "ds_urn")
    down = found.join(urns, ["catalog", "bare"], "left").select(
        "catalog", "shape_id", "statements", "runs", F.coalesce("ds_urn", "name").alias("down"),
        F.explode(F.array_distinct(F.transform("sources", lambda s: s["name"]))).alias("bare"))
    edges = down.join(urns, ["catalog", "bare"]).select(
        "catalog", "shape_id", F.col("ds_urn").alias("up"), "down", "statements", "runs").distinct()
    return edges.groupBy("catalog", "up", "down").agg(F.sum("statements").alias("statements"),
                                                      F.sum("runs").alias("runs"))


def usage_rows(attributed: DataFrame, keys: tuple[str, ...] = ("catalog", "shape_id"),
               ) -> tuple[DataFrame, DataFrame]:
    """(usage, stars): explicit use per (dataset, column), and datasets carried by a star."""
    stars = attributed.select(*keys, F.explode("star_of").alias("s")).select(
        *keys, F.col("s.ds_urn").alias("ds_urn"),
        F.when(F.col("s.star.qualifier") == "", "medium").otherwise("high").alias("confidence"))
    starred = F.transform("star_of", lambda s: s["ds_urn"])
    use = attributed.select(*keys, starred.alias("starred"), F.explode("uses").alias("u"))
    is_select = F.col("u.clause") == "select"
    grouped = use.groupBy(*keys, F.col("u.ds_urn").alias("ds_urn"),
                          F.col("u.column").alias("column")).agg(
        F.bool_or(is_select).alias("sel"),
        F.min(F.when(is_select, F.col("u.conf"))).alias("sel_conf"),
        F.min(F.when(~is_select, F.col("u.conf"))).alias("fil_conf"),
        F.collect_set("u.clause").alias("clauses"), F.first("starred").alias("starred"))
    conf = F.when(F.col("sel"), F.col("sel_conf")).otherwise(F.col("fil_conf"))
    usage = grouped.select(
        *keys, "ds_urn", "column", F.when(F.col("sel"), "select").otherwise("filter").alias("usage"),
        F.get(F.array(*[F.lit(c) for c in CONFIDENCE]), conf).alias("confidence"),
        F.sort_array("clauses").alias("clauses"),
        F.array_contains("starred", F.col("ds_urn")).alias("star"))
    return usage, stars


def build_index(catalog: Catalog) -> Index:
    """Read the log once, scan every shape once."""
    texts = catalog.queries.groupBy("catalog", "team", qlog.plain_text("sql").alias("sql")).agg(
        F.count("*").alias("n"), F.sum("runs").alias("runs"))
    shaped = cut_lineage(qlog.with_shape(texts).drop("tokens"))
    cells = cut_lineage(shaped.groupBy("catalog", "shape_id", "team").agg(
        F.sum("n").alias("n"), F.sum("runs").alias("runs"), F.first("sql").alias("sql")))
    one = cells.groupBy("catalog", "shape_id").agg(F.first("sql").alias("sql"))
    scanned = cut_lineage(qlog.scan(one.withColumn("tokens", qlog.shape_list("sql")).drop("sql"))
                          .drop("tokens", "projections", "outputs"))
    usage, stars = usage_rows(cut_lineage(attribute(scanned, catalog)))
    ids = shaped.groupBy(qlog.text_id("sql").alias("text_id")).agg(F.first("shape_id").alias("shape_id"))
    shapes = scanned.select("catalog", "shape_id", "assessable")
    ids = broadcast_if_small(ids)
    return Index(cells.drop("sql"), ids, cut_lineage(defined_rows(catalog, ids)), broadcast_if_small(shapes),
                 usage, stars)


def defined_rows(catalog: Catalog, texts: DataFrame) -> DataFrame:
    """Rows of the log that some asset names, picked out once for all that only asks for those."""
    named = catalog.assets.where(F.col("defining_query_id").isNotNull()).select(
        "catalog", F.col("defining_query_id").alias("query_id")).distinct()
    rows = catalog.queries.join(broadcast_if_small(named), ["catalog", "query_id"], "left_semi")
    return qlog.with_known_shape(rows, texts).drop("sql")


# ---------------------------------------------------------------- roll-ups
def catalog_totals(catalog: Catalog, index: Index) -> DataFrame:
    """Consumers per catalog and how many of them nobody could read."""
    q = (index.cells.join(index.shapes, ["catalog", "shape_id"]).groupBy("catalog").agg(
        F.sum("n").alias("nq"),
        F.sum(F.when(~F.col("assessable"), F.col("n")).otherwise(0)).alias("bad")))
    blind = undefined_assets(catalog, index).groupBy("catalog").agg(F.count("*").alias("blind"))
    out = q.join(blind, "catalog", "full").na.fill(0, ["nq", "bad", "blind"])
    return out.select("catalog", (F.col("nq") + F.col("blind")).alias("queries_total"),
                      (F.col("bad") + F.col("blind")).alias("unknown"))


def team_cells(wanted: DataFrame, index: Index) -> DataFrame:
    """(id, team) cells of breaks, degrades and ambiguous consumers for the wanted columns.

    `wanted(id, catalog, ds_urn, column, carries)`: `carries` tells whether a star over the
    dataset carries the column.
    """
    log = index.cells
    hit = index.usage.join(log, ["catalog", "shape_id"]).groupBy(
        "catalog", "ds_urn", "column", "team").agg(
        *[F.sum(F.when(cond, F.col(what)).otherwise(0)).alias(name) for name, cond, what in (
            ("breaks", F.col("confidence") != "low", "n"),
            ("break_runs", F.col("confidence") != "low", "runs"),
            ("ambiguous", F.col("confidence") == "low", "n"),
            ("star_n", F.col("star"), "n"), ("star_runs", F.col("star"), "runs"))])
    star = index.stars.join(log, ["catalog", "shape_id"]).groupBy(
        "catalog", "ds_urn", "team").agg(F.sum("n").alias("n"), F.sum("runs").alias("sruns"))
    w = wanted.select("id", "catalog", "ds_urn", F.lower("column").alias("column"), "carries")
    named = w.join(hit, ["catalog", "ds_urn", "column"]).select(
        "id", "team", "breaks", "break_runs", "ambiguous",
        F.when(F.col("carries"), -F.col("star_n")).otherwise(0).alias("degrades"),
        F.when(F.col("carries"), -F.col("star_runs")).otherwise(0).alias("degrade_runs"))
    zero = F.lit(0).cast("bigint")
    carried = w.where("carries").join(star, ["catalog", "ds_urn"]).select(
        "id", "team", zero.alias("breaks"), zero.alias("break_runs"), zero.alias("ambiguous"),
        F.col("n").alias("degrades"), F.col("sruns").alias("degrade_runs"))
    return named.unionByName(carried).groupBy("id", "team").agg(
        *[F.sum(c).alias(c) for c in ("breaks", "break_runs", "ambiguous", "degrades",
                                      "degrade_runs")])


def fold_cells(cells: DataFrame) -> DataFrame:
    """(id, team) cells to counts per id."""
    touched = (F.col("breaks") + F.col("degrades") > 0) & (
        F.length(F.coalesce("team", F.lit(""))) > 0)
    return cells.groupBy("id").agg(
        F.sum("breaks").alias("breaks"), F.sum("degrades").alias("degrades"),
        F.sum("ambiguous").alias("ambiguous"),
        F.sum(F.col("break_runs") + F.col("degrade_runs")).alias("runs_impacted"),
        F.count_if(touched).alias("teams"),
        F.sort_array(F.collect_list(F.when(touched, F.col("team")))).alias("teams_impacted"))


def finish_counts(rows: DataFrame) -> DataFrame:
    """Counts to coverage, risk and review columns.

    Needs breaks, degrades, ambiguous, unknown, queries_total, runs_impacted, teams.
    """
    out = rows.withColumn("unassessed", F.col("unknown")).withColumn(
        "analysed", F.col("queries_total") - F.col("unknown")).withColumn(
        "safe", F.col("analysed") - F.col("breaks") - F.col("degrades") - F.col("ambiguous"))
    out = out.withColumn("score", X.risk_score()).withColumn("level", X.risk_level())
    return (out.withColumn("level_qualifier", X.level_qualifier())
            .withColumn("coverage", X.coverage_line())
            .withColumn("review_required", (F.col("unknown") > 0) | (F.col("ambiguous") > 0))
            .withColumn("auto_applicable", ~F.col("review_required")))


SUMMARY = ("breaks", "degrades", "safe", "unknown", "ambiguous", "queries_total", "analysed",
           "unassessed", "runs_impacted", "teams", "teams_impacted", "score", "level",
           "level_qualifier", "coverage", "review_required", "auto_applicable")
_COUNTS = ["breaks", "degrades", "ambiguous", "runs_impacted", "teams"]


def impact_summary(changes: DataFrame, catalog: Catalog, index: Index) -> DataFrame:
    """One row per change; a change whose dataset is unknown keeps a row and a note."""
    target = resolve_changes(changes, catalog)
    wanted = target.where(F.col("target_urn").isNotNull()).select(
        F.col("change_id").alias("id"), "catalog", F.col("target_urn").alias("ds_urn"), "column",
        (F.col("has_column") | ~F.col("schema_known")).alias("carries"))
    counts = fold_cells(team_cells(wanted, index)).withColumnRenamed("id", "change_id")
    found = F.col("target_urn").isNotNull()
    rows = (target.join(counts, "change_id", "left")
            .join(catalog_totals(catalog, index), "catalog", "left"))
    for c in ("queries_total", "unknown"):
        rows = rows.withColumn(c, F.when(found, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)))
    rows = finish_counts(rows.na.fill(0, _COUNTS).withColumn(
        "teams_impacted", F.coalesce("teams_impacted", F.array().cast("array<string>"))))
    note = (F.when(~found, F.concat(F.lit("target dataset '"), F.col("dataset"),
                                    F.lit("' not found in catalog")))
            .when(~F.col("has_column"),
                  F.concat(F.lit("column '"), F.col("column"),
                           F.lit("' is not in the current schema; references assessed anyway"))))
    return rows.select("change_id", "catalog", X.describe_change().alias("change"), "dataset",
                       "column", "op", "new_name", "target_urn", "schema_known", "has_column",
                       *SUMMARY, note.alias("note"))


def column_candidates(catalog: Catalog) -> DataFrame:
    """Every column of every dataset as a change target, resolved like any other change."""
    ds = catalog.datasets.select("catalog", "ds_pos", "urn", "name", "sql_name")
    cand = ds.join(catalog.columns.select("catalog", "urn", "col_pos", "column"),
                   ["catalog", "urn"])
    return cand.select(
        F.concat_ws("|", "catalog", F.col("ds_pos").cast("string"),
                    F.col("col_pos").cast("string")).alias("id"),
        "catalog", "ds_pos", "col_pos", F.col("urn").alias("dataset_urn"),
        F.col("name").alias("dataset_name"), F.col("sql_name").alias("dataset"), "column")


def fragility(catalog: Catalog, index: Index, top: int | None = None) -> DataFrame:
    """Every column scored as if dropped, ranked per catalog, untouched columns at 0."""
    cand = column_candidates(catalog)
    target = resolve_changes(cand.select(F.col("id").alias("change_id"), "catalog", "dataset",
                                         "column"), catalog)
    wanted = target.select(F.col("change_id").alias("id"), "catalog",
                           F.col("target_urn").alias("ds_urn"), "column",
                           (F.col("has_column") | ~F.col("schema_known")).alias("carries"))
    counts = fold_cells(team_cells(wanted, index))
    rows = (cand.join(counts, "id", "left")
            .join(catalog_totals(catalog, index), "catalog", "left")
            .na.fill(0, [*_COUNTS, "queries_total", "unknown"]))
    rows = finish_counts(rows.withColumn(
        "teams_impacted", F.coalesce("teams_impacted", F.array().cast("array<string>"))))
    ranked = number_rows(rows, ["catalog"], [
        F.desc("score"), F.desc("breaks"), F.desc("runs_impacted"), F.desc("degrades"),
        "ds_pos", "col_pos"], "position")
    if top:
        ranked = ranked.where(F.col("position") <= top)
    return ranked.select("id", "catalog", "position", "dataset_name", "dataset_urn", "dataset",
                         "column", "ds_pos", "col_pos", *SUMMARY)


# ---------------------------------------------------------------- verdict rows
def shape_verdicts(target: DataFrame, usage: DataFrame, stars: DataFrame,
                   keys: tuple[str, ...] = ("catalog", "shape_id")) -> DataFrame:
    """(change_id, shape keys) rows with usage, confidence and clauses; unused shapes absent."""
    t = target.where(F.col("target_urn").isNotNull()).select(
        "change_id", "catalog", F.col("target_urn").alias("ds_urn"),
        F.lower("column").alias("column"),
        (F.col("has_column") | ~F.col("schema_known")).alias("carries"))
    star_clause = F.array(F.lit("select(*)"))
    named = t.join(usage, ["catalog", "ds_urn", "column"]).select(
        "change_id", *keys, "usage", "confidence",
        F.when(F.col("carries") & F.col("star"),
               F.sort_array(F.concat("clauses", star_clause)))
        .otherwise(F.col("clauses")).alias("clauses"))
    carried = (t.where("carries").join(stars, ["catalog", "ds_urn"])
               .join(named.select("change_id", *keys), ["change_id", *keys], "left_anti")
               .select("change_id", *keys, F.lit("star").alias("usage"), "confidence",
                       star_clause.alias("clauses")))
    return named.unionByName(carried)


VERDICT_COLS = ("change_id", "catalog", "query_id", "verdict", "usage", "clauses", "confidence",
                "team", "runs", "asset_urn", "asset_name", "asset_type", "reason", "q_pos")


def impact_verdicts(changes: DataFrame, catalog: Catalog, index: Index,
                    include_safe: bool = False, assets_only: bool = False) -> DataFrame:
    """One row per change and consumer that breaks, degrades or is unknown.

    `include_safe` adds the consumers proven safe, so the table then has one row
    for every change and consumer of its catalog.  `assets_only` leaves out the
    statements that no asset names, and then the log is not read again.
    """
    target = resolve_changes(changes, catalog)
    meta = target.where(F.col("target_urn").isNotNull()).select(
        "change_id", "catalog", "column", "op", "new_name")
    log = index.defined if assets_only else qlog.with_known_shape(catalog.queries, index.texts)
    log = log.select("catalog", "shape_id", "query_id", "team", "runs", "q_pos")
    # a statement whose shape was not scanned counts as unreadable
    log = log.join(index.shapes, ["catalog", "shape_id"], "left").withColumn(
        "shape_id", F.when(F.col("assessable").isNull(), "").otherwise(F.col("shape_id"))).na.fill(
        False, ["assessable"]).join(
        first_assets(catalog.assets).drop("model_path"), ["catalog", "query_id"], "left")
    hits = shape_verdicts(target, index.usage, index.stars)
    none = F.array().cast("array<string>")
    ids = meta.select("change_id", "catalog")
    unread = index.shapes.where(~F.col("assessable")).select("catalog", "shape_id").unionByName(
        ids.select("catalog", F.lit("").alias("shape_id")).distinct())
    bad = ids.join(unread, "catalog").withColumns({
        "usage": F.lit("parse_error"), "confidence": F.lit("low"), "clauses": none})
    if include_safe:
        read = (meta.select("change_id", "catalog").join(log.where("assessable"), "catalog")
                .join(hits, ["change_id", "catalog", "shape_id"], "left")
                .withColumn("usage", F.coalesce("usage", F.lit("none")))
                .withColumn("confidence", F.coalesce("confidence", F.lit("high")))
                .withColumn("clauses", F.coalesce("clauses", none)))
        hits = bad
    else:
        read, hits = None, hits.unionByName(bad)
    met = log.join(broadcast_if_small(hits), ["catalog", "shape_id"])
    cols = ["change_id", "catalog", "query_id", "team", "runs", "q_pos", "asset_urn",
            "asset_name", "asset_type", "usage", "confidence", "clauses"]
    blind = ids.join(undefined_assets(catalog, index).select(
        "catalog", F.coalesce("defining_query_id", F.concat(F.lit("no_definition:"),
                                                            F.col("urn"))).alias("query_id"),
        F.lit(None).cast("string").alias("team"), F.lit(0).alias("runs"),
        F.col("a_pos").alias("q_pos"), F.col("urn").alias("asset_urn"),
        F.col("name").alias("asset_name"), F.col("type").alias("asset_type")), "catalog"
    ).withColumns({"usage": F.lit("no_definition"), "confidence": F.lit("low"), "clauses": none})
    rows = met.select(*cols).unionByName(blind.select(*cols))
    if read is not None:
        rows = rows.unionByName(read.select(*cols))
    rows = rows.join(meta.drop("catalog"), "change_id")
    return (rows.withColumn("verdict", X.verdict_of("usage"))
            .withColumn("reason", X.verdict_reason()).select(*VERDICT_COLS))


def impacted(verdicts: DataFrame) -> DataFrame:
    """Confident breaks and degrades; order with `impacted_order`."""
    return verdicts.where(F.col("verdict").isin("BREAKS", "DEGRADES") & ~X.is_ambiguous())


def impacted_order() -> list:
    return [X.verdict_rank("verdict"), F.desc("runs"), F.col("q_pos")]


# ---------------------------------------------------------------- text statistics
def most_referenced_columns(catalog: Catalog) -> DataFrame:
    """Whole-word mentions of each column over all raw query text, most mentioned first."""
    words = F.explode(F.regexp_extract_all(F.lower("sql"), F.lit(r"\w+"), F.lit(0)))
    seen = (catalog.queries.select("catalog", words.alias("word")).groupBy("catalog", "word")
            .agg(F.count("*").alias("mentions")))
    cols = catalog.columns.select("catalog", "urn", "column", F.lower("column").alias("word"))
    return (cols.join(seen, ["catalog", "word"]).select("catalog", "urn", "column", "mentions")
            .orderBy("catalog", "urn", F.desc("mentions"), "column"))


def projected_columns(queries: DataFrame) -> DataFrame:
    """Output names of each readable statement's outermost first SELECT."""
    shaped = qlog.with_shape(queries).select("catalog", "query_id", "shape_id", "tokens")
    # Cut before filtering: a pushed-down filter would repeat the scan inside itself.
    scanned = cut_lineage(qlog.scan(qlog.distinct_shapes(shaped)).select(
        "catalog", "shape_id", "assessable", "outputs"))
    return shaped.drop("tokens").join(scanned.where("assessable"), ["catalog", "shape_id"]).select(
        "catalog", "query_id", F.posexplode("outputs").alias("pos", "output"))
