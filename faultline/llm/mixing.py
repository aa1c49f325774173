"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target over its size is the number of copies f its documents need on average.  The whole
part of f is certain for every document.  The rest R of the target, in words, is sampled with
probabilities in proportion to size, p = min(1, c * size), with c such that the expected words are
R: documents whose p is 1 are certain, the others are ranked by their random odds u/(1-u) over their
inclusion odds p/(1-p).  They are taken in that order until R is filled (a document counts when at
least half of it fits), so the sample is fixed in words, to within half a document.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; a source
without words has target 0; documents without words are ranked last; rows of one source alike in id and size are taken together; an empty
table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from faultline.llm.frames import table
from faultline.scale import cut_lineage, number_rows

WORD = r"[^\x20\x09-\x0D]+"
#: Least number of bins of a source's ranks, and documents aimed at in one.
BINS, BIN_ROWS = 1024, 1 << 14
MOST = 3
#: Inclusion probabilities of documents that are ranked are kept this far from 0 and 1.
CLOSE = 1e-12
#: Sources whose targets are broadcast; more are joined by shuffle.
SENT_SOURCES = 10_000


def draw(row_id: Column, seed: str) -> Column:
    """A uniform value in (0, 1) that depends on the id and the seed alone."""
    hashed = F.md5(F.concat_ws("|", F.lit(seed), row_id.cast("string")))
    whole = F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long")
    return (whole.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: int = 3) -> DataFrame:
    """Per source: weights 1, 2, 3, 1, ... share all words, none above 3 times its source.

    The excess of capped sources is shared again by weight: in order of size over weight the
    capped ones come first, so one pass of running sums finds where capping ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_last", F.col("source").isNull().cast("int")).withColumn("_all", F.lit(0))
    ranked = number_rows(per, ["_all"], ["_last", F.col("source")], "_rank")
    ranked = ranked.withColumn("_w", (F.col("_rank") - 1) % weights + 1).withColumn(
        "_ratio", F.col("source_size") / F.col("_w"))
    placed = cut_lineage(ranked.repartitionByRange("_ratio", "_rank")).withColumn(
        "_part", F.spark_partition_id())
    inside = W.partitionBy("_part").orderBy("_ratio", "_rank").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.sum("source_size").alias("_ps"), F.sum("_w").alias("_pw"))
    # one row per partition, not per source
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = parts.select("_part", F.coalesce(F.sum("_ps").over(ahead), zero).alias("_bs"),
                         F.coalesce(F.sum("_pw").over(ahead), zero).alias("_bw"))
    total = placed.agg(F.sum("source_size").alias("_ts"), F.sum("_w").alias("_tw"))
    run = (placed.join(parts, "_part").crossJoin(F.broadcast(total))  # one row
           .withColumn("_cs", F.col("_bs") + F.coalesce(F.sum("source_size").over(inside), zero))
           .withColumn("_cw", F.col("_bw") + F.coalesce(F.sum("_w").over(inside), zero))
           .withColumn("_over", F.col("_ts") - MOST * F.col("_cs"))
           .withColumn("_lw", F.col("_tw") - F.col("_cw"))
           .withColumn("_free", F.col("_over") * F.col("_w") <= MOST * F.col("source_size") * F.col("_lw")))
    run = cut_lineage(run)
    first = run.where("_free").agg(F.min(F.struct("_ratio", "_rank", "_over", "_lw")).alias("_f"))
    shared = F.col("_f._over") * F.col("_w") / F.col("_f._lw")
    capped = F.struct("_ratio", "_rank") < F.struct("_f._ratio", "_f._rank")
    return run.crossJoin(F.broadcast(first)).select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, 0.0)
        .when(F.col("_f").isNull() | capped, (MOST * F.col("source_size")).cast("double"))
        .otherwise(shared.cast("double")).alias("target"))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """Adds the word count and the random value of each row."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("_size", count).withColumn("_u", draw(F.col("doc_id"), seed))


def inclusion(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source of `wanted` (with `_rest`): c, the largest size that is ranked, typical odds, bins.

    The certain documents are the largest ones.  Seen from the largest size down, the first size
    whose own p stays below 1 is where they end.
    """
    sizes = rows.where("_size > 0").groupBy("source", "_size").agg(F.count("*").alias("_n"))
    larger = W.partitionBy("source").orderBy(F.desc("_size")).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("source").orderBy("_size").rowsBetween(W.unboundedPreceding, 0)
    words, squares = F.col("_n") * F.col("_size"), F.col("_n") * F.col("_size") * F.col("_size")
    sums = sizes.select(
        F.col("source").alias("_s"), "_size", F.coalesce(F.sum(words).over(larger), F.lit(0)).alias("_certain"),
        F.sum(squares).over(upto).alias("_squares"), F.sum(words).over(upto).alias("_ranked"),
        F.sum("_n").over(upto).alias("_docs"))
    met = sums.join(wanted, sums["_s"].eqNullSafe(wanted["_source"]))
    c = (F.col("_rest") - F.col("_certain").cast("double")) / F.col("_squares").cast("double")
    met = met.withColumn("_c", c).where(F.col("_c") * F.col("_size") < 1)
    mean = F.col("_squares").cast("double") / F.col("_ranked")
    found = met.groupBy("_s").agg(F.max(F.struct("_size", "_c", mean.alias("_mean"), "_docs")).alias("_x"))
    return wanted.join(found, wanted["_source"].eqNullSafe(found["_s"]), "left").select(
        *wanted.columns, F.coalesce("_x._c", F.lit(0.0)).alias("_c"), F.coalesce("_x._size", F.lit(0)).alias("_limit"),
        odds(F.coalesce(F.col("_x._c") * F.col("_x._mean"), F.lit(0.5))).alias("_typical"),
        F.greatest(F.lit(BINS), F.ceil(F.coalesce("_x._docs", F.lit(0)) / BIN_ROWS)).cast("int").alias("_bins"))


def odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(CLOSE)), F.lit(1 - CLOSE))
    return p / (1 - p)


def ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of `sized` with their source's values, the Pareto ranking variable `_q` and its bin."""
    # one row per source: counted before it is sent to every executor
    side = F.broadcast(sources) if sources.count() <= SENT_SOURCES else sources
    met = rows.join(side, rows["source"].eqNullSafe(side["_source"]), "left").drop("_source")
    u = F.col("_u")
    q = F.when(F.col("_size") > F.col("_limit"), 0.0).otherwise(
        (u / (1 - u)) / odds(F.col("_c") * F.col("_size")))
    x = F.col("_q") * F.col("_typical")
    place = F.floor(x / (1 + x) * F.col("_bins"))  # grows with the rank, near even for usual sizes
    return met.withColumn("_q", q).withColumn("_bin", F.least(place, F.col("_bins") - 1).cast("int")).drop(
        "_c", "_limit", "_typical", "_bins")


def cuts(rows: DataFrame) -> DataFrame:
    """Per source: target, whole copies, and the last rank that the sample takes.

    The ranking needs running sums within a source, which may hold most rows.  Ranks are cut into
    bins; sums per (source, bin) show in which bin a source fills up, and only the rows of that bin
    are sorted.
    """
    wanted = targets(rows.select("source", F.col("_size").alias("size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = wanted.withColumn("_whole", whole.cast("int")).withColumn(
        "_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    wanted = cut_lineage(inclusion(rows, cut_lineage(wanted.withColumnRenamed("source", "_source"))))
    binned = ranked(rows.select("doc_id", "source", "_size", "_u"), wanted)
    sums = binned.groupBy("source", "_bin").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"))
    upto = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
    full = cut_lineage(sums.where((F.col("_before") <= F.col("_rest"))
                                  & (F.col("_before") + F.col("_words") > F.col("_rest")))
                       .select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), "_before"))
    met = binned.join(full, binned["source"].eqNullSafe(full["_s"]) & (F.col("_bin") == F.col("_b")))
    run = W.partitionBy("_s").orderBy("_q", "doc_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    met = met.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_size").over(run), F.lit(0)))
    taken = F.when(F.col("_at") + F.col("_size") / 2.0 <= F.col("_rest"),
                   F.struct("_q", "doc_id", "_size"))
    last = met.groupBy("_s").agg(F.max(taken).alias("_last"), F.min("_b").alias("_b"))
    return cut_lineage(wanted.join(last, wanted["_source"].eqNullSafe(last["_s"]), "left").drop("_s"))


def mix(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows of `sized` with `source_size`, `target` and `copies`."""
    met = ranked(rows, cut)
    upto = F.struct("_q", "doc_id", "_size") <= F.col("_last")
    more = F.coalesce((F.col("_bin") < F.col("_b")) | upto, F.lit(False)).cast("int")
    return met.withColumn("copies", F.col("_whole") + more).drop(
        "_whole", "_rest", "_last", "_b", "_u", "_q", "_bin")


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it was taken, with the columns of `docs`.

    The columns travel as one value, so they may have any names.
    """
    rows = sized(docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")),
                 seed)
    cut = cuts(cut_lineage(rows.select("doc_id", "source", "_size", "_u")))
    rows = mix(rows, cut).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = cut_lineage(sized(docs, "mix").drop("text"))
    return mix(rows, cuts(rows)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target",
        (F.col("copies") * F.col("_size")).cast("long").alias("taken"))
