"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.scale import cut_lineage, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For what is materialised: shuffle files go with the query that wrote them, since its result is a
#: table and they are not read again; rows reach Python workers in small batches.
SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
           "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """Runs queries under SPARING; the session's own settings stand again after it."""
    own = {key: spark.conf.get(key) for key in SPARING}
    try:
        for key, value in SPARING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared checkpoint folder, and read again by column."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with sparing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps between the tasks of an operator.

    Workers serve one operator after the other; what others kept goes, so that their tables do not
    add up, and so does the memory they freed but the process still holds.
    """
    others = [k for k in _caches if k != owner]
    for other in others:
        del _caches[other]
    if others:
        _give_back()
    return _caches.setdefault(owner, {})


def _give_back() -> None:
    """Freed memory goes back to the system, as far as the C library offers it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


#: Bits of the filter on keys; its size is fixed, a larger corpus only gets more false hits.
KEY_BITS = 1 << 23


def maybe_in(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """Adds `flag`: false where `column` is certainly not in `keys` (one column of that name).

    The keys are folded into a bit table of fixed size, at most KEY_BITS / 64 rows, and that is
    what is broadcast.
    """
    def bit():
        return F.pmod(F.xxhash64(column), F.lit(KEY_BITS))

    bits = keys.select(bit().alias("_b")).groupBy(F.floor(F.col("_b") / 64).alias("_w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_b % 64 AS int)))").alias("_v"))
    met = df.withColumn("_b", bit()).join(F.broadcast(bits), F.floor(F.col("_b") / 64) == F.col("_w"), "left")
    hit = F.expr("shiftrightunsigned(_v, cast(_b % 64 AS int)) & 1L") == 1
    return met.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_b", "_w", "_v")


def having_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `df` whose doc_id is in `ids` (one column, doc_id, distinct).

    The bit table drops most other rows before the shuffle join; the join decides.
    """
    some = maybe_in(df, "doc_id", ids, "_maybe").where("_maybe").drop("_maybe")
    return some.join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")),
                     "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    Alternates the large-star and small-star steps until neither changes an edge, so the number of
    rounds grows with the logarithm of the longest chain and has no limit of its own.  Each round
    is two shuffles of the edges; the label of a node is found by an aggregate that combines before
    the shuffle, so a hub is no hot spot.
    """
    with sparing(edges.sparkSession):
        e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                     F.least("a", "b").alias("b")).distinct())
        same = False
        while not same:
            both = e.union(e.select("b", "a"))
            low = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m"))
                              .select("a", F.least("a", "m").alias("m")))
            large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"),
                                                                F.col("m").alias("b")))
            large = large.where("a <> b").distinct()
            large = cut_lineage(large)
            low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
            small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .union(low.select("a", F.col("m").alias("b"))))
            small = cut_lineage(small.distinct())
            same = small.count() == e.count() and small.exceptAll(e).isEmpty()
            e = small
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
