"""Document fingerprints by consistent weighted sampling.

Terms are the lower-cased words of a text, weighted by how many characters they cover.  For every
sample, two gamma variables and a uniform one that depend on the term alone give each term an
arrival; the smallest (term, quantised weight) is the sample.  Two fingerprints agree in a sample
with a probability equal to the generalised Jaccard similarity of the weights.

Defined cases: a null or wordless text has the fingerprint of zeros, alike only to itself; rows of
one id are ordered by text; a single row is its own next document; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import text as T
from faultline.llm.frames import table
from faultline.scale import cut_lineage

SAMPLES = 64
_U = np.uint64
_STREAM = T.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
       "edited_fingerprint string, near_edited double, near_next double")


def _arrivals(term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per term and sample: the log arrival, and a 16-bit name of (term, quantised weight)."""
    one = T.mix(term[:, None] + _STREAM[None, :])
    two = T.mix(one + _U(0x9E3779B97F4A7C15))
    three = T.mix(two + _U(0x9E3779B97F4A7C15))

    def uniform(h, shift):
        return ((h >> _U(shift)) & _U(0xFFFFFF)).astype(np.float32) / np.float32(1 << 24) \
            + np.float32(2.0 ** -25)

    r = -np.log(uniform(one, 0) * uniform(one, 24))
    c = -np.log(uniform(two, 0) * uniform(two, 24))
    beta = uniform(three, 0)
    step = np.floor(np.log(weight.astype(np.float32))[:, None] / r + beta)
    arrival = np.log(c) - r * (step - beta) - r
    name = T.mix(one + step.astype(np.int64).astype(np.uint64)) >> _U(48)
    return arrival, name.astype(np.uint16) | np.uint16(1)


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of samples per text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, SAMPLES), np.uint16)
    start, end, row, h = T.word_hashes(data, offsets)
    if not len(h):
        return out
    first = np.searchsorted(row, np.arange(rows + 1))
    terms, weights, sizes = [], [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        lo, hi = first[r], first[r + 1]
        u, at, n = np.unique(h[lo:hi], return_index=True, return_counts=True)
        terms.append(u)
        weights.append(n * (end[lo + at] - start[lo + at]))
        sizes[r + 1] = len(u)
    term, weight = np.concatenate(terms), np.concatenate(weights)
    _, at, back = np.unique(T.mix(term + weight.astype(np.uint64) * _U(0xA0761D6478BD642F)),
                            return_index=True, return_inverse=True)
    arrival = np.empty((len(at), SAMPLES), np.float32)
    name = np.empty((len(at), SAMPLES), np.uint16)
    for lo in range(0, len(at), 8192):
        part = at[lo:lo + 8192]
        arrival[lo:lo + 8192], name[lo:lo + 8192] = _arrivals(term[part], weight[part])
    bounds, every = np.cumsum(sizes), np.arange(SAMPLES)
    for r in range(rows):
        lo, hi = bounds[r], bounds[r + 1]
        if hi > lo:
            mine = back[lo:hi]
            out[r] = name[mine[arrival[mine].argmin(axis=0)], every]
    return out


def _of(texts: list[str]) -> np.ndarray:
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    parts = [signatures(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
             for a, b in T.chunks(offsets, 2 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, SAMPLES), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""

    def run(batches):
        for batch in batches:
            sig = _of([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.astype("<u2").tobytes().hex() for s in sig], pa.string())],
                ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Ranges of ascending doc_id, each closed by the first row of the next (`_sent`).

    Texts are shuffled once.  The ranges come from a sample of the ids, at most `parts` values;
    their first ids are known before texts move, so a range gets its neighbour's first row too.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_k", key)
    found = docs.select(F.percentile_approx("_k", [i / parts for i in range(1, parts)], 1000)).first()
    cuts = sorted(set(found[0] or []))
    part = F.lit(0)
    if cuts:
        edges = spark.createDataFrame([(cuts,)], "_cuts array<long>")
        docs = docs.crossJoin(F.broadcast(edges))  # one row of at most `parts` values
        part = F.size(F.filter("_cuts", lambda c: c <= F.col("_k")))
        docs = docs.withColumn("_part", part).drop("_cuts")
    else:
        docs = docs.withColumn("_part", part)
    heads = [tuple(r) for r in docs.groupBy("_part").agg(F.min("_k")).orderBy("_part").collect()]
    if not heads:
        return docs.withColumn("_sent", F.lit(False))
    # the first row of each range also closes the range before; the very first closes the last
    closes = spark.createDataFrame([(h[0], h[1], heads[i - 1][0]) for i, h in enumerate(heads)],
                                   "_part int, _head long, _before int")
    met = docs.join(F.broadcast(closes), "_part")  # a row per range
    to = F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("s")))
    both = F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("s")),
                   F.struct(F.col("_before").alias("p"), F.lit(True).alias("s")))
    met = met.select("doc_id", "text", "_k", F.explode(
        F.when(F.col("_k") == F.col("_head"), both).otherwise(to)).alias("_to"))
    met = met.select("doc_id", "text", "_k", F.col("_to.p").alias("_part"), F.col("_to.s").alias("_sent"))
    return met.repartition(parts, "_part").sortWithinPartitions("_part", "_sent", "_k", "text")


def edited_pairs(docs: DataFrame, parts: int) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how like they are.

    The edited text ends in as many characters of the next document as were cut from its end.
    """

    def close(rows, after):
        """Result rows of `rows`, given the text that follows the last."""
        texts = [t for _, t in rows]
        follow = texts[1:] + [after]
        cut = [len(t) // 4 for t in texts]
        edited = [t[:len(t) - q] + f[:q] for t, q, f in zip(texts, cut, follow)]
        sig, new = _of(texts + [after]), _of(edited)
        near, ahead = likeness(sig[:-1], new), likeness(sig[:-1], sig[1:])
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in rows], pa.int64()), pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([s.astype("<u2").tobytes().hex() for s in sig[:-1]]),
            pa.array([s.astype("<u2").tobytes().hex() for s in new]),
            pa.array(near, pa.float64()), pa.array(ahead, pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"])

    def run(batches):
        rows, part, held = [], None, 0
        for batch in batches:
            for doc, t, p, sent in zip(*(c.to_pylist() for c in batch.columns)):
                t = t or ""
                if sent:
                    if rows and p == part:
                        yield close(rows, t)
                        rows, held = [], 0
                    continue
                if p != part:
                    rows, part, held = [], p, 0
                rows.append((doc, t))
                held += len(t)
                if held > 4 << 20 and len(rows) > 1:
                    yield close(rows[:-1], t)
                    rows, held = rows[-1:], len(t)

    ordered = in_order(docs, parts).select("doc_id", "text", "_part", "_sent")
    return ordered.mapInArrow(run, OUT)


def op2_consistent_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return edited_pairs(table(spark, sf_dir, "documents"), parts)
