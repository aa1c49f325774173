"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

A text is the multiset of its k-word shingles; a bit of its fingerprint is 1 if more than half of
the shingle hashes have it.  Two fingerprints link when they differ in at most `radius` bits.  Then
some value lies within half the radius of both, so every distinct fingerprint emits all values
within half the radius of itself, and those that meet on a value are linked.  A value is met by no
more fingerprints than it has such neighbours (65 for radius 2), so no key is hot; and all that meet
on it are within the radius of each other, so the verified pairs of neighbours in their order
connect the same documents as all pairs would.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; equal
texts share a fingerprint and are one row until the end; rows with a null id have a fingerprint and
the component of their class, but are no class's smallest id; rows that share an id each return a
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from faultline.llm.frames import components, stored, table
from faultline.scale import cut_lineage

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Shingles whose bits are counted at once; bounds the memory of a long text.
AT_ONCE = 1 << 16
#: A fingerprint is hot above this share of all rows, so there are fewer hot ones than this.
HOT = 1000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), AT_ONCE):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED)
                  for a, b in zip(starts[lo:lo + AT_ONCE], ends[lo:lo + AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(over.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long) of every row of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle)
                     for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.int64())],
                ["doc_id", "fingerprint"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, fingerprint long")


def ball(radius: int) -> list[int]:
    """Signed 64-bit masks of at most `radius` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1)
             for bits in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified pairs (a, b) of the distinct values of `fingerprint`, a < b.

    Each pair differs in at most `radius` bits, and whatever all such pairs connect, these do:
    two values within the radius meet on a variant, and there the pairs of neighbours join them.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius is split in halves: give an even number of bits")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    met = (prints.select("fingerprint", F.explode(masks).alias("mask"))
           .select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant")))
    before = F.lag("fingerprint").over(W.partitionBy("variant").orderBy("fingerprint"))
    pairs = met.select(before.alias("a"), F.col("fingerprint").alias("b")).where("a IS NOT NULL")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row: the smallest id reachable by links."""
    prints = stored(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"),
                                                            F.count("*").alias("copies")))
    joined = components(links(distinct, radius))
    linked = distinct.join(joined, distinct.fingerprint == joined.node)
    lowest = linked.groupBy("component").agg(F.min("first").alias("low"))
    linked = linked.join(lowest, "component").select(F.col("fingerprint").alias("node"), "low")
    classes = cut_lineage(distinct.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "copies", F.coalesce("low", "first").alias("component_id")))
    total = prints.count()
    hot = F.broadcast(classes.where(F.col("copies") * HOT > total).drop("copies"))
    rest = classes.where(F.col("copies") * HOT <= total).drop("copies")
    return (prints.join(hot, "fingerprint")
            .unionByName(prints.join(hot, "fingerprint", "left_anti").join(rest, "fingerprint"))
            .select("doc_id", "fingerprint", "component_id"))


def op13_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles over whole texts; links at two differing bits or fewer."""
    docs = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return docs.select("doc_id", digits.alias("fingerprint"), "component_id")
