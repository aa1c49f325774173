"""Ranked lexical search: every document is scored for every query, by NRA (no random access).

A document's score for a query is the sum over the query's terms of an integer weight (rarity of
the term) times an integer impact (its frequency, damped by the document's length).  Statistics
come from one pass over the documents.  In a second pass every task turns its documents into
shards of impact-sorted lists, one per term, and reads the lists of a query from the top, always
further down.  Every document read so far has a lower score (what was read) and an upper score
(plus the next unread value of the lists in which it was not met).  Reading goes on until no unread
document can reach the k-th place, and every document that still could has an exact score; so
membership, ties and scores are final.  What a task has found raises the bar for its next shard.
Spark merges the best k of all tasks.

Queries go in blocks of at most BLOCK distinct terms, or one query, which bounds what is sent to
tasks and what comes back.  No posting is shuffled and no list is kept whole, so frequent terms make
no hot key, and a lost task reads its own documents again.

Defined cases: null, empty and termless texts have no term and are never found, and do not count in
N; termless queries return nothing; rows of queries that share an id are one query with the terms of
all; rows of documents that share an id are documents of their own; null ids of documents come last
among equal scores; empty tables give no rows; other columns are ignored.  Terms are compared by a
64-bit hash and their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from faultline.llm import text as T
from faultline.llm.frames import stored, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
#: Distinct terms of a block of queries; postings of a shard; bytes of text read at once.
BLOCK, SHARD, AT_ONCE = 1 << 17, 1 << 21, 1 << 24
#: Entries of each list in the first read; later reads are as long as all before together.
FIRST_READ = 64
#: Parts in which the best of all tasks are first merged.
PARTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def weight(n_docs: int, df: int) -> int:
    """Rarity of a term, in thousandths."""
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def terms_of(text: Column) -> Column:
    """Distinct terms of a text column."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


def blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Queries (id, terms) in blocks of bounded size."""
    each = (queries.select(F.col("item_id").cast("long").alias("item"), F.explode(terms_of(F.col("text"))).alias("term"))
            .groupBy("item").agg(F.collect_set("term").alias("terms")).orderBy("item"))
    block, size = [], 0
    for row in each.toLocalIterator():
        if block and size + len(row.terms) > BLOCK:
            yield block
            block, size = [], 0
        block.append((row.item, row.terms))
        size += len(row.terms)
    if block:
        yield block


class Terms:
    """The terms of a block, numbered in the order of their hashes."""

    def __init__(self, words: list[str]):
        column = pa.array(words, pa.large_string())
        data, offsets = T.utf8(column)
        h = T.range_hash(T.prefix_hash(data, lower=True), offsets[:-1], offsets[1:])
        order = np.argsort(h)
        self.hash, self.length = h[order], np.diff(offsets)[order]
        self.number = {words[i]: at for at, i in enumerate(order.tolist())}

    def postings(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, ...]]:
        """For row ranges of a text column: first row, terms of each row, and for each known term
        in a row the row, the term and how often it occurs."""
        data, at = T.utf8(column)
        for lo, hi in T.chunks(at, AT_ONCE):
            part, offsets = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            start, end, row = T.words(part, offsets, _BETWEEN)
            size = np.bincount(row, minlength=hi - lo)
            h = T.range_hash(T.prefix_hash(part, lower=True), start, end)
            term = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = (self.hash[term] == h) & (self.length[term] == end - start)
            key, tf = np.unique(row[hit] * len(self.hash) + term[hit], return_counts=True)
            yield lo, size, key // len(self.hash), key % len(self.hash), tf


def statistics(docs: DataFrame, terms: Terms) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents per known term."""
    known = len(terms.hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(known + 2, np.int64)
        for batch in batches:
            for _, size, _, term, _ in terms.postings(batch.column("text")):
                seen[:known] += np.bincount(term, minlength=known)
                seen[known] += (size > 0).sum()
                seen[known + 1] += size.sum()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["what", "n"])

    sums = docs.select("text").mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n").alias("n"))
    out = np.zeros(known + 2, np.int64)
    for row in sums.collect():  # at most one row a term of the block
        out[row.what] = row.n
    return int(out[known]), int(out[known + 1]), out[:known]


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the best k, at `bar` or above, with exact scores.

    `lists` are (documents, scores), by descending score, each document once a list.
    """
    low = np.zeros(n_docs, np.int64)
    depth, step = 0, FIRST_READ
    while True:
        for doc, score in lists:
            low[doc[depth:depth + step]] += score[depth:depth + step]
        depth += step
        step = depth
        ahead = np.array([s[depth] if depth < len(s) else 0 for _, s in lists], np.int64)
        unread = int(ahead.sum())
        least = max(bar, int(np.partition(low, -k)[-k]) if n_docs >= k else 0, 1)
        if unread >= least:
            continue  # a document that was not met yet could still come in
        rest = np.full(n_docs, unread, np.int64)
        for j in np.flatnonzero(ahead):
            rest[lists[j][0][:depth]] -= ahead[j]
        if not np.any(rest[low + rest >= least]):
            break
    found = np.flatnonzero(low >= least)
    return found, low[found]


def best_of(ids: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, null, -scores))[:k]


def search(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` highest scores above 0 of each query."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "item long, doc_id long, score long"
    found = [_block(docs, block, k, schema) for block in blocks(queries)]
    out = stored(found[0]) if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        out = out.unionByName(stored(more))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    out = out.withColumn("part", part).withColumn(
        "rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order)))
    return out.where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _block(docs: DataFrame, block: list[tuple], k: int, schema: str) -> DataFrame:
    """Best `k` of every task for the queries of one block."""
    terms = Terms(sorted({t for _, ts in block for t in ts}))
    n_docs, n_terms, df = statistics(docs, terms)
    weights = np.array([weight(n_docs, d) if d else 0 for d in df.tolist()], np.int64)
    wanted = [(item, np.array([t for t in map(terms.number.get, ts) if weights[t]], np.int64)) for item, ts in block]

    def shard(ids, null, doc, term, impact, best):
        order = np.lexsort((doc, -impact, term))
        doc, score = doc[order], (weights[term] * impact)[order]
        edge = np.searchsorted(term[order], np.arange(len(weights) + 1))
        for q, (_, own) in enumerate(wanted):
            lists = [(doc[a:b], score[a:b]) for a, b in zip(edge[own], edge[own + 1]) if a < b]
            if lists:
                kept = best.get(q)
                bar = int(kept[2].min()) if kept and len(kept[2]) == k else 0
                at, sums = resolve(lists, len(ids), k, bar)
                new = (ids[at], null[at], sums)
                if kept:
                    new = tuple(np.concatenate(x) for x in zip(kept, new))
                at = best_of(*new, k)
                best[q] = tuple(x[at] for x in new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        held: list[tuple] = []
        rows = postings = 0
        for batch in batches:
            column = batch.column("doc_id")
            ids, null = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            for lo, size, row, term, tf in terms.postings(batch.column("text")):
                m = 10 + 90 * size[row] * n_docs // max(n_terms, 1)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                at, doc = np.unique(row, return_inverse=True)  # rows with a known term
                held.append((ids[lo + at], null[lo + at], doc + rows, term, impact))
                rows, postings = rows + len(at), postings + len(row)
                if postings >= SHARD:
                    shard(*map(np.concatenate, zip(*held)), best)
                    held, rows, postings = [], 0, 0
        if held:
            shard(*map(np.concatenate, zip(*held)), best)
        for q, (ids, null, score) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([wanted[q][0]] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=null),
                 pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return docs.mapInArrow(run, schema)


def op12_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
