"""Ordinal quality classifier: cumulative-link regression on hashed words.

A grade 0 (toxic), 1 (poor) or 2 (good) is modelled by one score per text and ordered thresholds:
P(grade > k) = 1 / (1 + exp(threshold_k - score)).  The weights of hashed words are shared by all
thresholds.  The fit uses a bounded sample of the labelled texts; every text is scored.

Defined cases: a null or wordless text scores by the bias alone; labels with a null grade or no
document are not learned from; without any label every grade is equally likely; of repeated labels
each counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import text as T
from faultline.llm.frames import table
from faultline.scale import cut_lineage

#: Labelled texts that the fit may use; they are chosen by a hash of their id.
SAMPLE = 12_000
BUCKETS = 1 << 16
GRADES = 3
STEPS, RATE, DECAY = 250, 0.05, 1e-4
_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): hashed words and shape features, unit length per row."""
    rows = len(offsets) - 1
    _, _, row, h = T.word_hashes(data, offsets)
    key = row.astype(np.uint64) * _U(BUCKETS) + (h >> _U(48)) % _U(BUCKETS)
    key, n = np.unique(key, return_counts=True)
    row, bucket = (key // _U(BUCKETS)).astype(np.int64), (key % _U(BUCKETS)).astype(np.int64)
    value = 1.0 + np.log(n)
    size = np.sqrt(np.bincount(row, value * value, rows))
    value = value / np.maximum(size[row], 1e-9)
    return row, bucket, value


def shape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: shares of letters, digits, other signs, repeated words, and two of length."""
    rows = len(offsets) - 1
    n = np.maximum(np.diff(offsets), 1)

    def share(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flags)))
        return (run[offsets[1:]] - run[offsets[:-1]]) / n

    low = data | 0x20
    letter = (low >= 97) & (low <= 122) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | (data >= 9) & (data <= 13)
    _, _, row, h = T.word_hashes(data, offsets)
    total = np.bincount(row, minlength=rows)
    kinds = np.unique(T.mix(h + row.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), return_index=True)[1]
    different = np.bincount(row[kinds], minlength=rows) / np.maximum(total, 1)
    return np.stack([share(letter), share(digit), share(~(letter | digit | space)), different,
                     np.log1p(total) / 10, n / np.maximum(total, 1) / 20], axis=1)


def fit(texts: list[str], grades: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word weights, shape weights and ordered thresholds, by full-batch Adam."""
    y = np.array(grades)
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    parts = []
    for lo, hi in T.chunks(offsets, 4 << 20):
        raw, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        r, b, v = features(raw, at)
        parts.append((r + lo, b, v, shape(raw, at)))
    none = np.zeros(0, np.int64)
    parts = parts or [(none, none, np.zeros(0), np.zeros((0, 6)))]
    row, bucket, value, dense = (np.concatenate(x) for x in zip(*parts))
    params = [np.zeros(BUCKETS), np.zeros(dense.shape[1]), np.array([-1.0, *[0.5] * (GRADES - 2)])]
    if not len(y):
        share = np.arange(1, GRADES) / GRADES
        return params[0], params[1], np.log(share / (1 - share))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        w, d, t = params
        theta = np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))
        score = np.bincount(row, w[bucket] * value, len(y)) + dense @ d
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        up = 1 / (1 + np.exp(-np.clip(edges[y + 1] - score, -35, 35)))
        down = 1 / (1 + np.exp(-np.clip(edges[y] - score, -35, 35)))
        up, down = np.where(y == GRADES - 1, 1.0, up), np.where(y == 0, 0.0, down)
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        g = (du - dd) / len(y)  # of the loss by the score
        g_theta = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            g_theta[k] = (dd[y == k + 1].sum() - du[y == k].sum()) / len(y)
        tail = np.cumsum(g_theta[::-1])[::-1]
        grads = [np.bincount(bucket, g[row] * value, BUCKETS) + DECAY * w, dense.T @ g,
                 np.concatenate((tail[:1], tail[1:] * np.exp(t[1:])))]
        for i, grad in enumerate(grads):
            m, v = moments[i]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            params[i] = params[i] - RATE * (m / (1 - 0.9 ** step)) / (
                np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w, d, t = params
    return w, d, np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))


def learn(docs: DataFrame, graded: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit on at most SAMPLE of the (doc_id, grade) rows, in one task; the model has a fixed size."""
    total = graded.count()
    order = F.crc32(F.concat_ws("|", F.lit("fit"), F.col("doc_id").cast("string")).cast("binary"))
    bound = int((1 << 32) * min(1.0, 0.95 * SAMPLE / max(total, 1)))
    some = graded.where(order < bound).orderBy(order, "doc_id").limit(SAMPLE)
    some = cut_lineage(some.select(F.col("doc_id").alias("_id"), "grade"))
    rows = docs.join(some, docs["doc_id"] == some["_id"]).select(
        F.col("doc_id").cast("long"), "text", F.col("grade").cast("int"))

    def run(batches):
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        got.sort(key=lambda r: (r[0], r[2], r[1] or ""))
        w, d, theta = fit([r[1] or "" for r in got], [r[2] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64()))
                                          for x in (w, d, theta)], ["w", "d", "theta"])

    model = rows.repartition(1).mapInArrow(run, "w array<double>, d array<double>, theta array<double>")
    got = model.collect()
    if not got:
        return fit([], [])
    return tuple(np.array(x) for x in got[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray],
          keep: list[str]) -> DataFrame:
    """The columns `keep` with expected_grade, p_good (top grade), p_toxic (lowest) and grade_pred."""
    w, d, theta = model
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            data, offsets = T.utf8(batch.column(len(keep)))
            parts = []
            for lo, hi in T.chunks(offsets, 4 << 20):
                raw, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                row, bucket, value = features(raw, at)
                s = np.bincount(row, w[bucket] * value, hi - lo) + shape(raw, at) @ d
                parts.append(1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -35, 35))))
            over = np.concatenate(parts) if parts else np.zeros((0, GRADES - 1))
            steps = np.hstack([np.ones((len(over), 1)), over, np.zeros((len(over), 1))])
            each = steps[:, :-1] - steps[:, 1:]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(over.sum(axis=1)), pa.array(over[:, -1]),
                 pa.array(each[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32))],
                [*keep, "expected_grade", "p_good", "p_toxic", "grade_pred"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(
        run, f"{fields}, expected_grade double, p_good double, p_toxic double, grade_pred int")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = table(spark, sf_dir, "labels").withColumn("held_out", held_out()).where("NOT held_out").select(
        "doc_id", grade.alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    return score(docs, learn(docs, graded), ["doc_id", "held_out"])
