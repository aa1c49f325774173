"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram binds (multiplies) the vectors of its
letters after rotating them by their place; a text bundles (adds) its trigrams; a language bundles
the texts labelled with it.  A text gets the language whose prototype has the largest cosine.

Defined cases: `und` with score 0 for a null text, one without a letter, or when nothing was
learned; rows with a null id are learned from as if their id were empty; repeated rows count as
often as they occur; ties go to the language first by code point; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from faultline.llm import text as T
from faultline.llm.frames import sparing, table, worker_cache

DIMENSIONS = 1024
#: Bytes of text that are read at once.
AT_ONCE = 1 << 20
UNIT = 4096  # a text's vector is rounded to this length, so sums do not depend on their order


def letter(point: int) -> np.ndarray:
    """The vector of a code point, seeded by it; 0 stands for all that is no letter."""
    kept = worker_cache("langid")
    if point not in kept:
        kept[point] = np.random.default_rng((7, point)).choice(np.array([-1, 1], np.int8), DIMENSIONS)
    return kept[point]


def vector(text: str) -> np.ndarray | None:
    """The bundle of the trigrams of a text, at length 1; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(points, return_inverse=True)
    kinds = [int(p) if chr(p).isalpha() else 0 for p in kinds.tolist()]
    own = sorted({0, *kinds})  # the symbols of this text
    if len(own) == 1:
        return None
    place = {p: k for k, p in enumerate(own)}
    s = np.array([place[p] for p in kinds], np.int64)[at]
    s = np.concatenate(([0], s, [0]))
    size = len(own)
    tri = (s[:-2] * size + s[1:-1]) * size + s[2:]
    tri = tri[s[1:-1] > 0]  # centred on a letter
    if size ** 3 < 8 * len(tri):
        n = np.bincount(tri, minlength=size ** 3)
        tri = np.flatnonzero(n)
        n = n[tri]
    else:
        tri, n = np.unique(tri, return_counts=True)
    third = np.stack([letter(p) for p in own])
    first, second = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1)
    out = np.zeros(DIMENSIONS, np.float32)
    for lo in range(0, len(tri), 2048):
        t = tri[lo:lo + 2048]
        bound = first[t // size ** 2] * second[t // size % size] * third[t % size]
        out += n[lo:lo + 2048].astype(np.float32) @ bound.astype(np.float32)
    size = np.linalg.norm(out)
    return out / size if size else None


def learn(docs: DataFrame) -> DataFrame:
    """(lang, place, total): one prototype per language, summed where the texts lie."""

    def run(batches):
        worker_cache("langid")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in T.portions(batch.column(0), AT_ONCE):
                for t, lang in zip(*(c.to_pylist() for c in batch.slice(lo, hi - lo).columns)):
                    v = vector(t)
                    if v is not None:
                        sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                        sums[lang] += np.rint(v * UNIT).astype(np.int64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[k].tolist() for k in names],
                                                    pa.list_(pa.int64()))], ["lang", "sums"])

    seen = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    parts = seen.mapInArrow(run, "lang string, sums array<long>")
    return (parts.select("lang", F.posexplode("sums").alias("place", "v"))
            .groupBy("lang", "place").agg(F.sum("v").alias("total")))


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and unit vectors; DIMENSIONS numbers per language reach the driver."""
    found: dict[str, np.ndarray] = {}
    with sparing(docs.sparkSession):
        totals = learn(docs).collect()
    for lang, place, total in totals:
        found.setdefault(lang, np.zeros(DIMENSIONS))[place] = total
    names = sorted(found)
    rows = [found[k] / max(np.linalg.norm(found[k]), 1e-12) for k in names]
    return names, np.array(rows).reshape(len(names), DIMENSIONS)


def predict(docs: DataFrame, names: list[str], vectors: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred and score."""
    fields = StructType([*(docs.schema[c] for c in keep), StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])

    def run(batches):
        worker_cache("langid")
        for batch in batches:
            for lo, hi in T.portions(batch.column(batch.num_columns - 1), AT_ONCE):
                yield part(batch.slice(lo, hi - lo))

    def part(batch):
        out, scores = [], []
        for t in batch.column(batch.num_columns - 1).to_pylist():
            v = vector(t) if t is not None and names else None
            if v is None:
                out.append("und")
                scores.append(0.0)
                continue
            cosines = vectors @ v
            k = int(cosines.argmax())
            out.append(names[k])
            scores.append(float(min(1.0, max(0.0, cosines[k]))))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(out, pa.string()), pa.array(scores, pa.float64())],
            [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(
        run, fields)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identified(docs: DataFrame) -> DataFrame:
    """The documents in a known language, columns as they came: those read as `und` go.

    The columns travel as one value, so they may have any names.
    """
    rows = docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    names, vectors = prototypes(rows.where(~held_out()))
    return predict(rows, names, vectors, ["_row"]).where("lang_pred <> 'und'").select("_row.*")


def op7_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    names, vectors = prototypes(docs.where(~F.col("held_out")))
    return predict(docs, names, vectors, ["doc_id", "held_out"])
