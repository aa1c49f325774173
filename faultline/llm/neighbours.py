"""Approximate nearest neighbours: a navigable small-world graph per shard.

Distinct vectors are dealt to shards of bounded size by their hash.  A shard keeps three levels of
neighbours as flat arrays (n x degree integers): all nodes, a sixteenth, a 256th.  A node's
neighbours are near ones that are not nearer to each other than to it, and links go both ways.
A block of queries walks a shard together: from the top level down, then a beam of bounded width.
Results of all shards are merged by exact cosine in double precision.

Defined cases: null, zero or not finite vectors take no part, neither as query nor as candidate;
equal vectors share a node that carries as many of their smallest ids as a result can hold; ties go
to the smaller id; rows of one id are one candidate each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from faultline.llm.frames import table
from faultline.scale import cut_lineage

SHARD, BLOCK = 4096, 4096
DEGREE, BEAM = 24, 96
FOUND = "query_id long, vec_id long, score double"


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each vector times a power of two: products stay finite, and its cosines stay what they are."""
    _, power = np.frexp(np.abs(v).max(axis=1, keepdims=True))
    return np.ldexp(v, -power)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _level(x: np.ndarray, degree: int) -> np.ndarray:
    """Flat neighbour array (n, 2 * degree), -1 where there is none."""
    n = len(x)
    out = np.full((n, 2 * degree), -1, np.int32)
    if n < 2:
        return out
    near = min(n - 1, 2 * degree)
    kept: list[list[int]] = []
    for lo in range(0, n, 512):
        sims = x[lo:lo + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -2
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1), 1)
        for i, cand in enumerate(top):
            between = x[cand] @ x[cand].T
            mine = sims[i, cand]
            chosen: list[int] = []
            for j in range(near):
                if len(chosen) == degree:
                    break
                if not chosen or between[j, chosen].max() < mine[j]:
                    chosen.append(j)
            if len(chosen) < degree:  # fill up with the nearest that were passed over
                rest = [j for j in range(near) if j not in set(chosen)]
                chosen += rest[: degree // 2 - len(chosen)] if len(chosen) < degree // 2 else []
            kept.append(cand[chosen].tolist())
    back: list[list[int]] = [[] for _ in range(n)]
    for i, mine in enumerate(kept):
        for j in mine:
            if len(back[j]) < degree:
                back[j].append(i)
    for i in range(n):
        both = list(dict.fromkeys(kept[i] + back[i]))[: 2 * degree]
        out[i, :len(both)] = both
    return out


def build(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(nodes, neighbours)] from the top level down; nodes of a level are its first ones."""
    sizes = [n for n in (len(x) // 256, len(x) // 16, len(x)) if n >= 1]
    return [(np.arange(n), _level(x[:n], DEGREE if n == len(x) else DEGREE // 2))
            for n in dict.fromkeys(sizes)]


def search(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray,
           beam: int) -> np.ndarray:
    """Node numbers (queries, beam) found for unit queries, -1 where there are fewer."""
    m, top = len(q), len(levels[0][0])
    width = min(beam, max(top, 1))
    start = np.tile(np.arange(top), (m, 1))
    sims = q @ x[:top].T
    order = np.argsort(-sims, axis=1)[:, :width]
    ids, sims = np.take_along_axis(start, order, 1), np.take_along_axis(sims, order, 1)
    for depth, (nodes, links) in enumerate(levels):
        if depth == 0 and len(levels) > 1:
            continue
        wide = beam if depth == len(levels) - 1 else max(16, beam // 4)
        seen = np.zeros((m, len(nodes)), bool)
        seen[np.arange(m)[:, None], ids] = True
        done = np.zeros(ids.shape, bool)
        while True:
            open_ = np.where(done, -3.0, sims)
            step = np.argsort(-open_, axis=1)[:, :4]
            live = np.take_along_axis(open_, step, 1) > -2
            if not live.any():
                break
            np.put_along_axis(done, step, True, 1)
            hop = np.where(live, np.take_along_axis(ids, step, 1), 0)
            fresh = np.where(live[:, :, None], links[hop], -1).reshape(m, -1)
            rows = np.arange(m)[:, None]
            ok = (fresh >= 0) & ~seen[rows, np.maximum(fresh, 0)]
            fresh = np.sort(np.where(ok, fresh, -1), axis=1)
            ok = fresh >= 0
            ok[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            got = np.full(fresh.shape, -2.5, np.float32)
            r, c = np.nonzero(ok)
            seen[r, fresh[r, c]] = True
            for lo in range(0, len(r), 200_000):
                a, b = r[lo:lo + 200_000], c[lo:lo + 200_000]
                got[a, b] = np.einsum("ij,ij->i", q[a], x[fresh[a, b]])
            ids = np.concatenate((ids, fresh), 1)
            sims = np.concatenate((sims, got), 1)
            done = np.concatenate((done, ~ok), 1)
            best = np.argsort(-sims, axis=1)[:, :wide]
            ids, sims, done = (np.take_along_axis(v, best, 1) for v in (ids, sims, done))
    return np.where(sims > -2, ids, -1)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = (v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                                     & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), v.alias("v")).where(fine)


def index(rows: DataFrame, shards: int, ids: int) -> DataFrame:
    """A row per shard: vectors, ids and levels as flat binary arrays."""

    def fold(batches):
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = (np.array(v.as_py(), np.float64) + 0.0).tobytes()
                found.setdefault(key, []).append(i)
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()),
                 pa.array([sorted(found[k])[:ids] for k in keys], pa.list_(pa.int64()))], ["v", "ids"])

    def shape(batches):
        shard: dict[int, dict[bytes, list[int]]] = {}
        for batch in batches:
            for s, v, own in zip(*(c.to_pylist() for c in batch.columns)):
                mine = shard.setdefault(s, {})
                mine[v] = sorted(mine.get(v, []) + own)[:ids]
        for s in sorted(shard):
            by_size: dict[int, list[bytes]] = {}
            for v in shard[s]:
                by_size.setdefault(len(v), []).append(v)
            for size, keys in sorted(by_size.items()):  # vectors of other lengths do not compare
                keys.sort(key=lambda v: hash_of(v))
                raw = np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)
                levels = build(_unit(raw).astype(np.float32))
                own = [i for k in keys for i in shard[s][k]]
                at = np.cumsum([0] + [len(shard[s][k]) for k in keys])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([size // 8], pa.int32()),
                     pa.array([raw.tobytes()], pa.binary()),
                     pa.array([np.array(own, np.int64).tobytes()], pa.binary()),
                     pa.array([at.astype(np.int64).tobytes()], pa.binary()),
                     pa.array([[links.astype(np.int32).tobytes() for _, links in levels]],
                              pa.list_(pa.binary()))],
                    ["shard", "dims", "raw", "ids", "at", "links"])

    folded = rows.mapInArrow(fold, "v binary, ids array<long>")
    dealt = folded.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").select("shard", "v", "ids")
    return dealt.mapInArrow(shape, "shard int, dims int, raw binary, ids binary, at binary, "
                                   "links array<binary>")


def hash_of(v: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(v, digest_size=8).digest()


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows to each query but itself."""
    spark = rows.sparkSession
    points = usable(rows)
    total = points.count()
    shards = max(1, -(-total // SHARD))
    built = cut_lineage(index(points, shards, k + 1))
    asked = usable(queries)
    blocks = max(1, -(-asked.count() // BLOCK))

    def block(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.array(v.as_py(), np.float64).tobytes()
                                            for v in batch.column(1)], pa.binary())], ["query_id", "q"])

    asked = asked.select("vec_id", "v").mapInArrow(block, "query_id long, q binary")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    # every block of queries meets every shard
    left = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(key, shard, query):
        out = []
        for row in shard.to_pylist():
            dims = row["dims"]
            raw = _scaled(np.frombuffer(row["raw"], np.float64).reshape(-1, dims))
            x = _unit(raw)
            fast = x.astype(np.float32)
            links = [np.frombuffer(b, np.int32) for b in row["links"]]
            sizes = list(dict.fromkeys(n for n in (len(x) // 256, len(x) // 16, len(x)) if n >= 1))
            levels = [(np.arange(n), f.reshape(n, -1)) for n, f in zip(sizes, links)]
            own, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["at"], np.int64)
            asks = [(i, q) for i, q in zip(query["query_id"].to_pylist(), query["q"].to_pylist())
                    if len(q) == 8 * dims]
            for lo in range(0, len(asks), 512):
                part = asks[lo:lo + 512]
                qraw = _scaled(np.frombuffer(b"".join(q for _, q in part), np.float64).reshape(-1, dims))
                q = _unit(qraw)
                found = search(fast, levels, q.astype(np.float32), beam)
                for r, (i, _) in enumerate(part):
                    nodes = found[r][found[r] >= 0]
                    exact = np.array([np.dot(qraw[r], raw[n]) for n in nodes]) / (
                        np.linalg.norm(qraw[r]) * np.linalg.norm(raw[nodes], axis=1))
                    order = np.argsort(-exact, kind="stable")
                    last = exact[order[min(k, len(order) - 1)]]
                    rows = [(-exact[o], int(own[p])) for o in order if exact[o] >= last
                            for p in range(at[nodes[o]], at[nodes[o] + 1]) if own[p] != i]
                    out += [(i, v, float(-s)) for s, v in sorted(rows)[:k]]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                         pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        meet, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
