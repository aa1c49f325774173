"""N-gram Jaccard join: a size-aware heavy-light similarity join, exact.

A text is the set of its k-word shingles; two texts link when 100 * common >= percent * union.
Equal sets are one class from the start.  Small sets list their subsets of the size that a link
asks for: two that list the same subset are linked, no pair is tested.  Large sets are put into
inverted lists of the few shingles among which every link must show (a prefix of the set in a
common order), and the lists are scanned; bitmaps rule out most pairs before whole sets are compared.
The boundary between small and large is where listing
subsets starts to cost more than scanning.  Shingles that many texts hold come last in the order;
lists that are long all the same make a group, and the sets of a group are compared block by block,
where sizes allow a link.

Defined cases: null and wordless texts have an empty set and link with nothing; rows with a null id
link with nothing and have a null component; rows that share an id are one node; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import text as T
from faultline.llm.frames import components, having_ids, maybe_in, stored, table, worker_cache

_U = np.uint64
#: Lists longer than this are compared as a group, not pair by pair.
LONG_LIST = 48
#: Shingles that may be known as common, 8 bytes each; their number bounds what is broadcast.
COMMON = 1 << 20
#: Parts into which shingles are dealt to be counted, and the bits of a shingle that are kept beside its part.
PART_BITS, REST_BITS = 10, 32
#: Sets above this size never list subsets, whatever the cost model says.
MOST_SMALL = 14
#: Texts and shingles of a block whose sets are compared, and texts of one whose bitmaps are.
BLOCK, SHINGLES, BITMAP_BLOCK = 512, 1 << 20, 1024
#: Shingles of such a block of bitmaps, and the least slots of a bitmap.
BITMAP_SHINGLES, SLOTS = 1 << 25, 1 << 11
#: Bytes of text whose shingles are made at once.
AT_ONCE = 1 << 20
#: Bits of a block's number below its level.
BLOCK_BITS = 24
#: Shingles a task holds before it passes their counts on.
COUNTED = 1 << 20
#: Places of the table that tells most shingles from the common ones.
SIEVE = 1 << 23
SHAPE = "doc_id long, n int, s1 long, s2 long, part int, once binary, often binary, times binary"


def overlap(n: int, m: int, percent: int) -> int:
    """Common shingles that a link of sets of these sizes needs at least."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - ceil(percent * n / 100) + 1


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_cost(n: int, percent: int) -> int:
    return sum(comb(n, overlap(n, m, percent)) for m in partners(n, percent)
               if overlap(n, m, percent) <= min(n, m))


def reach(n: int, percent: int) -> int:
    """Shingles of a set that are counted: its prefix, and what follows if some of that is common."""
    p = prefix(n, percent)
    return p + p // 4 + 8


def brief(s: np.ndarray) -> np.ndarray:
    """42 bits of each shingle hash, its part on top: what is counted and known as common.

    Shingles that agree in them are common together, so the order stays the same in every set.
    """
    return ((s & _U((1 << PART_BITS) - 1)) << _U(REST_BITS)) | ((s >> _U(PART_BITS)) & _U((1 << REST_BITS) - 1))


def shapes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per text its size and 128-bit set digest; per task and part how often it met which shingles.

    `once` and `often` hold 4 bytes a shingle, `times` the counts of those met more than once.
    """

    def counted(seen):
        tokens, n = np.unique(brief(np.concatenate(seen)), return_counts=True)
        seen.clear()
        ends = np.arange((1 << PART_BITS) + 1, dtype=np.uint64) << _U(REST_BITS)

        def parts(values, pick):
            at = np.searchsorted(tokens[pick], ends).astype(np.int32) * 4
            data = np.ascontiguousarray(values[pick].astype(np.uint32))
            return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])

        no = pa.nulls(1 << PART_BITS, pa.int64())
        return pa.RecordBatch.from_arrays(
            [no, no.cast(pa.int32()), no, no, pa.array(np.arange(1 << PART_BITS, dtype=np.int32)),
             parts(tokens, n == 1), parts(tokens, n > 1), parts(n, n > 1)],
            ["doc_id", "n", "s1", "s2", "part", "once", "often", "times"])

    def run(batches):
        worker_cache("jaccard")
        seen, held = [], 0
        for batch in batches:
            data, at = T.utf8(batch.column(1))
            size, one, two = [], [], []
            for lo, hi in T.chunks(at, AT_ONCE):
                for s in T.shingle_sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], k):
                    size.append(len(s))
                    one.append(int((T.mix(s).sum(dtype=np.uint64)).view(np.int64)))
                    two.append(int((T.mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)).view(np.int64)))
                    if len(s):
                        seen.append(s[:reach(len(s), percent)].copy())  # else the whole set stays
                        held += len(seen[-1])
                if held > COUNTED:
                    yield counted(seen)
                    held = 0
            none, empty = pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), none, empty, empty, empty],
                ["doc_id", "n", "s1", "s2", "part", "once", "often", "times"])
        if seen:
            yield counted(seen)

    return docs.mapInArrow(run, SHAPE)


def frequencies(met: DataFrame) -> DataFrame:
    """(token, hits, squares): shingles met more than LONG_LIST times, as `brief`; in rows without a
    token, the sums of the counts above 1 and of their squares.
    """
    longest = LONG_LIST

    def run(batches):
        part, held, out = None, [], []

        def summed():
            tokens = np.concatenate([x for x, _ in held])
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            head = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))[:len(tokens)])
            n = np.add.reduceat(np.concatenate([c for _, c in held])[order], head) if len(head) else head
            out.append((None, int(n[n > 1].sum()), float((n[n > 1].astype(float) ** 2).sum())))
            many = n > longest
            top = part << REST_BITS
            out.extend((top | t, c, None) for t, c in zip(tokens[head][many].tolist(), n[many].tolist()))
            held.clear()

        def rows():
            token, hits, squares = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(hits, pa.int64()),
                                               pa.array(squares, pa.float64())], ["token", "hits", "squares"])

        for batch in batches:
            for p, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if held:
                        summed()
                    part = p
                once, often, times = (np.frombuffer(b, np.uint32) for b in blobs)
                held.append((np.concatenate((once, often)),
                             np.concatenate((np.ones(len(once), np.int64), times.astype(np.int64)))))
            if len(out) > COUNTED:
                yield rows()
        if held:
            summed()
        yield rows()

    parts = met.where("part IS NOT NULL").select("part", "once", "often", "times").repartition("part")
    return parts.sortWithinPartitions("part").mapInArrow(run, "token long, hits long, squares double")


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The size up to which listing subsets is cheaper than scanning lists."""
    best, least = 0, float("inf")
    for b in range(MOST_SMALL + 1):
        cost = sum(c * (subset_cost(n, percent) if n <= b else prefix(n, percent) * list_length)
                   for n, c in sizes.items() if 0 < n <= MOST_SMALL)
        if cost < least:
            best, least = b, cost
    return best


def postings(docs: DataFrame, k: int, percent: int, common: np.ndarray, small: int) -> DataFrame:
    """Per text (doc_id, n, bits, rare, common, lesser, greater): a parity bitmap of the set, the
    prefix shingles in order, the common ones last, and the listed subsets as the smaller and as
    the larger side of a link.
    """
    from_size = ceil(percent * (small + 1) / 100)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(common))  # at most COMMON values

    def sieve(known):
        maybe = np.zeros(SIEVE, bool)
        maybe[(known & _U(SIEVE - 1)).astype(np.int64)] = True

        def are_common(s):
            if not len(known):
                return np.zeros(len(s), bool)
            s = brief(s)
            out = maybe[(s & _U(SIEVE - 1)).astype(np.int64)]
            at = np.flatnonzero(out)
            out[at] = known[np.minimum(np.searchsorted(known, s[at]), len(known) - 1)] == s[at]
            return out

        return are_common

    def run(batches):
        are_common = sieve(shared.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, at = T.utf8(batch.column(1))
            for lo, hi in T.chunks(at, AT_ONCE):
                out = []
                sets = T.shingle_sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], k)
                for doc, s in zip(ids[lo:hi], sets):
                    n = len(s)
                    if not n or doc is None:
                        continue
                    rare = late = none = np.zeros(0, np.uint64)
                    listed = ([none], [none])
                    if n >= from_size:
                        p, head = prefix(n, percent), s[:reach(n, percent)]
                        late = are_common(head)
                        rare = head[~late][:p]
                        if len(rare) < p and len(head) < n:
                            head, late = s, are_common(s)
                            rare = head[~late][:p]
                        late = head[late][:p - len(rare)]
                    if n <= small:
                        own = T.mix(s)
                        for m in partners(n, percent):
                            c = overlap(n, m, percent)
                            if m > small or c > min(n, m):
                                continue
                            sides = T.mix(np.array([min(n, m) * 1000 + max(n, m)], np.uint64))
                            keys = np.array([own[list(pick)].sum(dtype=np.uint64)
                                             for pick in combinations(range(n), c)], np.uint64)
                            listed[n > m].append(T.mix(keys + sides))
                    out.append((doc, n, parities(s), rare, late, np.concatenate(listed[0]), np.concatenate(listed[1])))
                if out:
                    doc, n, bits, *keys = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.binary())]
                        + [_arrays(k) for k in keys],
                        ["doc_id", "n", "bits", "rare", "common", "lesser", "greater"])

    return docs.mapInArrow(run, "doc_id long, n int, bits binary, rare array<long>, common array<long>, "
                                "lesser array<long>, greater array<long>")


def _arrays(parts) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).view(np.int64)))


def parities(s: np.ndarray) -> bytes:
    """Per slot, whether an odd number of shingles falls into it.

    Two sets differ in at least as many shingles as their bitmaps differ in bits.  There are as many
    slots as shingles at least, a power of two, so large sets are told apart too.
    """
    slots = max(SLOTS, 1 << int(len(s) - 1).bit_length())
    slot = (T.mix(s ^ _U(0xD6E8FEB86659FD93)) & _U(slots - 1)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=slots) & 1).tobytes()


def _folded(bitmaps, width: int) -> np.ndarray:
    """Bitmaps as rows of `width` 64-bit words: wider ones as those of as many slots, half on half."""
    out = np.empty((len(bitmaps), width), np.uint64)
    for row, b in zip(out, bitmaps):
        b = np.frombuffer(b, np.uint64)
        while len(b) > width:
            b = b[:len(b) // 2] ^ b[len(b) // 2:]
        row[:] = b
    return out


def _lists(percent: int):
    """Scans rows sorted by key: possible pairs of short lists, and stars over long ones.

    Holds LONG_LIST rows of one list at most.
    """

    def run(batches):
        found: dict[tuple[int, int, bool], None] = {}
        key, held, head, long = None, [], None, False

        def pairs():
            for i, (d, n, p) in enumerate(held):
                for e, m, q in held[:i]:
                    # what stands before the common shingle on either side is not common
                    if d != e and min(n - p, m - q) >= overlap(n, m, percent):
                        found[min(d, e), max(d, e), False] = None

        def out():
            a, b, star = zip(*found) if found else ((), (), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                               pa.array(star, pa.bool_())], ["a", "b", "star"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            keys = cols[0]
            if not len(keys):
                continue
            alone = np.ones(len(keys), bool)
            alone[1:] &= keys[1:] != keys[:-1]
            alone[:-1] &= keys[:-1] != keys[1:]
            alone[0] = alone[-1] = False  # their lists may reach into other batches
            at = np.flatnonzero(~alone)
            for k, d, n, p in zip(*(c[at].tolist() for c in cols)):
                if k != key:
                    if not long:
                        pairs()
                    key, held, head, long = k, [], d, False
                if long:
                    if d != head:
                        found[min(head, d), max(head, d), True] = None
                    continue
                held.append((d, n, p))
                if len(held) > LONG_LIST:
                    for e, _, _ in held:
                        if e != head:
                            found[min(head, e), max(head, e), True] = None
                    long, held = True, []
                if len(found) > 100_000:
                    yield out()
        if not long:
            pairs()
        yield out()

    return run


def _compare(percent: int):
    """Links within blocks of packed sets; rows come sorted by group and block pair."""

    def links(rows):
        """A spanning forest of the links of one block pair."""
        ids = [r[0] for r in rows]
        sets = [_unpack(r[2]) for r in rows]
        side = np.array([r[1] for r in rows])
        size = np.array([len(s) for s in sets])
        tokens, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        new = np.cumsum(n > 1) - 1
        fit = n[back] > 1
        owner, token = owner[fit], new[back[fit]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        width = int((n > 1).sum())
        for lo in range(0, width, 4096):
            a, b = np.searchsorted(token, [lo, lo + 4096])
            grid = np.zeros((len(sets), min(4096, width - lo)), np.float32)
            grid[owner[a:b], token[a:b] - lo] = 1
            common += grid @ grid.T
        union = size[:, None] + size[None, :] - common
        hit = (100 * common >= percent * union) & (np.arange(len(sets))[:, None] < np.arange(len(sets)))
        if side.min() != side.max():
            hit &= side[:, None] != side[None, :]
        return _forest(ids, *np.nonzero(hit))

    def run(batches):
        held, at, out = [], None, []
        for batch in batches:
            for g, i, j, side, doc, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, i, j) != at:
                    if len(held) > 1:
                        out += links(held)
                    held, at = [], (g, i, j)
                held.append((doc, side, packed))
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if len(held) > 1:
            out += links(held)
        yield _edges(out)

    def _edges(out):
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()),
                                           pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    return run


def _blocks(members: DataFrame, percent: int, size: int, shingles: int, n: str, *columns: str) -> DataFrame:
    """The members (g, doc_id, ...) of each pair of blocks of a group, sorted by group and pair.

    `n` gives the size of a member's set.  A group is cut into levels of set size such that linked
    sets are on one level or on neighbouring ones, and a level into blocks of about `size` members
    and `shingles` shingles at most; a block meets those of its own level and of the next ones.  A
    group that is no larger than a block is one.
    """
    step = log(100 / percent) * (1 + 1e-9)  # two linked sets are less than one level apart
    members = members.withColumn("level", F.floor(F.log(F.greatest(F.expr(n), F.lit(1))) / step).cast("int"))

    def parts(count, mass):
        return F.greatest(F.ceil(count / size), F.ceil(mass / shingles)).cast("int")

    levels = members.groupBy("g", "level").agg(F.count("*").alias("c"), F.sum(F.expr(n)).alias("s"))
    groups = levels.groupBy("g").agg(
        parts(F.sum("c"), F.sum("s")).alias("whole"), F.map_from_entries(F.collect_list(
            F.struct("level", parts(F.col("c"), F.col("s"))))).alias("levels"))
    one = F.col("whole") <= 1
    groups = stored(groups.select("g", one.alias("one"), F.when(one, F.create_map(F.lit(0), F.lit(1)))
                                  .otherwise(F.col("levels")).alias("levels")))
    near = members.join(groups, "g").withColumn("level", F.when(F.col("one"), 0).otherwise(F.col("level")))
    side = F.pmod(F.xxhash64("doc_id"), F.try_element_at("levels", F.col("level")))
    near = near.withColumn("side", F.shiftleft(F.col("level").cast("long"), BLOCK_BITS) + side)
    others = F.flatten(F.transform(
        F.filter(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1),
                 lambda v: F.map_contains_key("levels", v)),
        lambda v: F.sequence(F.shiftleft(v.cast("long"), BLOCK_BITS),
                             F.shiftleft(v.cast("long"), BLOCK_BITS) + F.try_element_at("levels", v) - 1)))
    near = near.withColumn("other", F.explode(others))
    near = near.select("g", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                       "side", "doc_id", *columns)
    return near.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "doc_id")


def _forest(ids: list[int], x, y):
    """Of edges between positions, those that join parts not joined before."""
    root = list(range(len(ids)))

    def top(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in zip(x.tolist(), y.tolist()):
        p, q = top(a), top(b)
        if p != q:
            root[p] = q
            yield ids[a], ids[b]


def _similar(percent: int):
    """A spanning forest, per pair of blocks, of the pairs whose bitmaps do not rule out a link."""

    def edges(held):
        ids = [r[0] for r in held]
        side, n = (np.array([r[c] for r in held], np.int64) for c in (1, 2))
        wide = np.array([len(r[3]) // 8 for r in held])
        # per width, the place and the words of the bitmaps that are as wide or wider
        grids = {w: (np.cumsum(wide >= w) - 1, _folded([r[3] for r in held if len(r[3]) // 8 >= w], w))
                 for w in np.unique(wide).tolist()}
        one = side.min() == side.max()
        xs, ys = [], []
        for x in range(len(held)):
            y = np.arange(x + 1, len(held))
            y = y[(n[y] * 100 >= percent * n[x]) & (n[x] * 100 >= percent * n[y]) & (one | (side[y] != side[x]))]
            width = np.minimum(wide[y], wide[x])
            for w in np.unique(width).tolist():
                z, (place, words) = y[width == w], grids[w]
                apart = np.bitwise_count(words[place[z]] ^ words[place[x]]).sum(axis=1, dtype=np.int64)
                least = -(-percent * (n[x] + n[z]) // (100 + percent))
                z = z[apart <= n[x] + n[z] - 2 * least]
                xs.append(np.full(len(z), x))
                ys.append(z)
        if not xs:
            return ()
        return _forest(ids, np.concatenate(xs), np.concatenate(ys))

    def run(batches):
        held, at, out = [], None, []
        for batch in batches:
            for g, i, j, *row in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 3, 5, 6))):
                if (g, i, j) != at:
                    if len(held) > 1:
                        out += edges(held)
                    held, at = [], (g, i, j)
                held.append(row)
        if len(held) > 1:
            out += edges(held)
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()),
                                          pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    return run


def _bounded(percent: int):
    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            x, y = (batch.column(c).to_pylist() for c in (4, 5))
            width = np.array([min(len(a), len(b)) // 8 for a, b in zip(x, y)], np.int64)
            apart = np.zeros(len(n), np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                differ = _folded([x[k] for k in at], w) ^ _folded([y[k] for k in at], w)
                apart[at] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            least = -(-percent * (n + m) // (100 + percent))
            yield batch.filter(pa.array(apart <= n + m - 2 * least)).select([0, 1])

    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = _unpack(x), _unpack(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _pack(s: np.ndarray) -> bytes:
    """48 bits of each shingle hash: two of a pair's shingles meet there once in 10^9 pairs."""
    return np.ascontiguousarray((s >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _packed(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, at = T.utf8(batch.column(1))
            packed = []
            for lo, hi in T.chunks(at, AT_ONCE):
                packed += [_pack(s) for s in T.shingle_sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())],
                                             ["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    met = stored(shapes(docs, k, percent))
    shape = met.where("part IS NULL").select("doc_id", "n", "s1", "s2")
    # the shingles that would make long lists: any choice gives the same links, but those left out
    # tie texts that have little in common into groups, whose comparison grows with their square
    hits = stored(frequencies(met))
    common = (hits.where("token IS NOT NULL").orderBy(F.desc("hits"), "token").limit(COMMON).select("token")
              .toArrow().column(0).to_numpy().astype(np.uint64))
    classes = stored(shape.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2")
                     .agg(F.min("doc_id").alias("rep")))
    sizes = {r[0]: r[1] for r in classes.where(F.col("n") <= MOST_SMALL).groupBy("n").count().collect()}
    mass = hits.where("token IS NULL").agg(F.sum("squares"), F.sum("hits")).first()
    small = boundary(sizes, float(mass[0] or 1) / float(mass[1] or 1), percent)
    # texts that stand for no class are left out; only those that may be such are shuffled for it
    gone = shape.where("n > 0 AND doc_id IS NOT NULL").select("doc_id").distinct().join(
        classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_anti")
    gone = stored(gone)
    rows = stored(postings(docs, k, percent, common, small))
    flagged = maybe_in(rows, "doc_id", gone, "_maybe")
    mine = flagged.where("NOT _maybe").drop("_maybe").unionByName(
        flagged.where("_maybe").drop("_maybe").join(gone, "doc_id", "left_anti"))
    # lists of shingles that are not known as common
    short = (mine.select("doc_id", "n", F.posexplode("rare").alias("place", "key"))
             .select("key", "doc_id", "n", "place").repartition("key")
             .sortWithinPartitions("key", "doc_id").mapInArrow(_lists(percent), "a long, b long, star boolean"))
    short = stored(short)
    # lists of common ones: stars around their smallest id, at most COMMON lists
    lists = stored(mine.select("doc_id", F.explode("common").alias("key")))
    heads = stored(lists.groupBy("key").agg(F.min("doc_id").alias("head")))
    stars = lists.join(heads, "key").where("head <> doc_id").select(F.col("head").alias("a"),
                                                                    F.col("doc_id").alias("b"))
    stars = stars.unionByName(short.where("star").select("a", "b"))
    # listed subsets: whoever lists the same one as a smaller side is linked to it
    listed = stored(mine.where(F.size("lesser") + F.size("greater") > 0).select("doc_id", "lesser", "greater"))
    lead = stored(listed.select("doc_id", F.explode("lesser").alias("key"))
                  .groupBy("key").agg(F.min("doc_id").alias("head")))
    listed = listed.select("doc_id", F.explode(F.concat("lesser", "greater")).alias("key"))
    sure = stored(listed.join(lead, "key").where("head <> doc_id")
                  .select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct())
    group = stored(components(stars).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "g"))
    bits = rows.select("doc_id", "n", "bits")
    # a group that bitmaps take apart is compared as the groups that remain
    near = _blocks(group.join(bits, "doc_id"), percent, BITMAP_BLOCK, BITMAP_SHINGLES, "n", "n", "bits")
    group = stored(components(stored(near.mapInArrow(_similar(percent), "a long, b long")))
                   .withColumnRenamed("node", "doc_id").withColumnRenamed("component", "g"))
    # pairs of short lists whose bitmaps do not rule out a link
    pairs = short.where("NOT star").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(bits.select(*[F.col(c).alias(f"{c}_{side}") for c in bits.columns]),
                           F.col(side) == F.col(f"doc_id_{side}"))
    pairs = stored(pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(
        _bounded(percent), "a long, b long"))
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(group.select("doc_id"))
    sets = stored(_packed(having_ids(docs, stored(wanted.distinct())), k))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(f"doc_id_{side}"),
                                       F.col("packed").alias(f"packed_{side}")),
                           F.col(side) == F.col(f"doc_id_{side}"))
    linked = pairs.select("a", "b", "packed_a", "packed_b").mapInArrow(_linked(percent), "a long, b long")
    links = _blocks(group.join(sets, "doc_id"), percent, BLOCK, SHINGLES, "length(packed) / 6", "packed").mapInArrow(
        _compare(percent), "a long, b long")
    links = stored(links.unionByName(linked).unionByName(sure))
    found = components(links)
    named = stored(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"),
        F.coalesce("component", "rep").alias("component_id")))
    out = shape.join(named, (shape["n"] == named["_n"]) & (shape["s1"] == named["_s1"])
                     & (shape["s2"] == named["_s2"]), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("doc_id").isNull(), None)
                      .otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that link, directly or through others, to a smaller doc_id."""
    gone = jaccard_components(docs, k, percent).where("component_id <> doc_id").select(
        F.col("doc_id").alias("_id")).distinct()
    gone = stored(gone)
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def op3_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)
