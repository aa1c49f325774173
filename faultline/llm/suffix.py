"""Removal of repeated byte strings by distributed prefix doubling.

Positions are anchors that the bytes themselves choose, so a repeated string has the same anchors
at every place and all its 400-byte windows hold at least one stretch between neighbouring anchors.
The first names are those stretches; Spark counts equal names and drops what is unique.  Each
further round pairs the name at a position with the one at a growing offset, renames the pairs and
counts again, until a position is unique or its run reaches past the threshold: then every window
that starts there is repeated.  Equal names stand for equal ranks, as only equality matters here.
Windows that neither hold a unique stretch nor lie in a repeated run (near the ends of a match) are
compared byte for byte by their own hash.

The same steps run over bytes (windows of 400 bytes, op6) or over words (windows of 51 words, the
pipeline): `Bytes` and `Words` say what a position is.  Words are runs of bytes other than ASCII
white space, and compared as they are written; how they are spaced does not matter.

Equal texts are one text from the start; what has a copy and is long enough goes whole.

Defined cases: a null text is empty; texts shorter than the threshold are kept whole; rows of one
doc_id with different texts are separate; repeated rows are copies of each other and go whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import text as T
from faultline.llm.anchors import GRAM, anchors, lowest
from faultline.llm.frames import having_ids, maybe_in, stored, table, worker_cache

LENGTH = 400
#: The shortest passage of over 50 words.
PASSAGE = 51
_U = np.uint64
BASE = "row long, doc_id long, size long, sha string, starts array<int>, turns array<int>, names array<long>"
ROWS = "row long, at int, len int, next int, end int, name long, fresh boolean, open boolean"
OUT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, "
       "cut_from array<int>, cut_to array<int>, sha string")


class Bytes:
    """Positions are bytes; grams overlap."""

    gram = GRAM

    def __init__(self, length: int):
        self.length = length
        # two disjoint groups of so many grams fit into every window
        self.width = max(1, (length - GRAM + 1) // 2 - 6)

    def read(self, raw: np.ndarray) -> tuple[int, np.ndarray, tuple]:
        """Size of a text, its running hash, and its anchors."""
        width = self.width if len(raw) >= self.length else len(raw) + 1
        return len(raw), T.prefix_hash(raw), anchors(raw, width)

    def hashed(self, raw: np.ndarray) -> tuple[int, np.ndarray]:
        return len(raw), T.prefix_hash(raw)

    def cuts(self, raw: bytes, lo: list[int], hi: list[int]) -> tuple[list[int], list[int]]:
        """Spans of positions as spans of bytes."""
        return lo, hi


class Words:
    """Positions are words, each its own gram."""

    gram = 1

    def __init__(self, length: int):
        self.length = length
        self.width = max(1, length // 2 - 1)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        start, end, _ = T.words(raw, np.array([0, len(raw)]))
        return T.range_hash(T.prefix_hash(raw), start, end)

    def read(self, raw: np.ndarray) -> tuple[int, np.ndarray, tuple]:
        h = self._hashes(raw)
        width = self.width if len(h) >= self.length else len(h) + 1
        return len(h), T.running(h), lowest(h, width)

    def hashed(self, raw: np.ndarray) -> tuple[int, np.ndarray]:
        h = self._hashes(raw)
        return len(h), T.running(h)

    def cuts(self, raw: bytes, lo: list[int], hi: list[int]) -> tuple[list[int], list[int]]:
        """Words go with the white space after them; at the end of a text, with that before them."""
        data = np.frombuffer(raw, np.uint8)
        start, end, _ = T.words(data, np.array([0, len(data)]))
        n = len(start)
        a = [0 if i == 0 else int(end[i - 1] if j == n else start[i]) for i, j in zip(lo, hi)]
        return a, [len(raw) if j == n else int(start[j]) for j in hi]


def _pair(a: np.ndarray, b: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return T.mix(a * _U(0x9E3779B97F4A7C15) + T.mix(b + offset.astype(np.uint64)))


def positions(docs: DataFrame, unit: Bytes | Words) -> DataFrame:
    """(row, doc_id, size, sha, starts, names) of every text: its anchors and first names.

    `row` tells texts apart: 64 bits of their digest.
    """

    def run(batches):
        worker_cache("suffix")
        for batch in batches:
            data, at = T.utf8(batch.column(1))
            sizes, shas, starts, turns, names, rows = [], [], [], [], [], []
            for k in range(batch.num_rows):
                raw = data[at[k]:at[k + 1]]
                whole = raw.tobytes()
                sha = hashlib.sha256(whole).hexdigest()
                size, prefix, (a, turn) = unit.read(raw)
                if len(a) > 1:
                    n = T.range_hash(prefix, a[:-1], a[1:] + unit.gram)
                else:
                    n = np.zeros(0, np.uint64)
                sizes.append(size)
                shas.append(sha)
                starts.append(a.astype(np.int32))
                turns.append(turn.astype(np.int32))
                names.append(n.view(np.int64))
                rows.append(int.from_bytes(bytes.fromhex(sha[:16]), "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(shas, pa.string()), _lists(starts, pa.int32()), _lists(turns, pa.int32()),
                 _lists(names, pa.int64())],
                ["row", "doc_id", "size", "sha", "starts", "turns", "names"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BASE)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))


def _again(rows: DataFrame) -> DataFrame:
    """The rows whose name occurs more than once."""
    often = rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return rows.join(stored(often), "name", "left_semi")


def _by_row(df: DataFrame) -> DataFrame:
    return df.repartition("row").sortWithinPartitions("row", "at")


def _groups(batches, columns: int):
    """Streams sorted batches as (row, arrays of the other columns) per row."""
    held: list[list[np.ndarray]] = []
    current = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = np.flatnonzero(np.diff(cols[0])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(cols[0])]):
            if cols[0][lo] != current:
                if held:
                    yield current, [np.concatenate(p) for p in zip(*held)]
                current, held = cols[0][lo], []
            held.append([c[lo:hi] for c in cols[1:columns]])
    if held:
        yield current, [np.concatenate(p) for p in zip(*held)]


def double(active: DataFrame, unit: Bytes | Words) -> DataFrame:
    """Extends every run that is still short by a neighbour's, and renames it (`fresh`).

    A text is `open` while one of its runs is short.
    """

    def run(batches):
        out, size = [], 0
        for row, (at, run_len, nxt, end, name) in _groups(batches, 6):
            need = nxt.astype(np.int64) - 1 + unit.length
            short = end.astype(np.int64) + unit.gram < need
            name = name.view(np.uint64).copy()
            # the nearest neighbour that reaches far enough, else the farthest one
            pick, met, far = np.full(len(at), -1), ~short, end.copy()
            for d in range(1, int(run_len.max()) + 1):
                i = np.flatnonzero(~met[:-d] & (run_len[:-d] >= d) & (at[d:] - at[:-d] == d))
                if d >= len(at):
                    break
                i = i[end[i + d] > far[i]]
                pick[i], far[i] = i + d, end[i + d]
                met[i] = end[i + d] + unit.gram >= need[i]
            alive = pick >= 0
            i = np.flatnonzero(alive)
            j = pick[i]
            grown = _pair(name[i], name[j], at[j] - at[i])
            keep = np.flatnonzero(~short | alive)
            name[i] = grown
            new_len, new_end = run_len.copy(), end.copy()
            new_len[i] = at[j] - at[i] + run_len[j]
            new_end[i] = end[j]
            out.append((np.full(len(keep), row), at[keep], new_len[keep], nxt[keep],
                        new_end[keep], name[keep].view(np.int64), alive[keep],
                        np.full(len(keep), bool((new_end[keep] + unit.gram < need[keep]).any()))))
            size += len(keep)
            if size > 100_000:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    def _rows(out):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(),
                 pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c), k) for c, k in zip(zip(*out), kinds)],
            [f.split()[0] for f in ROWS.split(", ")])

    return _by_row(active.select("row", "at", "len", "next", "end", "name")).mapInArrow(run, ROWS)


def repeated_runs(base: DataFrame, unit: Bytes | Words) -> tuple[DataFrame, DataFrame]:
    """(row, at) of the stretches that recur; (row, at, name) of runs past the threshold that do."""
    pos = base.select("row", F.posexplode("names").alias("at", "name"), "starts").select(
        "row", "at", F.lit(1).alias("len"), F.expr("starts[at + 1]").alias("next"),
        F.expr("starts[at + 1]").alias("end"), "name")
    first = active = stored(_again(pos))
    runs = None
    while True:
        grown = stored(double(active, unit))
        if grown.where("fresh").isEmpty():
            break
        tested = _again(grown.where("fresh")).unionByName(grown.where("NOT fresh"))
        # a text without a short run is as it stays; only the others are shuffled again
        done = stored(tested.where("NOT open").select("row", "at", "name"))
        runs = done if runs is None else runs.unionByName(done)
        active = tested.where("open")
    # what is left after a round without growth reaches past the threshold everywhere
    left = grown.select("row", "at", "name")
    return first.select("row", "at"), left if runs is None else runs.unionByName(left)


def _state(starts, turns, size, seen, runs, unit):
    """Per window of a text: 1 repeated, 0 not, -1 not known."""
    windows = size - unit.length + 1
    edge = np.zeros(windows + 1, np.int64)
    recurs = np.zeros(len(starts) - 1, bool)
    recurs[seen] = True
    unique = np.flatnonzero(~recurs)
    # windows whose own bytes make the two ends of a unique stretch neighbours
    lo = np.maximum(turns[unique] - (unit.length - unit.gram + 1 - unit.width), 0)
    hi = np.minimum(turns[unique] - 1, windows - 1)
    ok = lo <= hi
    np.add.at(edge, lo[ok], 1)
    np.add.at(edge, hi[ok] + 1, -1)
    single = np.cumsum(edge[:windows]) > 0
    edge[:] = 0
    np.add.at(edge, np.minimum(starts[runs], windows), 1)
    np.add.at(edge, np.minimum(starts[runs + 1], windows), -1)
    twice = np.cumsum(edge[:windows]) > 0
    return np.where(twice, 1, np.where(single, 0, -1))


def removed(docs: DataFrame, unit: Bytes | Words) -> tuple[DataFrame, DataFrame]:
    """(base, cut): the rows of `positions`, and per text that loses bytes (row, lo, hi, n_removed)."""
    base = stored(positions(docs, unit))
    copies = base.groupBy("row").agg(F.count("*").alias("n"), F.first("size").alias("b"))
    all_of = stored(copies.where(f"n > 1 AND b >= {unit.length}").select(
        "row", F.array(F.lit(0)).alias("lo"), F.array((F.col("b") - unit.length).cast("int")).alias("hi")))
    # only texts that may have copies are shuffled to find one of each
    flagged = maybe_in(base.where(F.size("names") > 0), "row", stored(copies.where("n > 1").select("row")), "_maybe")
    texts = flagged.where("NOT _maybe").drop("_maybe").unionByName(
        stored(flagged.where("_maybe").drop("_maybe").dropDuplicates(["row"])))
    seen, runs = repeated_runs(texts, unit)
    # windows of equal runs are equal: one run of each name shows them to the windows not known
    shown = runs.groupBy("name").agg(F.min(F.struct("row", "at")).alias("s")).select("s.row", "s.at")

    def tag(df: DataFrame, kind: int) -> DataFrame:
        return df.select("row", "at", F.lit(kind).alias("kind"))

    lists = tag(seen, 0).unionByName(tag(runs, 1)).unionByName(tag(shown, 2))
    marks = stored(lists.groupBy("row").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("at")))).alias(name)
        for k, name in enumerate(("seen", "runs", "shown"))]))
    # the texts that need a look: with a repeated run, or windows between unique stretches
    known = texts.select("row", "doc_id", "sha", "size", "starts", "turns", "names").join(marks, "row")
    known = stored(known.mapInArrow(_open(unit), "row long, doc_id long, sha string, starts array<int>, "
                                                   "turns array<int>, seen array<int>, runs array<int>, "
                                                   "asked array<long>, places array<int>, held array<long>"))
    # equal windows hold the same first stretch: shown are those whose first stretch is asked for
    asked = stored(known.select(F.explode("asked").alias("name")).distinct())
    wanted = stored(known.select("row", F.explode(F.arrays_zip("places", "held")).alias("s"))
                    .select("row", "s.places", F.col("s.held").alias("name")).join(asked, "name", "left_semi")
                    .groupBy("row").agg(F.collect_set("places").alias("firsts")))
    look = stored(known.join(marks.select("row", "shown"), "row").join(wanted, "row", "left")
                  .where("size(asked) > 0 OR firsts IS NOT NULL")
                  .select("row", "doc_id", "sha", "starts", "turns", "seen", "runs",
                          F.when(F.col("firsts").isNotNull(), F.col("shown")).alias("shown"), "firsts"))
    chosen = having_ids(docs, stored(look.select("doc_id").distinct()))
    # of several rows with this id and text one is enough
    met = chosen.withColumn("_sha", F.sha2("text", 256)).join(
        look, chosen["doc_id"].eqNullSafe(look["doc_id"]) & (F.col("_sha") == F.col("sha")))
    tested = met.select("row", "text", "starts", "turns", "seen", "runs", "shown", "firsts").mapInArrow(
        _windows(unit), "row long, at int, hash long")
    again = tested.repartition("hash").sortWithinPartitions("hash").mapInArrow(
        _recurring, "row long, at int")
    spans = _by_row(again).mapInArrow(_ranges, "row long, lo array<int>, hi array<int>")
    spans = stored(spans.join(all_of.select("row"), "row", "left_anti").unionByName(all_of))
    runs_of = known.where(F.size("runs") > 0).select("row", "starts", "runs")
    cut = stored(runs_of.join(spans, "row", "full_outer").mapInArrow(
        _spans(unit.length), "row long, lo array<int>, hi array<int>, n_removed long"))
    return base, cut


def _losing(base: DataFrame, cut: DataFrame) -> DataFrame:
    """(row, lo, hi, n_removed, doc_id, sha) of every document that loses bytes."""
    return stored(cut.join(base.select("row", "doc_id", "sha").distinct(), "row"))


def _shorten(some: DataFrame, gone: DataFrame, unit: Bytes | Words, how: str) -> DataFrame:
    """What is left of the documents `some`, met with those that lose bytes by id and text."""
    met = some.withColumn("_sha", F.sha2("text", 256))
    met = met.join(gone.select(F.col("doc_id").alias("_id"), "sha", "lo", "hi"),
                   F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("sha")), how)
    return met.select("doc_id", "text", "lo", "hi", "_sha").mapInArrow(_keep(unit), OUT)


def shortened(docs: DataFrame, base: DataFrame, cut: DataFrame, unit: Bytes | Words) -> DataFrame:
    """A row per document that loses bytes."""
    gone = _losing(base, cut)
    return _shorten(having_ids(docs, stored(gone.select("doc_id").distinct())), gone, unit, "inner")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
                       .alias("text"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes (of the input), n_removed, n_spans, kept_sha256, the text left (`kept`),
    and where each removed span of bytes starts and ends (`cut_from`, `cut_to`).

    Matches are of bytes and may end inside a character: `kept` has only whole characters, its digest
    and the spans are of bytes.
    """
    docs, unit = _plain(docs), Bytes(length)
    base, cut = removed(docs, unit)
    gone = _losing(base, cut)
    flagged = maybe_in(docs, "doc_id", stored(gone.select("doc_id").distinct()), "_maybe")
    # texts that certainly lose nothing stay as they are and are not shuffled
    none, nothing = F.lit(0).cast("long"), F.array().cast("array<int>")
    whole = flagged.where("NOT _maybe").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"),
        none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"),
        nothing.alias("cut_from"), nothing.alias("cut_to"))
    return whole.unionByName(_shorten(flagged.where("_maybe"), gone, unit, "left").drop("sha"))


def _first(turns, windows):
    """Per window, the first stretch that its own bytes determine; equal windows have equal ones."""
    return np.searchsorted(turns, windows, side="right")


def _within(starts, at, windows: int):
    """Whether a window of a text starts in one of the stretches `at`."""
    edge = np.zeros(windows + 1, np.int64)
    np.add.at(edge, np.minimum(starts[at], windows), 1)
    np.add.at(edge, np.minimum(starts[at + 1], windows), -1)
    return np.cumsum(edge[:windows]) > 0


def _open(unit: Bytes | Words):
    """Texts with windows that are repeated or not known; the names of the first stretches of the
    latter (`asked`), and the first stretches (`places`, names `held`) of the windows of shown runs.
    """

    def run(batches):
        for batch in batches:
            keep, asked, places, held = [], [], [], []
            cols = zip(*(batch.column(k).to_pylist() for k in range(3, 10)))
            for n, starts, turns, names, seen, runs, shown in cols:
                starts, turns, names = np.array(starts), np.array(turns), np.array(names, np.int64)
                state = _state(starts, turns, n, np.array(seen, int), np.array(runs, int), unit)
                keep.append(bool((state != 0).any()))
                if keep[-1]:
                    ask = _first(turns, np.flatnonzero(state < 0))
                    show = np.flatnonzero(_within(starts, np.array(shown, int), len(state)) & (state > 0))
                    show = np.unique(_first(turns, show))
                    asked.append(names[np.unique(ask)])
                    places.append(show.astype(np.int32))
                    held.append(names[show])
            left = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [left.column(k) for k in (0, 1, 2, 4, 5, 7, 8)]
                + [_lists(asked, pa.int64()), _lists(places, pa.int32()), _lists(held, pa.int64())],
                ["row", "doc_id", "sha", "starts", "turns", "seen", "runs", "asked", "places", "held"])

    return run


def _windows(unit: Bytes | Words):
    """Hashes of the windows whose state is not known, and, at ~at, of those of shown runs."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            data, at = T.utf8(batch.column(1))
            for k in range(batch.num_rows):
                raw = data[at[k]:at[k + 1]]
                starts, turns, seen, runs, shown, firsts = (
                    np.array(batch.column(c)[k].as_py() or [], np.int64) for c in range(2, 8))
                size, prefix = unit.hashed(raw)
                state = _state(starts, turns, size, seen, runs, unit)
                show = np.flatnonzero(_within(starts, shown, len(state)) & (state > 0))
                show = show[np.isin(_first(turns, show), firsts)]
                s = np.concatenate((np.flatnonzero(state < 0), show))
                if not len(s):
                    continue
                h = T.range_hash(prefix, s, s + unit.length)
                s[len(s) - len(show):] = ~show
                for lo in range(0, len(s), 200_000):
                    part = s[lo:lo + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), rows[k])), pa.array(part.astype(np.int32)),
                         pa.array(h[lo:lo + 200_000].view(np.int64))], ["row", "at", "hash"])

    return run


def _recurring(batches):
    """Of rows sorted by hash, those whose hash occurs more than once, without shown ones (at < 0).

    Holds one batch at a time.
    """
    last = None  # the row before: (row, at, hash, already given)
    for batch in batches:
        row, at, h = (c.to_numpy() for c in batch.columns)
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        hit = np.zeros(len(h), bool)
        hit[1:] |= same
        hit[:-1] |= same
        if last is not None and last[2] == h[0]:
            hit[0] = True
            if not last[3] and last[1] >= 0:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int32())], ["row", "at"])
        last = (row[-1], at[-1], h[-1], hit[-1])
        hit &= at >= 0
        yield pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array(at[hit])], ["row", "at"])


def _ranges(batches):
    """Window starts of a row as ranges."""
    rows, los, his = [], [], []
    for row, (at,) in _groups(batches, 2):
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        rows.append(row)
        los.append(at[np.concatenate(([0], cut))].astype(np.int32))
        his.append(at[np.concatenate((cut - 1, [len(at) - 1]))].astype(np.int32))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), _lists(los, pa.int32()),
                                          _lists(his, pa.int32())], ["row", "lo", "hi"])


def _spans(length: int):
    """Maximal removed ranges [lo, hi) of a row, from its runs and its window ranges."""

    def run(batches):
        for batch in batches:
            rows, los, his, sums = [], [], [], []
            for row, starts, runs, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.array(lo or [], np.int64), np.array(hi or [], np.int64)
                if runs:
                    starts, runs = np.array(starts, np.int64), np.array(runs, np.int64)
                    a = np.concatenate((a, starts[runs]))
                    b = np.concatenate((b, starts[runs + 1] - 1))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order] + length)
                new = np.concatenate(([True], a[1:] > b[:-1]))
                a, b = a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(b) - 1]))]
                rows.append(row)
                los.append(a.astype(np.int32))
                his.append(b.astype(np.int32))
                sums.append(int((b - a).sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), _lists(los, pa.int32()), _lists(his, pa.int32()),
                 pa.array(sums, pa.int64())], ["row", "lo", "hi", "n_removed"])

    return run


def _keep(unit: Bytes | Words):
    """What is left of texts, a few MB of them at a time."""

    def run(batches):
        for batch in batches:
            _, at = T.utf8(batch.column(1))
            for first, last in T.chunks(at, 8 << 20):
                yield part(batch.slice(first, last - first))

    def part(batch):
        out = []
        for doc, text, lo, hi, sha in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            a, b = unit.cuts(raw, lo or [], hi or [])
            left = b"".join(raw[i:j] for i, j in zip([0, *b], [*a, len(raw)]))
            out.append((doc, len(raw), len(raw) - len(left), len(a), hashlib.sha256(left).hexdigest(),
                        left.decode("utf-8", "ignore"), a, b, sha))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          [f.split()[0] for f in OUT.split(", ")])

    return run


def without_repeats(docs: DataFrame, unit: Bytes | Words = Bytes(LENGTH)) -> DataFrame:
    """The documents with repeated strings (or passages) removed from their texts; the first copy
    goes too.

    A text that loses everything is dropped; n_chars, if there, follows the text.
    """
    plain = _plain(docs)
    base, cut = removed(plain, unit)
    kept = stored(shortened(plain, base, cut, unit).select(
        F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), F.col("kept").alias("_kept")).distinct())
    met = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"])
                    & (F.sha2(docs["text"].cast("string"), 256) == kept["_sha"]), "left")
    met = met.where(kept["_kept"].isNull() | (kept["_kept"] != ""))
    text = F.coalesce(kept["_kept"], docs["text"])
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(kept["_kept"].isNotNull(), F.length(text).cast("long")).otherwise(docs["n_chars"])
    return met.select(*[changed.get(c, docs[f"`{c}`"]).alias(c) for c in docs.columns])


def op6_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract, and the text left."""
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))
