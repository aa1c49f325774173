"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes.

Two words are near if one inserted, deleted or replaced code point makes one into the other.  A
query is cut in halves: an error in one leaves the other whole.  The first scheme matches the first
half exactly and extends to the right across the second, allowing one error; the other scheme
matches the second half and extends to the left.  The two directions of the index are FM-indexes
over the words as they are and over the reversed words; each is asked only for the direction that
its scheme extends in, always as a backward search that narrows an interval of suffix ranks.

The vocabulary is dealt out by (scheme, length of the query, exact half), so that every query and
all words that can match it meet in one group; a shard of the index is a run of whole groups of
bounded size, each word delimited by the number of its group in front of the search and by an end
mark behind it.  Deletions are insertions seen from the other word, so a query only looks for words
of its own length and of one more.  A group above GROUP words is dealt out in parts by a hash of the
word, and every part of its queries meets every part of its words in a shard of its own.  What leaves a shard is one row a word (number of near
words, best of them), so nothing grows with the number of pairs.

Defined cases: null and empty texts have no words; a null doc_id counts as empty text in the hash
of a run; rows that share an id are counted each; words may be of any length; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.frames import stored, table
from faultline.scale import cut_lineage

#: Shortest word, fewest occurrences, how much more frequent a form is, every how-manieth run is cut.
LEAST, SEEN, FACTOR, CUT = 7, 2, 10, 31
#: Distinct words a task counts before it passes them on.
COUNTED = 1 << 18
#: Words of a group that meet in one part; code points of a shard of the index.
GROUP, SHARD = 1 << 16, 1 << 20
WORD = re.compile(rb"[a-z\xC0-\xFF]+")
STATS = "word string, n_near long, less long, form string"


def occurrences(text: str, doc_id: int | None, least: int = LEAST) -> Iterator[tuple[str, int]]:
    """Words of at least `least` code points in a text, and how often each occurs."""
    runs = Counter(WORD.findall(text.encode("latin-1", "replace").lower()))
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < least:
            continue
        word = run.decode("latin-1")
        h = zlib.crc32(run if run.isascii() else word.encode(), head)
        if h % CUT == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        if len(word) >= least:
            yield word, n


def vocabulary(docs: DataFrame, least: int = LEAST, seen: int = SEEN) -> DataFrame:
    """(word, n) of the words that occur at least `seen` times in all texts together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()),
                                               pa.array(sums.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                if text.is_valid:
                    for word, n in occurrences(text.as_py(), doc_id.as_py(), least):
                        sums[word] += n
                if len(sums) >= COUNTED:
                    yield out()
                    sums.clear()
        yield out()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = docs.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


class Codes:
    """Words as numbers: code points (plus one) one after the other, and where each word starts."""

    def __init__(self, words: pa.Array, backward: bool = False):
        text = "".join(words.to_pylist())
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
        self.length = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1])).astype(np.int64)
        if backward and len(points):
            word = np.repeat(np.arange(len(words)), self.length)
            points = points[2 * self.start[word] + self.length[word] - 1 - np.arange(len(points))]
        self.points = points


class Index:
    """FM-index over delimited words: `search` narrows suffix-rank intervals, last code point first.

    Every word is followed by the number of its group and preceded by an end mark, so a search that
    starts at a group meets only words of that group.
    """

    END = 0

    def __init__(self, words: Codes, group: np.ndarray):
        n_words, groups = len(words.start), int(group.max()) + 1
        at = words.start + np.arange(n_words)  # each word takes one place more, for its group
        n = len(words.points) + n_words
        text = np.empty(n, np.int64)
        last = at + words.length
        letters = np.ones(n, bool)
        letters[last] = False
        text[letters] = words.points + groups
        text[last] = group
        rank = self._ranks(text, last)
        order = np.argsort(rank, kind="stable")
        first = np.zeros(n, bool)
        first[at] = True
        before = np.empty(n, np.int64)
        before[1:] = text[:-1] - groups
        before[first] = self.END
        before = before[order]
        self.n = n
        self.before = before
        self.keys = np.sort(before * (n + 1) + np.arange(n))
        self.word = np.repeat(np.arange(n_words), words.length + 1)[order]
        self.heads = np.searchsorted(np.sort(group), np.arange(groups + 1))

    @staticmethod
    def _ranks(text: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of each suffix, read up to the group that ends its word, by prefix doubling."""
        rank = np.unique(text, return_inverse=True)[1]
        n, step = len(text), 1
        left = np.repeat(last, np.diff(np.concatenate(([-1], last)))) - np.arange(n)
        longest = int(left.max()) if n else 0
        while step <= longest:
            ahead = np.zeros(n, np.int64)
            more = np.flatnonzero(left >= step)
            ahead[more] = rank[more + step] + 1
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1]
            step *= 2
        return rank

    def step(self, point: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank bound after one more code point to the left."""
        return np.searchsorted(self.keys, point * (self.n + 1) + at)

    def letters(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, code point): the distinct code points to the left within each interval."""
        pairs, inverse = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        a, b = pairs // (self.n + 1), pairs % (self.n + 1)
        node = np.repeat(np.arange(len(a)), b - a)
        place = np.arange(len(node)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[node]
        width = int(self.before.max(initial=0)) + 1
        found = np.unique(node * width + self.before[place])
        found = found[found % width != self.END]
        node, point = found // width, found % width
        many = np.bincount(node, minlength=len(a))
        head = np.cumsum(many) - many
        which = np.repeat(np.arange(len(lo)), many[inverse])
        inside = np.arange(len(which)) - np.repeat(np.cumsum(many[inverse]) - many[inverse], many[inverse])
        return which, point[head[inverse[which]] + inside]

    def complete(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, word): the words that end within each interval."""
        zero = np.zeros(len(lo), np.int64)
        a, b = self.step(zero, lo), self.step(zero, hi)  # places of end marks in the intervals
        which = np.repeat(np.arange(len(lo)), b - a)
        place = np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]
        return which, self.word[self.keys[place]]


def search(index: Index, queries: Codes, group: np.ndarray, exact: np.ndarray,
           strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, word, longer): words of the query's group that match it with one error to the left of
    the last `exact` code points, replaced or (`longer`) inserted in the word.

    With `strict`, words are left out that would also match with an insertion at the very border,
    which is where the scheme of the other half finds them.
    """
    query = np.arange(len(group))
    lo, hi = index.heads[group], index.heads[group + 1]
    p = queries.start + queries.length - 1  # next code point to match
    todo = exact.copy()
    same = np.full(len(group), -2, np.int64)  # the code point all matched of the other half equal
    while len(query):
        out = todo <= 0
        if out.any():
            q, at = query[out], p[out]
            end = at < queries.start[q]
            which, point = index.letters(lo[out], hi[out])
            due = np.where(end, -1, queries.points[np.maximum(at, 0)])
            differs = point != due[which]
            which, point = which[differs], point[differs]
            a, b = index.step(point, lo[out][which]), index.step(point, hi[out][which])
            one = same[out][which]
            inserted = (one != -2) & (one != point) if strict else np.ones(len(which), bool)
            for longer, chosen, skip in ((True, inserted, 0), (False, ~end[which], 1)):
                found, word = _rest(index, queries, q[which[chosen]], at[which[chosen]] - skip,
                                    a[chosen], b[chosen])
                yield found, word, np.full(len(found), longer)
        inside = p >= queries.start[query]
        query, lo, hi, p, todo, same = (x[inside] for x in (query, lo, hi, p, todo, same))
        point = queries.points[p]
        lo, hi = index.step(point, lo), index.step(point, hi)
        other = todo <= 0
        same = np.where(other, np.where((same == -2) | (same == point), point, -1), same)
        p, todo = p - 1, todo - 1
        inside = lo < hi
        query, lo, hi, p, todo, same = (x[inside] for x in (query, lo, hi, p, todo, same))


def _rest(index: Index, queries: Codes, query: np.ndarray, p: np.ndarray, lo: np.ndarray,
          hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches what is left of each query exactly, to the end of the word."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(query):
        end = p < queries.start[query]
        which, word = index.complete(lo[end], hi[end])
        found.append((query[end][which], word))
        query, p, lo, hi = (x[~end] for x in (query, p, lo, hi))
        point = queries.points[p]
        lo, hi = index.step(point, lo), index.step(point, hi)
        inside = lo < hi
        query, p, lo, hi = query[inside], p[inside] - 1, lo[inside], hi[inside]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _shard(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words among the rows of whole groups, folded to one row a word."""
    for right in (True, False):
        rows = part.filter(pa.compute.equal(part["to_right"], right))
        if not rows.num_rows:
            continue
        words = rows["word"].combine_chunks()
        n = rows["n"].to_numpy()
        group = np.unique(rows["bin"].to_numpy(), return_inverse=True)[1]
        group = _runs(rows, group)
        indexed = np.flatnonzero(rows["indexed"].to_numpy(zero_copy_only=False))
        asked = np.flatnonzero(rows["asks"].to_numpy(zero_copy_only=False))
        if not len(indexed) or not len(asked):
            continue
        index = Index(Codes(words.take(pa.array(indexed)), backward=right), group[indexed])
        queries = Codes(words.take(pa.array(asked)), backward=right)
        half = queries.length // 2
        of, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for query, word, longer in search(index, queries, group[asked], half if right else queries.length - half,
                                          strict=not right):
            a, b = asked[query], indexed[word]
            of += [a, b[longer]]
            near += [b, a[longer]]
        yield _folded(words, n, np.concatenate(of), np.concatenate(near))


def _runs(rows: pa.Table, group: np.ndarray) -> np.ndarray:
    """Numbers the groups: rows of one bin may still be of several lengths, halves or parts."""
    parts = [group]
    for name in ("length", "half", "part"):
        parts.append(rows[name].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False))
    out = parts[0].astype(np.int64)
    for more in parts[1:]:
        out = np.unique(out * (int(more.max()) + 1) + more, return_inverse=True)[1]
    return out


def _folded(words: pa.Array, n: np.ndarray, of: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """Per word: how many near words, and the most frequent (of equal ones the smallest)."""
    place = np.empty(len(words), np.int64)
    place[pa.compute.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((place[near], -n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    many = np.diff(np.append(first, len(of)))
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(of[first])), pa.array(many, pa.int64()), pa.array(-n[near[first]], pa.int64()),
         words.take(pa.array(near[first]))], ["word", "n_near", "less", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, form): for distinct (word, n), the number of near words and the most
    frequent of them (`best` its n; the smallest if equal).  Words without near words have nulls."""
    length = F.char_length("word")
    each = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("length"), length.alias("own"))
    each = each.where("length > 0").select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("to_right"))
    half = F.expr("CASE WHEN to_right THEN left(word, cast(length / 2 AS int)) "
                  "ELSE right(word, length - cast(floor(length / 2) AS int)) END")
    each = each.withColumn("half", half)
    keys = ["to_right", "length", "half"]
    big = cut_lineage(each.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > GROUP)
                      .select(*keys, F.ceil(F.col("rows") / GROUP).cast("int").alias("parts")))
    each = each.withColumn("parts", F.lit(1)) if big.isEmpty() else (
        each.join(big, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1))))
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    asks = F.col("own") == F.col("length")
    each = each.withColumn("mine", mine)
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    row = F.transform(others, lambda j: F.col("mine") * F.col("parts") + j)  # as a word of the index
    column = F.transform(others, lambda i: i * F.col("parts") + F.col("mine"))  # as a query
    each = each.withColumn("part", F.explode(F.when(asks, F.array_union(row, column)).otherwise(row)))
    each = each.select(*keys, "part", "word", "n",
                       (asks & (F.col("part") % F.col("parts") == F.col("mine"))).alias("asks"),
                       F.expr("part div parts = mine").alias("indexed"), F.xxhash64(*keys, "part").alias("bin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            bins = batch.column("bin").to_numpy()
            if held and size >= SHARD:
                edges = np.flatnonzero(np.diff(bins, prepend=held[-1].column("bin")[-1].as_py()))
                if len(edges):
                    yield from _shard(pa.Table.from_batches([*held, batch.slice(0, edges[0])]))
                    batch, held, size = batch.slice(edges[0]), [], 0
            held.append(batch)
            size += batch.column("word").nbytes
        if held:
            yield from _shard(pa.Table.from_batches(held))

    dealt = each.repartition("bin").sortWithinPartitions("bin")
    best = dealt.mapInArrow(run, STATS).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("b"))
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("b.less")).alias("best"),
        F.col("b.form").alias("form"))


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n).

    A form is at least `factor` times as frequent as its word, so chains are short; they are
    followed by doubling until no root moves.
    """
    words = stored(words)
    near = stored(near_words(words).withColumn("is_form", F.col("best") >= F.col("n") * factor).select(
        "word", F.expr("CASE WHEN is_form THEN form END").alias("form"), "n", "n_near",
        F.expr("CASE WHEN is_form THEN best END").alias("form_n")))
    to = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        next_ = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        to = cut_lineage(to.join(next_, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not to.where("moved").isEmpty()
        to = to.drop("moved")
    return near.join(to, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of at least seven letters that occur twice or more."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
