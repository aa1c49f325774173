"""Best-fit packing with Martello-Toth dominance reduction.

The documents are tokenised and cut once, inside tasks.  What decides the packing is the histogram
of piece lengths, which has at most `capacity` rows whatever the corpus holds; it is the only thing
the driver sees.  Spark numbers the pieces of each length and joins the numbers to the plan.

Defined cases: a null text is empty and gives the closing id alone; an empty table gives no rows;
repeated rows are packed once each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from faultline.llm import text as T
from faultline.llm.frames import sparing, table, worker_cache
from faultline.scale import cut_lineage

#: The tokenizer file's own split pattern, restated for the plain characters of `PLAIN`.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
#: Words of these characters alone keep their parts apart and lower-case one by one.
PLAIN = re.compile(r"[\x21-\x7E¡-¬®-ÿ]+")
CONTROLS = re.compile("[\x1c-\x1f]")
#: Words kept with their ids by each Python worker; later words are looked up as they come.
KEPT_WORDS = 250_000
#: Bytes of text that are tokenised at once.
AT_ONCE = 1 << 20
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


class WordIds:
    """Token ids of white-space-separated words, as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the model writes the bytes of a plain character that is not ASCII.
        self.written = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        out, one, split, wanted = {}, [], [], set()
        parts = self.parts
        for w in missing:
            if w.isalpha() and PLAIN.fullmatch(w):
                low = w.lower()
                one.append((w, low))
                wanted.add(low)
            elif PLAIN.fullmatch(w) and "<|" not in w:
                ps = SPLIT.findall(w.lower())
                split.append((w, ps))
                wanted.update(ps)
            else:
                out[w] = array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()
        tokenize, written, found = self.model.tokenize, self.written, {}
        for p in wanted:
            ids = parts.get(p)
            if ids is None:
                tokens = tokenize(p if p.isascii() else p.translate(written))
                ids = array("I", [t.id for t in tokens]).tobytes()
            found[p] = ids
        for w, p in one:
            out[w] = found[p]
        for w, ps in split:
            out[w] = b"".join([found[p] for p in ps])
        if len(parts) < KEPT_WORDS:
            parts.update(found)
        if len(self.words) < KEPT_WORDS:
            self.words.update(out)
        return out

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        # str.split also parts at the four control characters that the tokenizer keeps
        split = [t.split() if not CONTROLS.search(t)
                 else regex.split(r"\p{White_Space}+", t) for t in texts]
        get = self.words.get
        known = [list(map(get, ws)) for ws in split]
        missing: set[str] = set()
        for ws, got in zip(split, known):
            if not all(got):
                missing.update([w for w, g in zip(ws, got) if g is None])
        missing.discard("")
        extra = self.learn(missing) if missing else {}
        extra[""] = b""
        for ws, got in zip(split, known):
            yield b"".join(got if all(got) else
                           [extra[w] if g is None else g for w, g in zip(ws, got)])


def tokenised(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096,
              closing: int = 1) -> DataFrame:
    """A row per piece: whole documents, or cuts of `capacity` ids of longer ones.

    `nth` counts the pieces of the same length before it in its task.
    """

    def run(batches):
        loaded = worker_cache("packing")
        if tokenizer not in loaded:
            loaded[tokenizer] = WordIds(tokenizer)
        reader, end = loaded[tokenizer], np.array([closing], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        counts: dict[int, int] = {}
        for batch in batches:
            for lo, hi in T.portions(batch.column(1), AT_ONCE):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), reader.ids(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        n = len(cut) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(cut), counts.get(n, 0), task))
                        counts[n] = counts.get(n, 0) + 1
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                         pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: (length, from, to, sequence, per_sequence, offset).

    Pieces number `from` .. `to`-1 of that length go, `per_sequence` at a time, into the sequences
    counted from `sequence`, side by side from `offset`.
    """
    left = {w: n for w, n in histogram.items() if n}
    given = dict.fromkeys(left, 0)
    slots, sequences = [], 0

    def put(w: int, bins: int, base: int, each: int, at: int) -> None:
        slots.append((w, given[w], given[w] + bins * each, base, each, at))
        given[w] += bins * each
        left[w] -= bins * each
        if not left[w]:
            del left[w]

    def fix(bins: int, *lengths: int) -> None:
        nonlocal sequences
        at = 0
        for w, same in groupby(lengths):
            each = len(list(same))
            put(w, bins, sequences, each, at)
            at += each * w
        sequences += bins

    def smallest(ordered: list[int], w: int, k: int) -> list[int]:
        out: list[int] = []
        for s in ordered:
            out += [s] * min(k - len(out), left[s] - (s == w))
            if len(out) >= k:
                break
        return out

    def best_pair(ordered: list[int], w: int, room: int) -> int:
        """The largest sum of two pieces besides one of `w` that fits."""
        lo, hi, best = 0, len(ordered) - 1, 0
        while lo <= hi:
            a, b = ordered[lo], ordered[hi]
            short = left[a] - (a == w) < 1 + (lo == hi)
            if a + b > room or left[b] - (b == w) < 1:
                hi -= 1
            elif short:
                lo += 1
            else:
                best = max(best, a + b)
                lo += 1
        return best

    def dominate() -> bool:
        """Fix sets that no other set with their largest piece can beat."""
        fixed = False
        for w in sorted(left, reverse=True):
            while left.get(w):
                n, room, ordered = left[w], capacity - w, sorted(left)
                low = smallest(ordered, w, 3)
                if not low or low[0] > room:  # nothing else fits
                    fix(n, w)
                    fixed = True
                    continue
                if left.get(room, 0) > (room == w):  # a full sequence
                    pairs = n // 2 if room == w else min(n, left[room])
                    fix(pairs, *sorted((w, room), reverse=True))
                    fixed = True
                    continue
                k = bisect.bisect_right(ordered, room) - 1
                while left[ordered[k]] - (ordered[k] == w) < 1:
                    k -= 1
                best = ordered[k]
                one = len(low) < 2 or low[0] + low[1] > room
                two = len(low) < 3 or sum(low) > room
                if one or two and best >= best_pair(ordered, w, room):
                    fix(n // 2 if best == w else min(n, left[best]),
                        *sorted((w, best), reverse=True))
                    fixed = True
                    continue
                break
        return fixed

    while dominate():
        pass

    open_: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences
    rooms: list[int] = []

    def leave(room: int, base: int, bins: int) -> None:
        if not room or not bins:
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((base, bins))

    for w in sorted(left, reverse=True):
        while w in left:
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):
                room, base, bins = capacity, sequences, -(-left[w] // (capacity // w))
                sequences += bins
            else:
                room = rooms[i]
                base, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            each = room // w
            full = min(bins, left[w] // each)
            if full:
                put(w, full, base, each, capacity - room)
                leave(room - each * w, base, full)
            some = left.get(w, 0)
            if some and some < each and full < bins:
                put(w, 1, base + full, some, capacity - room)
                leave(room - some * w, base + full, 1)
                full += 1
            leave(room, base + full, bins - full)
    return slots


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to the rows of `tokenised`."""
    spark = pieces.sparkSession
    with sparing(spark):
        pieces = cut_lineage(pieces)
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    counts = cut_lineage(counts.select(
        "length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity) or [(0, 0, 0, 0, 1, 0)],
        "length long, first long, last long, base long, each long, at long")
    numbered = pieces.join(counts.drop("n"), ["length", "task"]).withColumn(
        "number", F.col("nth") + F.col("earlier"))
    placed = numbered.join(slots, (numbered["length"] == slots["length"])
                           & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
    step = F.col("number") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", numbered["length"], "ids_crc32",
        (F.col("base") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("each") * numbered["length"]).cast("long").alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenised(table(spark, sf_dir, "documents")))
