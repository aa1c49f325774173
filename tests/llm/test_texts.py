"""Packing, fingerprints, the Jaccard join and byte dedup against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import fingerprints, frames, jaccard, packing, queries, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def check_packing(got, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at:at + 4096]
            want[doc, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    return len(at), sum(r.length for r in got)


def test_packing(spark, sf_dir, rows):
    got = queries.QUERIES["op1_best_fit_packing"](spark, sf_dir).collect()
    used, ids = check_packing(got, rows("documents", "doc_id, text"))
    assert used <= -(-ids // 4096) * 1.02 + 1


def test_packing_odd(spark, odd):
    got = packing.pack(packing.tokenised(odd)).collect()
    check_packing(got, [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(packing.tokenised(odd.limit(0))).collect() == []


def test_packing_hands_workers_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([batch.nbytes], pa.int64()), "text": pa.array(["a"])})

    rows = spark.range(9000).coalesce(1).select(F.repeat(F.lit("word "), 400).alias("text"))
    before = {k: spark.conf.get(k) for k in frames.SPARING}
    got = packing.pack(packing.tokenised(rows.mapInArrow(sizes, "doc_id long, text string"))).collect()
    assert max(r.doc_id for r in got) < 10 << 20
    assert {k: spark.conf.get(k) for k in frames.SPARING} == before


def test_packing_of_texts_tokenised_in_several_goes(spark):
    docs = [(i, f"word{i % 7} Other's {i} " * 60 if i % 11 else None) for i in range(1500)]
    docs[700] = (700, "a long one " * 110_000)  # more than is tokenised at once
    assert sum(len(t or "") for _, t in docs) > 2 * packing.AT_ONCE and len(docs[700][1]) > packing.AT_ONCE
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    check_packing(packing.pack(packing.tokenised(frame)).collect(), docs)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    capacity = 97
    sizes = Counter(rng.integers(1 + 20 * (seed % 2), capacity + 1, 400).tolist())
    bins = defaultdict(list)
    for w, lo, hi, base, each, at in packing.plan(dict(sizes), capacity):
        for o in range(lo, hi):
            bins[base + (o - lo) // each].append((at + (o - lo) % each * w, w))
    assert Counter(w for b in bins.values() for _, w in b) == sizes
    for b in bins.values():
        end = 0
        for at, w in sorted(b):
            assert at == end
            end += w
        assert end <= capacity
    # first-fit decreasing as a yardstick
    room = []
    for w in sorted(sizes.elements(), reverse=True):
        for i, r in enumerate(room):
            if r >= w:
                room[i] -= w
                break
        else:
            room.append(capacity - w)
    assert len(bins) <= len(room)


def generalised(a, b):
    def weights(text):
        n = Counter(WORD.findall(lowered(text)))
        return {w: c * len(w.encode()) for w, c in n.items()}

    a, b = weights(a), weights(b)
    top = sum(max(a.get(w, 0), b.get(w, 0)) for w in a | b)
    return sum(min(a[w], b[w]) for w in a.keys() & b.keys()) / top if top else 1.0


def check_fingerprints(got, docs):
    by, errors = {r.doc_id: r for r in got}, []
    assert len(got) == len(docs)
    for i, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        r = by[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - generalised(text, edited), r.near_next - generalised(text, after)]
    same = defaultdict(set)
    for doc, text in docs:
        same[text].add(by[doc].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    return np.array(errors)


def test_fingerprints_estimate_generalised_jaccard(spark, sf_dir, rows):
    got = queries.QUERIES["op2_consistent_weighted"](spark, sf_dir).collect()
    errors = check_fingerprints(got, rows("documents", "doc_id, text"))
    assert abs(errors.mean()) < 0.01 and np.sqrt((errors ** 2).mean()) < 0.07


def test_fingerprints_odd(spark, odd):
    some = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = sorted((r.doc_id, r.text) for r in some.collect())
    check_fingerprints(fingerprints.edited_pairs(some, 3).collect(), docs)
    assert fingerprints.edited_pairs(odd, 4).count() == odd.count()
    assert fingerprints.edited_pairs(odd.limit(0), 4).count() == 0
    assert fingerprints.edited_pairs(odd.where("doc_id = 3"), 4).first().near_next == 1.0


def brute_components(docs, k, percent):
    sets = {}
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        sets[doc] = frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            inverted[g].append(d)
    common = Counter()
    for ds in inverted.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_jaccard(spark, sf_dir, rows):
    got = queries.QUERIES["op3_size_aware_jaccard"](spark, sf_dir).collect()
    want = brute_components(rows("documents", "doc_id, text"), 4, 85)
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_small_and_crowded_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 5)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(400):
        n = int(rng.integers(0, 24)) if i % 2 else 60
        words = base[:n] if i % 3 else [f"v{j}" for j in range(n)]
        words = list(words)
        for _ in range(int(rng.integers(0, 3))):
            if words:
                words[int(rng.integers(len(words)))] = f"x{rng.integers(4)}"
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for k, percent in ((4, 85), (1, 80)):
        got = jaccard.jaccard_components(frame, k, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, k, percent)


def test_jaccard_large_sets_of_different_sizes(spark):
    """Bitmaps of several widths meet: sets of about 2,000 and 4,000 shingles, crowded and not."""
    rng = np.random.default_rng(5)
    docs = []
    for name, size, count in (("a", 2300, 60), ("b", 4500, 10)):
        for _ in range(count):
            words = [f"{name}{j}" for j in range(int(size * rng.uniform(0.6, 1)))]
            for at in rng.integers(len(words), size=int(rng.integers(0, 600))):
                words[at] = f"x{rng.integers(10**9)}"
            docs.append((len(docs), " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_components(frame, 1, 80).collect()
    want = brute_components(docs, 1, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < len(docs)


def test_bitmaps_tell_large_sets_apart():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(1 << 63, size=n, dtype=np.uint64)) for n in (2100, 2500, 9000, 9000)]
    sets.append(sets[2][:8500])
    bits = [jaccard.parities(s) for s in sets]
    pairs = [(i, j) for i in range(5) for j in range(i)]
    n = [len(s) for s in sets]
    batch = pa.RecordBatch.from_pydict({
        "a": [i for i, _ in pairs], "b": [j for _, j in pairs], "n_a": [n[i] for i, _ in pairs],
        "n_b": [n[j] for _, j in pairs], "x": [bits[i] for i, _ in pairs], "y": [bits[j] for _, j in pairs]})
    left = [tuple(r.values()) for out in jaccard._bounded(80)([batch]) for r in out.to_pylist()]
    assert left == [(4, 2)]


def test_jaccard_phrases_met_once_a_batch_tie_no_texts(spark, monkeypatch):
    """Phrases that many texts share, though none is frequent in a single batch, make no group."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 5)
    blocks, members = jaccard._blocks, []

    def counted(group, *rest):
        members.append(group.count())
        return blocks(group, *rest)

    monkeypatch.setattr(jaccard, "_blocks", counted)
    rng = np.random.default_rng(8)
    phrases = [" ".join(f"p{i}{c}" for c in "abcd") for i in range(1000)]
    docs = []
    for i in range(400):
        parts = [phrases[p] for p in rng.choice(1000, 20, replace=False)] + [f"u{i}x{j}" for j in range(120)]
        docs.append((i, " ".join(rng.permutation(parts))))
    docs.append((400, docs[7][1] + " end"))
    per_batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame, 4, 85).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    assert got == {i: i for i in range(400)} | {400: 7}
    assert max(members) == 0


def test_jaccard_counts_shingles_over_all_texts(spark):
    """Counts do not depend on which texts share a task."""
    docs = [(i, f"u{i} common phrase of some words" if i < 60 else f"u{i} {i % 20} is in three texts") for i in range(120)]
    met = jaccard.shapes(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), 5, 80).cache()
    rows = jaccard.frequencies(met).collect()
    sets = [jaccard.T.shingle_sets(*jaccard.T.utf8(pa.array([text])), 5)[0] for _, text in docs]
    want = Counter(t for s in sets for t in jaccard.brief(s).tolist())
    assert {r.token: r.hits for r in rows if r.token is not None} == {t: n for t, n in want.items() if n > 48}
    assert sum(r.hits for r in rows if r.token is None) == sum(n for n in want.values() if n > 1)
    assert sum(r.squares for r in rows if r.token is None) == sum(n * n for n in want.values() if n > 1)
    met.unpersist()


def test_jaccard_odd(spark, odd):
    got = jaccard.jaccard_components(odd, 4, 85).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1] == (0, 1) and by[5] == (0, 5) and by[3] == (1, 3) and by[4] == (1, 3)
    assert by[None] == (1, None) and by[7] == (1, 6)
    assert jaccard.jaccard_components(odd.limit(0)).collect() == []
    assert jaccard.one_of_each(odd).columns == odd.columns


def brute_removed(docs, length):
    first, starts = {}, defaultdict(set)
    raws = [(t or "").encode() for _, t in docs]
    for d, raw in enumerate(raws):
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in first:
                starts[first[w][0]].add(first[w][1])
                starts[d].add(s)
            else:
                first[w] = (d, s)
    out = []
    for d, raw in enumerate(raws):
        gone = np.zeros(len(raw) + 1, bool)
        for s in starts[d]:
            gone[s:s + length] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((docs[d][0], len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def as_rows(frame):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def test_suffix_dedup(spark, sf_dir, rows):
    got = as_rows(queries.QUERIES["op6_prefix_doubling"](spark, sf_dir))
    assert got == brute_removed(rows("documents", "doc_id, text"), 400)


@pytest.mark.parametrize("length", (40, 61))
def test_suffix_dedup_small(spark, length):
    rng = np.random.default_rng(length)
    parts = ["".join(rng.choice(list("ab é"), 90)) for _ in range(12)] + ["ab" * 70, "a" * 200]
    docs = []
    for i in range(120):
        text = ""
        for _ in range(int(rng.integers(0, 5))):
            p = parts[int(rng.integers(len(parts)))]
            lo = int(rng.integers(len(p) // 2))
            text += p[lo:lo + int(rng.integers(10, 160))] + "".join(rng.choice(list("cdefg"), int(rng.integers(4))))
        docs.append((i, text))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert as_rows(suffix.suffix_dedup(frame, length)) == brute_removed(docs, length)


def test_suffix_dedup_odd(spark, odd):
    docs = [(r.doc_id, r.text if len(r.text or "") < 1000 else r.text[:2000]) for r in odd.collect()]
    docs += [(20, docs[-4][1]), (20, docs[-4][1]), (21, "z" * 399), (22, "q" * 401), (22, "q" * 401)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_rows(suffix.suffix_dedup(frame)) == brute_removed(docs, 400)
    assert suffix.suffix_dedup(odd.limit(0)).collect() == []
    left = suffix.without_repeats(odd)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, 4, None, 5, 8, 9}


def test_op6_gives_the_text_left(spark, tmp_path):
    rng = np.random.default_rng(11)
    prose = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, split = prose(450), prose(399)
    docs = [(i, f"{prose(300)}{i}{passage}{i}{prose(200)}") for i in range(8)]
    docs += [(i, prose(900)) for i in range(8, 16)] + [(16, None), (None, passage), (None, prose(500))]
    # the first byte of both letters is the same
    docs += [(17, f"{prose(90)}1{split}é"), (18, f"{prose(70)}2{split}è")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_prefix_doubling"](spark, str(tmp_path))
    assert as_rows(got) == brute_removed(docs, 400)
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert left == Counter((d, (t or "").replace(passage, "").split(split)[0]) for d, t in docs)
    texts = {r.doc_id: r for r in suffix.suffix_dedup(frame).collect() if r.doc_id is not None}
    for d, t in docs:
        if d is not None:
            raw, r = (t or "").encode(), texts[d]
            kept = b"".join(raw[i:j] for i, j in zip([0, *r.cut_to], [*r.cut_from, len(raw)]))
            assert hashlib.sha256(kept).hexdigest() == r.kept_sha256 and kept.decode("utf-8", "ignore") == r.kept


def test_stored_tables_leave_no_shuffle_files(spark):
    before = {k: spark.conf.get(k) for k in frames.SPARING}
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().shuffleManager().shuffleBlockResolver()
    start = files.getStoredShuffles().size()
    kept = frames.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long")
    parts = frames.stored(frames.components(edges))
    assert files.getStoredShuffles().size() <= start
    assert {k: spark.conf.get(k) for k in frames.SPARING} == before
    assert sorted(map(tuple, parts.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert kept.count() == 7


def test_workers_give_back_what_other_operators_held(monkeypatch):
    monkeypatch.setattr(frames, "_caches", {})
    frames.worker_cache("one")["blocks"] = [bytes(1000) for _ in range(200_000)]
    kept = frames.worker_cache("one")["blocks"][::4000]  # a few that stay hold the others' pages
    held = resident()
    frames.worker_cache("two")
    assert len(kept) == 50 and resident() < held - 100


def resident():
    """MB of memory this process holds."""
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_workers_of_stored_tables_get_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    rows = spark.range(9000).coalesce(1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    assert max(n for n, in frames.stored(rows.mapInArrow(sizes, "n long")).collect()) < 10 << 20
