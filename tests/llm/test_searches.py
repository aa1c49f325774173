"""Spelling variants, ranked lexical search and SimHash against plain versions."""

import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import lexical, simhash, spelling


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- spelling variants ---

def brute_vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(n):
    by_gap, by_short = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_gap[w[:i] + "\0" + w[i + 1:]].add(w)
            by_short[w[:i] + w[i + 1:]].add(w)
    near = {w: set().union(*(by_gap[w[:i] + "\0" + w[i + 1:]] for i in range(len(w))), by_short.get(w, ()))
            | {v for v in (w[:i] + w[i + 1:] for i in range(len(w))) if v in n} for w in n}
    near = {w: vs - {w} for w, vs in near.items()}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_variants_of_documents(spark, sf_dir, rows):
    want = brute_variants(brute_vocabulary(rows("documents", "doc_id, text")))
    got = spelling.op11_fm_index(spark, sf_dir).collect()
    assert [tuple(r) for r in got if tuple(r) not in want] == []
    assert len(got) == len(want) and any(r.form for r in got)


WORDS = ["aaaa", "aaaaa", "aaa", "aaba", "abaa", "ab", "a", "b", "ba", "abc", "acb", "bca", "été", "étés", "ete",
         "\U0001F600x", "x", "漢字", "漢", "字漢", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500]


@pytest.mark.parametrize("group", [1 << 16, 2])
def test_variants_of_short_equal_and_long_words(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "SHARD", 40)
    rng = np.random.default_rng(1)
    words = sorted({*WORDS, *("".join(rng.choice(list("ab"), rng.integers(1, 8))) for _ in range(150))})
    n = {w: int(rng.integers(1, 4) * 10 ** rng.integers(0, 4)) for w in words}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_variants(n)))
    chained = [r for r in got if r.form and r.root != r.form]
    assert chained, "forms of forms occur"


def test_vocabulary_of_odd_rows(spark, odd):
    got = {r.word: r.n for r in spelling.vocabulary(odd, 1, 1).collect()}
    want = Counter()
    for doc_id, text in [(r.doc_id, r.text) for r in odd.collect()]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    want.pop("", None)
    assert got == want
    assert spelling.variants(spelling.vocabulary(odd.where("false"))).collect() == []


# --- ranked lexical search ---

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    texts = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n_docs, n_terms = len(texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    by_item = defaultdict(set)
    for item, text in items:
        by_item[item] |= set(TERM.findall(lower(text or "")))
    out = []
    for item, terms in by_item.items():
        scored = []
        for d, c in texts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(item, i, d, s) for i, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[:2], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_search_of_documents(spark, sf_dir, rows):
    got = lexical.op12_nra(spark, sf_dir).collect()
    want = brute_search(rows("documents", "doc_id, text"), rows("benchmark", "item_id, text"))
    assert sorted(map(tuple, got), key=str) == want and want


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_in_many_small_shards_and_blocks(spark, sf_dir, rows, monkeypatch, k):
    monkeypatch.setattr(lexical, "SHARD", 500)
    monkeypatch.setattr(lexical, "BLOCK", 300)
    monkeypatch.setattr(lexical, "FIRST_READ", 2)
    docs, items = rows("documents", "doc_id, text"), rows("benchmark", "item_id, text")[:12]
    # ties: every text twice more under other ids
    docs = docs + [(d + 10_000, t) for d, t in docs[:60]] + [(d + 20_000, t) for d, t in docs[:60]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), k).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items, k)


def test_search_of_odd_rows(spark, odd):
    items = [(1, "one ONE one"), (2, None), (3, ""), (4, "word été 漢字"), (4, "two"), (None, "words 12345"), (5, "absent")]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    got = lexical.search(odd.withColumn("rank", F.lit(1)), queries).collect()
    want = brute_search([(r.doc_id, r.text) for r in odd.collect()], items)
    assert sorted(map(tuple, got), key=str) == want
    assert {r.item_id for r in got} == {1, 4, None}
    assert lexical.search(odd.where("false"), queries).collect() == []
    assert lexical.search(odd, queries.where("false")).collect() == []


def test_reading_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(3)
    lists, reads = [], []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.start:
                reads.append(key.stop - key.start)
            return super().__getitem__(key)

    for _ in range(3):
        doc = rng.permutation(20_000)
        score = np.sort(rng.integers(1, 1000, 20_000))[::-1]
        score[:20] += 100_000
        doc = np.concatenate((np.arange(20), doc[doc >= 20]))
        lists.append((doc.view(Counted), score))
    found, sums = lexical.resolve(lists, 20_000, 10, 0)
    whole = np.zeros(20_000, np.int64)
    for doc, score in lists:
        np.add.at(whole, np.asarray(doc), score)
    assert set(np.argsort(-whole)[:10]) <= set(found.tolist()) and (whole[found] == sums).all()
    assert sum(reads) < 3 * 5_000


# --- SimHash ---

def brute_prints(docs, k=3):
    out = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        k_ = min(k, len(words))
        hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + k_]).encode(), 42)
              for i in range(len(words) - k_ + 1)] if words else []
        out.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    return out


def brute_classes(prints, radius=2):
    kinds = sorted({p for _, p in prints})
    up = {p: p for p in kinds}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    low = {}
    for d, p in prints:
        if d is not None:
            low[root(p)] = min(d, low.get(root(p), d))
    return sorted(((d, f"{p:016x}", low.get(root(p))) for d, p in prints), key=str)


def test_simhash_of_documents(spark, sf_dir, rows):
    want = brute_classes(brute_prints(rows("documents", "doc_id, text")))
    got = simhash.op13_ball_hashing(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert any(r.doc_id != r.component_id for r in got)


def test_spark_hash_is_the_hash_of_a_shingle(spark):
    shown = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert xxhash.xxh64_intdigest(b"a b c", 42) == shown % (1 << 64)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_of_chains_and_dense_balls(spark, radius):
    rng = np.random.default_rng(5)
    prints = [0, (1 << 64) - 1]
    for _ in range(6):  # chains of small steps, and dense balls
        p = int(rng.integers(0, 1 << 63)) << 1
        prints.append(p)
        for _ in range(20):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                p ^= 1 << int(b)
            prints.append(p)
        prints += [p ^ (1 << i) for i in range(64)]
    if radius == 4:
        prints = prints[:60]
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    frame = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    pairs = simhash.links(frame, radius).collect()
    assert all((r.a ^ r.b).bit_count() <= radius if r.a ^ r.b >= 0 else ((r.a ^ r.b) % (1 << 64)).bit_count() <= radius
               for r in pairs)
    up = {s: s for _, s in signed}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for r in pairs:
        up[root(r.a)] = root(r.b)
    ours, theirs = defaultdict(set), defaultdict(set)
    for (i, s), (_, _, c) in zip(signed, sorted(brute_classes(rows, radius), key=lambda x: x[0])):
        ours[root(s)].add(i)
        theirs[c].add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_of_odd_rows(spark, odd):
    odd = odd.withColumn("fingerprint", F.lit("x")).withColumn("component_id", F.lit(1))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = simhash.near_duplicates(odd).withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(brute_prints(rows))
    assert simhash.near_duplicates(odd.where("false")).collect() == []
    assert simhash.fingerprint(b"a b") != 0 and simhash.fingerprint(b" \n") == 0
    with pytest.raises(ValueError):
        simhash.links(got.select(F.lit(1).cast("long").alias("fingerprint")), 3)


def test_a_fingerprint_that_a_third_of_the_rows_share(spark):
    rows = [(i, "same old text here") for i in range(1500)] + [(10_000 + i, f"w{i} x{i} y{i} z{i}") for i in range(3000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
    prints = brute_prints(rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(prints)
