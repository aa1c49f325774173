"""The pipeline's stages against plain versions of each, on the smallest data."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from faultline.scale import cut_lineage
from test_texts import brute_components


def test_stages(spark, sf_dir):
    start = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        steps.append(docs.collect())
        if len(steps) < len(corpus_pipeline.STAGES):
            assert docs.columns == start.columns
    texts = {r.doc_id: r.text for r in start.collect()}
    language, near, repeats, mixture, packed = steps
    assert {r.doc_id for r in language} == {d for d, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    groups = brute_components([(r.doc_id, r.text) for r in language], 5, 80)
    assert {r.doc_id for r in near} == {d for d, (_, c) in groups.items() if d == c}
    left = brute_passages([(r.doc_id, r.text) for r in near], 51)
    words = brute_passages([(r.doc_id, r.text) for r in near], 10**9)
    assert {r.doc_id: r.text for r in near if left[r.doc_id] == words[r.doc_id]}.items() <= {
        r.doc_id: r.text for r in repeats}.items()
    kept = brute_passages([(r.doc_id, r.text) for r in repeats], 10**9)
    assert kept == {d: w for d, w in left.items() if w}
    times = Counter(r.doc_id for r in mixture)
    assert set(times) <= {r.doc_id for r in repeats} and max(times.values()) <= 3
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times


def brute_passages(docs, length):
    """Per text, what is left without the runs of `length` words that occur more than once."""
    words = {d: [w for w in re.split(r"[ \t-\r]+", t or "") if w] for d, t in docs}
    windows = {d: [tuple(w[i:i + length]) for i in range(len(w) - length + 1)] for d, w in words.items()}
    often = Counter(x for found in windows.values() for x in found)
    left = {}
    for d, w in words.items():
        gone = {i + k for i, x in enumerate(windows[d]) if often[x] > 1 for k in range(length)}
        left[d] = [x for i, x in enumerate(w) if i not in gone]
    return left


def test_passages_of_51_short_words_go(spark, rows):
    rng = random.Random(51)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 5)))
    shared, near = [word() for _ in range(51)], [word() for _ in range(50)]
    assert len(" ".join(shared)) < 250
    docs = []
    for i in range(12):
        gap = ["\n", " ", "  "][i % 3]
        a, b, c = ([word() for _ in range(90)] for _ in range(3))
        docs.append((i, gap.join(a + shared + b) + " " + " ".join(near + c)))
    docs += [(20, " ".join(shared)), (21, " ".join(shared + [word()])), (22, " ".join(near)), (23, ""),
             (24, " ".join([word() for _ in range(60)] + shared)), (25, "la " * 120)]
    # runs that overlap, each of under 51 words, stay
    chain = [word() for _ in range(75)]
    docs += [(30, " ".join(chain)), (31, " ".join(chain[:45] + [word()])), (32, " ".join([word()] + chain[30:]))]
    pool = [[word() for _ in range(200)] for _ in range(5)]
    for i in range(100, 180):
        text = []
        for _ in range(rng.randint(1, 4)):
            p, lo = rng.choice(pool), rng.randrange(150)
            text += p[lo:lo + rng.randint(30, 90)] + [word() for _ in range(rng.randint(0, 3))]
        docs.append((i, " ".join(text)))
    # those of the data too: some of its documents share passages of under 400 bytes
    docs += [(1000 + d, t) for d, t in rows("documents", "doc_id, text")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, frame, "").collect()}
    left = brute_passages(docs, 51)
    assert len(left[0]) == 320 and left[30] == chain and left[20] == left[25] == []
    assert {d: w for d, w in brute_passages(got.items(), 10**9).items() if w} == {
        d: w for d, w in left.items() if w}
    assert {d for d, t in got.items() if d < 1000} == {d for d, w in left.items() if w and d < 1000} | {23}
    assert all(t == " ".join(t.split()) for d, t in got.items() if 20 <= d < 1000)


def test_stages_of_odd_rows_with_clashing_columns(spark, odd):
    """Nulls, empty and long texts, repeated rows and columns named like those the stages use."""
    for name in ("_id", "_kept", "_sha", "_text", "_size", "_u", "_row", "score", "target", "whole", "lang_pred"):
        odd = odd.withColumn(name, F.lit(name))
    docs = odd.withColumnRenamed("size", "copies").withColumn("a.b", F.lit("x"))
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, ""))
        steps.append(docs.collect())
        assert docs.columns[-1] == "a.b" and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r["_kept"] == "_kept" and r["a.b"] == "x" for r in steps[-1])
    language, near, repeats, mixture = ({r.doc_id for r in s} for s in steps)
    assert language == {3, 4, None, 6, 7, 8}
    # equal texts leave the smallest id; rows without an id stay
    assert near == {3, None, 6, 8}
    # a text that only repeats itself is one long repeated passage
    assert repeats == {3, None, 8} and mixture <= repeats
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, "").collect()} == mixture
    none = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.collect() == []
