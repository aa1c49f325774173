"""Extraction, archives, language, mixing, quality and neighbours against plain versions."""

import gzip
import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import text as T
from faultline.llm import extraction, langid, mixing, neighbours, quality, queries, warc


def same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(rel.columns)
    assert Counter(map(tuple, got.select(*rel.columns).collect())) == Counter(rel.fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, name)


def plain_article(page):
    """For pages built like those of the test data: the blocks of the article element."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts]
    return "\n".join(p for p in parts if p)


def test_extraction(spark, sf_dir, rows):
    got = {r.page_id: r for r in queries.QUERIES["op4_site_style_tree"](spark, sf_dir).collect()}
    pages = rows("pages", "page_id, url, html")
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        r = got[page_id]
        assert (r.text, r.n_chars, r.url) == (plain_article(page), len(r.text), url)


def test_extraction_cuts_what_a_site_repeats(spark):
    page = ("<html><body><div class=shell><div class=top><p>All about our shop</p></div><div class=x>"
            "<h2>Story {0}</h2><p>It was &eacute;t&eacute; &amp; day {0}.<br>More\n\n of  it <i>here</i></p>"
            "<script>no()</script></div><div class=comments><p>Nice {0}</p></div>"
            "<div id=cookie-bar>Take cookies</div><p>Call us</div></body></html>")
    pages = [(i, "https://Shop.example/a", page.format(i)) for i in range(20)]
    pages += [(100, "https://lone.example/", page.format(1)), (101, None, None), (102, "x", ""),
              (103, "x", "<p>a<div>b<ul><li>c<li>d</ul>e &lt;f&gt; <b>g</b>h <!-- i --> j"),
              (104, "x", "<article><p>A<nav>no</nav><aside>no</aside><p>B<table><tr><td>c<td>d</table>"
                         "</article><p>outside")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract(frame, ["page_id", "url"]).collect()}
    for i in range(20):
        assert got[i] == f"Story {i}\nIt was été & day {i}. More of it here"
    assert got[100].startswith("All about our shop\nStory 1")
    assert got[101] == got[102] == ""
    assert got[103] == "a\nb\nc\nd\ne <f> gh j"
    assert got[104] == "A\nB\nc\nd"
    assert extraction.extract(frame.limit(0), ["page_id", "url"]).collect() == []
    clash = frame.withColumn("_html", F.lit("x")).withColumn("_tree", F.lit(1)).withColumn("text", F.lit("y"))
    again = extraction.extract(clash, ["page_id", "_html", "_tree", "text"])
    assert again.columns == ["page_id", "_html", "_tree", "text", "n_chars"]
    assert {r.page_id: r.text for r in again.collect()} == got


def test_archives_odd(spark, tmp_path):
    big = "x" * 120 + "é\r\n\r\nWARC/1.1\r\n" + "y" * 50
    pages = [(3, "u\r\nv", big), (1, "a", big), (1, "a", big), (2, None, None), (5, "b", "x" * 99),
             (6, "b", "x" * 99), (None, "c", big), (9, "d", "z" * 100)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write(frame, str(tmp_path / "w"))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to)
                  for r in warc.read(spark, str(tmp_path / "w")).collect())
    n = len(big.encode())
    assert got == Counter({(3, n, "revisit", 1): 1, (1, n, "response", None): 2, (2, 0, "response", None): 1,
                           (5, 99, "response", None): 1, (6, 99, "response", None): 1,
                           (None, n, "revisit", 1): 1, (9, 100, "response", None): 1})
    warc.write(frame.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).collect() == []


def record(i, body):
    head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: {i}\r\n"
            f"WARC-Payload-Digest: sha256:{__import__('hashlib').sha256(body).hexdigest()}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode()
    return head + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", (False, True))
def test_salvage(packed):
    parts = [record(i, bytes([65 + i]) * (300 + i)) for i in range(6)]
    if packed:
        parts = [gzip.compress(p) for p in parts]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    raw = b"".join([*parts[:2], bytes(bad), parts[3], b"garbage", parts[4], parts[5][:-20]])
    got = list(warc.salvage(raw))
    assert [h["warc-page-id"] for h, *_ in got if h] == ["0", "1", "3", "4"]
    at = np.cumsum([0, *map(len, parts[:4])])
    gaps = [(s, e) for h, _, s, e in got if h is None]
    assert gaps == [(at[2], at[3]), (at[4], at[4] + 7), (at[4] + 7 + len(parts[4]), len(raw))]


def test_language(spark, sf_dir, rows):
    got = queries.QUERIES["op7_hyperdimensional"](spark, sf_dir).collect()
    lang = dict(rows("documents", "doc_id, lang"))
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def plain_vector(text):
    """The bundle of bound trigrams, one by one."""
    low = [langid.letter(ord(c) if c.isalpha() else 0).astype(float) for c in f" {text.lower()} "]
    mids = [c.isalpha() for c in f" {text.lower()} "]
    out = np.zeros(langid.DIMENSIONS)
    for i in range(1, len(low) - 1):
        if mids[i]:
            out += np.roll(low[i - 1], 2) * np.roll(low[i], 1) * low[i + 1]
    return out / np.linalg.norm(out) if any(mids) else None


@pytest.mark.parametrize("text", ["AbA", "a", "été naïve", "漢字 漢字漢", "Σίσυφος\tОдин", "x1y" * 4000])
def test_language_vector_is_the_bundle_of_bound_trigrams(text):
    assert np.allclose(langid.vector(text), plain_vector(text), atol=1e-5)
    assert langid.vector("12 !") is None


def test_languages_that_share_no_letter_with_latin(spark):
    rng = random.Random(8)
    scripts = {"ru": "абвгдежзиклмнопрстуя", "bg": "абвгдежзийклмнопрстъ", "el": "αβγδεζηθικλμνξοπρστυ", "ja": "日本語学校先生東京都市山川"}
    docs = []
    for k, (lang, letters) in enumerate(scripts.items()):
        weights = [rng.random() ** 3 for _ in letters]
        for i in range(40):
            text = " ".join("".join(rng.choices(letters, weights, k=rng.randint(2, 8))) for _ in range(60))
            docs.append((1000 * k + i, text, lang))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    names, vectors = langid.prototypes(frame.where(~langid.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame, names, vectors, ["doc_id"]).collect()}
    # the same by hand
    sums = {}
    for d, text, lang in docs:
        if zlib.crc32(str(d).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + np.rint(plain_vector(text) * langid.UNIT)
    for d, text, lang in docs:
        v = plain_vector(text)
        cosine = {k: float(x @ v / np.linalg.norm(x)) for k, x in sums.items()}
        assert got[d][0] == max(cosine, key=cosine.get) == lang
        assert got[d][1] == pytest.approx(cosine[lang], abs=1e-3)


def test_language_odd(spark, odd):
    names, vectors = langid.prototypes(odd)
    got = langid.predict(odd, names, vectors, ["doc_id", "size"]).collect()
    assert len(got) == odd.count() and names == ["en", "fr"]
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 5, 9}
    assert langid.identified(odd).columns == odd.columns
    clash = odd.withColumnsRenamed({"size": "score"}).withColumn("_text", F.lit("x")).withColumn("lang_pred", F.lit(1))
    kept = langid.identified(clash.withColumn("a b.c", F.lit(2)))
    assert kept.columns[-3:] == ["_text", "lang_pred", "a b.c"] and kept.first()["a b.c"] == 2
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect()} - und
    names, vectors = langid.prototypes(odd.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, names, vectors, ["doc_id"]).collect()} == {"und"}


def test_mixing_reaches_its_targets(spark, sf_dir):
    got = queries.QUERIES["op8_pareto_mixing"](spark, sf_dir).collect()
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in got:
        key = (r.source_size, r.target)
        taken[key] += r.taken
        target[key] = r.target
        most[key] = max(most[key], r.size)
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
    for key in taken:
        assert abs(taken[key] - target[key]) <= most[key] / 2 + 1
    assert abs(sum(target.values()) - sum(r.size for r in got)) < 1


def brute_mix(docs):
    """Taken words per row of (doc_id, size, source), ranks and all, for one round of weights."""
    size = defaultdict(int)
    for _, n, source in docs:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, [s for s in order if size[s]], sum(size.values())
    while True:
        over = [s for s in open_ if left * weight[s] > 3 * size[s] * sum(weight[x] for x in open_)]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
        left -= sum(3 * size[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    for s in open_:
        target[s] = left * weight[s] / sum(weight[x] for x in open_)
    out = []
    for s in order:
        rows = [(d, n) for d, n, x in docs if x == s]
        if not size[s]:
            out += [(d, 0) for d, _ in rows]
            continue
        whole = int(target[s] // size[s])
        rest = target[s] - whole * size[s]
        # c by bisection: the expected words of p = min(1, c * size) are the rest
        lo, hi = 0.0, 1e9
        for _ in range(300):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(1.0, c * n) * n for _, n in rows) < rest else (lo, c)

        def rank(d, n):
            p = min(max(lo * n, 1e-12), 1 - 1e-12)
            u = (int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return 0.0 if lo * n >= 1 else u / (1 - u) / (p / (1 - p))

        at = 0
        for d, n in sorted(rows, key=lambda r: (rank(*r), r[0], r[1])):
            out.append((d, (whole + (at + n / 2 <= rest)) * n))
            at += n
    return sorted(out)


def test_mixing_ranks_by_random_odds_over_inclusion_odds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 3)
    rng = random.Random(6)
    docs = [(i, rng.choice([1, 2, 3, 5, 8, 40, 200]) if i % 50 else 3000, rng.choice(["a", "b", "b", "b", "c", None]))
            for i in range(1500)] + [(2000, 0, "a"), (2001, 0, "d"), (2002, 9, "e")]
    frame = spark.createDataFrame([(d, "w " * n, s) for d, n, s in docs], "doc_id long, text string, source string")
    rows = mixing.sized(frame, "mix").cache()
    mixed = mixing.mix(rows, mixing.cuts(rows)).collect()
    got = sorted((r.doc_id, r.copies * r["_size"]) for r in mixed)
    assert got == brute_mix(docs)
    # a source of which a part is taken: large documents are in more often than small ones
    part = [r for r in mixed if r.source == "b"]
    whole = min(r.copies for r in part)
    share = {n: np.mean([r.copies - whole for r in part if r["_size"] == n]) for n in (1, 200, 3000)}
    assert share[1] < share[200] and share[1] < share[3000]


def test_mixing_odd(spark, odd):
    rows = mixing.sized(odd, "s")
    got = mixing.mix(rows, mixing.cuts(rows.select("doc_id", "source", "_size", "_u"))).collect()
    assert len(got) == odd.count()
    by = {r.source: (r.source_size, r.target) for r in got}
    total = sum(s for s, _ in by.values())
    assert abs(sum(t for _, t in by.values()) - total) < 1e-6 and by[None][0] == 3
    out = mixing.mixed_documents(odd, "s")
    assert out.columns == odd.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mixed_documents(odd.limit(0)).collect() == []


def test_quality(spark, sf_dir, rows):
    got = {r.doc_id: r for r in queries.QUERIES["op9_ordinal_quality"](spark, sf_dir).collect()}
    labels = rows("labels", "doc_id, quality, toxic")
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_toxic <= 1 for r in got.values())
    held = [(got[d], q, t) for d, q, t in labels if d in got and got[d].held_out]
    good = [r.expected_grade for r, q, t in held if q == 1 and t == 0]
    poor = [r.expected_grade for r, q, t in held if q == 0 or t == 1]
    if good and poor:
        assert np.mean([g > p for g in good for p in poor]) > 0.7


def plain_grades(text, model):
    """Expected grade and the probability of each grade, word by word."""
    w, d, theta = model
    words = [x for x in re.split(r"[ \t-\r]+", text) if x]
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words]
    hashed = {x: int(text_hash(x)) for x in low}
    n = Counter((hashed[x] >> 48) % quality.BUCKETS for x in low)
    value = {b: 1 + np.log(c) for b, c in n.items()}
    size = np.sqrt(sum(v * v for v in value.values())) or 1.0
    raw = text.encode()
    letters = sum(chr(b | 32).isalpha() and b < 128 or b >= 128 for b in raw)
    digits, space = sum(48 <= b <= 57 for b in raw), sum(b in b" \t\n\v\f\r" for b in raw)
    total = max(len(raw), 1)
    shape = [letters / total, digits / total, (len(raw) - letters - digits - space) / total,
             len(set(low)) / max(len(low), 1), np.log1p(len(low)) / 10, total / max(len(low), 1) / 20]
    s = sum(w[b] * v / size for b, v in value.items()) + np.dot(shape, d)
    over = [1.0, *(1 / (1 + np.exp(t - s)) for t in theta), 0.0]
    return sum(over[1:-1]), [a - b for a, b in zip(over, over[1:])]


def text_hash(word):
    data, offsets = T.utf8(pa.array([word]))
    return T.word_hashes(data, offsets)[3][0]


def test_quality_scores_follow_the_model(spark):
    rng, nrng = random.Random(4), np.random.default_rng(4)
    texts = ["", "One two ONE", "abc 123 !!! abc", "été naïve 漢字 x", *(" ".join(
        rng.choices(["good", "bad", "Fine", "so", "7", "--"], k=rng.randint(1, 80))) for _ in range(20))]
    model = (nrng.normal(size=quality.BUCKETS), nrng.normal(size=6), np.array([-0.4, 0.9]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score(frame, model, ["doc_id"]).collect():
        grade, each = plain_grades(texts[r.doc_id], model)
        assert r.expected_grade == pytest.approx(grade) and r.p_good == pytest.approx(each[2])
        assert r.p_toxic == pytest.approx(each[0]) and r.grade_pred == int(np.argmax(each))


def test_quality_learns_graded_words(spark):
    rng = random.Random(12)
    pools = [["spam", "ugh", "bad"], ["plain", "some", "so"], ["clear", "deep", "proof"]]
    docs = []
    for i in range(600):
        g = rng.randrange(3)
        words = [rng.choice(rng.choices(pools, [3 if k == g else 1 for k in range(3)])[0]) for _ in range(40)]
        docs.append((i, " ".join(words), g))
    frame = spark.createDataFrame(docs, "doc_id long, text string, grade int")
    model = quality.learn(frame.select("doc_id", "text"), frame.where("doc_id < 450").select("doc_id", "grade"))
    assert model[2][0] < model[2][1]
    rows = quality.score(frame.where("doc_id >= 450"), model, ["doc_id"]).collect()
    held = {d: g for d, _, g in docs}
    assert np.mean([r.grade_pred == held[r.doc_id] for r in rows]) >= 0.85
    pairs = [(held[a.doc_id], held[b.doc_id], a.expected_grade > b.expected_grade) for a in rows for b in rows]
    assert np.mean([more for x, y, more in pairs if x > y]) >= 0.95


def test_quality_odd(spark, odd):
    graded = spark.createDataFrame([(3, 2), (8, 2), (9, 0), (6, 1), (99, 1)], "doc_id long, grade int")
    got = quality.score(odd, quality.learn(odd, graded), ["doc_id", "size"]).collect()
    assert len(got) == odd.count() and all(0 <= r.expected_grade <= 2 for r in got)
    none = quality.score(odd, quality.learn(odd, graded.limit(0)), ["doc_id"]).collect()
    assert all(abs(r.expected_grade - none[0].expected_grade) < 2 for r in none)
    assert quality.score(odd.limit(0), quality.fit([], []), ["doc_id"]).collect() == []


def brute_nearest(vectors, k=5):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in zip(ids, x):
        if i % 50 == 0:
            s = x @ v
            order = np.lexsort((ids, -np.round(s, 12)))
            out[int(i)] = [int(ids[j]) for j in order if ids[j] != i][:k]
    return out


def test_neighbours(spark, sf_dir, rows):
    vectors = rows("embeddings", "vec_id, embedding")
    got = defaultdict(list)
    for r in queries.QUERIES["op10_small_world"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(vectors)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.95


def test_vectors_of_any_finite_size(spark):
    for scale in (1e200, 1e-200, 1e-310, 1e300):
        some = [(0, [scale, 0.0]), (1, [scale, scale]), (2, [-scale, scale]), (3, [scale / 2, 0.0])]
        frame = spark.createDataFrame(some, "vec_id long, embedding array<double>")
        got = neighbours.nearest(frame, frame.where("vec_id = 0")).orderBy("rank").collect()
        assert [(r.vec_id, round(r.score, 12)) for r in got] == [
            (3, 1.0), (1, round(0.5 ** 0.5, 12)), (2, round(-0.5 ** 0.5, 12))]
    mixed = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0])]
    frame = spark.createDataFrame(mixed, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, frame.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]


def test_recall_over_shards_with_a_tight_cluster(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 600)
    rng = np.random.default_rng(10)
    spread, centre = rng.normal(size=(1200, 24)), rng.normal(size=24)
    x = np.concatenate((spread, centre + 0.01 * rng.normal(size=(600, 24))))
    rng.shuffle(x)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(frame, frame.where("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, len(x), 50):
        sims = unit @ unit[q]
        sims[q] = -2
        hits.append(len(got[q] & set(np.argsort(-sims)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.9


def test_neighbours_odd(spark):
    some = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
            (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [-1.0, 0.0]), (50, None), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(some, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, frame.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [
        (0, 1, 1.0), (0, 2, 1.0), (0, 3, 0.0), (0, 8, -1.0)]
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(many, many.where("vec_id = 100")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).collect() == []


@pytest.mark.parametrize("wrap", ("content-sidebar-wrap", "layout with-sidebar", "no-sidebar", "left-side",
                                  "sidebar", "search widget"))
def test_layout_wrappers_keep_their_article(wrap):
    page = ("<body><div class='{0}'><{1}><div class='post-header'><h1>Title</h1></div><p>The text of it.</p>"
            "<div class='comments'><p>Nice</p></div></{1}><div class='sidebar'><p>Other</p></div></div>"
            "<div class='widget'><p>Ask</p></div></body>")
    for tag in ("main", "article"):
        kept = [text for _, text, marked, _ in extraction.blocks(page.format(wrap, tag)) if marked]
        assert kept == ["Title", "The text of it."]
    # nothing is marked: what holds most of the page stays
    kept = [text for _, text, _, _ in extraction.blocks(page.format(wrap, "div"))]
    assert kept == ["Title", "The text of it."]
    # comments longer than the marked text are still none of it
    kept = [b[1] for b in extraction.blocks("<article><p>A b</p></article><div id=comments><p>" + "c " * 90)]
    assert kept == ["A b"]


def test_importance_decides_over_marks(spark):
    teaser = ("<body><div class=page><div class=lead><h1>Story {0}</h1><p>It was day {0}, and much was told of it.</p>"
              "</div></div><article class=teaser><p>{1}</p></article></body>")
    both = "<body><main><p>Told on day {0} and {0}</p><div class=x><p>Buy our goods</p></div></main></body>"
    pages = [(i, "http://same.example/", teaser.format(i, "Read our best offers")) for i in range(20)]
    pages += [(100 + i, "http://new.example/", teaser.format(i, f"Next to read: {i}")) for i in range(20)]
    pages += [(200 + i, "http://main.example/", both.format(i)) for i in range(20)]
    # a small host: seven pages of which each repeats a line
    pages += [(300 + i, "http://few.example/", f"<div class=a><p>Call us</p></div><div class=b>Day {i}</div>")
              for i in range(7)]
    # the whole page again and again, all of it marked
    pages += [(400 + i, "http://copy.example/", "<article><p>One text</p></article>") for i in range(20)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract(frame, ["page_id"]).collect()}
    for i in range(20):
        story = f"Story {i}\nIt was day {i}, and much was told of it."
        assert got[i] == story
        assert got[100 + i] == f"{story}\nNext to read: {i}"
        assert got[200 + i] == f"Told on day {i} and {i}"
        assert got[400 + i] == "One text"
    assert {got[300 + i] for i in range(7)} == {f"Day {i}" for i in range(7)}
    tree = {(r.host, r.branch): r for r in extraction.style_tree(frame).collect()}
    top = tree["same.example", "body>article.teaser"]
    assert (top.pages, round(top.content, 6), round(top.presentation, 6)) == (20, 0, 0)
    assert round(tree["same.example", "body>div.page>div.lead"].content, 6) == 1
    assert all(0 <= r.importance <= 1 + 1e-9 for r in tree.values())
