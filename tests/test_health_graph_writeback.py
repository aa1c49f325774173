import hashlib
import random

from pyspark.sql import functions as F

from faultline import model as M
from faultline.operators import evidence as E, graph as G, writeback as WB
from faultline.scale import number_rows
from helpers import by


def test_six_assets(spark):
    rows = [
        ("rev", "rev", "Facts sourced from Oracle ERP.", None, ["month"], ["snow.raw"], 2, 340,
         [], ["Revenue"]),
        ("cust", "cust", "Deprecated temporary table, do not use.", None, ["id"], ["snow.raw"], 3,
         120, [], ["Customer"]),
        ("spend", "spend", "Spend loaded from Salesforce.", None, ["c"], ["s3.raw"], 0, 3, [], []),
        ("prod", "prod", None, None, ["id"], ["a", "b"], 0, 0, [], ["Product"]),
        ("date", "date", "Standard dates keyed by `day`.", None, ["Day"], ["stg"], 5, 60, [],
         ["Date"]),
        ("blob", "blob", None, None, [], [], 0, 0, [], []),
        ("stale", "stale", "Uses `gone` and `Day`, `gone`.", None, ["day"], [], 0, 0, [], []),
    ]
    h = E.health(E.investigate(spark.createDataFrame(rows, M.EVIDENCE)))
    r = by(h, "urn")
    assert [(c.kind, c.word) for c in r["rev"].contradictions] == [
        ("source_mismatch", "erp"), ("source_mismatch", "oracle")]
    assert r["cust"].contradictions[0].word == "deprecated"
    assert [c.word for c in r["stale"].contradictions] == ["gone", "gone"]
    assert {u: (x.action, x.status) for u, x in r.items()} == {
        "rev": ("review", "CRITICAL"), "cust": ("review", "CRITICAL"),
        "spend": ("review", "NEEDS_REVIEW"), "prod": ("write", "FORGOTTEN"),
        "date": ("none", "HEALTHY"), "blob": ("abstain", "FORGOTTEN"),
        "stale": ("review", "NEEDS_REVIEW")}
    cov = E.health_coverage(h.where("urn <> 'stale'")).first()
    assert (cov.assets, cov.healthy_pct, cov.critical, cov.needs_review, cov.forgotten,
            cov.healthy) == (6, 16.7, 2, 1, 2, 1)
    n = {x.outcome: x["count"] for x in
         E.write_gate(h.where("urn <> 'stale'")).groupBy("outcome").count().collect()}
    assert n == {"written": 1, "queued": 3, "skipped": 2}


def kahn(nodes, edges):
    """Queue version of the plan order, for comparison."""
    up = {n: {a for a, b in edges if b == n and a in nodes and a != n} for n in nodes}
    order, left = [], dict(up)
    while True:
        ready = sorted((n for n in left if not left[n]), key=lambda n: (*nodes[n], n))
        if not ready:
            break
        order.append(ready[0])
        del left[ready[0]]
        for n in left:
            left[n].discard(ready[0])
    return order + sorted(left, key=lambda n: (*nodes[n], n))


def test_plan_order_equals_a_queue(spark):
    rnd, rows, edges, want = random.Random(3), [], [], {}
    for c in range(6):
        names = [f"k{c}_{i}" for i in range(14)]
        nodes = {n: (rnd.randrange(3), rnd.choice("abcdefgh") + n) for n in names}
        e = {(rnd.choice(names[:i]), names[i]) for i in range(1, 14) for _ in range(rnd.randrange(3))}
        if c == 5:
            e |= {(names[3], names[2]), (names[2], names[3]), (names[1], names[1])}
        rows += [(f"c{c}", n, t, x) for n, (t, x) in nodes.items()]
        edges += list(e)
        want[f"c{c}"] = kahn(nodes, e)
    rnd.shuffle(rows)
    n = spark.createDataFrame(rows, "change_id string, key string, tier int, name string")
    e = spark.createDataFrame(edges, "up string, down string")
    got = {}
    for r in G.with_step(G.plan_order(n, e)).orderBy("change_id", "step").collect():
        got.setdefault(r.change_id, []).append(r.key)
        assert r.step == len(got[r.change_id])
    assert got == want


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")],
                              "up string, down string")
    reach = {(r.start, r.node): r.hop for r in G.closure(e).collect()}
    assert reach["a", "d"] == 3 and ("a", "a") not in reach and ("d", "d") not in reach
    two = {(r.start, r.node) for r in G.closure(e, max_hops=2).collect()}
    assert two == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "a"), ("b", "d"), ("c", "a"),
                   ("c", "d"), ("c", "b")}


def test_number_rows_spreads_a_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"),
                                  ((F.col("id") * 7919) % 1000).alias("v"))
    for k in ("hot", "cold"):
        rows = number_rows(df, ["k"], ["v"], "n").where(F.col("k") == k).orderBy("v").collect()
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))


def test_fingerprint_ignores_order_and_has_one_form(spark):
    rows = [("c", f"add_tags:u{i}", "add_tags", f"u{i}", f"tags: {i}") for i in range(50)]
    ddl = "change_id string, mutation_id string, tool string, target_urn string, payload_digest string"
    a = spark.createDataFrame(rows, ddl)
    b = spark.createDataFrame(rows[::-1], ddl).repartition(3)
    c = spark.createDataFrame(rows[:-1] + [("c", "add_tags:u49", "add_tags", "u49", "tags: x")], ddl)

    def entries(df):
        return WB.queue_digest(df).first().entries

    def plain(rows):
        buckets = {}
        for r in rows:
            text = f"{r[1]}::{r[4]}"
            buckets.setdefault(hashlib.sha256(text.encode()).hexdigest()[:3], []).append(text)
        return "|".join(hashlib.sha256("|".join(sorted(buckets[b])).encode()).hexdigest()
                        for b in sorted(buckets))

    assert entries(a) == entries(b) == plain(rows) != entries(c)
    many = [("c", f"add_tags:v{i}", "add_tags", f"v{i}", f"tags: {i}") for i in range(5000)]
    assert entries(spark.createDataFrame(many, ddl)) == plain(many)


def test_aspect_merges(spark):
    mark = M.FOOTER_MARK
    cur = spark.createDataFrame([("u", f"base\n\n{mark} old"), ("v", "keep")],
                                "urn string, description string")
    upd = spark.createDataFrame([("u", f"{mark} one", 1), ("u", f"{mark} two", 2),
                                 ("w", f"{mark} new", 1)], "urn string, footer string, at int")
    d = by(WB.merge_descriptions(cur, upd), "urn")
    assert d["u"].description == f"base\n\n{mark} two" and d["v"].description == "keep"
    assert d["w"].description == f"\n\n{mark} new"
    props = spark.createDataFrame([("u", {"a": "1", "b": "2"})], "urn string, props map<string,string>")
    new = spark.createDataFrame([("u", {"b": "9", "c": "3"})], "urn string, props map<string,string>")
    assert WB.merge_properties(props, new).first().props == {"a": "1", "b": "9", "c": "3"}
    assert WB.replace_properties(props, new).first().props == {"b": "9", "c": "3"}


def test_ledger_consumes_once(spark):
    dec = spark.createDataFrame([("m1", "ann", None), ("m1", "bob", None), ("m2", "cy", "stale"),
                                 ("m3", "di", None)],
                                "manifest_id string, approver string, refusal_code string")
    ledger = spark.createDataFrame([("m3",)], "manifest_id string")
    got = WB.consume(dec, ledger, F.current_timestamp()).collect()
    assert [(r.manifest_id, r.approver) for r in got] == [("m1", "ann")]
