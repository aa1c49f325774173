"""Closures, counts and plan order on long chains, ladders, hubs and cycles, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import graph as G
from test_health_graph_writeback import kahn

EDGES = "up string, down string"


def bfs(edges, start):
    out, seen, front, hop = {}, {start}, [start], 0
    down = {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)
    while front:
        hop += 1
        front = sorted({b for a in front for b in down.get(a, ())} - seen)
        seen |= set(front)
        out.update({b: hop for b in front})
    return out


def graphs():
    rnd = random.Random(11)
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(1000)]
    yield "chain", chain, ["n0000", "n0500", "n0998", "absent"]
    yield "ring with a tail", [*chain[:40], ("n0040", "n0000"), ("n0020", "x"), ("x", "y")], ["n0003", "y"]
    yield "tree", [(f"t{(i - 1) // 3}", f"t{i}") for i in range(1, 400)], ["t0", "t5"]
    for k in range(3):
        n = 60
        yield f"random {k}", [(f"r{rnd.randrange(n)}", f"r{rnd.randrange(n)}") for _ in range(n + 30 * k)], [
            f"r{i}" for i in range(0, n, 7)]
    yield "hub", [("hub", f"h{i}") for i in range(300)] + [(f"h{i}", "out") for i in range(300)], ["hub", "h1"]
    yield "none", [], ["a"]


@pytest.mark.parametrize("edges,starts", [pytest.param(e, s, id=n) for n, e, s in graphs()])
def test_closure_equals_breadth_first_search(spark, edges, starts):
    e = spark.createDataFrame(edges + edges[:3], EDGES)
    s = spark.createDataFrame([(x,) for x in starts], "start string")
    want = {(a, b, h) for a in starts for b, h in bfs(edges, a).items()}
    got = G.closure(e, s).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    if len(edges) < 500:
        got = G.closure(e, s, max_hops=3).collect()
        assert sorted(map(tuple, got)) == sorted(w for w in want if w[2] <= 3)


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    cuts = []
    plain = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    chain = spark.createDataFrame([(f"n{i + 1:04}", f"n{i:04}") for i in range(1000)], EDGES)
    models = spark.createDataFrame([("n0000",)], "model string")
    types = spark.range(1001).select(F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("node"),
                                     F.lit("DATASET").alias("type"))
    got = {r.dataset: r.hop for r in G.upstream_datasets(models, chain, types).collect()}
    assert got == {f"n{i:04}": i for i in range(1, 1001)}
    assert len(cuts) < 20


def test_downstream_counts(spark):
    rnd = random.Random(2)
    edges = [(f"v{rnd.randrange(200):03}", f"v{rnd.randrange(200):03}") for _ in range(300)]
    edges += [("hub", f"v{i:03}") for i in range(200)] + [("v001", "hub"), ("v007", "v007")]
    names = sorted({x for e in edges for x in e} | {"alone"})
    nodes = spark.createDataFrame([(x, x != "v003") for x in names], "node string, known boolean")
    for hops in (1, 2, 3, 50):
        want = {x: -1 if x == "v003" else sum(h <= hops for h in bfs(edges, x).values()) for x in names}
        got = {r.node: r.downstream for r in G.downstream_counts(
            nodes, spark.createDataFrame(edges, EDGES), hops).collect()}
        assert got == want
    none = G.downstream_counts(nodes, spark.createDataFrame([], EDGES), 2)
    assert {r.downstream for r in none.where("known").collect()} == {0}


def placed(spark, changes, edges):
    rows = [(c, n, t, x) for c, nodes in changes.items() for n, (t, x) in nodes.items()]
    random.Random(1).shuffle(rows)
    n = spark.createDataFrame(rows, "change_id string, key string, tier int, name string")
    out = {}
    for r in G.with_step(G.plan_order(n, spark.createDataFrame(edges, EDGES))).orderBy("change_id", "step").collect():
        out.setdefault(r.change_id, []).append(r.key)
        assert r.step == len(out[r.change_id])
    return out


def test_plan_order_of_long_chains(spark, monkeypatch):
    cuts = []
    plain = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    rnd = random.Random(4)
    up = {f"a{i:04}": (0, f"{i:04}") for i in range(1000)}
    down = {f"b{i:04}": (0, f"{9999 - i:04}") for i in range(1000)}
    mixed = {f"m{i:04}": (rnd.randrange(2), f"{rnd.randrange(500):04}") for i in range(1000)}
    mixed |= {f"z{i}": (rnd.randrange(2), f"{rnd.randrange(500):04}") for i in range(50)}
    edges = [(f"{p}{i:04}", f"{p}{i + 1:04}") for p in "abm" for i in range(999)]
    changes = {"up": up, "down": down, "mixed": mixed, "some": {k: v for k, v in mixed.items() if rnd.random() < 0.9}}
    got = placed(spark, changes, edges)
    assert len(cuts) < 30
    assert got["up"] == sorted(up) and got["down"] == sorted(down)
    for c in ("mixed", "some"):
        assert got[c] == kahn(changes[c], set(edges))


def test_plan_order_of_ladders_and_cycles(spark):
    rnd = random.Random(9)
    ladder = {f"l{i}_{s}": (rnd.randrange(3), rnd.choice("abc") + str(rnd.randrange(99))) for i in range(12) for s in "xy"}
    edges = [(f"l{i}_{a}", f"l{i + 1}_{b}") for i in range(11) for a in "xy" for b in "xy"]
    loop = {f"o{i}": (rnd.randrange(3), f"o{rnd.randrange(99)}") for i in range(16)}
    edges += [("o0", "o1"), ("o1", "o2"), ("o2", "o0"), ("o2", "o3"), ("o3", "o4"), ("o5", "o4"), ("o5", "o6"),
              ("o6", "o7"), ("o8", "o8"), ("o9", "o10"), ("o10", "o9"), ("o7", "o9"), ("o11", "o12")]
    wide = {f"w{i}": (rnd.randrange(3), f"{rnd.randrange(40)}") for i in range(60)}
    edges += [(f"w{rnd.randrange(i)}", f"w{i}") for i in range(1, 60) for _ in range(rnd.randrange(4))]
    changes = {"ladder": ladder, "loop": loop, "wide": wide, "alone": {"w1": (0, "x")}}
    assert placed(spark, changes, edges) == {c: kahn(n, set(edges)) for c, n in changes.items()}
    assert placed(spark, {"c": {"a": (1, "b"), "b": (0, "z")}}, []) == {"c": ["b", "a"]}
    assert placed(spark, {"c": {"a": (1, "b"), "b": (0, "z")}}, [("a", "b"), ("b", "a")]) == {"c": ["b", "a"]}


def test_rounds_of_a_plan_do_not_carry_constraints_on(spark, monkeypatch):
    """A checkpoint keeps the constraints of its plan, so that each round took longer to plan."""
    n = 5
    nodes = [("c", f"{side}{i}", 0, f"{side}{i}") for i in range(n) for side in "ab"]
    edges = [(f"{up}{i}", f"{down}{i + 1}") for i in range(n - 1) for up in "ab" for down in "ab"]
    kept = []
    real = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: kept.append(df.columns) or real(df))
    order = G.with_step(G.plan_order(
        spark.createDataFrame(nodes, "change_id string, key string, tier int, name string"),
        spark.createDataFrame(edges, "up string, down string")))
    assert not [c for c in kept if "got" in c]
    assert [r.key for r in order.orderBy("step").collect()] == [f"{side}{i}" for i in range(n) for side in "ab"]


def test_plan_order_of_paths_that_part_and_meet_takes_few_rounds(spark, monkeypatch):
    appended = []
    real = G.Appended.append
    monkeypatch.setattr(G.Appended, "append", lambda self, rows: appended.append(1) or real(self, rows))
    rnd = random.Random(11)
    edges = []
    for i in range(60):  # d to the next d on two or three ways, one of which parts and meets in between
        edges += [(f"d{i}", f"x{i}"), (f"x{i}", f"d{i + 1}"), (f"d{i}", f"y{i}"), (f"y{i}", f"s{i}"),
                  (f"y{i}", f"t{i}"), (f"s{i}", f"v{i}"), (f"t{i}", f"v{i}"), (f"v{i}", f"d{i + 1}")]
        edges += [(f"d{i}", f"d{i + 1}")] * (i % 3 == 0) + [(f"x{i}", f"y{i}")] * (i % 5 == 0)
        edges += [(f"f{i}", f"g{i}"), (f"g{i}", f"d{i}")]  # and from outside
    nodes = sorted({n for e in edges for n in e})
    changes = {c: {n: (rnd.randrange(2), f"{rnd.randrange(300):03}") for n in nodes if rnd.random() < share}
               for c, share in (("whole", 1), ("parts", 0.95), ("stuck", 1))}
    changes["stuck"] |= {"o1": (0, "o1"), "o2": (0, "o2")}
    edges += [("o1", "o2"), ("o2", "o1"), ("o2", "v30")]
    assert placed(spark, changes, edges) == {c: kahn(n, set(edges)) for c, n in changes.items()}
    assert len(appended) < 8
