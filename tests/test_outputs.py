"""Sinks and their read-back, stored baselines, and ordered outputs."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from faultline.operators import drift as D, order as O
from faultline.sources import sinks as SK


def test_overwrite_replaces_the_partitions_it_brings(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, n int, s string")
    SK.write_table(rows, path, partition_by="k", sort_by=["n"])
    SK.write_table(spark.createDataFrame([("a", 9, "new")], rows.schema), path, partition_by="k", sort_by=["n"])
    back = spark.read.parquet(path)
    assert sorted((r.k, r.n) for r in back.collect()) == [("a", 9), ("b", 3)]
    plan = back.where("k = 'b'")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*k#\d+ = b", plan)
    SK.write_table(rows, path)  # without partitions everything is replaced
    assert spark.read.parquet(path).count() == 3


def test_rows_of_a_file_are_sorted(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 500).alias("n"))
    SK.write_table(rows, path, partition_by="k", sort_by=["n"])
    for f in (tmp_path / "t").glob("k=*/*.parquet"):
        n = [r.n for r in spark.read.parquet(str(f)).collect()]
        assert n == sorted(n)


@pytest.fixture
def snapshot(spark, tmp_path):
    name = f"snap_{uuid.uuid4().hex}"
    snap = SK.Snapshot(spark, name, str(tmp_path / "snap"), 4)
    yield snap
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_snapshot_is_not_shuffled_again(spark, snapshot):
    values = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("feature"),
                                      (F.col("id") % 97).cast("double").alias("v"))
    odd = spark.createDataFrame([("a", None), ("a", float("nan")), ("gone", 1.0)], values.schema)
    snapshot.write(values.unionByName(odd))
    assert {r.feature for r in snapshot.counts().collect()} == {"a", "b", "gone"}
    now = values.withColumn("v", F.col("v") + 5).unionByName(
        spark.createDataFrame([("new", 1.0)], values.schema))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D._meet_snapshot(snapshot.counts(), now)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    baseline = plan[plan.index("SortMergeJoin"):plan.index("FileScan")]
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and "hashpartitioning" not in baseline
    got = {r.feature: r for r in D.against_snapshot(snapshot.counts(), now).collect()}
    # the same as comparing the values themselves
    both = values.withColumn("side", F.lit("baseline")).unionByName(
        now.where("feature <> 'new'").withColumn("side", F.lit("current")))
    want = {r.feature: r for r in D.distribution_drift(both).collect()}
    assert set(got) == {"a", "b"}
    for f, r in want.items():
        assert got[f].psi == pytest.approx(r.psi) and got[f].ks == pytest.approx(r.ks)
        assert (got[f].n_baseline, got[f].n_current, got[f].verdict) == (r.n_baseline, r.n_current, r.verdict)


def test_another_session_opens_a_snapshot(spark, snapshot):
    snapshot.write(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0)], "feature string, v double"))
    other = SK.Snapshot(spark, snapshot.name + "_again", snapshot.path, 4).open()
    assert sorted((r.feature, r.v, r.nb) for r in other.counts().collect()) == [("a", 1.0, 2), ("a", 2.0, 1)]
    spark.sql(f"DROP TABLE {other.name}")


def test_orders(spark):
    psi = spark.createDataFrame([("s", "b", 0.2), ("s", "a", 0.2), ("s", "c", None), ("s", "d", 0.9), ("t", "a", None)],
                                "seg string, feature string, psi double")
    got = {(r.seg, r.feature): r.position for r in O.by_psi(psi, ["seg"]).collect()}
    assert got == {("s", "d"): 1, ("s", "a"): 2, ("s", "b"): 3, ("s", "c"): 4, ("t", "a"): 1}
    moves = spark.createDataFrame([("c", "q1", "zed", False), ("c", "q2", "amy", False), ("c", "q3", "tom", True)],
                                  "change_id string, query_id string, consumer string, regressed boolean")
    assert [r.consumer for r in O.transitions(moves).orderBy("position").collect()] == ["tom", "amy", "zed"]
    health = spark.createDataFrame([(3, "u1", "HEALTHY"), (2, "u2", "CRITICAL"), (1, "u9", "CRITICAL"), (0, "u0", "FORGOTTEN")],
                                   "pos int, urn string, status string")
    assert [r.urn for r in O.leaderboard(health).orderBy("position").collect()] == ["u9", "u2", "u0", "u1"]
    ledger = spark.createDataFrame([("error", "a", 1), ("verified_safe", "a", 2), ("landmine", "b", 1), ("landmine", "a", 5)],
                                   "bucket string, catalog string, place int")
    assert [(r.bucket, r.catalog) for r in O.ledger(ledger).orderBy("position").collect()] == [
        ("landmine", "a"), ("landmine", "b"), ("verified_safe", "a"), ("error", "a")]


def test_first_occurrences_keep_their_order(spark):
    rows = [("k", v, i) for i, v in enumerate("banana split")] + [("l", None, 5), ("l", "z", 2), ("l", None, 1)]
    df = spark.createDataFrame(rows, "k string, v string, i int").repartition(5)
    got = O.first_occurrences(df, ["k"], "v", "i").orderBy("k", "position").collect()
    assert [r.v for r in got if r.k == "k"] == list(dict.fromkeys("banana split"))
    assert [(r.v, r.first, r.times) for r in got if r.k == "l"] == [(None, 1, 2), ("z", 2, 1)]
    assert O.first_occurrences(df.where("false"), ["k"], "v", "i").isEmpty()
