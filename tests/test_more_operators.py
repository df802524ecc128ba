"""Operators that have no query of their own, on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from strandway.functions import rotations as rot
from strandway.functions import text as txt
from strandway.operators import contracts, graphs, joins, mixing
from strandway.operators import selection as sel
from strandway.operators import windows as win
from strandway.sources.stages import kept


def test_fuzzy_block_words(spark):
    texts = spark.createDataFrame([("this is BADW0RD here",), ("a.b (c",), (None,), ("two bad  werds",)], "t string")
    at = lambda words, letters: [r[0] for r in texts.select(txt.nearly_blocked(F.col("t"), words, letters)).collect()]
    assert at(["badword"], 1.0) == [True, False, None, False] and at(["badword"], 0.5) == [False, False, None, False]
    assert at(["bad words"], 1.0) == [False, False, None, True] and at(["short"], 9.0) == [False, False, None, False]
    assert [r[0] for r in texts.select(txt.blocked(F.col("t"), ["a.b (c", "a?b"])).collect()][:2] == [False, True]


def test_workers_of_aspect_ratios():
    counts = {"16,9": 123456, "4,3": 234567, "1,1": 10000, "3,4": 500000, "9,16": 500000}
    got = mixing.proportional_workers(counts, 7)
    assert sum(got.values()) == 7 and min(got.values()) >= 1 and got["1,1"] == 1
    assert mixing.proportional_workers(dict.fromkeys("abcde", 100), 16) == {"a": 4, "b": 3, "c": 3, "d": 3, "e": 3}
    with pytest.raises(ValueError):
        mixing.proportional_workers(counts, 4)
    items, each = mixing.equal_shares({"a": 10, "b": 3}, 4)
    assert sum(items.values()) == 4 * each and items["b"] == each


def test_cycles_are_refused(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ValueError):
        graphs.levels(nodes, spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long"), kept)
    assert graphs.closure(spark.createDataFrame([], "parent long, child long"), kept).isEmpty()


def test_resampling_keeps_the_rate(spark):
    assert [r.pos for r in win.resampled(spark.createDataFrame([(31,)], "n long"), 30, 10).orderBy("pos").collect()] == list(range(0, 31, 3))
    with pytest.raises(ValueError):
        win.resampled(spark.createDataFrame([(31,)], "n long"), 10, 30)


def test_pose_of_the_fixture(spark):
    row = spark.range(1).select(rot.pose_of_euler(F.array(*[F.lit(x) for x in (100.0, 200.0, 300.0, 0.0, 0.0, 0.0)]), F.lit(1), 0.001).alias("v")).first()
    assert [round(x, 9) for x in row.v] == [0.1, 0.2, 0.3, 1, 0, 0, 0, 1, 0, 1]


def test_quaternions_and_angles_come_back(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 3.1],), ([3.0, 0.1, -3.0],), ([0.0, 3.0, 0.0],), ([0.2, -0.4, 1.0],)], "a array<double>")
    m = rows.withColumn("m", rot.matrix_of_euler(F.col("a"))).withColumn("back", rot.matrix_of_quaternion(rot.quaternion_of_matrix(F.col("m"))))
    again = m.withColumn("e", rot.matrix_of_euler(rot.euler_of_matrix(F.col("m"))))
    for r in again.collect():
        assert max(abs(x - y) for x, y in zip(r.m, r.back, strict=True)) < 1e-9 and max(abs(x - y) for x, y in zip(r.m, r.e, strict=True)) < 1e-9


def test_thinning_of_small_groups(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (2, 2), *[(3, k) for k in range(50)]], "g long, k long")
    got = {}
    for r in sel.thinned(rows, ["g"], ["k"], 5).collect():
        got.setdefault(r.g, []).append(r.k)
    assert {g: sorted(ks) for g, ks in got.items()} == {1: [1], 2: [1, 2], 3: [0, 12, 24, 36, 49]}


def test_no_round_of_a_graph_is_broadcast(spark):
    plans = []

    def stage(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    edges = spark.createDataFrame([(i, j) for i in range(12) for j in (i + 1, i + 3) if j < 12] + [(11, 9)], "parent long, child long")
    got = graphs.closure(edges, stage)
    assert sorted(tuple(r) for r in got.collect()) == sorted({(i, j) for i in range(12) for j in range(i + 1, 12)} | {(i, j) for i in (9, 10, 11) for j in (9, 10, 11)})
    ids = spark.range(12).select("id", F.lit("h").alias("sha256"))
    parents = edges.select(F.col("child").alias("id"), "parent", F.when(F.col("parent") == 4, "x").otherwise("h").alias("sha256"))
    fate = contracts.frozen(ids, parents, stage)
    plans.append(fate._jdf.queryExecution().executedPlan().toString())
    assert {r.id: r.steps for r in fate.collect()} == {**dict.fromkeys(range(5)), 5: 0, 6: 1, 7: 0, 8: 1, 9: 2, 10: 1, 11: 2}
    assert not [p for p in plans if "Broadcast" in p]


def test_totals_of_safe_pairs_are_those_of_the_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        first = rng.randrange(30)
        rows.append((rng.choice([1, 2, None]), rng.choice("abc"), i % 140, first, first + rng.randrange(3), first + 3 + rng.randrange(4)))
    w = spark.createDataFrame(rows, "task int, path string, id long, first int, future_first int, future_last int")
    want = joins.leakage_safe(w, w, "task", "path").groupBy("task", "query").agg(F.count("*").alias("candidates"), F.sum("candidate").alias("ids"))
    assert sorted(tuple(r) for r in joins.leakage_safe_totals(w, w, "task", "path").collect()) == sorted(tuple(r) for r in want.collect())
    alone = w.limit(0).unionByName(spark.createDataFrame([(1, "a", 5, 0, 2, 4)], w.schema))
    assert joins.leakage_safe_totals(alone, alone, "task", "path").isEmpty()
