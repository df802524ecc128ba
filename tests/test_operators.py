import hashlib
import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandway.functions import rotations, text
from strandway.operators import inference, mixing, retrieval, selection, statistics, timebase
from strandway.plans import catalog


def test_gaps_open_segments_on_leaps_and_rollbacks(spark):
    steps = [(0, 0, 100), (1, 1, 100), (2, 8, 101), (3, 9, 101), (4, 4, 99), (5, 5, 99)]
    df = spark.createDataFrame([("a", *s) for s in steps], "k string, row int, step int, ts int")
    got = timebase.gap_segments(df, ["k"], ["row"], {"step": 4, "ts": 5}).orderBy("row").collect()
    assert [r.gap_mask for r in got] == [False, False, True, False, True, False]
    assert [r.segment_id for r in got] == [0, 0, 1, 1, 2, 2]


def test_strided_view_starts_anew_in_each_segment(spark):
    df = spark.createDataFrame([("a", i, 0 if i < 5 else 1) for i in range(12)], "k string, row int, segment_id int")
    got = timebase.strided_view(timebase.positions(df, ["k", "segment_id"], ["row"]), 3)
    assert sorted(r.row for r in got.collect()) == [0, 3, 5, 8, 11]


def test_runs_need_five_in_a_row(spark):
    df = spark.createDataFrame([("a", i, i % 6 != 0) for i in range(12)] + [("b", i, i % 2 == 0) for i in range(12)], "k string, row int, f boolean")
    got = {r.k: (r.longest, r.detected) for r in timebase.long_runs(df, ["k"], ["row"], F.col("f"), 5).collect()}
    assert got == {"a": (5, True), "b": (1, False)}


def test_empty_frames_give_no_rows(spark):
    df = spark.createDataFrame([], "k string, row int, t long, v double")
    framed = timebase.gap_segments(timebase.positions(df, ["k"], ["row"]), ["k"], ["row"], {"t": 1})
    assert framed.isEmpty() and timebase.lag_pairs(framed, ["k"], ["row"], "v", 2).isEmpty()


def test_constant_dimensions_by_mode(spark):
    df = spark.createDataFrame([(3.0, 3.0, 3.0)], "x double, lo double, hi double")
    got = df.select(*[statistics.scaled(F.col("x"), F.col("lo"), F.col("hi"), m).alias(m) for m in ("plain", "clipped", "constant_zero", "equal_zero")]).first()
    assert got.plain is None and got.clipped == -1.0 and got.constant_zero == 0.0 and got.equal_zero == 0.0


def test_diverse_top_takes_one_of_each_family(spark):
    df = spark.createDataFrame([("q", "a", 9), ("q", "a", 8), ("q", "b", 7), ("q", "c", 1)], "q string, f string, s int")
    got = selection.diverse_top(df, ["q"], "f", [F.desc("s")], 2).orderBy("rank").collect()
    assert [(r.f, r.s) for r in got] == [("a", 9), ("b", 7)]


def test_nearest_scalars_match_brute_force(spark):
    rng = random.Random(2)
    at = lambda n: [(i, rng.choice("abc"), rng.choice([0.0, 0.1, 0.2, 0.5, 0.5, 1.0, rng.random()])) for i in range(n)]
    q, p = at(40), [x for x in at(90) if x[1] != "c"]
    frame = lambda rows, name: spark.createDataFrame([*rows, (999, "a", None), (998, None, 0.5)], f"{name} int, k string, x double")
    got = sorted((r.q, r["rank"], r.p) for r in retrieval.nearest_scalars(frame(q, "q"), frame(p, "p"), "k", "q", "p", "x", 4).collect())
    want = [(i, n + 1, c) for i, k, x in q for n, (_, c) in enumerate(sorted((abs(y - x), j) for j, l, y in p if l == k)[:4])]
    assert got == sorted(want)


def test_every_candidate_is_ranked(spark):
    rng = random.Random(7)
    q = [(i, rng.choice("ab"), rng.random()) for i in range(20)]
    p = [(i, rng.choice("abc"), rng.random()) for i in range(120)]
    tie = lambda i, j: hashlib.sha256(f"s:{i}:{j}".encode()).hexdigest()
    want = []
    for i, k, x in q:
        best = sorted((round(abs(y - x), 1), tie(i, j), j) for j, l, y in p if l == k)[:3]
        want += [(i, n + 1, j, 3) for n, (_, _, j) in enumerate(best)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, k string, x double")
    got = retrieval.rank_scalars(frame(q, "q"), frame(p, "p"), "k", "q", "p", "x", 1, "s", 3).collect()
    assert sorted((r.q, r["rank"], r.p, r.effective_k) for r in got) == sorted(want)


def test_own_angle_stands_alone(spark):
    pools = spark.createDataFrame([(0,), (30,), (-30,), (180,)], "pool int")
    q = spark.createDataFrame([(1, 0.2), (2, 350.0), (3, 100.0)], "q int, a double")
    got = sorted((r.q, r["rank"], r.pool) for r in retrieval.angular_pools(q, pools, "q", "a", "pool", 2).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (2, 2, -30), (3, 1, 30), (3, 2, 180)]


def test_sign_flips_are_enumerated(spark):
    rows = [(i, float(d)) for i, d in enumerate([-3, 1, -2, 0, 5])]
    got = inference.sign_flip_p(spark.createDataFrame([("f", *r) for r in rows], "f string, u int, d double"), ["f"], "u", "d").first().p
    seen = sum(d for _, d in rows)
    assert got == sum(sum(s * d for s, (_, d) in zip(signs, rows, strict=True)) <= seen for signs in itertools.product((1, -1), repeat=5)) / 32


def test_aligned_plans_start_at_the_anchor(spark):
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, *turn], [9.0, 8.0, 7.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "first array<double>, anchor array<double>")
    got = df.select(rotations.aligned(F.col("first"), F.col("first"), F.col("anchor")).alias("x"), rotations.geodesic(F.slice("first", 4, 9), F.slice("anchor", 4, 9)).alias("r")).first()
    assert got.x == df.first().anchor and abs(got.r - math.pi / 2) < 1e-12


def test_quaternions_and_six_numbers_make_the_same_matrix(spark):
    df = spark.createDataFrame([([0.0, 0.0, 3.0, 3.0],)], "q array<double>").withColumn("m", rotations.matrix_of_quaternion(F.col("q")))
    got = df.select("m", rotations.matrix_of_6d(rotations.six_of_matrix(F.col("m"))).alias("n")).first()
    assert all(abs(a - b) < 1e-12 for a, b in zip(got.m, got.n, strict=True)) and abs(got.m[3] - 1) < 1e-12


def test_rank_without_rows_overflows(spark):
    got = spark.range(3).select(*[x.alias(k) for k, x in mixing.rank_range(F.lit(2), 3, F.col("id")).items()]).collect()
    assert [tuple(r) for r in got] == [(0, 1, False), (1, 2, False), (0, 1, True)]


def test_correlation_of_what_does_not_vary_is_null(spark):
    rows = [("flat", 0.1, 0.1)] * 3 + [("half", 0.1, float(i)) for i in range(3)] + [("line", float(i), 2.0 * i) for i in range(3)] + [("one", 1.0, 2.0), ("none", None, 1.0)]
    got = spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(statistics.correlation(F.col("x"), F.col("y")).alias("r")).collect()
    assert {r.k: r.r and round(r.r, 12) for r in got} == {"flat": None, "half": None, "line": 1.0, "one": None, "none": None}


@pytest.mark.parametrize("name", ["c8_lag_sweep", "d13_best_lag", "d11_motion_correlation"])
def test_users_of_one_value_equal_the_twin(spark, tmp_path, name):
    at = "TIMESTAMP '2024-01-01' + to_minutes(i)"
    rows = f"SELECT i AS event_id, {at} AS ts, i // 10 AS user_id, 'view' AS event_type, CASE WHEN i < 10 THEN 7.1 ELSE i % 7 * i END::DOUBLE AS value FROM range(20) r(i)"
    duckdb.execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect()) == sorted(want.fetchall())


def test_letters_beyond_ascii_end_a_word(spark):
    words = [("and\u00e9", True), ("\u00c9the x", True), ("sand", False), ("the_", False), ("an d", False), ("un DES\u00df", True)]
    got = spark.createDataFrame(words, "t string, want boolean").select("t", "want", text.blocked(F.col("t"), ["the", "and", "des"]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_distances_round_as_their_products_do(spark):
    q = spark.createDataFrame([(1, "a", 0.15)], "q int, k string, x double")
    p = spark.createDataFrame([(5, "a", 0.6), (6, "a", 0.66)], "p int, k string, x double")  # 0.44999999999999996 and 0.51
    tie = {j: hashlib.sha256(f"s:1:{j}".encode()).hexdigest() for j in (5, 6)}
    got = retrieval.rank_scalars(q, p, "k", "q", "p", "x", 1, "s", 2).collect()
    assert {r.p: (r.distance, r["rank"]) for r in got} == {j: (0.5, 1 + (tie[j] == max(tie.values()))) for j in (5, 6)}
