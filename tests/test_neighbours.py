"""Grid neighbours, mixed captions and padded tokens against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandway.functions import text as txt
from strandway.operators import neighbours


def plain(queries, pool, k, own):
    out = []
    for key, q, v in queries:
        if key is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), p) for kk, p, w in pool if kk == key and w is not None and None not in w and not (own and p == q)]
        out += [(key, q, p, f"{d:.9g}", n + 1) for n, (d, p) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def clouds(kind, n, dims, seed):
    rng = random.Random(seed)
    point = {
        "even": lambda: [rng.random() for _ in range(dims)],
        "clumps": lambda: [rng.choice([0.0, 10.0, 500.0]) + rng.gauss(0, 1) for _ in range(dims)],
        "grid": lambda: [float(rng.randrange(4)) for _ in range(dims)],
        "line": lambda: [rng.random(), *[3.0] * (dims - 1)],
        "one": lambda: [1.0] * dims,
        "tails": lambda: [rng.choice([1, -1]) * 10 ** rng.uniform(-6, 6) for _ in range(dims)],
    }[kind]
    return [(rng.choice("ab") if kind != "even" else "a", i, point()) for i in range(n)]


@pytest.mark.parametrize(("kind", "dims", "axes", "own"), [*[(kind, 2, 2, True) for kind in ("even", "clumps", "grid", "line", "one", "tails")], ("clumps", 5, 2, False), ("tails", 5, 2, False), ("even", 1, 2, False), ("clumps", 3, 1, True), ("grid", 3, 3, False)])
def test_nearest_by_brute_force(spark, kind, dims, axes, own):
    pool = clouds(kind, 160, dims, 3)
    queries = pool[:90] if own else [*clouds(kind, 60, dims, 4), ("a", 500, [9e6] * dims), ("a", 501, [-1e3] * dims), ("no", 502, [0.0] * dims)]
    odd = [("a", 900, None), ("a", 901, [float("nan")] * dims), (None, 902, [0.0] * dims), ("a", 903, [None] * dims)]
    schema = "key string, {} long, v array<double>"
    q, p = spark.createDataFrame(queries + odd, schema.format("q")), spark.createDataFrame([r for r in pool if r[2] is not None] + odd[:1] + odd[3:], schema.format("p"))
    got = neighbours.nearest(q, p, "key", "q", "p", "v", 4, axes, own)
    assert sorted((r.key, r.q, r.p, f"{r.distance:.9g}", r["rank"]) for r in got.collect()) == plain(queries, pool, 4, own)


def test_no_key_meets_itself_in_full(spark):
    rows = spark.createDataFrame(clouds("even", 2000, 3, 1), "key string, q long, v array<double>")
    got = neighbours.nearest(rows, rows.withColumnRenamed("q", "p"), "key", "q", "p", "v", 3, own=True)
    seen = got.groupBy("q").agg(F.max("compared").alias("c")).agg(F.sum("c").alias("pairs"), F.count("*").alias("queries")).first()
    assert seen.queries == 2000 and seen.pairs < 0.3 * 2000 * 2000


def test_equal_vectors_stay_few(spark):
    rows = spark.createDataFrame([("a", i, [float(i % 2), 0.0]) for i in range(3000)], "key string, q long, v array<double>")
    got = neighbours.nearest(rows, rows.withColumnRenamed("q", "p"), "key", "q", "p", "v", 2, own=True)
    assert got.agg(F.max("compared")).first()[0] <= 6 and got.where("q = 2999").orderBy("rank").select("p").collect() == [(1,), (3,)]
    assert neighbours.nearest(rows.limit(0), rows.withColumnRenamed("q", "p"), "key", "q", "p", "v", 2).isEmpty()
    assert neighbours.nearest(rows, rows.limit(0).withColumnRenamed("q", "p"), "key", "q", "p", "v", 2).isEmpty()


def test_rounded_distances_tie(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, [rng.choice([0.0, 7.0]) + rng.randrange(9) / 10 + rng.choice([0, 1e-12, -1e-12])]) for i in range(200)]
    q = spark.createDataFrame(rows, "key string, q long, v array<double>")
    got = neighbours.nearest(q, q.withColumnRenamed("q", "p"), "key", "q", "p", "v", 3, axes=1, own=True, digits=9)
    half = lambda x: math.floor(x * 1e9 + 0.5) / 1e9
    want = [(i, n + 1, p) for k, i, x in rows for n, (_, p) in enumerate(sorted((half(abs(y[0] - x[0])), j) for m, j, y in rows if m == k and j != i)[:3])]
    assert sorted((r.q, r["rank"], r.p) for r in got.collect()) == sorted(want)


def test_copies_of_a_query_are_searched_for_once(spark):
    rows = spark.createDataFrame([("a", i, [float(i % 7), float(i % 5)]) for i in range(700)], "key string, q long, v array<double>")
    heard = []
    neighbours.top_k, whole = lambda df, *rest: (heard.append(df.groupBy().count().first()[0]) if "_bound" not in df.columns and "distance" in df.columns else None, whole(df, *rest))[1], neighbours.top_k
    try:
        got = neighbours.nearest(rows, rows.withColumnRenamed("q", "p"), "key", "q", "p", "v", 3, own=True)
        assert got.count() == 2100
    finally:
        neighbours.top_k = whole
    assert max(heard[:-1]) <= 35 * 35 * 4  # all pairs of distinct vectors with their least four ids


def test_captions_and_tokens(spark):
    rows = [(["a", "b"], "m", False, 0.1, 0.6), (["a", "b"], "m", True, 0.1, 0.6), (["a", "b"], "m", None, 0.1, 0.0), (["a"], None, False, 0.1, 0.99), ([], "m", False, 0.9, 0.5), (["a", "b"], "m", False, 0.4, 0.999)]
    df = spark.createDataFrame(rows, "t array<string>, m string, i boolean, u double, v double")
    got = [(r.c.source, r.c.place, r.c.text) for r in df.select(txt.mixed_caption(F.col("t"), F.col("m"), F.col("i"), 0.4, F.col("u"), F.col("v")).alias("c")).collect()]
    assert got == [("machine", None, "m"), ("truth", 1, "b"), ("truth", 0, "a"), ("truth", 0, "a"), ("truth", None, None), ("truth", 1, "b")]
    tokens = spark.createDataFrame([([[1.0, 2.0]],), ([[1.0, 2.0]] * 3,), ([],), (None,)], "t array<array<double>>")
    got = [(r.p.rows, r.p.mask) for r in tokens.select(txt.padded_tokens(F.col("t"), 2, 2).alias("p")).collect()]
    assert got == [([[1, 2], [0, 0]], [1, 0]), ([[1, 2], [1, 2]], [1, 1]), ([[0, 0], [0, 0]], [0, 0]), ([[0, 0], [0, 0]], [0, 0])]
    assert tokens.select(txt.padded_tokens(F.col("t"), 2, 2, True)["mask"].alias("m")).distinct().collect() == [([1, 1],)]
