"""Retrieval, paired tests, rotations and mixing on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.functions import rotations as rot
from strandway.functions import vectors as vec
from strandway.operators import inference, mixing
from strandway.operators import retrieval as ret
from strandway.operators import selection as sel
from strandway.operators import timebase as tb
from strandway.plans.catalog import query
from strandway.plans.queries_core import FRAMES, KEYS, ORDER, frames, in_segments, rounded, table

# Queries are the purchases and pool rows the views of a user, each at its phase of the segment.
PHASES = f"""{FRAMES}, p AS (SELECT user_id, event_id, event_type, spos / greatest(1, sn - 1) AS phase FROM s),
    q AS (SELECT user_id, event_id, phase FROM p WHERE event_type = 'purchase'),
    v AS (SELECT user_id, event_id AS match, phase AS place FROM p WHERE event_type = 'view')"""
# Six of each view list, evenly spaced.
THIN = """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY match) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM v),
    h AS (SELECT user_id, match, place FROM r WHERE list_contains(list_transform(range(6), lambda k: CAST(round_even(k * (m - 1) / 5, 0) AS BIGINT)), i))"""


def queries_and_pool(spark, sf_dir):
    p = tb.phase(in_segments(spark, sf_dir)).select("user_id", "event_id", "event_type", "phase")
    q, v = (p.where(F.col("event_type") == k).drop("event_type") for k in ("purchase", "view"))
    return q, v.withColumnRenamed("event_id", "match")


@query(
    "c9_phase_neighbours",
    f"""WITH {PHASES}, x AS (SELECT event_id, match, abs(place - phase) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(place - phase), match) AS rank FROM q JOIN v USING (user_id))
    SELECT event_id, match, round(d, 9) AS distance, CAST(rank AS INT) AS rank FROM x WHERE rank <= 5""",
)
def c9(spark, sf_dir):
    q, v = queries_and_pool(spark, sf_dir)
    return _named(ret.nearest_scalars(q, v, "user_id", "event_id", "match", "phase", 5))


def _named(found):
    return found.select("event_id", "match", rounded("distance", 9).alias("distance"), "rank")


@query(
    "c10_thinned_pool_neighbours",
    f"""WITH {PHASES} {THIN}, x AS (SELECT event_id, match, abs(place - phase) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(place - phase), match) AS rank FROM q JOIN h USING (user_id))
    SELECT event_id, match, round(d, 9) AS distance, CAST(rank AS INT) AS rank FROM x WHERE rank <= 3""",
)
def c10(spark, sf_dir):
    q, v = queries_and_pool(spark, sf_dir)
    return _named(ret.nearest_scalars(q, ret.thinned(v, "user_id", ["match"], 6), "user_id", "event_id", "match", "phase", 3))


@query(
    "c12_hash_ranked_candidates",
    f"""WITH {PHASES} {THIN}, x AS (SELECT event_id, match, round(abs(place - phase), 1) AS d FROM q JOIN h USING (user_id)),
    y AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, sha256('20260711:' || event_id || ':' || match), match) AS rank FROM x)
    SELECT event_id, match, CAST(rank AS INT) AS rank, count(*) OVER (PARTITION BY event_id) AS effective_k FROM y WHERE rank <= 3""",
)
def c12(spark, sf_dir):
    q, v = queries_and_pool(spark, sf_dir)
    pool = ret.thinned(v, "user_id", ["match"], 6).withColumnRenamed("phase", "at")
    return ret.rank_thinned(q, pool, "user_id", "event_id", "match", F.round(F.abs(F.col("at") - F.col("phase")), 1), "20260711", 3).select("event_id", "match", "rank", "effective_k")


# c12_hash_ranked_candidates over the whole pool.
@query(
    "c12_hash_ranked_whole_pool",
    f"""WITH {PHASES}, x AS (SELECT event_id, match, round(abs(place - phase), 1) AS d FROM q JOIN v USING (user_id)),
    y AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, sha256('20260711:' || event_id || ':' || match), match) AS rank FROM x)
    SELECT event_id, match, CAST(rank AS INT) AS rank, count(*) OVER (PARTITION BY event_id) AS effective_k FROM y WHERE rank <= 3""",
)
def c12_whole(spark, sf_dir):
    q, v = queries_and_pool(spark, sf_dir)
    return ret.rank_scalars(q, v, "user_id", "event_id", "match", "phase", 1, "20260711", 3).select("event_id", "match", "rank", "effective_k")


@query(
    "c13_padded_neighbours",
    f"""WITH {PHASES}, w AS (SELECT * FROM v WHERE user_id % 3 = 0), x AS (SELECT event_id, match, row_number() OVER (PARTITION BY event_id ORDER BY abs(place - phase), match) AS rank FROM q JOIN w USING (user_id))
    SELECT event_id, CAST(k AS INT) AS rank, coalesce(match, -1) AS match, match IS NULL AS masked FROM (SELECT event_id, unnest(range(1, 4)) AS k FROM q) z LEFT JOIN x USING (event_id) WHERE rank = k OR rank IS NULL
    UNION ALL SELECT event_id, CAST(k AS INT), -1, true FROM (SELECT event_id, count(*) AS c FROM x GROUP BY event_id), (SELECT unnest(range(1, 4)) AS k) WHERE k > c""",
)
def c13(spark, sf_dir):
    q, v = queries_and_pool(spark, sf_dir)
    found = ret.nearest_scalars(q, v.where(F.col("user_id") % 3 == 0), "user_id", "event_id", "match", "phase", 3)
    return ret.padded(found, q, "event_id", "match", 3).select("event_id", "rank", F.coalesce("match", F.lit(-1)).alias("match"), "masked")


@query(
    "c15_angular_pools",
    """WITH a AS (SELECT p_partkey, p_retailprice AS angle FROM part), p AS (SELECT DISTINCT n_nationkey * 15 AS pool FROM nation),
    x AS (SELECT p_partkey, pool, least(abs(angle % 360 - pool % 360), 360 - abs(angle % 360 - pool % 360)) AS d FROM a, p),
    y AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(d, 6), pool) AS rank, min(d) OVER (PARTITION BY p_partkey) AS best FROM x)
    SELECT p_partkey, pool, round(d, 6) AS degrees, CAST(rank AS INT) AS rank FROM y WHERE rank <= 2 AND (rank = 1 OR best >= 0.5)""",
)
def c15(spark, sf_dir):
    pools = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 15).alias("pool"))
    found = ret.angular_pools(table(spark, sf_dir, "part"), pools, "p_partkey", "p_retailprice", "pool", 2)
    return found.select("p_partkey", "pool", rounded("degrees").alias("degrees"), "rank")


@query("c16_predecessors", f"WITH {FRAMES} SELECT f.user_id, f.pos, coalesce(b.event_id, -1) AS before FROM f LEFT JOIN f b ON b.user_id = f.user_id AND b.pos = f.pos - 8")
def c16(spark, sf_dir):
    f = frames(spark, sf_dir).select("user_id", F.col("pos").cast("long").alias("pos"), "event_id")
    return ret.predecessors(f, ["user_id"], "pos", 8, "event_id").select("user_id", "pos", F.coalesce("before", F.lit(-1)).alias("before"))


@query(
    "c17_diverse_or_any",
    """WITH u AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60),
    x AS (SELECT e.user_id, event_id, u.user_id IS NOT NULL AS fallback, value FROM events e LEFT JOIN u ON u.user_id = e.user_id AND u.event_type = e.event_type),
    y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fallback, value, event_id) AS k FROM x)
    SELECT user_id, event_id, fallback FROM y WHERE k = 1""",
)
def c17(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return ret.diverse_or_any(e, e.where("value > 60"), "user_id", "event_type", [F.col("value"), F.col("event_id")]).select("user_id", "event_id", "fallback")


# Twelve units: four tasks (nations by remainder) and three seeds.
UNITS = "SELECT n_nationkey % 4 AS task, n_nationkey // 4 AS seed, (n_nationkey * 7) % 11 - 6 AS d FROM nation WHERE n_nationkey < 12"


def units(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(n < 12).select((n % 4).alias("task"), F.floor(n / 4).alias("seed"), ((n * 7) % 11 - 6).alias("d"), (n.cast("long")).alias("unit"))


@query(
    "d23_hierarchical_bootstrap",
    f"""WITH u AS ({UNITS}), r AS (SELECT *, dense_rank() OVER (ORDER BY task) - 1 AS ti, row_number() OVER (PARTITION BY task ORDER BY seed) - 1 AS si FROM u),
    c AS (SELECT b, i, j FROM (SELECT unnest(range(1000)) AS b), (SELECT unnest(range(4)) AS i), (SELECT unnest(range(3)) AS j)),
    k AS (SELECT b, CAST('0x' || substr(sha256('20260711:' || b || ':' || i), 1, 7) AS BIGINT) % 4 AS ti, CAST('0x' || substr(sha256('20260711:' || b || ':' || i || ':' || j), 1, 7) AS BIGINT) % 3 AS si FROM c),
    m AS (SELECT b, median(d) AS m FROM k JOIN r USING (ti, si) GROUP BY b)
    SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""",
)
def d23(spark, sf_dir):
    out = inference.hierarchical_bootstrap(units(spark, sf_dir), "task", "seed", "d", 1000, "20260711")
    return out.select(rounded("low", 9).alias("low"), rounded("high", 9).alias("high"))


@query(
    "d24_sign_flip_test",
    f"""WITH u AS ({UNITS}), r AS (SELECT d, row_number() OVER (ORDER BY task, seed) - 1 AS i FROM u),
    m AS (SELECT bits, sum(CASE WHEN (bits >> i) & 1 = 1 THEN d ELSE -d END) AS s FROM (SELECT unnest(range(4096)) AS bits), r GROUP BY bits)
    SELECT avg(CASE WHEN s <= (SELECT sum(d) FROM u) THEN 1.0 ELSE 0.0 END) AS p FROM m""",
)
def d24(spark, sf_dir):
    return inference.sign_flip_p(units(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "unit", "d").select("p")


# The first six numbers of a vector as a rotation, next to those of numbers 7 to 12.
GRAM = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    z AS (SELECT vec_id, o, e[o + 1:o + 3] AS a, e[o + 4:o + 6] AS b FROM v, (SELECT unnest([0, 6]) AS o)),
    y AS (SELECT *, list_transform(a, lambda x: x / greatest(sqrt(list_dot_product(a, a)), 1e-12)) AS f FROM z),
    x AS (SELECT *, [b[1] - f[1] * list_dot_product(f, b), b[2] - f[2] * list_dot_product(f, b), b[3] - f[3] * list_dot_product(f, b)] AS g FROM y),
    w AS (SELECT *, list_transform(g, lambda t: t / greatest(sqrt(list_dot_product(g, g)), 1e-12)) AS s FROM x),
    t AS (SELECT vec_id, o, f, s, [f[2] * s[3] - f[3] * s[2], f[3] * s[1] - f[1] * s[3], f[1] * s[2] - f[2] * s[1]] AS c FROM w)"""


@query("h10_rotation_matrix", f"WITH {GRAM} SELECT vec_id, round(f[1], 6) AS m00, round(s[1], 6) AS m01, round(c[1], 6) AS m02, round(f[3], 6) AS m20, round(c[3], 6) AS m22 FROM t WHERE o = 0")
def h10(spark, sf_dir):
    m = rot.matrix_of_6d(F.slice("embedding", 1, 6))
    e = table(spark, sf_dir, "embeddings").select("vec_id", m.alias("m"))
    return e.select("vec_id", *[rounded(F.element_at("m", 3 * i + j + 1)).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (2, 0), (2, 2))])


@query(
    "h11_orientation_error",
    f"""WITH {GRAM}, j AS (SELECT p.vec_id, (list_dot_product(p.f, q.f) + list_dot_product(p.s, q.s) + list_dot_product(p.c, q.c) - 1) / 2 AS h FROM t p JOIN t q ON p.vec_id = q.vec_id AND p.o = 0 AND q.o = 6)
    SELECT vec_id, round(acos(greatest(-1.0, least(1.0, h))), 6) AS radians FROM j""",
)
def h11(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", rot.matrix_of_6d(F.slice("embedding", 1, 6)).alias("a"), rot.matrix_of_6d(F.slice("embedding", 7, 6)).alias("b"))
    return e.select("vec_id", rounded(rot.geodesic(F.col("a"), F.col("b"))).alias("radians"))


@query("h3_cosine_distance", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(1 - list_cosine_similarity(e[1:32], e[33:64]), 6) AS distance FROM v")
def h3(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", rounded(vec.cosine_distance(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("distance"))


@query(
    "j1_epoch_counts",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS d, count(*) FILTER (event_type = 'purchase') AS s, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id),
    a AS (SELECT *, CASE WHEN s = 0 THEN 0.0::DOUBLE WHEN f = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS p, CASE WHEN s = 0 OR f = 0 THEN s ELSE greatest(s, 3 * f) END AS s1, CASE WHEN s = 0 OR f = 0 OR s < 3 * f THEN f ELSE s // 3 END AS f1 FROM c)
    SELECT user_id, CASE WHEN s + f = 0 THEN d WHEN d = 0 THEN 0 ELSE greatest(d, s1 + f1) END AS demos,
           CASE WHEN s + f = 0 THEN 0 WHEN d = 0 OR d < s1 + f1 THEN s1 ELSE CAST(trunc(d * p) AS BIGINT) END AS wins,
           CASE WHEN s + f = 0 THEN 0 WHEN d = 0 OR d < s1 + f1 THEN f1 ELSE CAST(trunc(d * (1 - p)) AS BIGINT) END AS losses FROM a""",
)
def j1(spark, sf_dir):
    kinds = {"d": "view", "s": "purchase", "f": "error"}
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])
    return c.select("user_id", *[x.cast("long").alias(k) for k, x in mixing.epoch_counts(F.col("d"), F.col("s"), F.col("f"), 0.5, 0.75).items()])


@query("j2_sample_type", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 < 50 THEN 'demo' WHEN o_orderkey % 100 < 80 THEN 'success' ELSE 'failure' END AS kind FROM orders")
def j2(spark, sf_dir):
    kind = mixing.sample_type(F.col("o_orderkey") % 100, F.lit(50), F.lit(30))
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


@query("j6_ratio_interleave", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN 'a' WHEN o_orderkey % 6 < 5 THEN 'b' ELSE 'c' END AS source FROM orders")
def j6(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", mixing.ratio_source(F.col("o_orderkey"), {"a": 3, "b": 2, "c": 1}).alias("source"))


@query(
    "j8_shard_owner",
    """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
    SELECT p_partkey, CAST(i % 4 AS INT) AS rank, CAST(i // 4 % 3 AS INT) AS worker, i // 12 AS turn FROM r""",
)
def j8(spark, sf_dir):
    return mixing.shard_owner(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], 4, 3).select("p_partkey", F.col("rank").cast("int").alias("rank"), "worker", "turn")


@query(
    "j13_rank_range",
    """WITH c AS (SELECT user_id, count(*) AS n, unnest(range(7)) AS r FROM events GROUP BY user_id), a AS (SELECT *, r * (n // 7) + least(r, n % 7) AS f FROM c)
    SELECT user_id, CAST(r AS INT) AS rank, CASE WHEN f >= n THEN 0 ELSE f END AS first, CASE WHEN f >= n THEN 1 ELSE f + n // 7 + CAST(r < n % 7 AS INT) END AS "end", f >= n AS overflow FROM a""",
)
def j13(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return c.select("user_id", "rank", *[x.alias(k) for k, x in mixing.rank_range(F.col("n"), 7, F.col("rank")).items()])


@query("j15_replayed", "SELECT n_nationkey, CAST(unnest(range(n_regionkey)) AS INT) AS copy FROM nation WHERE n_regionkey > 0")
def j15(spark, sf_dir):
    return mixing.replayed(table(spark, sf_dir, "nation"), F.col("n_regionkey")).select("n_nationkey", "copy")


@query(
    "l4_bounded_history",
    f"WITH {FRAMES} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS 7 PRECEDING), 6) AS mean FROM f",
)
def l4(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", rounded(F.avg("value").over(W.partitionBy(*KEYS).orderBy(*ORDER).rowsBetween(-7, 0))).alias("mean"))


@query(
    "h6_combined_feature",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, e[1:32] AS a, e[33:64] AS b FROM v)
    SELECT vec_id, round(a[1] / sqrt(list_dot_product(a, a)) / sqrt(2), 6) AS first, round(b[32] / sqrt(list_dot_product(b, b)) / sqrt(2), 6) AS last FROM p""",
)
def h6(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vec.combined(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("c"))
    return e.select("vec_id", rounded(F.element_at("c", 1)).alias("first"), rounded(F.element_at("c", -1)).alias("last"))


@query(
    "j18_seeded_control_group",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('7:' || o_orderkey), o_orderkey) AS k FROM orders)
    SELECT o_custkey, o_orderkey, CAST(k AS INT) AS rank FROM r WHERE k <= 3""",
)
def j18(spark, sf_dir):
    return sel.seeded_sample(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "7", 3).select("o_custkey", "o_orderkey", "rank")
