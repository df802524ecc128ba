"""Queries of poses, contracts, clips and further joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandway.functions import rotations as rot
from strandway.functions import vectors as vec
from strandway.functions.seeds import uniform, uniform_sql
from strandway.operators import contracts, joins
from strandway.operators import selection as sel
from strandway.operators import statistics as st
from strandway.operators import timebase as tb
from strandway.operators import windows as win
from strandway.plans.catalog import query
from strandway.plans.queries_core import FRAMES, KEYS, ORDER, frames, rounded, table


def angles(spark, sf_dir, at=1):
    return table(spark, sf_dir, "embeddings").withColumn("a", F.slice("embedding", at, 3).cast("array<double>"))


_E = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS p, CAST(embedding[5] AS DOUBLE) AS q, CAST(embedding[6] AS DOUBLE) AS r, CAST(embedding[10] AS DOUBLE) AS g FROM embeddings"


@query(
    "b1_pose_of_euler",
    f"""WITH e AS ({_E}), a AS (SELECT *, radians(p) AS i, radians(q) AS j, radians(r) AS k FROM e)
    SELECT vec_id, round(x * 2, 6) + 0.0 AS v0, round(cos(k) * cos(j), 6) + 0.0 AS v3, round(sin(k) * cos(j), 6) + 0.0 AS v4, round(-sin(j), 6) + 0.0 AS v5, round(cos(k) * sin(j) * sin(i) - sin(k) * cos(i), 6) + 0.0 AS v6, round(sin(k) * sin(j) * sin(i) + cos(k) * cos(i), 6) + 0.0 AS v7,
           round(cos(j) * sin(i), 6) + 0.0 AS v8, round(g, 6) + 0.0 AS v9 FROM a""",
)
def b1(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("v", rot.pose_of_euler(F.slice("embedding", 1, 6), F.element_at("embedding", 10), 2.0))
    return v.select("vec_id", *[(rounded(F.col("v")[i]) + 0.0).alias(f"v{i}") for i in (0, 3, 4, 5, 6, 7, 8, 9)])


@query("h16_rotation_round_trip", f"SELECT vec_id, round(x, 6) AS a, round(y, 6) AS b, round(z, 6) AS c FROM ({_E})")
def h16(spark, sf_dir):
    a = angles(spark, sf_dir).withColumn("m", rot.matrix_of_euler(F.col("a"))).withColumn("q", rot.quaternion_of_matrix(F.col("m"))).withColumn("m2", rot.matrix_of_quaternion(F.col("q")))
    return a.withColumn("e", rot.euler_of_matrix(F.col("m2"))).select("vec_id", *[rounded(F.col("e")[i]).alias(c) for i, c in enumerate("abc")])


@query("h12_aligned_plan", f"SELECT vec_id, round(x + 1, 6) AS x, round(y + 2, 6) AS y, round(z + 3, 6) AS z, round(cos(r) * cos(q), 6) AS m0, round(cos(q) * cos(p), 6) AS m8 FROM ({_E})")
def h12(spark, sf_dir):
    a = angles(spark, sf_dir, 4).withColumn("pose", F.concat(F.slice("embedding", 1, 3).cast("array<double>"), rot.matrix_of_euler(F.col("a"))))
    turn = rot.matrix_of_euler(F.array(*[F.lit(x) for x in (0.3, -0.2, 0.5)]))
    first, anchor = (F.concat(F.array(*[F.lit(float(x)) for x in place]), turn) for place in ((0, 0, 0), (1, 2, 3)))
    v = a.withColumn("v", rot.aligned(F.col("pose"), first, anchor))
    return v.select("vec_id", *[rounded(F.col("v")[i]).alias(c) for i, c in enumerate("xyz")], rounded(F.col("v")[3]).alias("m0"), rounded(F.col("v")[11]).alias("m8"))


@query("h13_projected_action", f"SELECT vec_id, round(x, 6) AS x, round(greatest(0, least(1, g)), 6) AS grip, CAST(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS length, vec_id % 3 = 0 AS fell_back FROM ({_E})")
def h13(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    bad = F.concat(F.slice("embedding", 1, 3), F.transform(F.slice("embedding", 4, 6), lambda x: x * 0), F.slice("embedding", 10, 1))
    current = F.array_repeat(F.lit(0.0), 10)
    p = e.withColumn("p", rot.projected(F.when(F.col("vec_id") % 3 == 0, bad).otherwise(F.slice("embedding", 1, 10)), current))
    return p.select("vec_id", rounded(F.col("p.pose")[0]).alias("x"), rounded(F.col("p.pose")[9]).alias("grip"), rounded(vec.norm(F.slice("p.pose", 4, 3))).alias("length"), "p.fell_back")


@query(
    "d6_relative_statistics",
    """WITH p AS (SELECT embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), d AS (SELECT unnest([1, 2]) AS i, e, b FROM p WHERE b IS NOT NULL), x AS (SELECT i, CAST(b[i] AS DOUBLE) - e[i] AS x FROM d UNION ALL SELECT i, 0.0 FROM d)
    SELECT CAST(i - 1 AS INT) AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 0.000001), 6) AS std FROM x GROUP BY i""",
)
def d6(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").withColumn("b", F.lag("embedding").over(win.W.partitionBy("label").orderBy("vec_id"))).where("b IS NOT NULL")
    two = lambda c: F.slice(c, 1, 2).cast("array<double>")
    rel = lambda a: F.zip_with(two(a), two("embedding"), lambda x, y: x - y)
    s = st.vector_summary(p.select(F.explode(F.array(rel("b"), rel("embedding"))).alias("v")), "v", 1e-6)
    return s.select("dim", "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("c18_task_text", "SELECT n_nationkey, coalesce(r_name, '') AS task FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def c18(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("task"))
    return joins.lookup(table(spark, sf_dir, "nation"), names, ["n_regionkey"], {"task": ""}).select("n_nationkey", "task")


@query("c20_shard_merge", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, 0 AS only_shards, 0 AS only_source FROM events")
def c20(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    shards = e.where("event_id % 3 = 0").unionByName(e.where("event_id % 3 = 1")).unionByName(e.where("event_id % 3 = 2"))
    d = sel.disagreement(shards, e, "event_id")
    counts = shards.agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"))
    return counts.join(d, F.lit(True)).select("rows", "ids", F.col("only_a").cast("int").alias("only_shards"), F.col("only_b").cast("int").alias("only_source"))  # one row each


@query("c21_checkpoints", "SELECT user_id, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, count(*) = 2 AS aligned FROM (SELECT user_id, event_id % 2 AS k, max(value) AS v FROM events WHERE value > 60 GROUP BY ALL) GROUP BY user_id")
def c21(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 60")
    each = {n: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("value").alias("v")) for n, k in (("a", 0), ("b", 1))}
    return joins.keyed_merge(each, "user_id", "v").select("user_id", "a", "b", (F.size("missing") == 0).alias("aligned"))


@query("c23_bound_parents", "SELECT o_orderkey, c_nationkey AS nation, c_custkey IS NOT NULL AS bound FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def c23(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"), F.lit(True).alias("bound"))
    return joins.lookup(table(spark, sf_dir, "orders"), parents, ["o_custkey"], {"bound": False}).join(parents.select("o_custkey", "nation"), "o_custkey", "left").select("o_orderkey", "nation", "bound")


@query("f7_head", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def f7(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "value")


@query("b2_modality_slices", "SELECT vec_id, round(CAST(list_sum(embedding[1:3]) AS DOUBLE), 4) AS place, round(CAST(list_sum(embedding[4:9]) AS DOUBLE), 4) AS turn, round(CAST(embedding[10] AS DOUBLE), 4) AS grip FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)")
def b2(spark, sf_dir):
    parts = vec.slices(F.col("embedding"), {"place": 3, "turn": 6, "grip": 1})
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[rounded(total(v), 4).alias(k) for k, v in parts.items()])


@query("b3_concatenated", "SELECT vec_id, 10 AS width, true AS same FROM embeddings")
def b3(spark, sf_dir):
    sizes = {"place": 3, "turn": 6, "grip": 1}
    e = table(spark, sf_dir, "embeddings").withColumn("v", vec.joined(*vec.slices(F.col("embedding"), sizes).values()))
    back = vec.slices(F.col("v"), sizes)
    return e.select("vec_id", F.size("v").alias("width"), (back["turn"] == F.slice("embedding", 4, 6)).alias("same"))


@query("h25_vector_dropout", f"SELECT vec_id, CASE WHEN {uniform_sql('CAST(vec_id AS VARCHAR)')} < 0.3 THEN 0 ELSE CAST(embedding[1] AS DOUBLE) END AS first FROM embeddings")
def h25(spark, sf_dir):
    v = vec.dropped_out(F.col("embedding").cast("array<double>"), uniform(F.col("vec_id").cast("string")), 0.3)
    return table(spark, sf_dir, "embeddings").select("vec_id", v[0].alias("first"))


@query("e24_busiest_window", f"WITH {FRAMES}, x AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS e FROM f) SELECT user_id, arg_max(pos, (e, -pos)) AS first, round(max(e), 6) AS total FROM x WHERE pos + 4 <= n GROUP BY user_id")
def e24(spark, sf_dir):
    x = win.busiest_window(frames(spark, sf_dir), KEYS, ORDER, "value", 4)
    return x.select("user_id", F.col("first").cast("long").alias("first"), rounded("total").alias("total"))


@query("e34_clip_chunks", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CAST(k AS INT) AS chunk, k * 6 AS first, least(n, k * 6 + 6) AS stop FROM c, range(500) r(k) WHERE k < n // 6 + CASE WHEN 2 * (n % 6) >= 6 THEN 1 ELSE 0 END")
def e34(spark, sf_dir):
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return win.clip_chunks(lengths, 6).select("user_id", "chunk", "first", "stop")


@query("e29_corrupted_windows", f"WITH {FRAMES} SELECT event_id, pos // 5 * 5 AS frozen, pos // 5 * 5 + least(n, pos // 5 * 5 + 5) - 1 - pos AS reversed, greatest(pos // 5 * 5, pos - 1) AS shifted FROM f")
def e29(spark, sf_dir):
    f = frames(spark, sf_dir)
    for kind in ("frozen", "reversed", "shifted"):
        f = win.corrupted(f, 5, kind).withColumnRenamed("source_pos", kind)
    return f.select("event_id", "frozen", "reversed", "shifted")


@query("b21_unequal_copies", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS status FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0")
def b21(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    digest = lambda d: d.withColumn("h", contracts.stable_hash(F.col("user_id"), F.col("event_type")))
    copy = e.where("event_id % 11 <> 0").withColumn("event_type", F.when(F.col("event_id") % 13 == 0, "other").otherwise(F.col("event_type")))
    return contracts.unequal_copies(digest(e), digest(copy), "event_id", "h")


@query("b22_required_values", "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS found FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O'")
def b22(spark, sf_dir):
    return contracts.required(table(spark, sf_dir, "orders"), "o_orderkey", {"o_orderstatus": "O"})


@query("b23_pool_independence", "SELECT n_regionkey, 'n_name' AS \"column\", count(*) AS rows, count(DISTINCT n_name) AS distinct_values FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 'n_nationkey', count(*), count(DISTINCT n_nationkey) FROM nation GROUP BY 1")
def b23(spark, sf_dir):
    return contracts.repeats(table(spark, sf_dir, "nation"), "n_regionkey", ["n_name", "n_nationkey"])


@query("b20_leaked_keys", "SELECT DISTINCT user_id FROM events WHERE value > 95 AND user_id % 5 = 0")
def b20(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return contracts.leaked(e.where("value > 95"), e, "user_id", F.col("user_id") % 5 == 0)


@query("d30_stable_hash", "SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS hash FROM nation")
def d30(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", contracts.stable_hash(F.col("n_nationkey"), F.col("n_name")).alias("hash"))


@query("c25_nearest_time", "SELECT a.event_id, arg_min(b.event_id, (abs(epoch_us(a.ts) - epoch_us(b.ts)), epoch_us(b.ts), b.event_id)) AS match FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1")
def c25(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", tb.micros(F.col("ts")).alias("t"))
    m = tb.nearest_match(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("other")), "user_id", "t", 1 << 62, "other")
    return m.where("match IS NOT NULL").select("event_id", "match")
